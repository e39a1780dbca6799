import gzip
import json
from datetime import datetime

import pytest

from sensorloom.schemas import FAILURE_SEED, NORMAL_SEED, TELEMETRY
from sensorloom.sources import derived, export, traces, versioned

SCHEMA = "id string, n bigint, x double"

LINES = ["id,n,x", '"A",1,1.5', "B,zz,2", "C,3", "D,4,,9", "E,5,", ",6,1", "\\N,7,1"]


@pytest.fixture(params=["plain", "gzip"])
def trace_file(request, tmp_path):
    text = "\n".join(LINES) + "\n"
    if request.param == "gzip":
        path = tmp_path / "trace.csv.gz"
        path.write_bytes(gzip.compress(text.encode()))
    else:
        path = tmp_path / "trace.csv"
        path.write_text(text)
    return str(path)


@pytest.fixture(scope="module")
def schema(spark):
    return spark.createDataFrame([], SCHEMA).schema


def test_good_lines_are_kept(spark, trace_file, schema):
    got = traces.load_trace_csv(spark, trace_file, schema)
    expected = [("A", 1, 1.5), ("E", 5, None), (None, 7, 1.0), ("", 6, 1.0)]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 4
    assert {r[1]: r[2] for r in rows} == {r[1]: r[2] for r in expected}
    assert {r[1] for r in rows if not r[0]} == {6, 7}


def test_counting_and_projecting_check_whole_lines(spark, trace_file, schema):
    got = traces.load_trace_csv(spark, trace_file, schema)
    assert got.count() == 4
    assert got.select("id").count() == 4
    assert sorted(r.n for r in got.select("n").collect()) == [1, 5, 6, 7]


def test_rejects(spark, trace_file, schema):
    got = traces.load_rejects(spark, trace_file, schema)
    assert sorted(r.line for r in got.collect()) == ["B,zz,2", "C,3", "D,4,,9"]
    assert got.count() == 3


def test_trace_round_trip(spark, tmp_path):
    normal = derived.normal_seed(spark, "/root/testdata/sf0.001")
    path = str(tmp_path / "normal")
    normal.write.option("header", True).option("compression", "gzip").csv(path)
    back = traces.load_trace_csv(spark, path, NORMAL_SEED)
    assert back.count() == 6000
    assert back.exceptAll(normal.select(*back.columns)).count() == 0
    audit = {r.table_name: r.row_count for r in traces.load_audit({"NORMAL": back}).collect()}
    assert audit == {"NORMAL": 6000}


def test_json_records(spark, tmp_path):
    t = datetime(2024, 1, 1, 0, 0, 5)
    df = spark.createDataFrame([("a", t, 1.5), ("b", None, None)], "id string, t timestamp_ntz, x double")
    got = [json.loads(r.record) for r in export.json_records(df).orderBy("record").collect()]
    assert got == [
        {"id": "a", "t": "2024-01-01T00:00:05.000", "x": 1.5},
        {"id": "b", "t": None, "x": None},
    ]
    export.write_json(df, str(tmp_path / "out"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) == sorted(
        r.record for r in export.json_records(df).collect()
    )


def test_versions_are_read_back_and_repeated_writes_replace(spark, tmp_path, schema):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), schema, keep=2)
    assert table.read().count() == 0
    one = spark.createDataFrame([("a", 1, 1.0)], schema)
    assert table.write(one) == 1
    assert table.write(table.read().unionByName(one)) == 2
    assert table.write(table.read(up_to=1).unionByName(one), 2) == 2
    assert table.read().count() == 2
    assert table.read(up_to=1).count() == 1
    table.write(one)
    assert table.versions() == [2, 3]
    with pytest.raises(ValueError):
        table.write(one, 2)


def test_unfinished_version_is_not_read(spark, tmp_path, schema):
    table = versioned.VersionedTable(spark, str(tmp_path / "t"), schema)
    table.write(spark.createDataFrame([("a", 1, 1.0)], schema))
    (tmp_path / "t" / "v=000000000002").mkdir()
    assert table.versions() == [1]
    assert table.read().count() == 1


def test_telemetry_is_laid_out_by_day(spark, tmp_path):
    rows = [(datetime(2024, 1, d, 12), "a", 1.0, 2.0, 3.0, "NORMAL") for d in (1, 2, 2)]
    path = str(tmp_path / "tel")
    versioned.append_by_day(spark.createDataFrame(rows, TELEMETRY), path)
    back = spark.read.parquet(path)
    assert sorted(p.name for p in (tmp_path / "tel").iterdir() if p.name.startswith("date")) == [
        "date=2024-01-01",
        "date=2024-01-02",
    ]
    assert back.count() == 3
    versioned.replace_table(back.limit(0).select(*FAILURE_SEED.names[1:]), str(tmp_path / "other"))
    assert spark.read.parquet(str(tmp_path / "other")).count() == 0


def test_one_parse_gives_rows_rejects_and_counts(spark, tmp_path):
    lines = ["entity_id,epoch,a,b,c", "x,1,1.5,2,3", "y,zz,2,3,4", "z,3", "w,4,,9,1"]
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(5):
        with gzip.open(folder / f"{i}.csv.gz", "wt") as out:
            out.write("\n".join(lines) + "\n")
    expected = traces.load_trace_csv(spark, str(folder), NORMAL_SEED)
    rejects = traces.load_rejects(spark, str(folder), NORMAL_SEED)
    assert expected.count() == 10 and rejects.count() == 10
    audit = traces.load_parsed(spark, str(folder), NORMAL_SEED, str(tmp_path / "out"), "T")
    assert {r.table_name: (r.row_count, r.data) for r in audit.collect()} == {
        "T": (10, "T: 10 rows"), "T_REJECTS": (10, "T_REJECTS: 10 rows")
    }
    base = str(tmp_path / "streamed")

    def run():
        traces.stream_trace_files(
            spark, str(folder), NORMAL_SEED, base, "T", checkpoint=f"{base}-checkpoint", files_per_batch=2
        ).awaitTermination()

    run()
    for where in (str(tmp_path / "out"), base):
        assert traces.parsed_rows(spark, where, NORMAL_SEED).exceptAll(expected).isEmpty()
        assert traces.parsed_rejects(spark, where, NORMAL_SEED).exceptAll(rejects).isEmpty()
        assert traces.parsed_rows(spark, where, NORMAL_SEED).count() == 10
    # A batch whose end was not noted runs again and leaves the same.
    commits = sorted((tmp_path / "streamed-checkpoint" / "commits").glob("[0-9]*"))
    assert len(commits) == 3
    commits[-1].unlink()
    (commits[-1].parent / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    run()
    assert traces.parsed_rows(spark, base, NORMAL_SEED).count() == 10
    assert {r.row_count for r in traces.stream_audit(spark, base).collect()} == {10}


def test_streamed_files_fill_the_cores(spark, monkeypatch):
    from sensorloom.plans import registry

    seen = []

    class Done:
        def awaitTermination(self):
            pass

    def load(*args, files_per_batch, **options):
        seen.append(files_per_batch)
        return Done()

    monkeypatch.setattr(traces, "stream_trace_files", load)
    monkeypatch.setattr(registry, "_trace_files", lambda spark, sf_dir: sf_dir)
    registry._streamed_files(spark, "in")
    assert seen == [spark.sparkContext.defaultParallelism]


def test_a_load_parses_files_once(spark, monkeypatch):
    from sensorloom.plans import registry

    parses, plain = [], traces._lines
    monkeypatch.setattr(traces, "_lines", lambda *args: parses.append(1) or plain(*args))
    counts = registry.all_queries()["load_pipeline"](spark, "/root/testdata/sf0.001").collect()
    assert sum(r.row_count for r in counts) == 6000
    # Two loads of rows and rejects.
    assert len(parses) == 2
