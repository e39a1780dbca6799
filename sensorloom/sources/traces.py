"""Reading trace files, what was wrong in them, and an audit of the load.

``write_parsed`` reads files once: good rows and rejects leave the same parse in one
write, and its counts are observed by that write. ``stream_trace_files`` does so for files as
they come.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

_BAD = "_bad_record"
# Folders of the two sides of a parse.
_KIND, _ROW, _REJECT = "kind", "row", "reject"


def _lines(reader, path: str, schema: T.StructType) -> DataFrame:
    """All lines, with the text of the ones that do not fit the schema.

    The parser would check only the columns a query asks for, so a count or a narrow
    projection would let bad lines through: it is told to read all of them.
    """
    with_bad = T.StructType(schema.fields + [T.StructField(_BAD, T.StringType())])
    return (
        reader.schema(with_bad)
        .option("header", True)
        .option("enforceSchema", True)
        .option("quote", '"')
        .option("nullValue", "\\N")
        .option("emptyValue", "")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD)
        .option("columnPruning", False)
        .csv(path)
    )


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    # Spark refuses to read the rejected text alone, as a count of either side would: this
    # condition holds for every line and asks for all columns.
    return _lines(spark.read, path, schema).filter(F.pmod(F.hash(*schema.names), F.lit(2)) < 2)


def load_trace_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of a CSV trace (plain or gzip), columns by position.

    Lines with a wrong field count or a value of the wrong type are skipped.
    A gzip file is one task, so large traces belong in many files.
    """
    return _read(spark, path, schema).filter(F.col(_BAD).isNull()).select(*schema.names)


def load_rejects(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The text of the lines that ``load_trace_csv`` skips."""
    bad = _read(spark, path, schema).filter(F.col(_BAD).isNotNull())
    return bad.select(F.col(_BAD).alias("line"))


def load_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """Row count per loaded table, with its label."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"),
            "row_count",
            F.concat(F.lit(f"{name}: "), F.col("row_count").cast("string"), F.lit(" rows")).alias(
                "data"
            ),
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts)


def _labelled(counts: DataFrame) -> DataFrame:
    text = F.concat("table_name", F.lit(": "), F.col("row_count").cast("string"), F.lit(" rows"))
    return counts.withColumn("data", text)


def write_parsed(lines: DataFrame, folder: str, name: str) -> DataFrame:
    """Writes good rows and rejects of one parse; returns the audit that the write has observed.

    The folder is replaced, so a repeated write leaves the same content.
    """
    bad = F.col(_BAD).isNotNull()
    seen = Observation()
    counted = lines.observe(seen, F.count_if(~bad).alias("rows"), F.count_if(bad).alias("rejects"))
    sides = counted.withColumn(_KIND, F.when(bad, _REJECT).otherwise(_ROW))
    sides.write.mode("overwrite").partitionBy(_KIND).parquet(folder)
    counts = [(name, seen.get["rows"]), (f"{name}_REJECTS", seen.get["rejects"])]
    return _labelled(lines.sparkSession.createDataFrame(counts, "table_name string, row_count long"))


def load_parsed(spark: SparkSession, path: str, schema: T.StructType, folder: str, name: str) -> DataFrame:
    """Loads files as they are, in full, by one parse; returns the audit."""
    return write_parsed(_read(spark, path, schema), folder, name)


def _side(spark: SparkSession, folder: str, schema: T.StructType, kind: str) -> DataFrame:
    fields = [*schema.fields, T.StructField(_BAD, T.StringType()), T.StructField(_KIND, T.StringType())]
    return spark.read.schema(T.StructType(fields)).parquet(folder).filter(F.col(_KIND) == kind)


def parsed_rows(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The good rows of a folder written by ``write_parsed`` or ``stream_trace_files``."""
    return _side(spark, folder, schema, _ROW).select(*schema.names)


def parsed_rejects(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """The rejected lines of such a folder."""
    return _side(spark, folder, schema, _REJECT).select(F.col(_BAD).alias("line"))


def stream_trace_files(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    folder: str,
    name: str,
    *,
    checkpoint: str,
    files_per_batch: int | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Loads files as they come: each is parsed once, in a batch that is one folder.

    A repeated batch replaces its folder. Audits of the batches lie beside it, under
    ``<folder>-audit``.
    """
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def each(batch: DataFrame, batch_id: int) -> None:
        part = f"batch={batch_id:012d}"
        audit = write_parsed(batch, f"{folder}/{part}", name)
        audit.coalesce(1).write.mode("overwrite").parquet(f"{folder}-audit/{part}")

    writer = _lines(reader, path, schema).writeStream.option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).foreachBatch(each).start()


def stream_audit(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of all batches of such a load."""
    counts = spark.read.parquet(f"{folder}-audit").groupBy("table_name").agg(F.sum("row_count").alias("row_count"))
    return _labelled(counts)
