"""Keyed tables in buckets, of which a write touches only those its keys fall into.

A version holds the buckets that it changed and counts once its marker is there; a bucket
is as its newest version has it. So what a batch writes follows the keys it touches, not
the table, and a batch that is repeated starts from the versions before its own and writes
the same files again. Buckets that no later reader asks for are removed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.sources.versioned import complete, complete_versions, file_system

_BUCKET = "bucket"


@dataclass(frozen=True)
class BucketedTable:
    """A folder of versions; rows belong to the bucket of their key."""

    spark: SparkSession
    path: str
    schema: T.StructType
    key: tuple[str, ...]
    buckets: int = 64
    keep: int = 5

    def bucket(self) -> Column:
        nulls = F.concat(*[F.col(k).isNull().cast("string") for k in self.key])
        return F.pmod(F.xxhash64(nulls, *self.key), F.lit(self.buckets)).cast("int").alias(_BUCKET)

    def layout(self, up_to: int | None = None) -> dict[int, tuple[int, str]]:
        """Each bucket's newest version, or newest up to a number, and its folder."""
        root, fs, jvm = file_system(self.spark, self.path)
        found = {}
        for version in complete_versions(self.spark, self.path):
            if up_to is not None and version > up_to:
                break
            folder = jvm.org.apache.hadoop.fs.Path(root, f"v={version:012d}")
            for status in fs.listStatus(folder):
                name = status.getPath().getName()
                if name.startswith(f"{_BUCKET}="):
                    found[int(name.split("=")[1])] = (version, status.getPath().toString())
        return found

    def read(self, up_to: int | None = None, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets, with the column of the bucket."""
        layout = self.layout(up_to)
        folders = [folder for b, (_, folder) in sorted(layout.items()) if only is None or b in only]
        schema = T.StructType([*self.schema.fields, T.StructField(_BUCKET, T.IntegerType())])
        if not folders:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(self.schema).parquet(*folders)
        return rows.select("*", self.bucket())

    def touched(self, rows: DataFrame) -> list[int]:
        """The buckets that the keys of some rows fall into: as many numbers as there are buckets."""
        return sorted(r[0] for r in rows.select(self.bucket()).distinct().collect())

    def write(self, rows: DataFrame, version: int, touched: list[int]) -> None:
        """Replaces the touched buckets by ``rows``, which are all there are in them."""
        folder = f"{self.path}/v={version:012d}"
        named = rows.select(*self.schema.names).select("*", self.bucket())
        dealt = named.repartition(max(1, len(touched)), _BUCKET)
        dealt.write.mode("overwrite").partitionBy(_BUCKET).parquet(folder)
        _, fs, jvm = file_system(self.spark, self.path)
        # A bucket that has lost its last row is an empty folder.
        for b in touched:
            fs.mkdirs(jvm.org.apache.hadoop.fs.Path(folder, f"{_BUCKET}={b}"))
        complete(self.spark, folder)
        self._forget(version - self.keep)

    def _forget(self, oldest: int) -> None:
        """Removes buckets of old versions that are newer in a version up to ``oldest``."""
        root, fs, jvm = file_system(self.spark, self.path)
        kept = {folder for _, folder in self.layout(oldest).values()}
        for version in complete_versions(self.spark, self.path):
            if version > oldest:
                return
            folder = jvm.org.apache.hadoop.fs.Path(root, f"v={version:012d}")
            for status in fs.listStatus(folder):
                path = status.getPath()
                if path.getName().startswith(f"{_BUCKET}=") and path.toString() not in kept:
                    fs.delete(path, True)
