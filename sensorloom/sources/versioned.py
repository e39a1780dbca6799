"""Small keyed tables kept as numbered Parquet versions.

A version is written whole beside the one being read and counts once its
marker file is there, which this module writes last, so a job that dies half-way
leaves the table as it was, and writing the same version again replaces the
half-written one. The marker does not depend on how Spark commits its output.

The ``keep`` newest versions stay; a reader has that many writes to finish.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorloom.functions.timeops import DAY

_MARKER = "_COMPLETE"


def file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    return root, root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm


def complete_folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in ``path`` that have been written to the end."""
    root, fs, jvm = file_system(spark, path)
    if not fs.exists(root):
        return []
    found = []
    for status in fs.listStatus(root):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), _MARKER)
        if name.startswith(prefix) and fs.exists(done):
            found.append(name)
    return sorted(found)


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table, in order."""
    return [int(name[2:]) for name in complete_folders(spark, path, "v=")]


def complete(spark: SparkSession, folder: str) -> None:
    """Marks a folder as written to the end."""
    _, fs, jvm = file_system(spark, folder)
    fs.create(jvm.org.apache.hadoop.fs.Path(folder, _MARKER)).close()


@dataclass(frozen=True)
class VersionedTable:
    """One table: a folder of versions and the schema they share."""

    spark: SparkSession
    path: str
    schema: T.StructType
    keep: int = 5

    def _folder(self, version: int) -> str:
        return f"{self.path}/v={version:012d}"

    def versions(self) -> list[int]:
        """Numbers of the complete versions, in order."""
        return complete_versions(self.spark, self.path)

    def read(self, up_to: int | None = None) -> DataFrame:
        """The newest complete version, or the newest one up to a number."""
        usable = [v for v in self.versions() if up_to is None or v <= up_to]
        if not usable:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(usable[-1]))

    def write(self, df: DataFrame, version: int | None = None) -> int:
        """Write ``df`` as a version (the next one by default); returns its number.

        The newest version may be written again; an older one may not, since
        readers would go on seeing the newer one.
        """
        newest = (self.versions() or [0])[-1]
        if version is None:
            version = newest + 1
        if version < newest:
            raise ValueError(f"{self.path} is at version {newest}, past {version}")
        df.select(*self.schema.names).write.mode("overwrite").parquet(self._folder(version))
        complete(self.spark, self._folder(version))
        self._forget(version - self.keep)
        return version

    def _forget(self, oldest: int) -> None:
        _, fs, jvm = file_system(self.spark, self.path)
        for version in self.versions():
            if version <= oldest:
                fs.delete(jvm.org.apache.hadoop.fs.Path(self._folder(version)), True)


def append_by_day(df: DataFrame, path: str, *, ts: str = "timestamp") -> None:
    """Append rows, one folder per day of ``ts``, so that time ranges prune folders.

    Rows of a day are brought together, large days in several tasks, so a folder gets few files.
    """
    dated = df.withColumn(DAY, F.to_date(ts))
    dated.hint("rebalance", DAY).write.mode("append").partitionBy(DAY).parquet(path)


def replace_table(df: DataFrame, path: str) -> None:
    """Full replacement of a loaded table."""
    df.write.mode("overwrite").parquet(path)
