"""Result sets as JSON records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OPTIONS = {
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSS",
    "ignoreNullFields": "false",
}


def json_records(df: DataFrame) -> DataFrame:
    """One JSON text per row: ISO times, NULL fields kept."""
    return df.select(F.to_json(F.struct(*df.columns), _OPTIONS).alias("record"))


def write_json(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Write the rows as JSON lines in the same form."""
    df.write.mode(mode).options(**_OPTIONS).json(path)
