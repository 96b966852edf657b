"""The table of queries: each with a Spark callable and, where SQL can say it, the same in DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table, its zone-less timestamps read as UTC instants."""
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def rounded(df: DataFrame, digits: int = 6, **own: int) -> DataFrame:
    """Doubles rounded, as the SQL does; `own` gives single columns their own number of digits."""
    doubles = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.round(c, own.get(c, digits)) for c in doubles}) if doubles else df


def nudged(column, digits: int):
    """Rounded after a tiny shift, so that exact halves round the same way in both engines."""
    return F.round(column + 1e-7, digits)


def bucket(seconds_text: str, column: str) -> str:
    return f"time_bucket(INTERVAL '{seconds_text}', {column}, TIMESTAMP '1970-01-01')"


DAY = 86400
MONTH = 30 * DAY
