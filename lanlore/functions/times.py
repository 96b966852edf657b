"""Fixed time windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def tumbling(ts: Column, seconds: int) -> Column:
    """WIN1: epoch-aligned window start; rows without a timestamp are dropped by Spark."""
    return F.window(ts, f"{int(seconds)} seconds")["start"]


def floor_to(ts: Column, seconds: int) -> Column:
    """WIN1b: the same floor as plain arithmetic, so rows without a timestamp stay (null window)."""
    micros = F.unix_micros(ts)
    return F.timestamp_micros(micros - F.pmod(micros, F.lit(int(seconds) * 1_000_000)))


def bucket_of(ts: Column, seconds: float) -> Column:
    """The number of the epoch-aligned bucket holding `ts`."""
    width = int(seconds * 1_000_000)
    micros = F.unix_micros(ts)
    return F.floor((micros - F.pmod(micros, F.lit(width))) / F.lit(width)).cast("bigint")


def seconds_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1e6)
