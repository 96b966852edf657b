"""Per-device gaps and sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.times import bucket_of, seconds_between
from .running import running


#: Keys are counted by so many hashes; one with more rows than this, and so many times the mean, is cut into slices.
KEY_BUCKETS, BUSY_ROWS, BUSY_TIMES = 65_536, 100_000, 20


def positive_gaps(df: DataFrame, keys: Sequence[str], ts: str, slice_seconds: float) -> DataFrame:
    """WIN2: seconds since the device's previous record in the window, where positive.

    Equal times give gap 0, which is never kept, so the distinct times are enough: they are
    reduced map-side first. The previous time is a running maximum, taken slice by slice, so
    a busy device and window is not ordered in one task.
    """
    distinct = df.select(*keys, ts).where(F.col(ts).isNotNull()).distinct()
    sliced = distinct.withColumn("_slice", bucket_of(F.col(ts), slice_seconds))
    before = running(sliced, {"_previous": ts}, order=[ts], by=keys, func=F.max, inclusive=False)
    return before.where(F.col("_previous").isNotNull()).select(
        *keys, ts, seconds_between(F.col(ts), F.col("_previous")).alias("gap")
    )


def busy(df: DataFrame, keys: Sequence[str]) -> Column:
    """Whether a row's key may have more rows than one task should order. Runs a job that counts rows by hash of the key.

    Keys are counted by bucket, so a task sends at most KEY_BUCKETS counts and only those of busy buckets reach the driver;
    a key that shares a bucket with a busy one counts as busy too.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS)).cast("int")
    counts = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("n"))
    most = F.greatest(F.lit(BUSY_ROWS), F.lit(BUSY_TIMES) * counts.agg(F.sum("n")).scalar() / F.lit(KEY_BUCKETS))
    hot = [r[0] for r in counts.where(F.col("n") > most).select("_bucket").collect()]
    return bucket.isin(hot) if hot else F.lit(False)


def whole_gap_statistics(df: DataFrame, keys: Sequence[str], ts: str, sums: Sequence[str], distinct: str, out: str) -> DataFrame:
    """`gap_statistics` of keys of few rows each, and in `out` how many values `distinct` has: one shuffle by key, nothing else."""
    gap = seconds_between(F.col(ts), F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)))
    first = F.row_number().over(Window.partitionBy(*keys, distinct).orderBy(ts)) == 1
    rows = df.select(*keys, ts, *dict.fromkeys([*sums, distinct])).where(F.col(ts).isNotNull())
    rows = rows.withColumn("_gap", gap).withColumn("_new", first & F.col(distinct).isNotNull())
    positive = F.when(F.col("_gap") > 0, F.col("_gap"))
    return rows.groupBy(*keys).agg(
        *[F.sum(c).alias(c) for c in sums],
        F.coalesce(F.avg(positive), F.lit(0.0)).alias("mean_inter_arrival_time"),
        F.when(F.count(positive) == 0, F.lit(0.0)).otherwise(F.var_samp(positive)).alias("var_inter_arrival_time"),
        F.count_if("_new").alias(out),
    )


def gap_statistics(df: DataFrame, keys: Sequence[str], ts: str, slice_seconds: float, sums: Sequence[str] = ()) -> DataFrame:
    """WIN3: mean and sample variance of the positive gaps per key.

    One (device, window) may be hot, so its time span is cut into slices. Each slice gives
    the count, mean and squared deviation of its own gaps; the gap that crosses a slice edge
    comes from the neighbouring slices' first and last times; the parts then merge exactly.
    No gap gives 0 and 0; a single gap has a null variance. The columns `sums` are added up on
    the way, so that they need no shuffle of their own.
    """
    # no distinct times: equal times are dropped as gaps of 0 below, so one shuffle by slice is enough
    sliced = df.select(*keys, ts, *sums).where(F.col(ts).isNotNull()).withColumn("_slice", bucket_of(F.col(ts), slice_seconds))
    inside = Window.partitionBy(*keys, "_slice").orderBy(ts)
    gap = seconds_between(F.col(ts), F.lag(ts).over(inside))
    gaps = sliced.withColumn("_all", gap).withColumn("_gap", F.when(F.col("_all") > 0, F.col("_all")))
    per_slice = gaps.groupBy(*keys, "_slice").agg(
        F.count("_gap").alias("_n"),
        F.avg("_gap").alias("_mean"),
        F.coalesce(F.var_pop("_gap") * F.count("_gap"), F.lit(0.0)).alias("_dev"),
        F.min(ts).alias("_first"),
        F.max(ts).alias("_last"),
        *[F.sum(c).alias(c) for c in sums],
    )
    chain = Window.partitionBy(*keys).orderBy("_slice")
    whole = Window.partitionBy(*keys)
    edge = seconds_between(F.col("_first"), F.lag("_last").over(chain))
    parts = (
        per_slice.withColumn("_edge", edge)
        .withColumn("_edges", F.count("_edge").over(whole))
        .withColumn("_total", F.sum("_n").over(whole) + F.col("_edges"))
        .withColumn(
            "_avg",
            F.try_divide(
                seconds_between(F.max("_last").over(whole), F.min("_first").over(whole)), F.col("_total")
            ),
        )
    )
    spread = (
        F.col("_dev")
        + F.col("_n") * F.coalesce(F.pow(F.col("_mean") - F.col("_avg"), 2), F.lit(0.0))
        + F.coalesce(F.pow(F.col("_edge") - F.col("_avg"), 2), F.lit(0.0))
    )
    merged = parts.groupBy(*keys).agg(
        F.max("_total").alias("_total"), F.max("_avg").alias("_avg"), F.sum(spread).alias("_spread"), *[F.sum(c).alias(c) for c in sums]
    )
    return merged.select(
        *keys,
        *sums,
        F.coalesce("_avg", F.lit(0.0)).alias("mean_inter_arrival_time"),
        F.when(F.col("_total") == 0, F.lit(0.0))
        .when(F.col("_total") > 1, F.col("_spread") / (F.col("_total") - 1))
        .alias("var_inter_arrival_time"),
    )


def sequences(
    df: DataFrame,
    features: Sequence[str],
    length: int = 12,
    device: str = "device_id",
    window: str = "time_window",
) -> DataFrame:
    """WIN4: the last `length` feature rows of a device, for every window with a full history.

    Runs on the aggregated table, where a device has one row per window, so the
    largest partition is bounded by the time span, not by traffic.
    """
    row = F.array(*[F.col(c).cast("double") for c in features])
    recent = Window.partitionBy(device).orderBy(window).rowsBetween(-(length - 1), 0)
    return (
        df.select(device, window, row.alias("_row"))
        .withColumn("sequence", F.collect_list("_row").over(recent))
        .where(F.size("sequence") == length)
        .drop("_row")
    )
