"""Event intervals: pairing markers, merging, and labelling records that fall inside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from ..schema import DHCP
from .running import SLICE_BITS, quantile_slice, running

# A joined-in table is broadcast only when counted and found below this many rows.
BROADCAST_ROWS = 200_000


def pair_markers(
    df: DataFrame,
    is_start: Column,
    is_end: Column,
    at: str,
    order: str,
    by: Sequence[str] = (),
    carry: Sequence[str] = (),
    slice_by: Column | None = None,
) -> DataFrame:
    """JOI1, WIN5: START and END markers to closed intervals, one chain per `by`.

    An END closes the most recent START; when several follow, the last one before the next
    START counts. A START that never ends and an END before any START give nothing.
    The chain number is a running count of STARTs, taken slice by slice so that one busy
    chain does not end up in one task.
    """
    marks = df.select(
        *by, *carry, F.col(at).alias("_at"), F.col(order).alias("_order"),
        is_start.alias("_start"), is_end.alias("_end"),
        *([slice_by.alias("_slice")] if slice_by is not None else []),
    ).where(F.col("_start") | F.col("_end"))
    if slice_by is None:
        marks = quantile_slice(marks, "_order")
    chained = running(marks, {"_chain": F.col("_start").cast("bigint")}, order=["_order"], by=by)
    opened = F.col("_start")
    return (
        chained.where(F.col("_chain") > 0)
        .groupBy(*by, "_chain")
        .agg(
            F.max(F.when(opened, F.col("_at"))).alias("start"),
            F.max_by("_at", F.when(F.col("_end"), F.col("_order"))).alias("end"),
            *[F.max(F.when(opened, F.col(c))).alias(c) for c in carry],
        )
        .where(F.col("end").isNotNull())
        .drop("_chain")
    )


def parse_markers(lines: DataFrame, line: str = "line", order: str = "line_no") -> DataFrame:
    """The marker lines of an event file as columns; other lines are left out."""
    text = F.trim(F.col(line))
    informational = F.startswith(text, F.lit("[")) & F.contains(text, F.lit("INFO"))

    def group(pattern: str, i: int) -> Column:
        return F.nullif(F.regexp_extract(text, pattern, i), F.lit(""))

    # The patterns of the marker format.
    change = r"(?U)(\w+):\s*([\d.]+)\s*-->\s*([\d.]+)"
    stamp = r"(?U)^\[([\d.]+)"
    marker = (
        F.when(F.contains(text, F.lit("BAD-MISCONF-START")), "misconf_start")
        .when(F.contains(text, F.lit("BAD-MISCONF-END")), "misconf_end")
        .when(F.contains(text, F.lit("BAD-MISCONF-DUPLICATION-START")), "duplication_start")
        .when(F.contains(text, F.lit("BAD-MISCONF-DUPLICATION-END")), "duplication_end")
    )
    parsed = lines.where((text != "") & ~informational).select(
        F.col(order).alias("line_no"),
        group(stamp, 1).try_cast("double").alias("ts"),
        marker.alias("marker"),
        group(change, 1).alias("_changed"),
        group(change, 2).alias("old_ip"),
        group(change, 3).alias("new_ip"),
        group(r"(?U)ip\s+([\d.]+)", 1).alias("ip"),
        group(r"(?U)(\w+)\s+will be given", 1).alias("_given"),
    )
    duplicate = F.startswith("marker", F.lit("duplication"))
    return parsed.where(F.col("ts").isNotNull() & F.col("marker").isNotNull()).select(
        "line_no",
        "ts",
        F.when(duplicate, "duplicate_ip").otherwise("invalid_ip").alias("type"),
        F.endswith("marker", F.lit("_start")).alias("opens"),
        F.when(duplicate, F.coalesce("_given", F.lit("unknown"))).otherwise(F.col("_changed")).alias("device"),
        F.when(~duplicate, F.col("old_ip")).alias("old_ip"),
        F.when(~duplicate, F.col("new_ip")).alias("new_ip"),
        F.when(duplicate, F.col("ip")).alias("ip"),
    )


def event_intervals(lines: DataFrame, strict: bool = False) -> DataFrame:
    """JOI1 on an event file: `type, device, old_ip, new_ip, ip, start, end`.

    A START whose details do not parse is ignored, so the next END moves the previous
    interval's end; with ``strict=True`` that END is dropped with its START.
    """
    marks = parse_markers(lines)
    usable = F.coalesce("new_ip", "ip").isNotNull()
    opens = F.col("opens") if strict else F.col("opens") & usable
    if isinstance(lines.schema["line_no"].dataType, T.StructType):
        part = F.struct("line_no.file", "line_no.block")
    else:
        part = F.floor(F.col("line_no") / 10_000)
    paired = pair_markers(
        marks.withColumn("usable", usable.cast("int")),
        is_start=opens,
        is_end=~F.col("opens"),
        at="ts",
        order="line_no",
        by=["type"],
        carry=["device", "old_ip", "new_ip", "ip", "usable"],
        slice_by=part,
    )
    return paired.where("usable = 1").select("type", "device", "old_ip", "new_ip", "ip", "start", "end")


def merge_intervals(df: DataFrame, by: Sequence[str] = (), start: str = "start", end: str = "end") -> DataFrame:
    """JOI3: overlapping or touching closed intervals joined into disjoint ones."""
    spans = df.where(F.col(end) >= F.col(start)).select(*by, start, end).distinct()
    # keys already spread the rows, so fewer slices do; they still split a hot key
    sliced = quantile_slice(spans, start, bits=8 if by else SLICE_BITS)
    reach = running(sliced, {"_reach": end}, order=[start, end], by=by, func=F.max, inclusive=False)
    fresh = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach")), 1).otherwise(0)
    islands = running(reach, {"_island": fresh.cast("bigint")}, order=[start, end], by=by)
    return islands.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


def _axis(df: DataFrame, name: str) -> Column:
    """Seconds as they are, timestamps as exact microseconds."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp"))
    return F.col(name)


def interval_buckets(intervals: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """Disjoint intervals repeated per time bucket they touch, for an equality join."""
    first, last = (F.floor(F.col(c) / F.lit(width)).cast("bigint") for c in ("_lo", "_hi"))
    return intervals.select(
        *by, _axis(intervals, "start").alias("_lo"), _axis(intervals, "end").alias("_hi")
    ).select(*by, F.explode(F.sequence(first, last)).alias("_bucket"), "_lo", "_hi")


def label_by_intervals(
    flows: DataFrame,
    intervals: DataFrame,
    ts: str,
    by: Sequence[str] = (),
    label: int = DHCP,
    bucket_seconds: float = 3600,
    out: str = "label",
    merged: bool = False,
) -> DataFrame:
    """JOI2: `label` for records inside any closed interval (both ends count), else 0.

    The intervals are merged first, so a record meets at most one and no row is doubled;
    the range test runs inside an equality join on coarse time buckets. The merged table is
    written once and counted; below BROADCAST_ROWS it is broadcast and the flows are not
    shuffled at all, above it the join shuffles on the bucket and AQE splits hot ones.
    """
    timestamped = isinstance(flows.schema[ts].dataType, (T.TimestampType, T.TimestampNTZType))
    width = bucket_seconds * 1_000_000 if timestamped else bucket_seconds
    disjoint = intervals if merged else merge_intervals(intervals, by)
    buckets = cut_lineage(interval_buckets(disjoint, by, width))
    if buckets.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        buckets = F.broadcast(buckets)
    at = flows.withColumn("_t", _axis(flows, ts)).withColumn("_bucket", F.floor(F.col("_t") / F.lit(width)).cast("bigint"))
    right = buckets.withColumnsRenamed({**{c: f"_r_{c}" for c in by}, "_bucket": "_r_bucket"})
    match = (F.col("_bucket") == F.col("_r_bucket")) & (F.col("_t") >= F.col("_lo")) & (F.col("_t") <= F.col("_hi"))
    for c in by:
        match = match & (F.col(c) == F.col(f"_r_{c}"))
    keep = [c for c in flows.columns if c != out]
    return at.join(right, match, "left").select(
        *keep, F.when(F.col("_lo").isNotNull(), F.lit(label)).otherwise(F.lit(0)).cast("int").alias(out)
    )


def label_by_sweep(flows: DataFrame, intervals: DataFrame, ts: str, by: Sequence[str] = (), label: int = DHCP, out: str = "label") -> DataFrame:
    """JOI2 without buckets: records and interval starts stand on one axis, and each record looks back at the furthest end.

    A record is inside some closed interval if the largest end of all starts up to it is not before it. That is a running
    maximum, taken in slices, so neither many intervals at one time nor very long ones cost more than their own rows, and
    nothing is repeated, merged or broadcast. Intervals of a null key hold for nothing; records without a time or key get 0.
    """
    keys = [f"_by{i}" for i in range(len(by))]
    named = [F.col(c).alias(k) for c, k in zip(by, keys)]
    kept = F.struct(*[F.col(f"`{c}`") for c in flows.columns if c != out])
    rows = flows.select(*named, _axis(flows, ts).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(dict(intervals.select(_axis(intervals, "end").alias("e")).dtypes)["e"]).alias("_end"), kept.alias("_row"))
    spans = intervals.where(F.col("end") >= F.col("start"))
    for c in by:
        spans = spans.where(F.col(c).isNotNull())
    kind = rows.schema["_row"].dataType
    starts = spans.select(*named, _axis(intervals, "start").alias("_t"), F.lit(0).alias("_kind"), _axis(intervals, "end").alias("_end"), F.lit(None).cast(kind).alias("_row"))
    axis = starts.unionByName(rows.where(F.col("_t").isNotNull()))
    sliced = quantile_slice(axis, "_t", bits=8 if by else SLICE_BITS)
    seen = running(sliced, {"_until": "_end"}, order=["_t", "_kind"], by=keys, func=F.max).where("_kind = 1")
    inside = seen.select("_row", F.when(F.col("_until") >= F.col("_t"), F.lit(label)).otherwise(F.lit(0)).cast("int").alias(out))
    timeless = rows.where(F.col("_t").isNull()).select("_row", F.lit(0).cast("int").alias(out))
    return inside.unionByName(timeless).select("_row.*", out)
