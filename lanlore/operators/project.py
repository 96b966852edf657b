"""Projections and filters that bring raw records to canonical form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import (
    first_present,
    from_unix_seconds,
    lookup,
    named,
    resolve_columns,
    to_instant,
    to_number,
    to_whole,
)
from ..schema import (
    CONNECTION_CANDIDATES,
    FLOW_FEATURE_NAMES,
    MODEL_INPUT_NAMES,
    PACKET_CANDIDATES,
    PROTOCOL_NUMBERS,
)
from .running import ranked

RAW_FLOW = ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts", "duration")


def protocol_number(name: Column) -> Column:
    """PRJ6: protocol number of a name, 0 when unknown."""
    return lookup(PROTOCOL_NUMBERS, name, F.lit(0))


def packets_to_flows(df: DataFrame, default_ts: str | None = None) -> DataFrame:
    """PRJ7, FLT1: exported packets as one-way flow records.

    A time that does not parse becomes `default_ts`, given once for the run.
    """
    device = first_present(df, PACKET_CANDIDATES["device_id"])
    if device is None:
        raise ValueError(f"no source address column among {df.columns}")
    fallback = F.to_timestamp(F.lit(default_ts)) if default_ts else F.lit(None).cast("timestamp")
    ts = first_present(df, PACKET_CANDIDATES["timestamp"])
    size = first_present(df, PACKET_CANDIDATES["orig_bytes"])
    if "ip.proto" in df.columns:
        proto = to_whole(named("ip.proto")).cast("int")
    elif "Protocol" in df.columns:
        proto = protocol_number(named("Protocol"))
    else:
        proto = F.lit(0)
    zero = F.lit(0).cast("bigint")
    extra = [named(c).alias(c) for c in ("ip.src", "ip.dst") if c in df.columns]
    return nonblank(df, device).select(
        named(device).cast("string").alias("device_id"),
        (F.coalesce(to_instant(df, ts), fallback) if ts else fallback).alias("timestamp"),
        (to_whole(named(size)) if size else zero).alias("orig_bytes"),
        zero.alias("resp_bytes"),
        F.lit(1).cast("bigint").alias("orig_pkts"),
        zero.alias("resp_pkts"),
        F.lit(0.0).alias("duration"),
        proto.alias("proto"),
        *extra,
    )


def connections_to_flows(df: DataFrame, default_ts: str | None = None) -> DataFrame:
    """PRJ8: connection-log rows as canonical flow records."""
    fallback = F.to_timestamp(F.lit(default_ts)) if default_ts else F.lit(None).cast("timestamp")
    defaults = {"orig_bytes": 0, "resp_bytes": 0, "orig_pkts": 1, "resp_pkts": 0, "duration": 0.0, "proto": 0, "timestamp": fallback}
    c = resolve_columns(df, CONNECTION_CANDIDATES, defaults)
    ts_name = first_present(df, CONNECTION_CANDIDATES["timestamp"])
    if ts_name == "ts" and isinstance(df.schema["ts"].dataType, T.StringType):
        instant = from_unix_seconds(named("ts").try_cast("double"))
    else:
        instant = to_instant(df, ts_name) if ts_name else fallback
    return df.select(
        c["device_id"].cast("string").alias("device_id"),
        F.coalesce(instant, fallback).alias("timestamp"),
        *[to_whole(c[k]).alias(k) for k in ("orig_bytes", "resp_bytes", "orig_pkts", "resp_pkts")],
        to_number(c["duration"]).alias("duration"),
        c["proto"].alias("proto"),
    )


def rename_features(df: DataFrame, back: bool = False) -> DataFrame:
    """PRJ10: window aggregates to `flow_*` feature names, or back."""
    names = {v: k for k, v in FLOW_FEATURE_NAMES.items()} if back else FLOW_FEATURE_NAMES
    return df.withColumnsRenamed(names)


def raw_as_aggregates(df: DataFrame) -> DataFrame:
    """PRJ12: a single raw flow row as the window aggregate of itself."""
    if not set(RAW_FLOW) & set(df.columns) or {"orig_bytes_sum", "flow_bytes_out_sum", "orig_bytes_count"} & set(df.columns):
        return df
    value = {c: to_number(named(c)) if c in df.columns else F.lit(0.0) for c in RAW_FLOW}
    return df.withColumns(
        {
            "orig_bytes_sum": value["orig_bytes"],
            "orig_bytes_mean": value["orig_bytes"],
            "orig_bytes_count": F.lit(1).cast("bigint"),
            "resp_bytes_sum": value["resp_bytes"],
            "resp_bytes_mean": value["resp_bytes"],
            "orig_pkts_sum": value["orig_pkts"],
            "resp_pkts_sum": value["resp_pkts"],
            "duration_mean": value["duration"],
        }
    ).drop(*RAW_FLOW)


def align_features(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), names: Mapping[str, str] = MODEL_INPUT_NAMES) -> DataFrame:
    """PRJ11: exactly the columns a model was trained on, in its order, as doubles; absent ones 0."""
    have = set(df.columns)
    source = {names[c]: c for c in df.columns if c in names and names[c] not in have}
    source.update({c: c for c in df.columns})
    columns = [to_number(named(source[f])).alias(f) if f in source else F.lit(0.0).alias(f) for f in features]
    return df.select(*[named(c) for c in keep], *columns)


def default_device(df: DataFrame, order: str, keys: Sequence[str] = ()) -> DataFrame:
    """PRJ16: `device_{n}` for tables without a device, numbered in the order given."""
    if "device_id" in df.columns:
        return df
    return ranked(df, "_n", order=order, keys=keys).withColumn("device_id", F.concat(F.lit("device_"), F.col("_n"))).drop("_n")


def nonblank(df: DataFrame, name: str) -> DataFrame:
    """FLT1: rows whose text is neither null nor blank."""
    return df.where(F.trim(named(name).cast("string")) != "")


def ip_packets(df: DataFrame, name: str = "ip.src") -> DataFrame:
    """FLT2: packets that carry an IP header."""
    return df.where(named(name).isNotNull())


def normal_only(df: DataFrame, label: str = "label") -> DataFrame:
    """FLT3."""
    return df.where(F.col(label) == 0)


def known_only(df: DataFrame, prediction: str = "prediction") -> DataFrame:
    """FLT4."""
    return df.where(F.col(prediction) != -1)


def valid_only(df: DataFrame, error: str = "error") -> DataFrame:
    """FLT5."""
    return df.where(F.col(error).isNull())
