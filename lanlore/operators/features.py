"""Per-device window features from DHCP, DNS and flow logs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import first_present, fill_numeric, lookup, named, to_instant, truthy
from ..functions.times import floor_to
from ..schema import FLOW_FEATURE_NAMES
from .windows import busy, gap_statistics, whole_gap_statistics

KEYS = ["device_id", "time_window"]

# DHCP message types that get their own counter.
DHCP_MESSAGES = ("DISCOVER", "REQUEST", "ACK", "NAK", "RELEASE", "INFORM")
BROADCAST_SUFFIX = ".255"


def keyed(
    df: DataFrame, device: str, ts: str, seconds: int, keep_null_keys: bool = False
) -> DataFrame:
    """Add `device_id` and the floored `time_window`.

    The log parsers drop rows without a device or time; the dataset paths keep them.
    """
    out = df.withColumns({"device_id": named(device), "time_window": floor_to(to_instant(df, ts), seconds)})
    if keep_null_keys:
        return out
    return out.where(F.col("device_id").isNotNull() & F.col("time_window").isNotNull())


def dhcp_features(
    df: DataFrame,
    seconds: int = 300,
    device: str = "device_id",
    ts: str = "timestamp",
    message: str = "message_type",
    types: Mapping[str, str] | None = None,
) -> DataFrame:
    """AGG1, AGG2: message counts and the failed-lease ratio per device and window.

    `types` maps each DHCP message name to the value that stands for it in `message`.
    """
    types = types or {m: m for m in DHCP_MESSAGES}
    counts = {m: F.count_if(named(message) == types[m]) for m in DHCP_MESSAGES}
    grouped = (
        keyed(df, device, ts, seconds)
        .groupBy(*KEYS)
        .agg(
            *[counts[m].alias(f"dhcp_{m.lower()}_count") for m in DHCP_MESSAGES],
            F.count(F.lit(1)).alias("dhcp_total_count"),
        )
    )
    request = F.col("dhcp_request_count")
    unmet = F.col("dhcp_discover_count") + request - F.col("dhcp_ack_count")
    return grouped.withColumns(
        {
            "lease_renew_count": request,
            "failed_lease_ratio": F.when(request > 0, unmet / request).otherwise(F.lit(0.0)),
        }
    )


def entropy_of_counts(count: str) -> Column:
    """AGG5: Shannon entropy in bits of the counts in a group, in one aggregate pass."""
    c = F.col(count).cast("double")
    return F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)


def dns_features(
    df: DataFrame,
    seconds: int = 300,
    device: str = "device_id",
    ts: str = "timestamp",
    domain: str = "query_domain",
    code: str = "response_code",
    response_time: str = "response_time",
    success: str = "NOERROR",
    nxdomain: str = "NXDOMAIN",
) -> DataFrame:
    """AGG3-AGG5: DNS counts, ratio, distinct domains and entropy per device and window.

    Two aggregate levels: per domain first, then per window. The first level leaves one row
    per domain, so distinct domains are a count and entropy a sum; no set is ever held in a
    buffer, and a busy device shrinks before its rows meet. A missing code is a failure and
    a missing domain is a category of its own.
    """
    timed = response_time in df.columns
    answered = F.col(response_time) if timed else F.lit(None).cast("double")
    known = truthy(F.col(code).isin(success, nxdomain))
    per_domain = (
        keyed(df, device, ts, seconds)
        .groupBy(*KEYS, named(domain).alias("_domain"))
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col(code) == success).alias("_ok"),
            F.count_if(F.col(code) == nxdomain).alias("_nx"),
            F.count_if(~known).alias("_bad"),
            F.sum(answered).alias("_time"),
            F.count(answered).alias("_timed"),
        )
    )
    mean_time = F.try_divide(F.sum("_time"), F.sum("_timed")) if timed else F.lit(0.0)
    return (
        per_domain.groupBy(*KEYS)
        .agg(
            F.sum("_n").alias("dns_query_count"),
            F.sum("_ok").alias("dns_success_count"),
            F.sum("_bad").alias("dns_failure_count"),
            F.sum("_nx").alias("dns_nxdomain_count"),
            F.count(F.lit(1)).alias("num_unique_domains"),
            F.abs(entropy_of_counts("_n")).alias("entropy_of_domains"),
            mean_time.alias("mean_response_time"),
        )
        .withColumn("dns_failure_ratio", F.col("dns_failure_count") / F.col("dns_query_count"))
    )


def two_sided(df: DataFrame, src: str = "src_ip", dst: str = "dst_ip") -> DataFrame:
    """SET2: every flow once for its source and once for its destination."""
    sides = F.array(
        F.struct(F.lit("src").alias("side"), named(src).alias("device_id")),
        F.struct(F.lit("dst").alias("side"), named(dst).alias("device_id")),
    )
    return df.withColumn("_end", F.explode(sides)).select("*", "_end.side", "_end.device_id").drop("_end")


def flow_side_features(
    df: DataFrame,
    seconds: int = 300,
    src: str = "src_ip",
    dst: str = "dst_ip",
    ts: str = "timestamp",
    sent: str = "bytes_sent",
    received: str = "bytes_received",
    protocol: str | None = "protocol",
    arp: str = "ARP",
    icmp: str = "ICMP",
    broadcast: Column | None = None,
    small_bytes: float = 100,
    gap_slices: int = 16,
) -> DataFrame:
    """AGG6-AGG10, WIN3: the features of each device, window and side.

    Most devices have few flows in a window and take one shuffle. Busy ones, found by a count that runs when this is
    called, are added up by slices of the window, and their distinct destinations from distinct pairs, so that no hot device
    and none with many peers meets in one task. As a destination, a device has one peer: itself.
    """
    flows = df.select(
        named(src).alias("_src"),
        named(dst).alias("_dst"),
        to_instant(df, ts).alias("_ts"),
        (named(sent) if sent in df.columns else F.lit(0)).alias("_sent"),
        (named(received) if received in df.columns else F.lit(0)).alias("_received"),
        (named(protocol) if protocol and protocol in df.columns else F.lit(None).cast("string")).alias("_protocol"),
        truthy(broadcast if broadcast is not None else F.endswith(named(dst).cast("string"), F.lit(BROADCAST_SUFFIX))).alias("_all_hosts"),
    ).withColumn("time_window", floor_to(F.col("_ts"), seconds))
    side_keys = [*KEYS, "side"]
    has_protocol = bool(protocol) and protocol in df.columns

    def one(condition: Column) -> Column:
        return F.when(condition, 1).otherwise(0)

    arp_count = one(F.col("_protocol") == arp) + one((F.col("_sent") < small_bytes) & F.col("_all_hosts")) if has_protocol else F.lit(0)
    measured = flows.withColumns(
        {"_flows": F.lit(1), "_arp": arp_count, "_icmp": one(F.col("_protocol") == icmp), "_broadcast": one(F.col("_all_hosts"))}
    )
    ends = two_sided(measured, "_src", "_dst").where(F.col("device_id").isNotNull() & F.col("time_window").isNotNull())
    sums = ["_flows", "_sent", "_received", "_arp", "_icmp", "_broadcast"]
    hot = busy(ends, side_keys)
    few = whole_gap_statistics(ends.where(~hot), side_keys, "_ts", sums, "_dst", "_peers")
    many = ends.where(hot)
    totals = gap_statistics(many, side_keys, "_ts", seconds / gap_slices, sums)
    pairs = many.where("side = 'src'").select(*side_keys, "_dst").dropna().distinct()
    peers = pairs.groupBy(*side_keys).agg(F.count(F.lit(1)).alias("_peers"))
    own = F.when(F.col("side") == "dst", F.lit(1).cast("bigint")).otherwise(F.coalesce("_peers", F.lit(0).cast("bigint")))
    busy_totals = totals.join(peers, side_keys, "left").withColumn("_peers", own)
    return few.unionByName(busy_totals).select(
        *side_keys,
        F.col("_flows").alias("flows"),
        F.coalesce("_sent", F.lit(0)).alias("bytes_sent"),
        F.coalesce("_received", F.lit(0)).alias("bytes_received"),
        F.col("_arp").alias("arp_request_count"),
        F.col("_icmp").alias("icmp_unreachable_count"),
        F.try_divide("_broadcast", "_flows").alias("broadcast_packet_ratio"),
        F.col("_peers").alias("num_distinct_gateways"),
        "mean_inter_arrival_time",
        "var_inter_arrival_time",
    )


def flow_features(df: DataFrame, seconds: int = 300, gateway_agg: str = "mean", **options) -> DataFrame:
    """AGG11: both sides merged per device and window.

    Byte, flow and count columns add up and the others are averaged over the sides; with
    ``gateway_agg="max"`` the destination side's 1 does not halve the fan-out.
    """
    sides = flow_side_features(df, seconds, **options)

    def of(side: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col(name))), F.lit(0))

    gateways = {"mean": F.avg, "max": F.max}[gateway_agg]
    return sides.groupBy(*KEYS).agg(
        of("src", "bytes_sent").alias("bytes_out"),
        of("src", "bytes_received").alias("bytes_in"),
        of("src", "flows").alias("flows_out"),
        of("dst", "bytes_sent").alias("bytes_dst"),
        of("dst", "bytes_received").alias("bytes_received_dst"),
        of("dst", "flows").alias("flows_in"),
        F.avg("mean_inter_arrival_time").alias("mean_inter_arrival_time"),
        F.avg("var_inter_arrival_time").alias("var_inter_arrival_time"),
        F.sum("arp_request_count").alias("arp_request_count"),
        F.sum("icmp_unreachable_count").alias("icmp_unreachable_count"),
        F.avg("broadcast_packet_ratio").alias("broadcast_packet_ratio"),
        gateways("num_distinct_gateways").alias("num_distinct_gateways"),
    )


# Canonical flow column -> aggregates taken of it, for the pre-flattened dataset tables.
DATASET_AGGREGATES = {
    "orig_bytes": ("sum", "mean", "count"),
    "resp_bytes": ("sum", "mean"),
    "orig_pkts": ("sum",),
    "resp_pkts": ("sum",),
    "duration": ("mean",),
}
RAW_NAMES = {"orig_bytes": "sBytesSum", "resp_bytes": "rBytesSum", "orig_pkts": "sPackets", "resp_pkts": "rPackets"}


def device_column(df: DataFrame) -> Column:
    """PRJ3: the originator address, canonical or raw name, else 'unknown'."""
    found = first_present(df, ["orig_ip", "sIPs"])
    return named(found) if found else F.lit("unknown")


def window_aggregates(
    df: DataFrame,
    seconds: int = 300,
    device: str = "device_id",
    ts: str = "timestamp",
    label: str | None = "label",
    first_by: Sequence[str] = (),
    proto: str | None = None,
    rename: bool = False,
) -> DataFrame:
    """AGG12, AGG13, PRJ9, PRJ10, PRJ15: window features of pre-aggregated flow records.

    Rows without a device or time keep their group. The label is that of the earliest
    record (ties by `first_by`), never of whichever row a task happened to read first. With
    no known column to aggregate, flows are counted instead (AGG14).
    """
    work = keyed(df, device, ts, seconds, keep_null_keys=True).withColumn("_ts", to_instant(df, ts))
    first, merge, out = {}, {}, {}  # per value of the protocol, over its values, and what is shown
    for canonical, kinds in DATASET_AGGREGATES.items():
        column = first_present(df, [canonical, RAW_NAMES.get(canonical, canonical)])
        if column:
            first |= {f"_s_{column}": F.sum(named(column)), f"_n_{column}": F.count(named(column))}
            merge |= {f"_s_{column}": F.sum(f"_s_{column}"), f"_n_{column}": F.sum(f"_n_{column}")}
            shown = {"sum": F.col(f"_s_{column}"), "count": F.col(f"_n_{column}"), "mean": F.try_divide(F.col(f"_s_{column}"), F.col(f"_n_{column}"))}
            out |= {f"{column}_{k}": shown[k] for k in kinds}
    by_proto = bool(proto and proto in df.columns)
    if not out and not by_proto:
        return flow_counts(df, seconds, device, ts)
    if by_proto:
        first["_rows"] = F.count(named(proto))
        merge["_mode"] = F.min_by("_proto", F.when(F.col("_proto").isNotNull(), F.struct(-F.col("_rows"), F.col("_proto"))))
        out["proto_mode"] = F.coalesce(F.col("_mode"), F.lit(0).cast(df.schema[proto].dataType))
    if label and label in df.columns:
        earliest = F.struct(F.col("_ts").isNull().alias("none"), F.col("_ts").alias("ts"), *[named(c).alias(f"tie{i}") for i, c in enumerate(first_by)])
        first["_first"] = F.min(F.when(named(label).isNotNull(), F.struct(earliest.alias("at"), named(label).alias("label"))))
        merge["_first"] = F.min("_first")
        out["label"] = F.coalesce(F.col("_first.label"), F.lit(0)).cast("int")
    if by_proto:
        # values are counted before windows are, so no window's distinct values meet in one buffer
        grouped = work.withColumn("_proto", named(proto)).groupBy(*KEYS, "_proto").agg(*[c.alias(n) for n, c in first.items()])
        grouped = grouped.groupBy(*KEYS).agg(*[c.alias(n) for n, c in merge.items()])
    else:
        grouped = work.groupBy(*KEYS).agg(*[c.alias(n) for n, c in first.items()])
    shown = fill_numeric(grouped.select(*KEYS, *[c.alias(n) for n, c in out.items()]), skip=["device_id"])
    return shown.withColumnsRenamed(FLOW_FEATURE_NAMES) if rename else shown


def flow_counts(df: DataFrame, seconds: int = 300, device: str = "device_id", ts: str = "timestamp") -> DataFrame:
    """AGG14: flows per device and window."""
    return keyed(df, device, ts, seconds).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("flow_count"))
