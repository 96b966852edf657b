"""From log files to one labelled feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.columns import add_aliases, first_present, named, to_instant
from ..operators.features import device_column, dhcp_features, dns_features, flow_features, window_aggregates
from ..operators.fuse import fuse
from ..operators.intervals import event_intervals, label_by_sweep
from ..schema import DATASET_ALIASES, LABEL_TIME_CANDIDATES
from ..sources import logs


def features_from_logs(
    spark: SparkSession,
    dhcp: str | None = None,
    dns: str | None = None,
    flows: str | None = None,
    settings: Settings = Settings(),
) -> DataFrame:
    """Each log that is given, as window features, fused on device and window."""
    width = settings.window_seconds
    tables = []
    if dhcp:
        tables.append(dhcp_features(logs.read_dhcp(spark, dhcp), width))
    if dns:
        tables.append(dns_features(logs.read_dns(spark, dns), width))
    if flows:
        tables.append(flow_features(logs.read_flows(spark, flows), width))
    return fuse(*tables)


def label_flows(flows: DataFrame, intervals: DataFrame) -> DataFrame:
    """JOI2 on whichever time column the flows have; without one, every flow is normal."""
    name = first_present(flows, LABEL_TIME_CANDIDATES)
    if name is None:
        return flows.withColumn("label", F.lit(0))
    if flows.schema[name].dataType.simpleString() == "double":
        return label_by_sweep(flows, intervals, name)
    seconds = F.unix_micros(to_instant(flows, name)) / F.lit(1e6)
    return label_by_sweep(flows.withColumn("unix_timestamp", seconds), intervals, "unix_timestamp")


def dataset_flows(spark: SparkSession, folder: str, events: str, max_files: int | None = None) -> DataFrame:
    """Flow files and event markers to labelled canonical flows."""
    raw = add_aliases(logs.read_flow_folder(spark, folder, max_files), DATASET_ALIASES)
    intervals = event_intervals(logs.read_marker_lines(spark, events))
    labelled = label_flows(raw, intervals.select("start", "end"))
    if "timestamp" in labelled.columns:
        labelled = labelled.withColumn("timestamp", to_instant(labelled, "timestamp"))
    return labelled.withColumn("device_id", device_column(labelled))


def features_from_dataset(
    spark: SparkSession, folder: str, events: str, settings: Settings = Settings(), max_files: int | None = None
) -> DataFrame:
    """Window features of labelled flows; the label of a window is that of its first flow."""
    flows = dataset_flows(spark, folder, events, max_files)
    order = [c for c in ("resp_ip", "orig_bytes", "resp_bytes") if c in flows.columns]
    return window_aggregates(flows, settings.window_seconds, first_by=order)


def features_from_flows(flows: DataFrame, settings: Settings = Settings(), default_ts: str | None = None) -> DataFrame:
    """Canonical flow records to `flow_*` features with the most common protocol."""
    if "timestamp" not in flows.columns:
        flows = flows.withColumn("timestamp", F.to_timestamp(F.lit(default_ts)))
    return window_aggregates(flows, settings.window_seconds, proto="proto" if "proto" in flows.columns else None, rename=True)
