"""Input schemas, label names and column aliases."""

from __future__ import annotations

from pyspark.sql import types as T

# Label codes and their names.
NORMAL, DNS, DHCP, GATEWAY, ARP, UNKNOWN = 0, 1, 2, 3, 4, -1

REPORT_NAMES = {
    0: "Normal Configuration",
    1: "DNS Misconfiguration",
    2: "DHCP Misconfiguration",
    3: "Gateway Misconfiguration",
    4: "ARP Storm / Local Misconfiguration",
    -1: "Unknown Misconfiguration Type",
}
SHORT_NAMES = {
    0: "Normal Configuration",
    1: "DNS Misconfiguration",
    2: "DHCP Misconfiguration",
    3: "Gateway Misconfiguration",
    4: "ARP Storm",
    -1: "Unknown Misconfiguration",
}
CLASS_NAMES = {0: "Normal", 1: "DNS Misconfig", 2: "DHCP Misconfig", 3: "Gateway Misconfig", 4: "ARP Storm"}

METADATA = ("device_id", "time_window", "label")


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in spec.items()])


_str, _ts, _long, _double, _int = (
    T.StringType(),
    T.TimestampType(),
    T.LongType(),
    T.DoubleType(),
    T.IntegerType(),
)

DHCP_LOG = _struct({"timestamp": _ts, "device_id": _str, "message_type": _str, "result": _str})
DNS_LOG = _struct(
    {
        "timestamp": _ts,
        "device_id": _str,
        "query_domain": _str,
        "response_code": _str,
        "response_time": _double,
    }
)
FLOW_LOG = _struct(
    {
        "timestamp": _ts,
        "src_ip": _str,
        "dst_ip": _str,
        "bytes_sent": _long,
        "bytes_received": _long,
        "protocol": _str,
        "packet_count": _long,
        "duration": _double,
    }
)
DATASET_FLOW = _struct(
    {
        "start": _double,
        "sIPs": _str,
        "rIPs": _str,
        "sAddress": _str,
        "rAddress": _str,
        "sBytesSum": _long,
        "rBytesSum": _long,
        "sPackets": _long,
        "rPackets": _long,
        "duration": _double,
        "protocol": _str,
    }
)
FEATURE_TABLE = _struct(
    {
        "device_id": _str,
        "time_window": _ts,
        "flow_bytes_out_sum": _long,
        "flow_bytes_out_mean": _double,
        "flow_count": _long,
        "flow_bytes_in_sum": _long,
        "flow_bytes_in_mean": _double,
        "flow_packets_out_sum": _long,
        "flow_packets_in_sum": _long,
        "flow_duration_mean": _double,
        "proto_mode": _int,
        "dhcp_discover_count": _int,
        "dhcp_request_count": _int,
        "dhcp_ack_count": _int,
        "dns_query_count": _int,
        "dns_success_count": _int,
        "dns_failure_count": _int,
        "label": _int,
    }
)

# Raw dataset column -> canonical column.
DATASET_ALIASES = {
    "sIPs": "orig_ip",
    "rIPs": "resp_ip",
    "sAddress": "orig_mac",
    "rAddress": "resp_mac",
    "sBytesSum": "orig_bytes",
    "rBytesSum": "resp_bytes",
    "sPackets": "orig_pkts",
    "rPackets": "resp_pkts",
    "start": "timestamp",
    "duration": "duration",
    "protocol": "proto",
}

# Names to try, in order, for each canonical column of a connection log.
CONNECTION_CANDIDATES = {
    "device_id": ["id.orig_h", "orig_ip", "src_ip", "source", "id_orig_h"],
    "timestamp": ["ts", "timestamp", "time", "start"],
    "orig_bytes": ["orig_bytes", "orig_bytes_sum", "bytes_orig", "sBytesSum"],
    "resp_bytes": ["resp_bytes", "resp_bytes_sum", "bytes_resp", "rBytesSum"],
    "orig_pkts": ["orig_pkts", "orig_packets", "pkts_orig", "sPackets"],
    "resp_pkts": ["resp_pkts", "resp_packets", "pkts_resp", "rPackets"],
    "duration": ["duration", "dur", "flow_duration"],
    "proto": ["proto", "protocol", "ip.proto"],
}
PACKET_CANDIDATES = {
    "device_id": ["ip.src", "Source", "src_ip", "source_ip", "ip_src"],
    "timestamp": ["frame.time", "Time"],
    "orig_bytes": ["frame.len", "Length"],
}
LABEL_TIME_CANDIDATES = ["start", "timestamp", "ts", "start_time", "time"]

# IP protocol numbers.
PROTOCOL_NUMBERS = {"TCP": 6, "UDP": 17, "ICMP": 1}

# Window aggregate -> feature name, and feature name -> model input name.
FLOW_FEATURE_NAMES = {
    "orig_bytes_sum": "flow_bytes_out_sum",
    "orig_bytes_mean": "flow_bytes_out_mean",
    "orig_bytes_count": "flow_count",
    "resp_bytes_sum": "flow_bytes_in_sum",
    "resp_bytes_mean": "flow_bytes_in_mean",
    "orig_pkts_sum": "flow_packets_out_sum",
    "resp_pkts_sum": "flow_packets_in_sum",
    "duration_mean": "flow_duration_mean",
}
MODEL_INPUT_NAMES = {
    **{feature: aggregate for aggregate, feature in FLOW_FEATURE_NAMES.items()},
    "orig_bytes": "orig_bytes_sum",
    "resp_bytes": "resp_bytes_sum",
    "orig_pkts": "orig_pkts_sum",
    "resp_pkts": "resp_pkts_sum",
    "duration": "duration_mean",
}

# Column-name prefixes and exact names that belong to each view.
VIEW_PREFIXES = {
    "dhcp": ("dhcp_", "lease_", "failed_lease"),
    "dns": ("dns_", "num_unique_domains", "entropy_of_domains", "mean_response_time"),
    "flow": (
        "flow_", "flows_", "bytes_", "orig_", "resp_", "duration", "proto", "mean_inter_arrival",
        "var_inter_arrival", "arp_", "icmp_", "broadcast_", "num_distinct_gateways",
        "sBytesSum", "rBytesSum", "sPackets", "rPackets",
    ),
}
