"""Windows, log features and dataset features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import floor_to, tumbling
from ..operators import features as ops
from ..operators.windows import gap_statistics, positive_gaps, sequences
from .registry import DAY, MONTH, bucket, nudged, query, rounded, table

EVENT_DAY = bucket("1 day", "ts")
# event types in the roles of DHCP messages
MESSAGES = {"DISCOVER": "error", "REQUEST": "click", "ACK": "view", "NAK": "purchase", "RELEASE": "signup", "INFORM": "none"}

DHCP_SQL = """
SELECT {key} AS device_id, {window} AS time_window,
  count(*) FILTER (event_type = 'error') AS dhcp_discover_count,
  count(*) FILTER (event_type = 'click') AS dhcp_request_count,
  count(*) FILTER (event_type = 'view') AS dhcp_ack_count,
  count(*) FILTER (event_type = 'purchase') AS dhcp_nak_count,
  count(*) FILTER (event_type = 'signup') AS dhcp_release_count,
  count(*) FILTER (event_type = 'none') AS dhcp_inform_count,
  count(*) AS dhcp_total_count,
  count(*) FILTER (event_type = 'click') AS lease_renew_count,
  round(CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN
    (count(*) FILTER (event_type = 'error') + count(*) FILTER (event_type = 'click')
     - count(*) FILTER (event_type = 'view')) / count(*) FILTER (event_type = 'click') ELSE 0.0 END, 6) AS failed_lease_ratio
FROM events GROUP BY ALL"""

DNS_SQL = """
WITH d AS (
  SELECT user_id AS device_id, {window} AS time_window, json_extract_string(props, '$.k') AS dom,
    count(*) AS n, count(*) FILTER (event_type = 'view') AS ok, count(*) FILTER (event_type = 'click') AS nx,
    count(*) FILTER (NOT coalesce(event_type IN ('view', 'click'), false)) AS bad, sum(value) AS t, count(value) AS tn
  FROM events GROUP BY ALL)
SELECT device_id, time_window, sum(n)::BIGINT AS dns_query_count, sum(ok)::BIGINT AS dns_success_count,
  sum(bad)::BIGINT AS dns_failure_count, sum(nx)::BIGINT AS dns_nxdomain_count, count(*) AS num_unique_domains,
  round(abs(log2(sum(n)) - sum(n * log2(n)) / sum(n)), 6) AS entropy_of_domains,
  round(sum(t) / sum(tn), 6) AS mean_response_time, round(sum(bad) / sum(n), 6) AS dns_failure_ratio
FROM d GROUP BY ALL"""


def events(spark, sf):
    return table(spark, sf, "events")


def dhcp_of_events(spark, sf, seconds=DAY):
    return ops.dhcp_features(events(spark, sf), seconds, "user_id", "ts", "event_type", MESSAGES)


def dns_of_events(spark, sf, seconds=DAY):
    src = events(spark, sf).withColumn("query_domain", F.get_json_object("props", "$.k"))
    return ops.dns_features(
        src, seconds, "user_id", "ts", "query_domain", "event_type", "value", success="view", nxdomain="click"
    )


@query(f"SELECT {EVENT_DAY} AS time_window, user_id, count(*) AS n FROM events GROUP BY ALL")
def win1_tumbling_counts(spark, sf):
    return events(spark, sf).groupBy(tumbling(F.col("ts"), DAY).alias("time_window"), "user_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT time_window, count(*) AS n FROM (
    SELECT CASE WHEN event_type = 'view' THEN NULL ELSE {EVENT_DAY} END AS time_window FROM events) GROUP BY ALL"""
)
def win1b_floor_keeps_null_times(spark, sf):
    ts = F.when(F.col("event_type") != "view", F.col("ts"))
    return events(spark, sf).groupBy(floor_to(ts, DAY).alias("time_window")).agg(F.count(F.lit(1)).alias("n"))


@query(DHCP_SQL.format(key="user_id", window=EVENT_DAY))
def agg1_message_counts_by_user_day(spark, sf):
    return rounded(dhcp_of_events(spark, sf))


@query(
    """SELECT user_id AS device_id, count(*) FILTER (event_type = 'click') AS requests,
    round(CASE WHEN count(*) FILTER (event_type = 'click') > 0 THEN (count(*) FILTER (event_type = 'error')
      + count(*) FILTER (event_type = 'click') - count(*) FILTER (event_type = 'view'))
      / count(*) FILTER (event_type = 'click') ELSE 0.0 END, 6) AS failed_lease_ratio
    FROM events GROUP BY ALL"""
)
def agg2_failed_lease_ratio_by_user(spark, sf):
    whole = dhcp_of_events(spark, sf, 36500 * DAY)
    return rounded(whole.select("device_id", F.col("dhcp_request_count").alias("requests"), "failed_lease_ratio"))


@query(DNS_SQL.format(window=EVENT_DAY))
def agg3_response_stats_by_user_day(spark, sf):
    return rounded(dns_of_events(spark, sf))


@query(f"SELECT device_id, time_window, dns_failure_ratio FROM ({DNS_SQL.format(window=bucket('30 days', 'ts'))})")
def agg4_failure_ratio_by_user_month(spark, sf):
    wide = dns_of_events(spark, sf, MONTH)
    return rounded(wide.select("device_id", "time_window", "dns_failure_ratio"))


@query(
    f"""WITH d AS (SELECT user_id, {EVENT_DAY} AS time_window, json_extract_string(props, '$.k') AS k, count(*) AS c
      FROM events GROUP BY ALL), p AS (SELECT *, c / sum(c) OVER (PARTITION BY user_id, time_window) AS p FROM d)
    SELECT user_id, time_window, round(abs(-sum(p * log2(p))), 6) AS entropy FROM p GROUP BY ALL"""
)
def agg5_entropy_by_user_day(spark, sf):
    per_key = events(spark, sf).groupBy(
        "user_id", floor_to(F.col("ts"), DAY).alias("time_window"), F.get_json_object("props", "$.k").alias("k")
    ).agg(F.count(F.lit(1)).alias("c"))
    return rounded(per_key.groupBy("user_id", "time_window").agg(F.abs(ops.entropy_of_counts("c")).alias("entropy")))


GAPS_SQL = """
SELECT {keys}, epoch_us(ts - lag(ts) OVER (PARTITION BY {keys} ORDER BY ts)) / 1e6 AS gap, ts
FROM (SELECT DISTINCT {select}, {ts} AS ts FROM {table})"""


@query(
    f"""SELECT user_id, time_window, ts, round(gap, 6) AS gap FROM (
    {GAPS_SQL.format(keys='user_id, time_window', select=f'user_id, {EVENT_DAY} AS time_window', ts='ts', table='events')}) WHERE gap > 0"""
)
def win2_gaps_by_user_day(spark, sf):
    src = events(spark, sf).withColumn("time_window", floor_to(F.col("ts"), DAY))
    return rounded(positive_gaps(src, ["user_id", "time_window"], "ts", DAY / 16))


@query(
    f"""SELECT user_id, time_window, round(coalesce(avg(gap), 0) + 1e-7, 4) AS mean_inter_arrival_time,
      round(CASE WHEN count(gap) = 0 THEN 0.0 ELSE var_samp(gap) END + 1e-7, 0) AS var_inter_arrival_time
    FROM ({GAPS_SQL.format(keys='user_id, time_window', select=f'user_id, {EVENT_DAY} AS time_window', ts='ts', table='events')}) GROUP BY ALL"""
)
def win3_inter_arrival_by_user_day(spark, sf):
    src = events(spark, sf).withColumn("time_window", floor_to(F.col("ts"), DAY))
    stats = gap_statistics(src, ["user_id", "time_window"], "ts", DAY / 16)
    return stats.withColumns(
        {
            "mean_inter_arrival_time": nudged(F.col("mean_inter_arrival_time"), 4),
            "var_inter_arrival_time": nudged(F.col("var_inter_arrival_time"), 0),
        }
    )


@query(
    f"""WITH f AS (SELECT user_id, {EVENT_DAY} AS w, count(*)::DOUBLE AS n, sum(value) AS v FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w) AS i FROM f)
    SELECT a.user_id AS device_id, a.w AS time_window, (11 - (a.i - b.i))::INTEGER AS step,
      b.n AS n_events, round(b.v, 4) AS total_value
    FROM r a JOIN r b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 11 AND a.i WHERE a.i >= 12"""
)
def win4_sequences_of_12_days(spark, sf):
    daily = events(spark, sf).groupBy(
        F.col("user_id").alias("device_id"), floor_to(F.col("ts"), DAY).alias("time_window")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    rows = sequences(daily, ["n", "v"], 12).select("device_id", "time_window", F.posexplode("sequence").alias("step", "row"))
    return rows.select(
        "device_id", "time_window", "step", F.get("row", F.lit(0)).alias("n_events"),
        F.round(F.get("row", F.lit(1)), 4).alias("total_value"),
    )


# ---- two-sided flow features ------------------------------------------------------------

FLOW_OPTIONS = dict(
    src="l_suppkey", dst="l_partkey", ts="l_shipdate", sent="l_extendedprice", received="l_quantity",
    protocol="l_returnflag", arp="A", icmp="N", small_bytes=20000,
)
SIDES_SQL = f"""
WITH ends AS (
  SELECT 'src' AS side, l_suppkey AS device_id, l_partkey AS dst, {bucket('30 days', 'l_shipdate')} AS time_window, * FROM lineitem
  UNION ALL
  SELECT 'dst', l_partkey, l_partkey, {bucket('30 days', 'l_shipdate')}, * FROM lineitem),
gaps AS (
  SELECT device_id, time_window, side, epoch_us(t - lag(t) OVER (PARTITION BY device_id, time_window, side ORDER BY t)) / 1e6 AS gap
  FROM (SELECT DISTINCT device_id, time_window, side, l_shipdate AS t FROM ends)),
g AS (SELECT device_id, time_window, side, coalesce(avg(gap), 0) AS mean_iat,
   CASE WHEN count(gap) = 0 THEN 0.0 ELSE var_samp(gap) END AS var_iat FROM gaps GROUP BY ALL),
s AS (
  SELECT device_id, time_window, side, count(*) AS flows, sum(l_extendedprice) AS bytes_sent, sum(l_quantity) AS bytes_received,
    count(*) FILTER (l_returnflag = 'A') + count(*) FILTER (l_extendedprice < 20000 AND dst % 10 = 5) AS arp_request_count,
    count(*) FILTER (l_returnflag = 'N') AS icmp_unreachable_count,
    count(*) FILTER (dst % 10 = 5) / count(*) AS broadcast_packet_ratio, count(DISTINCT dst) AS num_distinct_gateways
  FROM ends GROUP BY ALL),
sides AS (SELECT * FROM s JOIN g USING (device_id, time_window, side))
"""


def flow_options():
    return {**FLOW_OPTIONS, "broadcast": F.col("l_partkey") % 10 == 5}


@query(
    SIDES_SQL
    + """SELECT device_id, time_window, side, flows, round(bytes_sent, 2) AS bytes_sent, round(bytes_received, 2) AS bytes_received,
    arp_request_count, icmp_unreachable_count, round(broadcast_packet_ratio, 6) AS broadcast_packet_ratio, num_distinct_gateways,
    round(mean_iat, 3) AS mean_inter_arrival_time, round(var_iat / 1e6, 3) AS var_inter_arrival_time FROM sides"""
)
def agg6_two_sided_flow_features(spark, sf):
    sides = ops.flow_side_features(table(spark, sf, "lineitem"), MONTH, **flow_options())
    scaled = sides.withColumn("var_inter_arrival_time", F.col("var_inter_arrival_time") / 1e6)
    return rounded(scaled, bytes_sent=2, bytes_received=2, mean_inter_arrival_time=3, var_inter_arrival_time=3)


MERGED_SQL = """SELECT device_id, time_window,
    round(coalesce(sum(bytes_sent) FILTER (side = 'src'), 0), 2) AS bytes_out,
    round(coalesce(sum(bytes_received) FILTER (side = 'src'), 0), 2) AS bytes_in,
    coalesce(sum(flows) FILTER (side = 'src'), 0)::BIGINT AS flows_out,
    round(coalesce(sum(bytes_sent) FILTER (side = 'dst'), 0), 2) AS bytes_dst,
    round(coalesce(sum(bytes_received) FILTER (side = 'dst'), 0), 2) AS bytes_received_dst,
    coalesce(sum(flows) FILTER (side = 'dst'), 0)::BIGINT AS flows_in,
    round(avg(mean_iat), 3) AS mean_inter_arrival_time, round(avg(var_iat) / 1e6, 3) AS var_inter_arrival_time,
    sum(arp_request_count)::BIGINT AS arp_request_count, sum(icmp_unreachable_count)::BIGINT AS icmp_unreachable_count,
    round(avg(broadcast_packet_ratio), 6) AS broadcast_packet_ratio, {gateways} AS num_distinct_gateways
    FROM sides GROUP BY ALL"""
MERGED_DIGITS = dict(bytes_out=2, bytes_in=2, bytes_dst=2, bytes_received_dst=2, mean_inter_arrival_time=3, var_inter_arrival_time=3)


def merged_flows(spark, sf, gateway_agg):
    merged = ops.flow_features(table(spark, sf, "lineitem"), MONTH, gateway_agg=gateway_agg, **flow_options())
    return rounded(merged.withColumn("var_inter_arrival_time", F.col("var_inter_arrival_time") / 1e6), **MERGED_DIGITS)


@query(SIDES_SQL + MERGED_SQL.format(gateways="round(avg(num_distinct_gateways), 6)"))
def agg11_merged_flow_features(spark, sf):
    return merged_flows(spark, sf, "mean")


@query(SIDES_SQL + MERGED_SQL.format(gateways="max(num_distinct_gateways)"))
def agg11_merged_flow_features_max_fanout(spark, sf):
    return merged_flows(spark, sf, "max")


def _counting(name, sql, pick):
    """The single measures of AGG7-AGG10 per source and window."""

    def run(spark, sf):
        sides = ops.flow_side_features(table(spark, sf, "lineitem"), MONTH, **flow_options())
        return rounded(sides.where("side = 'src'").select("device_id", "time_window", pick))

    run.__name__ = name
    query(sql)(run)


_FROM_LINES = f"FROM lineitem GROUP BY ALL"
_LINE_KEYS = f"l_suppkey AS device_id, {bucket('30 days', 'l_shipdate')} AS time_window"
_counting(
    "agg7_arp_count",
    f"""SELECT {_LINE_KEYS}, count(*) FILTER (l_returnflag = 'A')
      + count(*) FILTER (l_extendedprice < 20000 AND l_partkey % 10 = 5) AS arp_request_count {_FROM_LINES}""",
    "arp_request_count",
)
_counting(
    "agg8_icmp_count",
    f"SELECT {_LINE_KEYS}, count(*) FILTER (l_returnflag = 'N') AS icmp_unreachable_count {_FROM_LINES}",
    "icmp_unreachable_count",
)
_counting(
    "agg9_broadcast_ratio",
    f"SELECT {_LINE_KEYS}, round(count(*) FILTER (l_partkey % 10 = 5) / count(*), 6) AS broadcast_packet_ratio {_FROM_LINES}",
    "broadcast_packet_ratio",
)
_counting(
    "agg10_distinct_destinations",
    f"SELECT {_LINE_KEYS}, count(DISTINCT l_partkey) AS num_distinct_gateways {_FROM_LINES}",
    "num_distinct_gateways",
)


@query(
    """SELECT side, count(*) AS n, count(DISTINCT device_id) AS devices FROM (
    SELECT 'src' AS side, l_suppkey AS device_id FROM lineitem UNION ALL SELECT 'dst', l_partkey FROM lineitem) GROUP BY ALL"""
)
def set2_union_of_sides(spark, sf):
    ends = ops.two_sided(table(spark, sf, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey")
    return ends.groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("device_id").alias("devices"))


# ---- dataset features -------------------------------------------------------------------


def order_flows(spark, sf):
    status = F.col("o_orderstatus")
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("device_id"), F.col("o_orderdate").alias("timestamp"), "o_orderkey",
        F.col("o_totalprice").alias("orig_bytes"), (F.col("o_totalprice") * 0.25).alias("resp_bytes"),
        (F.col("o_orderkey") % 10).alias("orig_pkts"), (F.col("o_orderkey") % 7).alias("resp_pkts"),
        (F.col("o_orderkey") % 13).cast("double").alias("duration"),
        F.when(status == "F", 0).when(status == "O", 2).otherwise(1).alias("label"),
    )


ORDER_WINDOW = bucket("30 days", "o_orderdate")


@query(
    f"""SELECT o_custkey AS device_id, {ORDER_WINDOW} AS time_window, round(sum(o_totalprice), 2) AS orig_bytes_sum,
      round(avg(o_totalprice) + 1e-7, 4) AS orig_bytes_mean, count(o_totalprice) AS orig_bytes_count,
      round(sum(o_totalprice * 0.25) + 1e-7, 2) AS resp_bytes_sum, round(avg(o_totalprice * 0.25) + 1e-7, 4) AS resp_bytes_mean,
      sum(o_orderkey % 10)::BIGINT AS orig_pkts_sum, sum(o_orderkey % 7)::BIGINT AS resp_pkts_sum,
      round(avg(o_orderkey % 13), 6) AS duration_mean,
      arg_min(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 1 END, (o_orderdate, o_orderkey))::INTEGER AS label
    FROM orders GROUP BY ALL"""
)
def agg12_customer_month_features(spark, sf):
    out = ops.window_aggregates(order_flows(spark, sf), MONTH, first_by=["o_orderkey"])
    return out.withColumns(
        {
            "orig_bytes_sum": F.round("orig_bytes_sum", 2),
            "resp_bytes_sum": nudged(F.col("resp_bytes_sum"), 2),
            "orig_bytes_mean": nudged(F.col("orig_bytes_mean"), 4),
            "resp_bytes_mean": nudged(F.col("resp_bytes_mean"), 4),
            "duration_mean": F.round("duration_mean", 6),
        }
    )


@query(
    f"""WITH c AS (SELECT user_id AS device_id, {EVENT_DAY} AS time_window, event_type, count(*) AS n FROM events GROUP BY ALL),
    m AS (SELECT device_id, time_window, min(event_type) AS proto_mode FROM (
      SELECT *, max(n) OVER (PARTITION BY device_id, time_window) AS top FROM c) WHERE n = top GROUP BY ALL),
    a AS (SELECT user_id AS device_id, {EVENT_DAY} AS time_window, round(sum(value), 4) AS flow_bytes_out_sum,
      round(avg(value), 6) AS flow_bytes_out_mean, count(value) AS flow_count, sum(event_id % 5)::BIGINT AS flow_packets_out_sum,
      round(avg(value / 2), 6) AS flow_duration_mean FROM events GROUP BY ALL)
    SELECT * FROM a JOIN m USING (device_id, time_window)"""
)
def agg13_mode_by_user_day(spark, sf):
    flows = events(spark, sf).select(
        F.col("user_id").alias("device_id"), F.col("ts").alias("timestamp"), F.col("value").alias("orig_bytes"),
        (F.col("event_id") % 5).alias("orig_pkts"), (F.col("value") / 2).alias("duration"), F.col("event_type").alias("proto"),
    )
    out = ops.window_aggregates(flows, DAY, proto="proto", rename=True)
    return rounded(out, flow_bytes_out_sum=4)


@query(f"SELECT user_id AS device_id, {EVENT_DAY} AS time_window, count(*) AS flow_count FROM events GROUP BY ALL")
def agg14_flow_counts(spark, sf):
    return ops.window_aggregates(events(spark, sf).select("user_id", "ts"), DAY, "user_id", "ts")
