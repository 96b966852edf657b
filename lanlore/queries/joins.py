"""Projections, filters, interval joins and fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import add_aliases, fill_numeric, from_unix_seconds, to_instant, to_number, to_whole
from ..functions.times import bucket_of, floor_to
from ..operators import fuse as fusion
from ..operators import project as prj
from ..operators import summary
from ..operators.intervals import label_by_sweep, merge_intervals, pair_markers
from .features import EVENT_DAY, events
from .registry import DAY, nudged, query, rounded, table

# ---- projections and filters ------------------------------------------------------------


@query(
    """SELECT l_orderkey, l_linenumber, l_suppkey AS "sIPs", l_suppkey AS orig_ip, l_partkey AS "rIPs", l_partkey AS resp_ip,
    l_quantity AS duration FROM lineitem"""
)
def prj1_alias_columns(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("sIPs"), F.col("l_partkey").alias("rIPs"), F.col("l_quantity").alias("duration")
    )
    return add_aliases(raw, {"sIPs": "orig_ip", "rIPs": "resp_ip", "duration": "duration"})


@query(
    """SELECT event_id, ts AS from_text, make_timestamp((epoch_us(ts) // 1000) * 1000) AS from_seconds FROM events"""
)
def prj4_timestamps_from_text_and_seconds(spark, sf):
    raw = events(spark, sf).select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("text"),
        (F.floor(F.unix_micros("ts") / 1000) / 1000.0).alias("seconds"),
    )
    return raw.select("event_id", to_instant(raw, "text").alias("from_text"), to_instant(raw, "seconds").alias("from_seconds"))


@query(
    """SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.k') AS DOUBLE), 0.0) AS parsed,
    coalesce(try_cast(event_type AS DOUBLE), 0.0) AS unparsed, CAST(trunc(value) AS BIGINT) AS whole FROM events"""
)
def prj5_numeric_coercion(spark, sf):
    return events(spark, sf).select(
        "event_id", to_number(F.get_json_object("props", "$.k")).alias("parsed"),
        to_number(F.col("event_type")).alias("unparsed"), to_whole(F.col("value").cast("string")).alias("whole"),
    )


PROTO = "CASE event_type WHEN 'view' THEN 'TCP' WHEN 'click' THEN 'UDP' WHEN 'error' THEN 'ICMP' WHEN 'signup' THEN 'GRE' END"


@query(
    f"""SELECT user_id, sum(CASE {PROTO} WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 ELSE 0 END)::BIGINT AS proto_sum
    FROM events GROUP BY ALL"""
)
def prj6_protocol_numbers(spark, sf):
    return events(spark, sf).groupBy("user_id").agg(F.sum(prj.protocol_number(F.expr(PROTO))).cast("bigint").alias("proto_sum"))


@query(
    f"""SELECT user_id::VARCHAR AS device_id, ts AS timestamp, CAST(trunc(value) AS BIGINT) AS orig_bytes, 0::BIGINT AS resp_bytes,
    1::BIGINT AS orig_pkts, 0::BIGINT AS resp_pkts, 0.0::DOUBLE AS duration,
    CASE {PROTO} WHEN 'TCP' THEN 6 WHEN 'UDP' THEN 17 WHEN 'ICMP' THEN 1 ELSE 0 END AS proto FROM events WHERE user_id % 10 <> 0"""
)
def prj7_packets_to_flows(spark, sf):
    source = F.when(F.col("user_id") % 10 == 0, F.lit("  ")).otherwise(F.col("user_id").cast("string"))
    packets = events(spark, sf).select(
        source.alias("Source"), F.col("ts").alias("Time"), F.col("value").cast("string").alias("Length"), F.expr(PROTO).alias("Protocol")
    )
    return prj.packets_to_flows(packets)


@query(
    """SELECT o_custkey::VARCHAR AS device_id, o_orderdate AS timestamp, CAST(trunc(o_totalprice) AS BIGINT) AS orig_bytes,
    0::BIGINT AS resp_bytes, 1::BIGINT AS orig_pkts, (o_orderkey % 5)::BIGINT AS resp_pkts, (o_orderkey % 13)::DOUBLE AS duration,
    o_orderstatus AS proto FROM orders"""
)
def prj8_connections_to_flows(spark, sf):
    log = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("id.orig_h"), F.unix_seconds("o_orderdate").cast("double").alias("ts"),
        F.col("o_totalprice").alias("orig_bytes"), (F.col("o_orderkey") % 5).alias("resp_packets"),
        (F.col("o_orderkey") % 13).alias("dur"), F.col("o_orderstatus").alias("proto"),
    )
    return prj.connections_to_flows(log)


@query(
    """SELECT o_custkey AS device_id, round(sum(o_totalprice), 2) AS flow_bytes_out_sum, round(avg(o_totalprice) + 1e-7, 4) AS flow_bytes_out_mean,
    count(*) AS flow_count FROM orders GROUP BY ALL"""
)
def prj10_renamed_features(spark, sf):
    sums = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("device_id")).agg(
        F.sum("o_totalprice").alias("orig_bytes_sum"), F.avg("o_totalprice").alias("orig_bytes_mean"), F.count(F.lit(1)).alias("orig_bytes_count")
    )
    return prj.rename_features(sums).withColumns(
        {"flow_bytes_out_sum": F.round("flow_bytes_out_sum", 2), "flow_bytes_out_mean": nudged(F.col("flow_bytes_out_mean"), 4)}
    )


@query(
    """SELECT o_orderkey, 0.0::DOUBLE AS duration_mean, o_totalprice AS orig_bytes_sum, (o_orderkey % 9)::DOUBLE AS orig_bytes_count,
    0.0::DOUBLE AS resp_pkts_sum FROM orders"""
)
def prj11_aligned_to_model(spark, sf):
    raw = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_totalprice").alias("flow_bytes_out_sum"), (F.col("o_orderkey") % 9).cast("string").alias("flow_count"), "o_orderstatus"
    )
    return prj.align_features(raw, ["duration_mean", "orig_bytes_sum", "orig_bytes_count", "resp_pkts_sum"], keep=["o_orderkey"])


@query(
    """SELECT o_orderkey, o_totalprice AS orig_bytes_sum, o_totalprice AS orig_bytes_mean, 1::BIGINT AS orig_bytes_count,
    (o_orderkey % 9)::DOUBLE AS resp_bytes_sum, (o_orderkey % 9)::DOUBLE AS resp_bytes_mean, 0.0::DOUBLE AS orig_pkts_sum,
    0.0::DOUBLE AS resp_pkts_sum, 0.0::DOUBLE AS duration_mean FROM orders"""
)
def prj12_raw_rows_as_aggregates(spark, sf):
    raw = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").alias("orig_bytes"), (F.col("o_orderkey") % 9).alias("resp_bytes"))
    return prj.raw_as_aggregates(raw)


@query(
    """SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, 0) AS balance,
    coalesce(CASE WHEN c_nationkey <> 3 THEN c_nationkey END, 0) AS nation FROM customer"""
)
def prj15_filled_numbers(spark, sf):
    holes = table(spark, sf, "customer").select(
        "c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")).alias("nation"),
    )
    return fill_numeric(holes)


@query("SELECT 'device_' || (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS device_id, event_id FROM events")
def prj16_numbered_devices(spark, sf):
    return prj.default_device(events(spark, sf).select("event_id"), order="event_id").select("device_id", "event_id")


@query("SELECT event_type, count(*) AS n FROM events WHERE user_id % 3 <> 0 GROUP BY ALL")
def flt1_nonblank_source(spark, sf):
    source = F.when(F.col("user_id") % 3 == 0, F.when(F.col("user_id") % 2 == 0, F.lit(" "))).otherwise(F.col("user_id").cast("string"))
    return prj.nonblank(events(spark, sf).withColumn("source", source), "source").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY ALL")
def flt2_ip_packets(spark, sf):
    packets = events(spark, sf).withColumn("ip.src", F.when(F.col("event_type") != "view", F.col("user_id")))
    return prj.ip_packets(packets).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id, quality FROM labels WHERE toxic = 0")
def flt3_normal_slice(spark, sf):
    return prj.normal_only(table(spark, sf, "labels"), "toxic").select("doc_id", "quality")


@query("SELECT vec_id, CASE WHEN label < 8 THEN label ELSE -1 END AS prediction FROM embeddings WHERE label < 8")
def flt4_known_slice(spark, sf):
    scored = table(spark, sf, "embeddings").select("vec_id", F.when(F.col("label") < 8, F.col("label")).otherwise(-1).alias("prediction"))
    return prj.known_only(scored)


# ---- intervals --------------------------------------------------------------------------

CHAINS_SQL = """
m AS (SELECT user_id, ts, event_id, event_type = 'error' AS s, event_type = 'signup' AS e FROM events WHERE event_type IN ('error', 'signup')),
c AS (SELECT *, sum(s::INT) OVER ({by} ORDER BY ts, event_id) AS chain FROM m),
iv AS (SELECT {key} chain, max(ts) FILTER (s) AS "start", max(ts) FILTER (e) AS "end" FROM c GROUP BY ALL
  HAVING chain > 0 AND count(*) FILTER (e) > 0)
"""
PER_USER = CHAINS_SQL.format(by="PARTITION BY user_id", key="user_id,")
GLOBAL = CHAINS_SQL.format(by="", key="")


def user_intervals(spark, sf, by=("user_id",)):
    kind = F.col("event_type")
    return pair_markers(
        events(spark, sf), kind == "error", kind == "signup", at="ts", order="ts", by=list(by), slice_by=bucket_of(F.col("ts"), 6 * 3600)
    )


@query(f'WITH {PER_USER} SELECT user_id, "start", "end" FROM iv')
def joi1_intervals_from_markers(spark, sf):
    return user_intervals(spark, sf)


@query(f'WITH {GLOBAL} SELECT "start", "end" FROM iv')
def win5_latest_start_one_chain(spark, sf):
    return user_intervals(spark, sf, by=())


MERGE_SQL = """
o AS (SELECT *, max("end") OVER ({by} ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
n AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" > reach THEN 1 ELSE 0 END) OVER ({by} ORDER BY "start", "end") AS island FROM o)
"""
TRIPS_SQL = """iv AS (SELECT l_suppkey, l_shipdate AS "start", l_shipdate + to_days(CAST(l_quantity AS INTEGER)) AS "end" FROM lineitem),"""


@query(
    f"""WITH {TRIPS_SQL} {MERGE_SQL.format(by='PARTITION BY l_suppkey')}
    SELECT l_suppkey, min("start") AS "start", max("end") AS "end" FROM n GROUP BY l_suppkey, island"""
)
def joi3_merged_intervals(spark, sf):
    spans = table(spark, sf, "lineitem").select(
        "l_suppkey", F.col("l_shipdate").alias("start"), F.timestamp_add("DAY", F.col("l_quantity").cast("int"), "l_shipdate").alias("end")
    )
    return merge_intervals(spans, by=["l_suppkey"])


LABELLED_SQL = """
SELECT event_id, user_id, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE {match} v.ts BETWEEN iv."start" AND iv."end") THEN 2 ELSE 0 END AS label
FROM events v"""


def labelled_events(spark, sf):
    flows = events(spark, sf).select("event_id", "user_id", "ts")
    return label_by_sweep(flows, user_intervals(spark, sf), "ts", by=["user_id"]).drop("ts")


@query(f"WITH {PER_USER} {LABELLED_SQL.format(match='iv.user_id = v.user_id AND')}")
def joi2_interval_labels(spark, sf):
    return labelled_events(spark, sf)


@query(
    f"""WITH {GLOBAL}
    SELECT o_orderkey, CASE WHEN EXISTS (SELECT 1 FROM iv WHERE o_orderdate + INTERVAL '9000 days' - INTERVAL '15 years' BETWEEN iv."start" AND iv."end")
    THEN 2 ELSE 0 END AS label FROM orders"""
)
def joi2_shared_intervals(spark, sf):
    kind = F.col("event_type")
    marks = events(spark, sf)
    spans = pair_markers(marks, kind == "error", kind == "signup", at="ts", order="ts", slice_by=bucket_of(F.col("ts"), DAY))
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.expr("o_orderdate + INTERVAL '9000' DAY - INTERVAL '15' YEAR").alias("ts")
    )
    return label_by_sweep(orders, spans, "ts").drop("ts")


@query(f"""WITH {PER_USER}, l AS ({LABELLED_SQL.format(match='iv.user_id = v.user_id AND')})
    SELECT label, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6) AS percent FROM l GROUP BY label""")
def agg16_label_distribution(spark, sf):
    return rounded(summary.label_distribution(labelled_events(spark, sf)))


# ---- fusion -----------------------------------------------------------------------------


def three_views(spark, sf):
    base = events(spark, sf).withColumns({"device_id": F.col("user_id"), "time_window": floor_to(F.col("ts"), DAY)})

    def view(kinds, **aggs):
        return base.where(F.col("event_type").isin(*kinds)).groupBy("device_id", "time_window").agg(*[e.alias(n) for n, e in aggs.items()])

    one = F.count(F.lit(1))
    return (
        view(["error"], dhcp_discover_count=one),
        view(["click", "view"], dns_query_count=one, mean_response_time=F.avg("value")),
        view(["purchase"], flow_count=one, label=F.max(F.when(F.col("value") > 100, 2).otherwise(0))),
    )


FUSED_SQL = f"""
WITH b AS (SELECT *, user_id AS device_id, {EVENT_DAY} AS time_window FROM events),
h AS (SELECT device_id, time_window, count(*) AS dhcp_discover_count FROM b WHERE event_type = 'error' GROUP BY ALL),
d AS (SELECT device_id, time_window, count(*) AS dns_query_count, avg(value) AS mean_response_time FROM b WHERE event_type IN ('click', 'view') GROUP BY ALL),
f AS (SELECT device_id, time_window, count(*) AS flow_count, max(CASE WHEN value > 100 THEN 2 ELSE 0 END) AS label FROM b WHERE event_type = 'purchase' GROUP BY ALL)
SELECT device_id, time_window, coalesce(dhcp_discover_count, 0) AS dhcp_discover_count, coalesce(dns_query_count, 0) AS dns_query_count,
  round(coalesce(mean_response_time, 0), 6) AS mean_response_time, coalesce(flow_count, 0) AS flow_count, coalesce(label, 0) AS label
FROM h FULL JOIN d USING (device_id, time_window) FULL JOIN f USING (device_id, time_window)"""


def fused_events(spark, sf):
    return fusion.fuse(*three_views(spark, sf), default_label=0)


@query(FUSED_SQL)
def joi4_fused_features(spark, sf):
    return rounded(fused_events(spark, sf))


@query(
    f"""WITH f AS (SELECT user_id AS device_id, {EVENT_DAY} AS time_window, count(*) AS n FROM events GROUP BY ALL),
    l AS (SELECT user_id AS device_id, {EVENT_DAY} AS time_window, 2 AS label FROM events WHERE event_type = 'error' GROUP BY ALL)
    SELECT device_id, time_window, n, coalesce(label, 0) AS label FROM f LEFT JOIN l USING (device_id, time_window)"""
)
def joi5_window_labels(spark, sf):
    base = events(spark, sf).select(F.col("user_id").alias("device_id"), floor_to(F.col("ts"), DAY).alias("time_window"), "event_type")
    counts = base.groupBy("device_id", "time_window").agg(F.count(F.lit(1)).alias("n"))
    labels = base.where("event_type = 'error'").select("device_id", "time_window", F.lit(2).alias("label")).distinct()
    return fusion.with_window_label(counts, labels)


@query(
    f"""WITH b AS (SELECT user_id AS device_id, {EVENT_DAY} AS time_window, count(*) AS n, max(value) AS top FROM events GROUP BY ALL)
    SELECT r.device_id, r.time_window, CASE WHEN r.n > 3 THEN 'busy' ELSE 'quiet' END AS misconfig_type, w.top
    FROM b r LEFT JOIN (SELECT * FROM b WHERE n > 2) w USING (device_id, time_window)"""
)
def joi6_report_with_windows(spark, sf):
    base = events(spark, sf).groupBy(F.col("user_id").alias("device_id"), floor_to(F.col("ts"), DAY).alias("time_window")).agg(
        F.count(F.lit(1)).alias("n"), F.max("value").alias("top")
    )
    kind = F.when(F.col("n") > 3, "busy").otherwise("quiet")
    report = base.select("device_id", "time_window", kind.alias("misconfig_type"))
    return fusion.report_with_windows(report, base.where("n > 2").select("device_id", "time_window", "top"))


@query(
    """SELECT c_custkey FROM customer WHERE c_custkey NOT IN (
    SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995 AND o_orderpriority = '1-URGENT')"""
)
def joi7_customers_missing_in_1995(spark, sf):
    urgent = table(spark, sf, "orders").where(
        (F.col("o_orderdate") >= "1995-01-01") & (F.col("o_orderdate") < "1996-01-01") & (F.col("o_orderpriority") == "1-URGENT")
    )
    return fusion.missing_keys(table(spark, sf, "customer"), urgent.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


# ---- summaries --------------------------------------------------------------------------

LABEL_OF = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'signup' THEN 2 WHEN 'error' THEN 3 ELSE 4 END"


@query(
    f"""WITH c AS (SELECT user_id, {EVENT_DAY} AS time_window, {LABEL_OF} AS label, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, time_window, label FROM c QUALIFY row_number() OVER (PARTITION BY user_id, time_window ORDER BY (label <> 0) DESC, n DESC, label) = 1"""
)
def agg15_label_mode(spark, sf):
    src = events(spark, sf).select("user_id", floor_to(F.col("ts"), DAY).alias("time_window"), F.expr(LABEL_OF).alias("label"))
    return summary.label_mode(src, ["user_id", "time_window"])


@query(
    """SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS proportion, (sum(count(*)) OVER ())::BIGINT AS total_samples,
    (count(*) OVER ())::BIGINT AS n_classes, round(max(count(*)) OVER () / min(count(*)) OVER (), 6) AS imbalance_ratio FROM embeddings GROUP BY label"""
)
def agg17_class_balance(spark, sf):
    return rounded(summary.class_balance(table(spark, sf, "embeddings")))


@query(
    """WITH w AS (SELECT quality, count(*) AS n FROM labels GROUP BY ALL), t AS (SELECT *, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM w)
    SELECT doc_id, quality, round(weight, 6) AS weight FROM labels JOIN t USING (quality)"""
)
def agg18_class_weights(spark, sf):
    return rounded(summary.with_class_weight(table(spark, sf, "labels"), "quality").select("doc_id", "quality", "weight"))


@query(
    """WITH w AS (SELECT label, count(*) AS n FROM embeddings WHERE label <> 4 GROUP BY ALL), t AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM w)
    SELECT i::INTEGER AS label, round(coalesce(weight, 1.0), 6) AS weight FROM range(10) r(i) LEFT JOIN t ON t.label = r.i"""
)
def agg18_weights_with_absent_class(spark, sf):
    return rounded(summary.class_weights(table(spark, sf, "embeddings").where("label <> 4"), num_classes=10))


@query(
    f"""SELECT * REPLACE (coalesce(click, 0) AS click, coalesce(error, 0) AS error, coalesce(purchase, 0) AS purchase, coalesce(signup, 0) AS signup, coalesce("view", 0) AS "view")
    FROM (PIVOT (SELECT {EVENT_DAY} AS time_window, event_type FROM events) ON event_type IN ('click', 'error', 'purchase', 'signup', 'view') USING count(*))"""
)
def agg20_pivot_by_day(spark, sf):
    src = events(spark, sf).select(floor_to(F.col("ts"), DAY).alias("time_window"), "event_type")
    return summary.counts_by_window(src, "time_window", "event_type", ["click", "error", "purchase", "signup", "view"])


@query(
    """SELECT event_type, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q1, round(quantile_cont(value, 0.5), 6) AS median,
    round(quantile_cont(value, 0.75), 6) AS q3, max(value) AS max FROM events GROUP BY ALL"""
)
def agg21_quartiles(spark, sf):
    return rounded(summary.confidence_quartiles(events(spark, sf), "event_type", "value"))


@query(
    """SELECT count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT event_type) AS distinct_event_type,
    count(DISTINCT json_extract_string(props, '$.k')) AS distinct_k FROM events"""
)
def agg23_distinct_counts(spark, sf):
    src = events(spark, sf).select("user_id", "event_type", F.get_json_object("props", "$.k").alias("k"))
    return summary.distinct_counts(src, ["user_id", "event_type", "k"])


@query("SELECT user_id FROM events EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 150")
def set4_except_devices(spark, sf):
    everything = events(spark, sf)
    return fusion.missing_keys(everything, everything.where("event_type = 'purchase' AND value > 150"), "user_id")


@query("SELECT event_id, user_id, value FROM events ORDER BY event_id LIMIT 20")
def ord5_head_preview(spark, sf):
    return events(spark, sf).orderBy("event_id").limit(20).select("event_id", "user_id", "value")
