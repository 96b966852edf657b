"""Streams over the events table, run to the end of what is there and compared as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import floor_to
from ..operators import rules
from ..operators.intervals import label_by_intervals
from ..session import scratch_path
from ..streaming import features as st
from ..streaming.markers import label_by_markers
from ..streaming.sequences import rolling_sequences
from .features import MESSAGES
from .joins import LABELLED_SQL, PER_USER, user_intervals
from .registry import DAY, bucket, query, rounded, table

DELAY = "10 minutes"
CLOSED = "(SELECT max(ts) - INTERVAL '10 minutes' FROM events)"


def stream_of(spark, sf, name="events"):
    return st.read_stream(spark, f"{sf}/{name}.parquet")


@query(
    f"""SELECT *, time_window + INTERVAL '1 day' AS window_end FROM (SELECT user_id AS device_id, {bucket('1 day', 'ts')} AS time_window,
    count(*) FILTER (event_type = 'error') AS dhcp_discover_count, count(*) FILTER (event_type = 'click') AS dhcp_request_count,
    count(*) FILTER (event_type = 'view') AS dhcp_ack_count, count(*) FILTER (event_type = 'purchase') AS dhcp_nak_count,
    count(*) FILTER (event_type = 'signup') AS dhcp_release_count, 0::BIGINT AS dhcp_inform_count, count(*) AS dhcp_total_count
    FROM events GROUP BY ALL) WHERE time_window + INTERVAL '1 day' <= {CLOSED}"""
)
def str1_message_counts(spark, sf):
    stream = st.windowed(stream_of(spark, sf), st.dhcp_aggregates("event_type", MESSAGES), "ts", "user_id", "1 day", delay=DELAY)
    return st.to_table(stream)[0]


@query(
    f"""SELECT * FROM (SELECT user_id AS device_id, {bucket('1 day', 'ts')} AS time_window, count(*) AS dns_query_count,
    count(*) FILTER (event_type NOT IN ('view', 'click')) AS dns_failure_count, round(avg(value), 6) AS mean_response_time
    FROM events GROUP BY ALL) WHERE time_window + INTERVAL '1 day' <= {CLOSED}"""
)
def str1_dns_counts(spark, sf):
    aggregates = st.dns_aggregates("props", "event_type", "value", success="view", nxdomain="click")
    rows = st.to_table(st.windowed(stream_of(spark, sf), aggregates, "ts", "user_id", "1 day", delay=DELAY))[0]
    return rounded(rows.select("device_id", "time_window", "dns_query_count", "dns_failure_count", "mean_response_time"))


@query(
    f"""WITH w AS (SELECT *, unnest(range(4)) AS i FROM events),
    p AS (SELECT *, {bucket('6 hours', 'ts')} - i * INTERVAL '6 hours' AS time_window FROM w)
    SELECT user_id AS device_id, time_window, count(*) AS n, round(sum(value), 4) AS total FROM p
    WHERE ts < time_window + INTERVAL '1 day' GROUP BY ALL HAVING time_window + INTERVAL '1 day' <= {CLOSED}"""
)
def str2_sliding_windows(spark, sf):
    stream = st.windowed(
        stream_of(spark, sf), {"n": F.count(F.lit(1)), "total": F.sum("value")}, "ts", "user_id", "1 day", "6 hours", DELAY
    )
    return rounded(st.to_table(stream)[0].drop("window_end"), 4)


@query(
    f"""WITH g AS (SELECT *, CASE WHEN lag(ts) OVER u IS NULL OR ts >= lag(ts) OVER u + INTERVAL '8 hours' THEN 1 ELSE 0 END AS fresh
      FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g)
    SELECT user_id AS device_id, min(ts) AS session_start, max(ts) + INTERVAL '8 hours' AS session_end, count(*) AS n
    FROM s GROUP BY user_id, session HAVING session_end <= {CLOSED}"""
)
def str3_sessions(spark, sf):
    stream = st.sessions(stream_of(spark, sf), {"n": F.count(F.lit(1))}, "ts", "user_id", "8 hours", DELAY)
    return st.to_table(stream)[0]


@query("SELECT 0::BIGINT AS late_rows, count(*) AS n FROM events")
def str4_late_rows(spark, sf):
    """Late rows by all of the query's progress beside the rows read: in one batch nothing is late."""
    listener = st.LateRows()
    spark.streams.addListener(listener)
    try:
        _, run = st.to_table(st.windowed(stream_of(spark, sf), {"n": F.count(F.lit(1))}, "ts", "user_id", "1 day", delay=DELAY))
        late = listener.of(run)
    finally:
        spark.streams.removeListener(listener)
    return table(spark, sf, "events").agg(F.lit(late).cast("bigint").alias("late_rows"), F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH f AS (SELECT user_id, {bucket('1 day', 'ts')} AS w, count(*)::DOUBLE AS n, sum(value) AS v FROM events GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY w) AS i FROM f)
    SELECT a.user_id AS device_id, a.w AS time_window, (11 - (a.i - b.i))::INTEGER AS step, b.n AS n_events, round(b.v, 4) AS total_value
    FROM r a JOIN r b ON a.user_id = b.user_id AND b.i BETWEEN a.i - 11 AND a.i
    WHERE a.i >= 12 AND a.w <= (SELECT max(w) - INTERVAL '10 minutes' FROM f)"""
)
def str5_rolling_sequences(spark, sf):
    daily = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("device_id"), floor_to(F.col("ts"), DAY).alias("time_window")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"))
    folder = scratch_path(spark, "daily")
    daily.write.parquet(folder)
    stream = spark.readStream.schema(daily.schema).parquet(folder)
    rows, _ = st.to_table(rolling_sequences(stream, ["n", "v"], 12))
    steps = rows.select("device_id", "time_window", F.posexplode("sequence").alias("step", "row"))
    return steps.select(
        "device_id", "time_window", "step", F.get("row", F.lit(0)).alias("n_events"), F.round(F.get("row", F.lit(1)), 4).alias("total_value")
    )


@query(f"WITH {PER_USER} {LABELLED_SQL.format(match='iv.user_id = v.user_id AND')}")
def str6_labelled_stream(spark, sf):
    flows = stream_of(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    labelled = label_by_intervals(flows, user_intervals(spark, sf), "ts", by=["user_id"], bucket_seconds=DAY)
    return st.to_table(labelled.drop("ts"))[0]


STREAM_FEATURES = f"""f AS (SELECT * FROM (SELECT user_id AS device_id, {bucket('5 days', 'ts')} AS time_window,
    count(*) FILTER (event_type = 'error') * 4 AS dhcp_discover_count, count(*) FILTER (event_type = 'signup') AS dhcp_ack_count,
    count(*) AS dns_query_count, count(*) FILTER (value > 40) AS dns_failure_count FROM events GROUP BY ALL) WHERE time_window + INTERVAL '5 days' <= {CLOSED}),
g AS (SELECT *, dns_failure_count / dns_query_count AS ratio, dhcp_discover_count > 10 AND dhcp_ack_count < 0.5 * dhcp_discover_count AS is_dhcp FROM f)"""


def rule_features(spark, sf):
    kind = F.col("event_type")
    return st.windowed(
        stream_of(spark, sf),
        {
            "dhcp_discover_count": F.count_if(kind == "error") * 4,
            "dhcp_ack_count": F.count_if(kind == "signup"),
            "dns_query_count": F.count(F.lit(1)),
            "dns_failure_count": F.count_if(F.col("value") > 40),
        },
        "ts", "user_id", "5 days", delay=DELAY,
    )


@query(
    f"""WITH {STREAM_FEATURES} SELECT device_id, time_window,
    CASE WHEN ratio > 0.5 AND dns_query_count > 5 AND (NOT is_dhcp OR ratio > 0.7) THEN 1 WHEN is_dhcp THEN 2 ELSE 0 END AS prediction FROM g"""
)
def str7_streaming_rules(spark, sf):
    rows, _ = st.to_table(st.verdicts(rule_features(spark, sf)))
    return rows.select("device_id", "time_window", "prediction")


@query(
    f"""WITH {STREAM_FEATURES} SELECT device_id::VARCHAR AS device_id, time_window,
    CASE WHEN ratio > 0.5 AND dns_query_count > 5 AND (NOT is_dhcp OR ratio > 0.7) THEN 1 WHEN is_dhcp THEN 2 ELSE 0 END AS misconfig_label FROM g"""
)
def str8_scored_reports(spark, sf):
    folder = scratch_path(spark, "reports")
    st.score_to_table(rule_features(spark, sf), rules.rule_only, folder)
    return spark.read.parquet(folder).select("device_id", "time_window", "misconfig_label")


@query(
    f"""WITH e AS (SELECT user_id AS device_id, {bucket('1 day', 'ts')} AS time_window, event_type, value, coalesce(json_extract_string(props, '$.k'), '') AS d FROM events),
    c AS (SELECT device_id, time_window, d, count(*) AS n FROM e GROUP BY ALL),
    h AS (SELECT device_id, time_window, count(*) AS num_unique_domains, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS query_entropy FROM c GROUP BY ALL)
    SELECT e.device_id, e.time_window, count(*) AS dns_query_count, count(*) FILTER (event_type = 'view') AS dns_success_count,
      count(*) FILTER (event_type NOT IN ('view', 'click')) AS dns_failure_count, num_unique_domains, round(greatest(query_entropy, 0), 6) AS query_entropy,
      round(avg(value), 6) AS mean_response_time
    FROM e JOIN h ON e.device_id = h.device_id AND e.time_window = h.time_window WHERE e.time_window + INTERVAL '1 day' <= {CLOSED} GROUP BY ALL"""
)
def str1_dns_entropy(spark, sf):
    rows = stream_of(spark, sf).withColumn("domain", F.get_json_object("props", "$.k"))
    found = st.to_table(st.dns_features(rows, "domain", "event_type", "value", "ts", "user_id", "1 day", DELAY, success="view", nxdomain="click"))[0]
    names = ["device_id", "time_window", "dns_query_count", "dns_success_count", "dns_failure_count", "num_unique_domains", "query_entropy", "mean_response_time"]
    return rounded(found.select(*names))


@query(
    f"""SELECT * FROM (SELECT o_custkey AS device_id, {bucket('30 days', 'o_orderdate')} AS time_window, round(sum(o_totalprice), 2) AS orig_bytes_sum, round(avg(o_totalprice), 4) AS orig_bytes_mean,
    count(o_totalprice) AS orig_bytes_count, sum(o_orderkey % 5)::BIGINT AS orig_pkts_sum, round(avg(o_orderkey % 7), 6) AS duration_mean FROM orders GROUP BY ALL)
    WHERE time_window + INTERVAL '30 days' <= (SELECT max(o_orderdate) - INTERVAL '10 minutes' FROM orders)"""
)
def str1_flow_features(spark, sf):
    orders = stream_of(spark, sf, "orders").withColumns({"packets": F.col("o_orderkey") % 5, "lasted": F.col("o_orderkey") % 7})
    orders = orders.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp"))
    aggregates = st.flow_aggregates("o_totalprice", "o_totalprice", "packets", "lasted")
    found = st.to_table(st.windowed(orders, aggregates, "o_orderdate", "o_custkey", "30 days", delay=DELAY))[0]
    return rounded(found.drop("window_end", "resp_bytes_sum"), 6, orig_bytes_sum=2, orig_bytes_mean=4)


@query(
    """WITH w AS (SELECT least(max(ts), max(ts) FILTER (event_type IN ('error', 'signup'))) - INTERVAL '10 minutes' AS wm FROM events),
    e AS (SELECT event_id, user_id, ts, event_type, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts) AS chain FROM events, w WHERE ts <= wm),
    s AS (SELECT user_id, chain, min(ts) FILTER (event_type = 'error') AS started FROM e WHERE chain > 0 GROUP BY ALL),
    c AS (SELECT s.user_id, s.chain, started, (SELECT max(ts) FROM e x WHERE x.user_id = s.user_id AND x.chain = s.chain AND x.event_type = 'signup' AND x.ts <= started + INTERVAL '3 days') AS ended FROM s)
    SELECT e.event_id, e.user_id, (CASE WHEN e.ts <= ended THEN 2 ELSE 0 END)::INTEGER AS label FROM e JOIN w ON true LEFT JOIN c ON c.user_id = e.user_id AND c.chain = e.chain
    WHERE NOT (e.chain > 0 AND e.ts > coalesce(ended, TIMESTAMP '1900-01-01') AND e.ts <= started + INTERVAL '3 days' AND wm <= started + INTERVAL '3 days'
      AND NOT EXISTS (SELECT 1 FROM s n WHERE n.user_id = e.user_id AND n.chain > e.chain))"""
)
def str6_marker_stream(spark, sf):
    """Errors start and sign-ups end a user's intervals; both sides are streams. What is not sure at the end stays in state."""
    events = stream_of(spark, sf).select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    markers = events.where("event_type IN ('error', 'signup')").select("user_id", "ts", (F.col("event_type") == "error").alias("is_start"))
    labelled = label_by_markers(events.drop("event_type"), markers, "ts", by=["user_id"], delay=DELAY, longest=3 * DAY)
    return st.to_table(labelled)[0].select("event_id", "user_id", "label")
