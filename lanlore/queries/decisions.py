"""Rules, decisions, reports and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import floor_to
from ..functions.vectors import argmax, as_doubles
from ..operators import evaluate as ev
from ..operators import openset, rules, summary
from ..operators.explain import report, short_explanation
from .registry import MONTH, bucket, query, rounded, table

# ---- rules over one feature row per user and 30-day window -------------------------------

VERDICT_SQL = f"""
base AS (
  SELECT user_id AS device_id, {bucket('30 days', 'ts')} AS time_window,
    count(*) FILTER (event_type = 'error' AND value > 20) AS dhcp_discover_count,
    count(*) FILTER (event_type = 'signup' AND value > 60) AS dhcp_ack_count,
    count(*) FILTER (value > 55) AS dns_query_count,
    count(*) FILTER (value > 80) AS dns_failure_count,
    count(*) FILTER (event_type = 'view') * 3 AS arp_request_count,
    count(*) FILTER (event_type = 'click') / count(*) AS broadcast_packet_ratio,
    count(DISTINCT CASE WHEN value > 100 THEN event_type END) AS num_distinct_gateways,
    sum(value) * 1000 AS flow_bytes_out_sum
  FROM events GROUP BY ALL),
feat AS (SELECT *, CASE WHEN dns_query_count > 0 THEN dns_failure_count / dns_query_count ELSE 0 END AS dns_failure_ratio FROM base),
cond AS (SELECT *,
    dhcp_discover_count > 10 AND dhcp_ack_count < 0.5 * dhcp_discover_count AS is_dhcp,
    dns_failure_ratio > 0.5 AND dns_query_count > 5 AS is_dns,
    arp_request_count > 50 OR (broadcast_packet_ratio > 0.3 AND arp_request_count > 20) AS is_arp,
    num_distinct_gateways > 3 AS is_gateway FROM feat),
"""


def feature_rows(spark, sf):
    v, kind = F.col("value"), F.col("event_type")
    counts = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("device_id"), floor_to(F.col("ts"), MONTH).alias("time_window")
    ).agg(
        F.count_if((kind == "error") & (v > 20)).alias("dhcp_discover_count"),
        F.count_if((kind == "signup") & (v > 60)).alias("dhcp_ack_count"),
        F.count_if(v > 55).alias("dns_query_count"),
        F.count_if(v > 80).alias("dns_failure_count"),
        (F.count_if(kind == "view") * 3).alias("arp_request_count"),
        (F.count_if(kind == "click") / F.count(F.lit(1))).alias("broadcast_packet_ratio"),
        F.count_distinct(F.when(v > 100, kind)).alias("num_distinct_gateways"),
        (F.sum("value") * 1000).alias("flow_bytes_out_sum"),
    )
    ratio = F.coalesce(F.try_divide(F.col("dns_failure_count"), F.col("dns_query_count")), F.lit(0.0))
    return counts.withColumn("dns_failure_ratio", ratio)


DETECT_SQL = """CASE WHEN is_dhcp THEN 2 WHEN is_dns THEN 1 WHEN is_arp THEN 4 WHEN is_gateway THEN 3 ELSE 0 END"""


@query(
    f"""WITH {VERDICT_SQL.rstrip().rstrip(',')} SELECT device_id, time_window, {DETECT_SQL} AS predicted_label,
    CASE WHEN is_dhcp THEN 'DHCP_MISCONFIG' WHEN is_dns THEN 'DNS_MISCONFIG' WHEN is_arp THEN 'ARP_STORM' WHEN is_gateway THEN 'GATEWAY_MISCONFIG' ELSE 'NORMAL' END AS rule_name,
    CASE WHEN {DETECT_SQL} <> 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS confidence FROM cond"""
)
def rul1_first_match(spark, sf):
    return rules.detect(feature_rows(spark, sf)).select("device_id", "time_window", "predicted_label", "rule_name", "confidence")


@query(
    f"""WITH {VERDICT_SQL.rstrip().rstrip(',')} SELECT device_id, time_window,
    CASE WHEN is_dns THEN 1 WHEN is_dhcp THEN 2 WHEN is_gateway THEN 3 WHEN is_arp THEN 4 ELSE 0 END AS label FROM cond"""
)
def rul2_pseudo_labels(spark, sf):
    return rules.pseudo_labels(feature_rows(spark, sf)).select("device_id", "time_window", "label")


GRADED_SQL = VERDICT_SQL + """
graded AS (SELECT *,
  CASE WHEN is_dns AND (NOT is_dhcp OR dns_failure_ratio > 0.7) THEN 1 WHEN is_dhcp THEN 2 WHEN is_gateway THEN 3 WHEN is_arp THEN 4 ELSE 0 END AS rule_prediction,
  CASE WHEN is_dns AND (NOT is_dhcp OR dns_failure_ratio > 0.7) THEN 0.70::DOUBLE + least(dns_failure_ratio, 1.0::DOUBLE) * 0.20::DOUBLE
    WHEN is_dhcp THEN 0.75::DOUBLE + least(dhcp_discover_count / 20, 1.0::DOUBLE) * 0.15::DOUBLE
    WHEN is_gateway THEN 0.80::DOUBLE WHEN is_arp THEN 0.75::DOUBLE + least(arp_request_count / 100, 1.0::DOUBLE) * 0.15::DOUBLE ELSE 0.85::DOUBLE END AS rule_confidence
  FROM cond)"""


@query(f"WITH {GRADED_SQL} SELECT device_id, time_window, rule_prediction, round(rule_confidence, 6) AS rule_confidence FROM graded")
def rul3_graded(spark, sf):
    out = rules.graded(feature_rows(spark, sf))
    return rounded(out.select("device_id", "time_window", "rule_prediction", "rule_confidence"))


NAMES_SQL = """CASE {c} WHEN 0 THEN 'Normal Configuration' WHEN 1 THEN 'DNS Misconfiguration' WHEN 2 THEN 'DHCP Misconfiguration'
  WHEN 3 THEN 'Gateway Misconfiguration' WHEN 4 THEN 'ARP Storm' WHEN -1 THEN 'Unknown Misconfiguration' END"""


@query(
    f"""WITH {GRADED_SQL} SELECT device_id, time_window, rule_prediction AS prediction, {NAMES_SQL.format(c='rule_prediction')} AS prediction_name,
    round(rule_confidence, 6) AS confidence, 'rule_based' AS method FROM graded"""
)
def rul4_rules_only(spark, sf):
    out = rules.rule_only(feature_rows(spark, sf))
    return rounded(out.select("device_id", "time_window", "prediction", "prediction_name", "confidence", "method"))


# a model's verdict stands in as a fixed function of the features
MODEL_SQL = GRADED_SQL + """,
model AS (SELECT *, ((dns_query_count + arp_request_count) % 5)::INTEGER AS ml_prediction,
  0.30::DOUBLE + ((dns_query_count * 7 + dhcp_discover_count * 3 + arp_request_count) % 70) / 100 AS ml_confidence FROM graded),
hybrid AS (SELECT *, rule_prediction IN (1, 2) AS p, CASE WHEN rule_prediction IN (1, 2) THEN 0.6::DOUBLE ELSE 0.4::DOUBLE END AS w FROM model),
method AS (SELECT *, CASE
  WHEN rule_confidence > 0.8 AND ml_confidence < 0.6 AND (p OR rule_confidence > 0.85) THEN 'rule_based_override'
  WHEN rule_confidence > 0.8 AND ml_confidence < 0.6 THEN 'weighted_average'
  WHEN rule_prediction = ml_prediction THEN 'combined_agreement'
  WHEN p AND rule_confidence > 0.75 THEN 'rule_based_preferred'
  WHEN ml_confidence > 0.7 AND rule_confidence < 0.7 THEN 'ml_preferred'
  WHEN rule_confidence * w > ml_confidence * (1 - w) THEN 'weighted_rule_based' ELSE 'weighted_ml' END AS method FROM hybrid),
decided AS (SELECT *,
  CASE WHEN method IN ('rule_based_override', 'rule_based_preferred', 'weighted_rule_based') THEN rule_prediction ELSE ml_prediction END AS prediction,
  CASE method WHEN 'rule_based_override' THEN rule_confidence WHEN 'weighted_average' THEN rule_confidence * 0.4::DOUBLE + ml_confidence * 0.6::DOUBLE
    WHEN 'combined_agreement' THEN least(0.95::DOUBLE, ml_confidence + 0.1::DOUBLE) WHEN 'rule_based_preferred' THEN rule_confidence * 0.9::DOUBLE
    WHEN 'weighted_rule_based' THEN rule_confidence ELSE ml_confidence END AS confidence FROM method)"""


def decided_rows(spark, sf):
    score = F.col("dns_query_count") * 7 + F.col("dhcp_discover_count") * 3 + F.col("arp_request_count")
    scored = rules.graded(feature_rows(spark, sf)).withColumns(
        {
            "ml_prediction": F.pmod(F.col("dns_query_count") + F.col("arp_request_count"), F.lit(5)).cast("int"),
            "ml_confidence": F.lit(0.30) + F.pmod(score, F.lit(70)) / 100,
        }
    )
    return rules.hybrid(scored)


@query(f"WITH {MODEL_SQL} SELECT device_id, time_window, prediction, round(confidence, 6) AS confidence, method FROM decided")
def rul5_hybrid_decision(spark, sf):
    return rounded(decided_rows(spark, sf).select("device_id", "time_window", "prediction", "confidence", "method"))


@query(
    f"""WITH {MODEL_SQL} SELECT device_id, time_window, prediction,
    CASE WHEN flow_bytes_out_sum > 10000000 THEN 'high' WHEN flow_bytes_out_sum < 1000 THEN 'low' ELSE '' END AS traffic, method FROM decided"""
)
def rul6_short_explanation(spark, sf):
    rows = decided_rows(spark, sf)
    text = short_explanation(rows, method="method")
    traffic = F.when(F.contains(text, F.lit("High outbound")), "high").when(F.contains(text, F.lit("Very low outbound")), "low").otherwise("")
    return rows.select("device_id", "time_window", "prediction", traffic.alias("traffic"), "method")


REPORT_SQL = """CASE {c} WHEN 0 THEN 'Normal Configuration' WHEN 1 THEN 'DNS Misconfiguration' WHEN 2 THEN 'DHCP Misconfiguration'
  WHEN 3 THEN 'Gateway Misconfiguration' WHEN 4 THEN 'ARP Storm / Local Misconfiguration' WHEN -1 THEN 'Unknown Misconfiguration Type' END"""

# how many parts the explanation of each row has: the head, the evidence that applies, the cause
PARTS_SQL = """1 + CASE prediction
  WHEN 1 THEN (dns_failure_ratio > 0.5)::INT + (dns_query_count > 10)::INT + 1
  WHEN 2 THEN (dhcp_discover_count > 10)::INT + (dhcp_ack_count < 0.5 * dhcp_discover_count)::INT + 1
  WHEN 3 THEN (num_distinct_gateways > 3)::INT + 1
  WHEN 4 THEN (arp_request_count > 50)::INT + (broadcast_packet_ratio > 0.3)::INT + 1 ELSE 1 END"""


@query(f"WITH {MODEL_SQL} SELECT device_id, time_window, ({PARTS_SQL})::INTEGER AS parts FROM decided")
def rul7_explanation_parts(spark, sf):
    rows = report(decided_rows(spark, sf))
    parts = F.size(F.split("explanation", r" \| "))
    return rows.select(F.col("device_id").cast("bigint").alias("device_id"), "time_window", parts.alias("parts"))


@query(
    f"""WITH {MODEL_SQL} SELECT device_id::VARCHAR AS device_id, time_window, {REPORT_SQL.format(c='prediction')} AS misconfig_type,
    prediction AS misconfig_label, round(confidence, 6) AS confidence_score FROM decided"""
)
def rul8_report(spark, sf):
    return rounded(report(decided_rows(spark, sf)).drop("explanation"))


@query(
    f"""WITH {MODEL_SQL} SELECT device_id::VARCHAR AS device_id, strftime(time_window, '%Y-%m-%d %H:%M:%S') AS time_window,
    CASE WHEN device_id % 11 = 0 THEN 'Error' ELSE {NAMES_SQL.format(c='prediction')} END AS prediction,
    CASE WHEN device_id % 11 = 0 THEN NULL WHEN method IN ('rule_based_override', 'rule_based_preferred') THEN 'Rule-Based'
      WHEN method = 'combined_agreement' THEN 'ML+Rule' WHEN method = 'ml_preferred' THEN 'ML' ELSE 'Hybrid' END AS method,
    CASE WHEN device_id % 11 = 0 THEN 'Error' WHEN prediction = 0 THEN 'Normal' ELSE 'Misconfigured' END AS status,
    CASE WHEN device_id % 11 = 0 THEN repeat('x', 200) END AS error FROM decided"""
)
def rul10_result_table(spark, sf):
    return rules.result_table(with_errors(spark, sf)).drop("confidence")


def with_errors(spark, sf):
    failed = F.when(F.col("device_id") % 11 == 0, F.repeat(F.lit("x"), F.lit(300)))
    return decided_rows(spark, sf).withColumn("error", failed)


@query(
    f"""WITH {MODEL_SQL} SELECT device_id, prediction FROM decided WHERE device_id % 11 <> 0"""
)
def flt5_valid_rows(spark, sf):
    from ..operators.project import valid_only

    return valid_only(with_errors(spark, sf)).select("device_id", "prediction")


@query(
    f"""WITH {MODEL_SQL} SELECT count(*) AS total, count(*) FILTER (device_id % 11 <> 0 AND prediction = 0) AS normal,
    count(*) FILTER (device_id % 11 <> 0 AND prediction <> 0) AS misconfigured,
    round(count(*) FILTER (device_id % 11 <> 0 AND prediction <> 0) / count(*) FILTER (device_id % 11 <> 0), 6) AS misconfig_rate,
    count(*) FILTER (device_id % 11 = 0) AS errors FROM decided"""
)
def agg22_batch_summary(spark, sf):
    return rounded(summary.batch_summary(with_errors(spark, sf)))


@query(
    f"""WITH {MODEL_SQL} SELECT {REPORT_SQL.format(c='prediction')} AS misconfig_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence
    FROM decided GROUP BY ALL"""
)
def agg19_type_summary(spark, sf):
    return rounded(summary.type_summary(report(decided_rows(spark, sf)).drop("explanation")))


# ---- scores of a two-class problem --------------------------------------------------------

SCORE_SQL = "s AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars / (d.n_chars + 2000) AS score FROM labels l JOIN documents d USING (doc_id))"
CURVE_SQL = SCORE_SQL + """,
b AS (SELECT score AS threshold, count(*) FILTER (quality = 1) AS pos, count(*) AS n FROM s GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS predicted, sum(pos) OVER () AS positives FROM b
  WINDOW w AS (ORDER BY threshold DESC)),
pr AS (SELECT *, tp / predicted AS precision, tp / positives AS recall FROM c)"""


def scored_documents(spark, sf):
    chars = F.col("n_chars")
    docs = table(spark, sf, "documents").select("doc_id", (chars / (chars + 2000)).alias("score"))
    return table(spark, sf, "labels").join(docs, "doc_id")


@query(
    f"""WITH {CURVE_SQL} SELECT round(threshold, 9) AS threshold, tp::BIGINT AS tp, predicted::BIGINT AS predicted,
    round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr"""
)
def eva1_pr_curve(spark, sf):
    curve = ev.pr_curve(scored_documents(spark, sf), "quality", "score")
    return rounded(curve.select("threshold", "tp", "predicted", "precision", "recall"), threshold=9)


def _threshold_sql(value: str) -> str:
    return f"""WITH {CURVE_SQL} SELECT round(threshold, 9) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall
    FROM pr WHERE {value} IS NOT NULL ORDER BY {value} DESC, threshold LIMIT 1"""


def _best(metric):
    def run(spark, sf):
        return rounded(ev.best_threshold(scored_documents(spark, sf), "quality", "score", 1, metric), threshold=9)

    run.__name__ = f"eva2_threshold_{metric}"
    return run


for _metric, _value in {
    "f1": "(2 * precision * recall / (precision + recall + 1e-10))",
    "precision": "(CASE WHEN recall > 0.1 THEN precision END)",
    "recall": "(CASE WHEN precision > 0.1 THEN recall END)",
    "balanced_f1": "(0.5 * precision + 0.5 * recall)",
}.items():
    query(_threshold_sql(_value))(_best(_metric))


@query(f"WITH {SCORE_SQL} SELECT doc_id, CASE WHEN score >= 0.4 THEN 1 ELSE 0 END AS prediction FROM s")
def eva3_applied_threshold(spark, sf):
    return scored_documents(spark, sf).select("doc_id", ev.apply_threshold(F.col("score"), 0.4).alias("prediction"))


@query(
    f"""WITH {CURVE_SQL}, t AS (SELECT threshold FROM pr ORDER BY 0.5 * precision + 0.5 * recall DESC, threshold LIMIT 1),
    m AS (SELECT t.threshold, count(*) FILTER (score >= t.threshold AND quality = 1) AS tp, count(*) FILTER (score >= t.threshold) AS p,
      count(*) FILTER (quality = 1) AS a FROM s, t GROUP BY ALL)
    SELECT round(threshold, 9) AS threshold, round(tp / p, 6) AS precision, round(tp / a, 6) AS recall, round(2 * tp / (p + a), 6) AS f1 FROM m"""
)
def eva4_tuned_class(spark, sf):
    return rounded(ev.tune_class(scored_documents(spark, sf), "quality", "score", 1), threshold=9)


@query(
    f"""WITH {SCORE_SQL}, r AS (SELECT quality, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS rk FROM s),
    n AS (SELECT count(*) FILTER (quality = 1) AS p, count(*) FILTER (quality <> 1) AS q, sum(rk) FILTER (quality = 1) AS ranks FROM r)
    SELECT round((ranks - p * (p + 1) / 2) / (p * q), 6) AS roc_auc FROM n"""
)
def eva9_auc(spark, sf):
    return rounded(ev.roc_auc(scored_documents(spark, sf), "quality", "score"))


@query(f"WITH {CURVE_SQL} SELECT round(sum(pos / positives * precision), 6) AS average_precision FROM pr")
def eva10_average_precision(spark, sf):
    return rounded(ev.average_precision(scored_documents(spark, sf), "quality", "score"))


# ---- nearest class mean on the embeddings -------------------------------------------------

CENTRES_SQL = """
v AS (SELECT vec_id, label, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings),
centre AS (SELECT label AS c, i, avg(x) AS m FROM v GROUP BY ALL),
dist AS (SELECT vec_id, label, c, sqrt(sum((x - m) * (x - m))) AS d FROM v JOIN centre USING (i) GROUP BY ALL),
near AS (SELECT vec_id, any_value(label) AS label, arg_min(c, d) AS nearest, min(d) AS d FROM dist GROUP BY vec_id),
known AS (SELECT vec_id, label, CASE WHEN d > 1.0 THEN -1 ELSE nearest END AS prediction FROM near)"""


def class_centres(spark, sf):
    """Class means: one 64-number row per label, read by the driver."""
    per_position = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(
        F.avg(F.col("x").cast("double")).alias("m")
    )
    rows = per_position.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("m")).orderBy("label").collect()
    return [r["label"] for r in rows], [[p["m"] for p in r["m"]] for r in rows]


def nearest_class(spark, sf):
    from ..functions.vectors import array_literal, distance

    labels, centres = class_centres(spark, sf)
    vector = as_doubles(F.col("embedding"))
    far = table(spark, sf, "embeddings").select(
        "vec_id", "label", F.array(*[distance(vector, array_literal(c)) for c in centres]).alias("distances")
    )
    ids = F.array(*[F.lit(x) for x in labels])
    return far.withColumns(
        {"nearest": F.get(ids, F.array_position("distances", F.array_min("distances")).cast("int") - 1), "distance": F.array_min("distances")}
    )


def known_or_not(spark, sf):
    scored = nearest_class(spark, sf)
    return scored.withColumn("prediction", openset.mark_unknown(F.col("nearest"), F.col("distance") > 1.0))


@query(f"WITH {CENTRES_SQL} SELECT vec_id, round(d, 6) AS distance FROM near")
def mod16_centre_distance(spark, sf):
    _, centres = class_centres(spark, sf)
    d = openset.nearest_centre(as_doubles(F.col("embedding")), centres)
    return rounded(table(spark, sf, "embeddings").select("vec_id", d.alias("distance")))


@query(
    f"""WITH {CENTRES_SQL} SELECT round(count(*) FILTER (label = prediction) / count(*), 6) AS accuracy,
    round((SELECT avg(r) FROM (SELECT count(*) FILTER (label = prediction) / count(*) AS r FROM known GROUP BY label)), 6) AS balanced_accuracy,
    round(count(*) FILTER (label <> 0 AND prediction <> 0) / count(*) FILTER (label <> 0), 6) AS misconfig_recall,
    count(*) FILTER (prediction = -1) AS unknown_count, round(count(*) FILTER (prediction = -1) / count(*), 6) AS unknown_share FROM known"""
)
def eva5_scores(spark, sf):
    return rounded(ev.scores(known_or_not(spark, sf)))


REPORT_OF_CLASSES = f"""WITH {CENTRES_SQL}, cls AS (SELECT label AS class FROM known UNION SELECT prediction FROM known),
k AS (SELECT class, (SELECT count(*) FROM known WHERE label = class AND prediction = class) AS tp, (SELECT count(*) FROM known WHERE prediction = class) AS p,
  (SELECT count(*) FROM known WHERE label = class) AS support FROM cls),
rep AS (SELECT class, CASE WHEN p > 0 THEN tp / p ELSE 0 END AS precision, CASE WHEN support > 0 THEN tp / support ELSE 0 END AS recall,
  CASE WHEN p + support > 0 THEN 2 * tp / (p + support) ELSE 0 END AS f1, support FROM k)"""


@query(f"{REPORT_OF_CLASSES} SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM rep")
def eva6_class_report(spark, sf):
    return rounded(ev.class_report(known_or_not(spark, sf)))


@query(
    f"""{REPORT_OF_CLASSES} SELECT round(avg(precision), 6) AS macro_precision, round(avg(recall), 6) AS macro_recall, round(avg(f1), 6) AS macro_f1,
    round(sum(precision * support) / sum(support), 6) AS weighted_precision, round(sum(recall * support) / sum(support), 6) AS weighted_recall,
    round(sum(f1 * support) / sum(support), 6) AS weighted_f1, sum(support)::BIGINT AS support FROM rep"""
)
def eva6_averages(spark, sf):
    return rounded(ev.averages(ev.class_report(known_or_not(spark, sf))))


PREDICTED = [-1, *range(10)]


@query(
    f"""WITH {CENTRES_SQL} SELECT label AS actual, """
    + ", ".join(f'count(*) FILTER (prediction = {p}) AS "{p}"' for p in PREDICTED)
    + " FROM known GROUP BY label"
)
def eva7_confusion(spark, sf):
    return ev.confusion_matrix(known_or_not(spark, sf), PREDICTED)


@query(
    f"""WITH {CENTRES_SQL} SELECT round(count(*) FILTER (prediction <> 0) / count(*), 6) AS misconfig_recall FROM known WHERE label <> 0"""
)
def eva8_misconfig_recall(spark, sf):
    return rounded(ev.scores(known_or_not(spark, sf)).select("misconfig_recall"))


@query(f"WITH {CENTRES_SQL} SELECT count(*) FILTER (prediction = -1) AS unknown_count, round(count(*) FILTER (prediction = -1) / count(*), 6) AS unknown_share FROM known")
def eva12_unknown_share(spark, sf):
    return rounded(ev.scores(known_or_not(spark, sf)).select("unknown_count", "unknown_share"))


MODELS_SQL = f"""WITH {CENTRES_SQL}, m AS (
    SELECT 'centroid' AS model, label, nearest AS p FROM near UNION ALL SELECT 'open_set', label, prediction FROM known
    UNION ALL SELECT 'parity', label, (vec_id % 10)::INTEGER FROM near),
    k AS (SELECT model, label, count(*) AS n, count(*) FILTER (label = p) AS hit FROM m WHERE p <> -1 GROUP BY ALL),
    cmp AS (SELECT model, sum(hit) / sum(n) AS accuracy, avg(hit / n) AS balanced_accuracy FROM k GROUP BY model)"""


def compared_models(spark, sf):
    wide = known_or_not(spark, sf).withColumn("parity", (F.col("vec_id") % 10).cast("int"))
    return ev.compare_models(wide, {"centroid": "nearest", "open_set": "prediction", "parity": "parity"})


@query(f"{MODELS_SQL} SELECT model, round(accuracy, 6) AS accuracy, round(balanced_accuracy, 6) AS balanced_accuracy FROM cmp")
def eva11_model_comparison(spark, sf):
    return rounded(compared_models(spark, sf))


@query(f"{MODELS_SQL} SELECT model, round(balanced_accuracy, 6) AS balanced_accuracy FROM cmp ORDER BY cmp.balanced_accuracy DESC, model LIMIT 1")
def ord3_best_model(spark, sf):
    return rounded(summary.best_model(compared_models(spark, sf)))


# ---- decisions from given probabilities ---------------------------------------------------

# two members' class probabilities, from all numbers of a vector: every sixth goes into one of six sums, three a member,
# which a power sets apart before they become shares


def _sums_sql(first: int) -> str:
    sums = (f"pow(list_sum(list_transform(list_filter(embedding, lambda x, i: (i - 1) % 6 = {k}), lambda x: abs(x::DOUBLE))), 8)" for k in range(first, first + 3))
    return f"[{', '.join(sums)}]"


MEMBERS_SQL = f"""
e AS (SELECT vec_id, label, {_sums_sql(0)} AS a, {_sums_sql(3)} AS b FROM embeddings),
pq AS (SELECT vec_id, label, list_transform(a, lambda x: x / (a[1] + a[2] + a[3])) AS p, list_transform(b, lambda x: x / (b[1] + b[2] + b[3])) AS q FROM e),
vote AS (SELECT vec_id, label, p, [(p[1] + q[1]) / 2, (p[2] + q[2]) / 2, (p[3] + q[3]) / 2] AS v FROM pq)"""


def member_probabilities(spark, sf):
    def part(k):
        mine = F.filter("embedding", lambda x, i: i % 6 == k)
        return F.pow(F.aggregate(mine, F.lit(0.0), lambda s, x: s + F.abs(x.cast("double"))), F.lit(8.0))

    def share(first):
        parts = [part(first + i) for i in range(3)]
        total = parts[0] + parts[1] + parts[2]
        return F.array(*[p / total for p in parts])

    rows = table(spark, sf, "embeddings").select("vec_id", "label", share(0).alias("p"), share(3).alias("q"))
    return rows.withColumn("v", openset.soft_vote(F.col("p"), F.col("q")))


@query(f"WITH {MEMBERS_SQL} SELECT vec_id, (list_position(v, list_max(v)) - 1)::INTEGER AS prediction, round(list_max(v), 6) AS confidence FROM vote")
def mod6_soft_vote(spark, sf):
    rows = member_probabilities(spark, sf)
    return rounded(rows.select("vec_id", argmax(F.col("v")).alias("prediction"), F.array_max("v").alias("confidence")))


@query(f"WITH {MEMBERS_SQL} SELECT vec_id, CASE WHEN p[3] >= 0.4 THEN 2 ELSE 0 END AS prediction FROM vote")
def mod8_custom_threshold(spark, sf):
    return member_probabilities(spark, sf).select("vec_id", ev.apply_threshold(F.get("p", F.lit(2)), 0.4, 2).alias("prediction"))


@query(
    f"""WITH {MEMBERS_SQL}, ok AS (SELECT vec_id, p, [CASE WHEN p[1] >= 0.5 THEN p[1] ELSE -1 END, CASE WHEN p[2] >= 0.3 THEN p[2] ELSE -1 END,
      CASE WHEN p[3] >= 0.6 THEN p[3] ELSE -1 END] AS o FROM vote)
    SELECT vec_id, [0, 1, 2][CASE WHEN list_max(o) >= 0 THEN list_position(o, list_max(o)) ELSE list_position(p, list_max(p)) END] AS prediction FROM ok"""
)
def mod9_class_thresholds(spark, sf):
    decided = openset.thresholded(F.col("p"), [0, 1, 2], {1: 0.3, 2: 0.6})
    return member_probabilities(spark, sf).select("vec_id", decided.alias("prediction"))


@query(f"WITH {MEMBERS_SQL} SELECT vec_id, round(list_max(p), 6) AS confidence FROM vote")
def mod22_confidence(spark, sf):
    return rounded(member_probabilities(spark, sf).select("vec_id", openset.confidence_of(F.col("p")).alias("confidence")))


@query(
    f"""WITH {MEMBERS_SQL} SELECT vec_id, unnest([0, 2, 4]) AS class_id, unnest(['Normal', 'DHCP Misconfig', 'ARP Storm']) AS class_name,
    round(unnest(p), 6) AS probability FROM vote"""
)
def rul11_class_probabilities(spark, sf):
    return rounded(rules.class_probabilities(member_probabilities(spark, sf), ["vec_id"], "p", [0, 2, 4]))


OPEN_SQL = f"""WITH {CENTRES_SQL}, {MEMBERS_SQL},
sig AS (SELECT vote.vec_id, list_max(p) AS conf, abs(vote.vec_id * 37 % 1000) / 1000 AS err, near.d, near.nearest FROM vote JOIN near USING (vec_id)),
lim AS (SELECT quantile_cont(err, 0.95) AS le, quantile_cont(d, 0.95) AS ld FROM sig)"""


def open_signals(spark, sf):
    near = nearest_class(spark, sf).select("vec_id", "nearest", F.col("distance").alias("d"))
    return member_probabilities(spark, sf).join(near, "vec_id").select(
        "vec_id", F.array_max("p").alias("conf"), (F.abs(F.col("vec_id") * 37 % 1000) / 1000).alias("err"), "d", "nearest"
    )


def _limits(spark, sf):
    return openset.calibrate(open_signals(spark, sf), ["err", "d"])


@query(f"{OPEN_SQL} SELECT vec_id, conf < 0.5 AND (err > le OR d > ld) AS unknown FROM sig, lim")
def mod17_unknown_base(spark, sf):
    limits = _limits(spark, sf)
    flag = openset.unknown_base(F.col("conf"), F.col("err"), F.col("d"), 0.5, limits["err"], limits["d"])
    return open_signals(spark, sf).select("vec_id", flag.alias("unknown"))


@query(
    f"""{OPEN_SQL}, flags AS (SELECT vec_id, (conf < 0.5)::INT + (err > le)::INT + (d > ld)::INT AS n FROM sig, lim)
    SELECT vec_id, n >= 1.5 AS majority, n >= 3 AS unanimous, n >= 1 AS any_vote FROM flags"""
)
def mod18_unknown_votes(spark, sf):
    limits = _limits(spark, sf)
    flags = [
        openset.unknown_votes(F.col("conf"), F.col("err"), F.col("d"), 0.5, limits["err"], limits["d"], voting).alias(name)
        for voting, name in (("majority", "majority"), ("unanimous", "unanimous"), ("any", "any_vote"))
    ]
    return open_signals(spark, sf).select("vec_id", *flags)


@query(f"{OPEN_SQL} SELECT round(le, 6) AS error_threshold, round(ld, 6) AS distance_threshold FROM lim")
def mod19_calibrated_thresholds(spark, sf):
    from ..operators.running import percentiles

    signals = open_signals(spark, sf)
    err = percentiles(signals, "err", [0.95]).select(F.get("percentiles", F.lit(0)).alias("error_threshold"))
    far = percentiles(signals, "d", [0.95]).select(F.get("percentiles", F.lit(0)).alias("distance_threshold"))
    return rounded(err.withColumn("distance_threshold", far.scalar()))


@query(f"{OPEN_SQL} SELECT vec_id, CASE WHEN conf < 0.5 AND (err > le OR d > ld) THEN -1 ELSE nearest END AS prediction FROM sig, lim")
def mod20_unknown_marked(spark, sf):
    limits = _limits(spark, sf)
    flag = openset.unknown_base(F.col("conf"), F.col("err"), F.col("d"), 0.5, limits["err"], limits["d"])
    return open_signals(spark, sf).select("vec_id", openset.mark_unknown(F.col("nearest"), flag).alias("prediction"))
