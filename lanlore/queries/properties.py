"""What must hold for every row that a fitted model or a resampling gives, whatever the fit: true for each, as in the SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..learn import classify, clusters, fusion, isolation, sequences
from ..operators import balance as bal
from ..operators import openset
from ..operators.summary import top_features
from ..session import cut_lineage
from .balancing import FEATURES, imbalanced
from .models import WIDE, daily_sequences, scaled_embeddings, wide_embeddings
from .registry import bucket, query, table

EACH_VECTOR = "SELECT vec_id, true AS sums_to_one, true AS most_is_confidence, true AS winner_is_prediction FROM embeddings"


def probabilities_hold(scored, classes):
    """Shares in [0, 1] that sum to one; the confidence is the largest, the prediction the class it belongs to."""
    p, ids = F.col("probabilities"), F.array(*[F.lit(int(c)) for c in classes])
    whole = F.abs(F.aggregate(p, F.lit(0.0), lambda a, x: a + x) - 1) < 1e-9
    return scored.select(
        "vec_id", (whole & F.forall(p, lambda x: x.between(0, 1)) & (F.size(p) == len(classes))).alias("sums_to_one"), (F.col("confidence") == F.array_max(p)).alias("most_is_confidence"),
        F.exists(F.arrays_zip(p.alias("p"), ids.alias("c")), lambda x: (x["c"] == F.col("prediction")) & (x["p"] == F.col("confidence"))).alias("winner_is_prediction"),
    )


def _classifier(fit, classes):
    def run(spark, sf):
        data = wide_embeddings(spark, sf, classes)
        model = fit(data)
        return probabilities_hold(model.score(data), model.classes)

    return run


for _name, _fit, _classes in (
    ("mod2_forest_holds", lambda d: classify.random_forest(d, WIDE), 10),
    ("mod4_boosted_holds", lambda d: classify.boosted(d, WIDE), 3),
    ("mod5_second_booster_holds", lambda d: classify.second_booster(d, WIDE), 2),
    ("mod13_multiview_holds", lambda d: fusion.fit_multi_view(d, {"dhcp": WIDE[:20], "dns": WIDE[20:40], "flow": WIDE[40:], "other": []}, width=16), 3),
):
    _run = _classifier(_fit, _classes)
    _run.__name__ = _name
    query(EACH_VECTOR)(_run)


@query("SELECT count(*) > 0 AS none_negative, true AS sum_to_one, 64::BIGINT AS n, 15::BIGINT AS n_top, true AS top_are_largest FROM embeddings")
def mod7_importances_hold(spark, sf):
    """Importances of all features sum to one; the top of them are no less important than any other."""
    found = cut_lineage(classify.random_forest(wide_embeddings(spark, sf, 10), WIDE).importances())
    top = top_features(found, 15)
    least = top.agg(F.min("importance")).scalar()
    rest = found.join(top.select("feature"), "feature", "left_anti").agg(F.coalesce(F.max("importance"), F.lit(0.0))).scalar()
    return found.agg(
        (F.min("importance") >= 0).alias("none_negative"), (F.abs(F.sum("importance") - 1) < 1e-9).alias("sum_to_one"), F.count(F.lit(1)).alias("n"),
    ).withColumns({"n_top": F.lit(top.count()).cast("long"), "top_are_largest": least >= rest})


@query("SELECT count(*) AS normal, true AS share_is_the_contamination, true AS signs_agree FROM embeddings WHERE label <> 0")
def mod10_isolation_holds(spark, sf):
    """Of the rows it was fitted on, the share named by the contamination is flagged, and flags are the sign of the score."""
    data = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label").where("label <> 0")
    scored = isolation.fit_isolation_forest(data, "vec_id").score(data)
    off = F.abs(F.count_if(F.col("anomaly") == -1) - 0.05 * F.count(F.lit(1)))
    return scored.agg(
        F.count(F.lit(1)).alias("normal"), (off <= 1).alias("share_is_the_contamination"), F.bool_and((F.col("anomaly") == -1) == (F.col("anomaly_score") < 0)).alias("signs_agree")
    )


@query(
    f"""WITH f AS (SELECT user_id AS device_id, {bucket('1 day', 'ts')} AS time_window FROM events GROUP BY ALL)
    SELECT device_id, time_window, true AS within FROM f QUALIFY count(*) OVER (PARTITION BY device_id ORDER BY time_window ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) = 12"""
)
def mod11_reconstruction_holds(spark, sf):
    """The residual is no more than the whole: an error lies between 0 and the mean square of the standardised history."""
    rows = daily_sequences(spark, sf)
    model = sequences.fit_reconstruction(rows)
    width = len(model.stages[0].mean)
    whole = model.transform(rows.withColumn("_flat", sequences._flat("sequence"))).select("device_id", "time_window", (sequences._energy(F.col("_scaled")) / width).alias("whole"))
    errors = sequences.reconstruction_error(model, rows).join(whole, ["device_id", "time_window"])
    return errors.select("device_id", "time_window", F.col("reconstruction_error").between(0, F.col("whole") + 1e-9).alias("within"))


@query("SELECT vec_id, true AS nearest FROM embeddings")
def mod14_kmeans_holds(spark, sf):
    """Every vector is in the cluster of the centre nearest to it."""
    data = scaled_embeddings(spark, sf)
    model = clusters.kmeans(data)
    centres = clusters.centres(model)
    own = F.array(*[openset.nearest_centre(F.col("scaled"), [c]) for c in centres])
    found = clusters.assign(model, data)
    return found.select("vec_id", (F.get(own, F.col("cluster")) <= openset.nearest_centre(F.col("scaled"), centres) + 1e-9).alias("nearest"))


@query("SELECT true AS between_bounds, count(*) > 0 AS known FROM embeddings")
def mod21_silhouette_holds(spark, sf):
    data = scaled_embeddings(spark, sf)
    score = clusters.silhouette(clusters.assign(clusters.kmeans(data), data))
    return data.limit(1).select(F.lit(score).between(-1, 1).alias("between_bounds"), F.lit(score is not None).alias("known"))


GROWN = "SELECT CASE WHEN label >= 8 THEN 2 ELSE 0 END AS label, true AS originals_are_the_table, true AS made_lie_among_their_class, true AS made_are_marked FROM embeddings GROUP BY 1"


def resampling_holds(out, rows, whole):
    """By label: originals are rows of the table (all of them if `whole`), made rows lie in their class's box and carry a row's device, marked."""
    box = rows.groupBy("label").agg(*[F.struct(F.min(c).alias("lo"), F.max(c).alias("hi")).alias(f"b_{c}") for c in FEATURES], F.count(F.lit(1)).alias("size"))
    inside = F.lit(True)
    for c in FEATURES:
        inside = inside & F.col(c).between(F.col(f"b_{c}.lo") - 1e-9, F.col(f"b_{c}.hi") + 1e-9)
    made = F.col("synthetic")
    marked = made == F.endswith("device_id", F.lit("_synthetic"))
    same = F.count_if(~made) == F.max("size") if whole else F.count_if(~made) <= F.max("size")
    out = out.join(F.broadcast(box), "label")  # a row a class
    known = out.where("NOT synthetic").select(*[F.col(c) for c in ("vec_id", "label", *FEATURES)]).exceptAll(rows.select("vec_id", "label", *FEATURES)).isEmpty()
    return out.groupBy("label").agg(
        (same & F.lit(known)).alias("originals_are_the_table"), F.bool_and(inside).alias("made_lie_among_their_class"), F.bool_and(marked).alias("made_are_marked")
    )


for _name, _make, _whole in (
    ("bal2_smote_holds", bal.smote, True), ("bal3_adasyn_holds", bal.adasyn, True), ("bal4_borderline_smote_holds", bal.borderline_smote, True),
    ("bal5_smote_enn_holds", bal.smote_enn, False), ("bal6_smote_tomek_holds", bal.smote_tomek, False),
):

    def _run(spark, sf, make=_make, whole=_whole):
        rows = cut_lineage(imbalanced(spark, sf))
        return resampling_holds(cut_lineage(make(rows, FEATURES, "vec_id")), rows, whole)

    _run.__name__ = _name
    query(GROWN)(_run)
