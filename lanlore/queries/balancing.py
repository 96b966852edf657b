"""Splits, resampling and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import balance as bal
from ..operators.knn import nearest
from .registry import query, rounded, table

RANKED_SQL = "r AS (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY doc_id) - 1 AS rk, count(*) OVER (PARTITION BY quality) AS size FROM labels)"


@query(f"WITH {RANKED_SQL} SELECT doc_id, quality, rk < round(size * 0.2) AS is_test FROM r")
def bal1_stratified_split(spark, sf):
    split = bal.stratified_split(table(spark, sf, "labels"), "doc_id", "quality", 0.2, order="doc_id")
    return split.select("doc_id", "quality", "is_test")


@query(f"WITH {RANKED_SQL} SELECT doc_id, quality FROM r WHERE rk < (SELECT min(size) FROM r)")
def bal7_undersample(spark, sf):
    return bal.undersample(table(spark, sf, "labels"), "doc_id", "quality", order="doc_id").select("doc_id", "quality")


@query(
    f"""WITH {RANKED_SQL}, c AS (SELECT min(size) AS size, max(size) // min(size) AS rounds, arg_min(quality, size) AS minor FROM r)
    SELECT doc_id, quality, (rk // c.size)::INTEGER AS round_id FROM r, c WHERE quality <> minor AND rk // c.size < rounds
    UNION ALL SELECT doc_id, quality, unnest(range(rounds))::INTEGER FROM r, c WHERE quality = minor"""
)
def bal8_repeated_undersample(spark, sf):
    out = bal.repeated_undersample(table(spark, sf, "labels"), "doc_id", "quality", order="doc_id")
    return out.select("doc_id", "quality", "round_id")


@query(
    """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    d AS (SELECT a.vec_id, b.vec_id AS neighbor, list_distance(a.x, b.x) AS distance FROM v a, v b WHERE a.vec_id <> b.vec_id)
    SELECT vec_id, (row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbor))::INTEGER AS rank, neighbor, round(distance, 6) AS distance
    FROM d QUALIFY rank <= 3"""
)
def bal9_knn_top3(spark, sf):
    vectors = table(spark, sf, "embeddings")
    found = nearest(vectors, vectors, 3, "vec_id", "embedding")
    return rounded(
        found.select("vec_id", F.posexplode("neighbors").alias("i", "nn")).select(
            "vec_id", (F.col("i") + 1).alias("rank"), F.col("nn.id").alias("neighbor"), F.col("nn.distance").alias("distance")
        )
    )


@query("SELECT CASE WHEN max(n) / min(n) > 2 THEN 'smote' ELSE 'none' END AS method FROM (SELECT quality, count(*) AS n FROM labels GROUP BY ALL)")
def bal10_method_choice(spark, sf):
    labels = table(spark, sf, "labels")
    method = bal.choose_method(labels, "quality")
    return labels.limit(1).select(F.lit(method).alias("method"))


FEATURES = [f"x{i}" for i in range(64)]


def imbalanced(spark, sf):
    """Every embedding, its 64 numbers as features; labels 0-7 against 8 and 9."""
    numbers = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(FEATURES)]
    label = F.when(F.col("label") >= 8, 2).otherwise(0)
    return table(spark, sf, "embeddings").select(
        "vec_id", F.concat(F.lit("device_"), F.col("vec_id")).alias("device_id"), *numbers, label.alias("label")
    )


def _tally(out):
    """What a resampling did, per label and kind of row."""
    return out.groupBy("label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


SIZES = "WITH c AS (SELECT CASE WHEN label >= 8 THEN 2 ELSE 0 END AS label, count(*) AS n FROM embeddings GROUP BY ALL)"


@query(
    f"""{SIZES} SELECT label, false AS synthetic, n FROM c UNION ALL
    SELECT label, true, (SELECT max(n) FROM c) - n FROM c WHERE n < (SELECT max(n) FROM c)"""
)
def bal2_smote_counts(spark, sf):
    return _tally(bal.smote(imbalanced(spark, sf), FEATURES, "vec_id"))


@query()
def bal2_smote(spark, sf):
    return bal.smote(imbalanced(spark, sf), FEATURES, "vec_id")


@query()
def bal3_adasyn(spark, sf):
    return bal.adasyn(imbalanced(spark, sf), FEATURES, "vec_id")


@query()
def bal4_borderline_smote(spark, sf):
    return bal.borderline_smote(imbalanced(spark, sf), FEATURES, "vec_id")


@query()
def bal5_smote_enn(spark, sf):
    return bal.smote_enn(imbalanced(spark, sf), FEATURES, "vec_id")


@query()
def bal6_smote_tomek(spark, sf):
    return bal.smote_tomek(imbalanced(spark, sf), FEATURES, "vec_id")


NEIGHBOURS_SQL = """
v AS (SELECT vec_id, embedding::DOUBLE[] AS x, CASE WHEN label >= 8 THEN 2 ELSE 0 END AS label FROM embeddings),
d AS (SELECT a.vec_id, a.label, b.vec_id AS nn, b.label AS nl, list_distance(a.x, b.x) AS d FROM v a, v b WHERE a.vec_id <> b.vec_id),
k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, nn) AS r FROM d)"""


@query(f"WITH {NEIGHBOURS_SQL} SELECT vec_id, label FROM k WHERE r <= 3 GROUP BY ALL HAVING count(*) FILTER (label <> nl) = 0")
def bal5_edited_neighbours_whole(spark, sf):
    return bal.drop_mislabelled(imbalanced(spark, sf), FEATURES, "vec_id").select("vec_id", "label")


@query(
    f"""WITH {NEIGHBOURS_SQL}, f AS (SELECT * FROM k WHERE r = 1)
    SELECT vec_id, label FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.vec_id = f.nn AND g.nn = f.vec_id AND g.label <> f.label)"""
)
def bal6_without_tomek_links_whole(spark, sf):
    return bal.drop_tomek_links(imbalanced(spark, sf), FEATURES, "vec_id").select("vec_id", "label")
