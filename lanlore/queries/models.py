"""Models over the embeddings, labels and daily event features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.times import floor_to
from ..learn import classify, clusters, fusion, isolation, sequences
from ..operators.windows import sequences as device_sequences
from .registry import DAY, query, rounded, table

WIDE = [f"x{i}" for i in range(64)]


def wide_embeddings(spark, sf, classes=2):
    """All 64 numbers as columns; the label folded to `classes` classes."""
    columns = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(WIDE)]
    return table(spark, sf, "embeddings").select("vec_id", *columns, F.pmod(F.col("label"), F.lit(classes)).cast("int").alias("label"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - (SELECT avg(l_quantity) FROM lineitem)) / (SELECT stddev_pop(l_quantity) FROM lineitem), 6) AS l_quantity,
    round((l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem)) / (SELECT stddev_pop(l_extendedprice) FROM lineitem), 6) AS l_extendedprice FROM lineitem"""
)
def mod1_standardised(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    return rounded(classify.standardised(rows, ["l_quantity", "l_extendedprice"]))


@query()
def mod2_forest(spark, sf):
    data = wide_embeddings(spark, sf, 10)
    return classify.random_forest(data, WIDE).score(data).select("vec_id", "label", "prediction", "confidence")


def _named(chosen):
    """Chosen parameters as text."""
    return F.lit(", ".join(f"{k}={v}" for k, v in sorted(chosen.items()) if k != "macro_f1"))


@query()
def mod3_tuned_forest(spark, sf):
    data = wide_embeddings(spark, sf, 2)
    model, chosen = classify.tuned_forest(data, WIDE, "vec_id")
    return model.score(data).select("vec_id", "label", "prediction", _named(chosen).alias("chosen"))


@query()
def mod3_tuned_booster(spark, sf):
    data = wide_embeddings(spark, sf, 2)
    model, chosen = classify.tuned_booster(data, WIDE, "vec_id")
    return model.score(data).select("vec_id", "label", "prediction", _named(chosen).alias("chosen"))


@query()
def mod4_boosted(spark, sf):
    data = wide_embeddings(spark, sf, 3)
    return classify.boosted(data, WIDE).score(data).select("vec_id", "label", "prediction", "confidence")


@query()
def mod5_second_booster(spark, sf):
    data = wide_embeddings(spark, sf, 2)
    return classify.second_booster(data, WIDE).score(data).select("vec_id", "label", "prediction", "confidence")


@query()
def mod6_ensemble(spark, sf):
    data = wide_embeddings(spark, sf, 2)
    members = [classify.random_forest(data, WIDE), classify.boosted(data, WIDE)]
    return classify.Ensemble(members).score(data).select("vec_id", "label", "prediction", "confidence")


@query()
def mod7_importances(spark, sf):
    return classify.random_forest(wide_embeddings(spark, sf, 10), WIDE).importances()


@query()
def ord2_top_features(spark, sf):
    from ..operators.summary import top_features

    return top_features(classify.random_forest(wide_embeddings(spark, sf, 10), WIDE).importances(), 15)


@query()
def mod10_isolation(spark, sf):
    data = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("features"), "label")
    forest = isolation.fit_isolation_forest(data.where("label <> 0"), "vec_id")
    return forest.score(data).select("vec_id", "anomaly_score", "anomaly")


def daily_sequences(spark, sf):
    daily = table(spark, sf, "events").groupBy(
        F.col("user_id").alias("device_id"), floor_to(F.col("ts"), DAY).alias("time_window")
    ).agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("v"), F.max("value").alias("top"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
    )
    return device_sequences(daily, ["n", "v", "top", "errors"], 12)


@query()
def mod11_reconstruction_error(spark, sf):
    rows = daily_sequences(spark, sf)
    model = sequences.fit_reconstruction(rows)
    return sequences.reconstruction_error(model, rows).select("device_id", "time_window", "reconstruction_error")


@query(
    """WITH f AS (SELECT user_id AS device_id, time_bucket(INTERVAL '1 day', ts, TIMESTAMP '1970-01-01') AS time_window, count(*) AS n, sum(value) AS v,
      max(value) AS top, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY ALL)
    SELECT device_id, time_window, round(avg(n) OVER w, 6) AS mean_n, round(avg(v) OVER w, 4) AS mean_v, round(avg(top) OVER w, 6) AS mean_top,
      round(avg(errors) OVER w, 6) AS mean_errors FROM f
    WINDOW w AS (PARTITION BY device_id ORDER BY time_window ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
    QUALIFY count(*) OVER w = 12"""
)
def mod12_mean_embedding(spark, sf):
    rows = sequences.mean_embedding(daily_sequences(spark, sf))
    digits = {"n": 6, "v": 4, "top": 6, "errors": 6}
    return rows.select(
        "device_id", "time_window",
        *[F.round(F.get("embedding", F.lit(i)), d).alias(f"mean_{c}") for i, (c, d) in enumerate(digits.items())],
    )


@query()
def mod13_multiview(spark, sf):
    data = wide_embeddings(spark, sf, 3)
    views = {"dhcp": WIDE[:20], "dns": WIDE[20:40], "flow": WIDE[40:], "other": []}
    model = fusion.fit_multi_view(data, views, width=16)
    return model.score(data).select("vec_id", "label", "prediction", "confidence")


def scaled_embeddings(spark, sf):
    data = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return clusters.scaled(clusters.standardise_vectors(data), data)


@query()
def mod14_kmeans(spark, sf):
    data = scaled_embeddings(spark, sf)
    return clusters.assign(clusters.kmeans(data), data).select("vec_id", "cluster")


@query(
    """WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
    d AS (SELECT a.vec_id AS a, b.vec_id AS b, list_distance(a.x, b.x) AS d FROM v a, v b),
    k AS (SELECT a, d FROM d WHERE a <> b QUALIFY row_number() OVER (PARTITION BY a ORDER BY d, b) = 4),
    curve AS (SELECT unnest(range(101)) AS i, unnest(quantile_cont(d, list_transform(range(101), lambda i: i / 100))) AS y FROM k),
    eps AS (SELECT arg_max(y, i / 100 - (y - lo) / (hi - lo)) AS eps FROM curve, (SELECT min(y) AS lo, max(y) AS hi FROM curve)),
    e AS (SELECT a, b FROM d, eps WHERE d <= eps),
    core AS (SELECT a AS id FROM e GROUP BY a HAVING count(*) >= 5),
    ce AS (SELECT a, b FROM e WHERE a IN (SELECT id FROM core) AND b IN (SELECT id FROM core)),
    reach(id, r) AS (SELECT id, id FROM core UNION SELECT ce.b, reach.r FROM reach JOIN ce ON ce.a = reach.id WHERE reach.r <= ce.b),
    comp AS (SELECT id, min(r) AS c FROM reach GROUP BY id),
    border AS (SELECT a AS id, min(c) AS c FROM e JOIN comp ON e.b = comp.id WHERE a NOT IN (SELECT id FROM core) GROUP BY a)
    SELECT vec_id, coalesce(comp.c, border.c, -1) AS cluster, comp.c IS NOT NULL AS core FROM v LEFT JOIN comp ON vec_id = comp.id LEFT JOIN border ON vec_id = border.id"""
)
def mod15_density_clusters(spark, sf):
    """All 64 numbers; the radius is the knee of the distances to the fourth nearest other vector."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    eps = clusters.density_radius(vectors, 5, "vec_id", "embedding")
    return clusters.dbscan(vectors, eps=eps, min_points=5, id="vec_id", vector="embedding")


@query()
def mod21_silhouette(spark, sf):
    data = scaled_embeddings(spark, sf)
    score = clusters.silhouette(clusters.assign(clusters.kmeans(data), data))
    return data.limit(1).select(F.lit(score).alias("silhouette"))
