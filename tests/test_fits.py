"""Fits over bounded parts, side by side."""

import pytest
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lanlore.learn import classify, clusters, search

from .conftest import SF


@pytest.fixture(scope="module")
def rows(spark):
    x = [F.get("embedding", F.lit(i)).cast("double").alias(f"x{i}") for i in range(4)]
    return spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", *x, (F.col("label") % 3).cast("int").alias("label"))


def test_parts_follow_rows_and_not_files(spark, rows):
    cores = spark.sparkContext.defaultParallelism
    assert search.in_parts(rows.repartition(40)).rdd.getNumPartitions() == 1
    assert search.in_parts(rows.repartition(40), 10).rdd.getNumPartitions() == cores
    assert search.in_parts(rows, 250).rdd.getNumPartitions() == 2


def test_a_forest_in_pieces_is_one_forest(spark, rows, tmp_path):
    vector = array_to_vector(F.array("x0", "x1", "x2", "x3"))
    ready = search.in_parts(rows.select(vector.alias("features"), F.col("label").cast("double").alias("label_index")))
    model = search.fit_forest(ready, RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=13, maxDepth=4, seed=7))
    assert len(model.trees) == model.getNumTrees == 13 and len({t.toDebugString.split("\n", 1)[1] for t in model.trees}) == 13
    assert abs(sum(model.featureImportances) - 1) < 1e-9
    model.write().save(str(tmp_path / "m"))
    again = RandomForestClassificationModel.load(str(tmp_path / "m"))
    pairs = zip(*[[tuple(r) for r in m.transform(ready).select("probability", "prediction").collect()] for m in (model, again)])
    assert all(a == b for a, b in pairs) and again.getNumTrees == 13


def test_classes_are_boosted_side_by_side(spark, rows, monkeypatch):
    seen, real = [], classify.in_threads
    monkeypatch.setattr(classify, "in_threads", lambda s, work, items, threads: seen.append((list(items), threads)) or real(s, work, items, threads))
    model = classify.boosted(rows, ["x0", "x1", "x2", "x3"], rounds=2, depth=2)
    assert seen == [([0, 1, 2], 3)] and model.score(rows).count() == rows.count()


def test_starts_of_k_means_read_a_written_table_side_by_side(spark, monkeypatch):
    points = spark.range(300).select(F.array(F.pmod("id", F.lit(3)) * 10.0 + F.rand(1), F.rand(2)).alias("scaled"))
    seen, real = [], clusters.KMeans.fit
    monkeypatch.setattr(clusters.KMeans, "fit", lambda self, data: seen.append((data.storageLevel.useMemory, self.getSeed())) or real(self, data))
    at_once = []
    monkeypatch.setattr(clusters, "in_threads", lambda s, work, items, threads: at_once.append(threads) or search.in_threads(s, work, items, threads))
    model = clusters.kmeans(points, k=3, starts=5)
    assert sorted(seen) == [(False, 42 + i) for i in range(5)] and at_once == [clusters.STARTS_AT_ONCE]
    assert sorted(round(c[0]) // 10 for c in clusters.centres(model)) == [0, 1, 2]
