"""Boosters of a grid grown side by side against Spark's own fits."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from lanlore.learn import boosting, search

from .conftest import SF


@pytest.fixture(scope="module")
def ready(spark):
    data = spark.read.parquet(f"{SF}/embeddings.parquet")
    vector = array_to_vector(F.slice(F.col("embedding").cast("array<double>"), 1, 12))
    weight = F.when(F.col("label") % 2 == 0, 1.25).otherwise(0.8)
    return data.select(vector.alias("features"), (F.col("label") % 2).cast("double").alias("label_index"), weight.alias("weight"), F.pmod("vec_id", F.lit(2)).cast("int").alias("fold"))


def booster():
    return GBTClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", seed=3)


@pytest.mark.parametrize("parts", [1, 3])
def test_margins_are_those_of_sparks_booster(ready, parts):
    table = search.in_parts(ready, 200 if parts == 3 else 1000)
    assert table.rdd.getNumPartitions() == parts
    points = search.grid_points({"maxIter": [2, 6], "maxDepth": [2, 4], "stepSize": [0.3]})
    got = {(c, a, p): n for c, a, p, n, f in boosting.held_out_counts(table, booster(), points, 2, "label_index", "fold") if n and f == 0}
    plain, want = booster(), {}
    for c, point in enumerate(points):
        model = plain.fit(table.where("fold <> 0"), {plain.getParam(k): v for k, v in point.items()})
        for r in model.transform(table.where("fold = 0")).groupBy("label_index", "prediction").count().collect():
            want[c, int(r[0]), int(r[1])] = r["count"]
    assert got == want


def test_a_search_makes_no_fit_of_its_own_per_candidate(ready, monkeypatch):
    monkeypatch.setattr(GBTClassifier, "fit", lambda *_: pytest.fail("a candidate was fitted alone"))
    jobs, collect = [], type(ready.rdd).collect
    monkeypatch.setattr("pyspark.core.rdd.RDD.collect", lambda self: jobs.append(1) or collect(self))
    grid = {"maxIter": [1, 2], "maxDepth": [2, 3], "stepSize": [0.1, 0.2], "subsamplingRate": [0.8, 1.0]}
    _, _, scores = search.nested_search(ready, booster(), grid, 2, 4)
    assert len(scores) == 16 and all(0 <= s <= 1 for _, s in scores) and len(jobs) <= 2 * 3 + 2


def test_row_samples_leave_rows_out_at_their_rate_and_agree_on_reruns(ready):
    block = boosting.Block(0, [0, 1], np.zeros((4000, 1), np.uint8), np.ones(4000), np.ones(4000), np.zeros(4000, bool), np.zeros((2, 4000)))
    both = [boosting.Booster(0, 1, 0.1, 0.8), boosting.Booster(0, 1, 0.1, 1.0)]
    trees, root = [boosting.Tree(1)] * 2, np.zeros(1, int)
    sums = [{i: s[0].sum() for i, s in boosting._sums(block, both, trees, {0: root, 1: root}, 0, turn, 3, 2)} for turn in (1, 1, 2)]
    assert sums[0] == sums[1] != sums[2] and all(s[1] == 4000 and 3050 < s[0] < 3350 for s in sums)


def test_other_parameters_are_left_to_sparks_fits(ready):
    grid = {"maxIter": [1], "maxDepth": [2]}
    assert boosting.covers(ready, booster(), grid)
    assert not boosting.covers(ready, booster().setMinInstancesPerNode(5), grid) and not boosting.covers(ready, booster(), {"maxIter": [1], "maxBins": [4, 8]})


def test_whole_boosters_in_tasks_score_as_levels_of_all_do(ready, monkeypatch):
    table = search.in_parts(ready, 200)
    points = search.grid_points({"maxIter": [1, 3], "maxDepth": [3], "stepSize": [0.3], "subsamplingRate": [0.8, 1.0]})
    whole = boosting.held_out_counts(table, booster(), points, 2, "label_index", "fold")
    monkeypatch.setattr(boosting, "ROWS_OF_A_TASK", 100)
    assert sorted(whole) == sorted(boosting.held_out_counts(table, booster(), points, 2, "label_index", "fold"))


def test_a_table_that_fits_a_task_is_searched_without_a_job_for_each_level(ready, monkeypatch):
    monkeypatch.setattr(boosting, "_level_by_level", lambda *_: pytest.fail("a job for each level"))
    points = search.grid_points({"maxIter": [1, 2], "maxDepth": [3]})
    assert sum(n for *_, n, _ in boosting.held_out_counts(search.in_parts(ready), booster(), points, 2, "label_index", "fold")) == 2 * ready.count()


def test_a_booster_grown_in_a_task_is_sparks(ready, monkeypatch):
    table, one = search.in_parts(ready, 1000), booster().setMaxIter(4).setMaxDepth(4).setStepSize(0.3)
    want = one.fit(table)
    monkeypatch.setattr(GBTClassifier, "fit", lambda *_: pytest.fail("Spark's fit was asked for"))
    got = search.grow_booster(table, one)
    splits = [[line for line in m.toDebugString.split("\n")[1:] if "Predict" not in line] for m in (got, want)]
    assert splits[0] == splits[1] and got.treeWeights == want.treeWeights
    assert got.getMaxDepth() == 4 and got.numFeatures == 12 and np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    both = [[tuple(r.rawPrediction) for r in m.transform(table).collect()] for m in (got, want)]
    assert np.allclose(*both)


def test_a_booster_with_row_samples_is_left_to_spark_where_it_fits_no_task(ready, monkeypatch):
    monkeypatch.setattr(boosting, "ROWS_OF_A_TASK", 100)
    assert boosting.fit(ready, booster()) is None
    monkeypatch.undo()
    some = search.grow_booster(search.in_parts(ready), booster().setMaxIter(3).setMaxDepth(2).setSubsamplingRate(0.8))
    assert some.getNumTrees == 3 and some.treeWeights == [1.0, 0.1, 0.1]
