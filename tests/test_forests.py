"""Forests of a grid grown side by side against Spark's own trees."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from lanlore.learn import boosting, forests, search

from .test_boosting import ready  # noqa: F401


def forest(**params):
    return RandomForestClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", seed=3, **params)


@pytest.mark.parametrize("parts, rows_of_a_task", [(1, 100_000), (3, 100_000), (3, 40)])
def test_every_depth_of_one_tree_is_sparks_tree(ready, monkeypatch, parts, rows_of_a_task):  # noqa: F811
    monkeypatch.setattr(forests, "ROWS_OF_A_TASK", rows_of_a_task)
    table = search.in_parts(ready, 200 if parts == 3 else 1000)
    plain, want = forest(bootstrap=False), {}
    points = search.grid_points({"numTrees": [1], "maxDepth": [2, 5], "minInstancesPerNode": [1, 10]})
    got = {(c, a, p): n for c, a, p, n, f in forests.held_out_counts(table, plain, points, 2, "label_index", "fold") if f == 0}
    for c, point in enumerate(points):
        model = plain.fit(table.where("fold <> 0"), {plain.getParam(k): v for k, v in point.items()})
        for r in model.transform(table.where("fold = 0")).groupBy("label_index", "prediction").count().collect():
            want[c, int(r[0]), int(r[1])] = r["count"]
    assert got == want


def test_votes_are_the_shares_of_sparks_joined_leaves(ready):  # noqa: F811
    table, depths = search.in_parts(ready, 1000), [1, 3, 6, 30]
    found = boosting.thresholds(table, 2, 32, "features", "weight", "fold")
    rows = table.select(vector_to_array("features"), "label_index", "weight", "fold").collect()
    block = next(b for _, b in boosting._blocks(found, [(0, [0])], False)(0, rows))
    plan = forests.Plan([(0, 1)], 1, [1], depths, 2, 1 + max(len(c) for of in found for c in of), 12, 0.0, False, 3)
    ((_, piece),) = forests._pieces(block, plan, {})
    votes = forests._votes(plan, piece, 0, False, 1, (0, 0))
    for k, depth in enumerate(depths):
        model = forest(bootstrap=False, numTrees=1, maxDepth=depth).fit(table.where("fold <> 0"))
        want = [r[0] for r in model.transform(table).where("fold = 0").select(vector_to_array("probability")).collect()]
        assert np.isclose(votes[:, k], want).all(axis=1).mean() == 1, depth


def test_a_search_grows_no_forest_per_candidate_and_agrees_on_reruns(ready, monkeypatch):  # noqa: F811
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: pytest.fail("a candidate was fitted alone"))
    grid = {"numTrees": [2, 4], "maxDepth": [2, 30], "minInstancesPerNode": [1, 4]}
    (_, _, one), (_, _, two) = (search.nested_search(ready, forest(), grid, 2, 4) for _ in range(2))
    assert len(one) == 8 and one == two and len({s for _, s in one}) > 4


def test_bags_and_chosen_features_are_drawn_for_each_tree(ready):  # noqa: F811
    plan = forests.Plan([(0, 1)], 2, [2], [2], 2, 32, 8, 0.0, True, 3)
    block = boosting.Block(0, [0], np.zeros((5000, 1)), np.ones(5000), np.ones(5000), np.zeros(5000, bool), np.zeros((0, 5000)))
    one, two = (forests._draws(plan, block, t) for t in range(2))
    assert (one != two).any() and abs(one.mean() - 1) < 0.1 and abs((one == 0).mean() - np.exp(-1)) < 0.03
    chosen = forests._subsets(plan, 64, 500, 0, 0)
    assert chosen.shape == (500, 8) and all(len(set(c)) == 8 for c in chosen.tolist()) and len(np.unique(chosen)) == 64


def test_a_tree_grown_in_a_task_is_sparks(ready):  # noqa: F811
    table = search.in_parts(ready, 200).withColumn("label_index", F.col("label_index") + 2 * (F.abs(F.hash("features")) % 2))
    one = forest(bootstrap=False, numTrees=1, maxDepth=5, minInstancesPerNode=3)
    want, got = one.fit(table), search.grow_forest(table, one)
    assert got.numClasses == want.numClasses == 4 and got.getNumTrees == 1 and got.getMaxDepth() == 5
    assert got.toDebugString.split("\n")[1:] == want.toDebugString.split("\n")[1:]
    assert np.allclose(got.featureImportances.toArray(), want.featureImportances.toArray())
    both = [[tuple(r.probability) for r in m.transform(table).collect()] for m in (got, want)]
    assert np.allclose(*both)


def test_a_forest_grown_in_tasks_sends_rows_once_a_task(ready, monkeypatch):  # noqa: F811
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda *_: pytest.fail("Spark's fit was asked for"))
    monkeypatch.setattr(forests, "_pieces", lambda *_: pytest.fail("rows were dealt out tree by tree"))
    table = search.in_parts(ready, 200)
    model = search.grow_forest(table, forest(numTrees=40, maxDepth=6))
    assert model.getNumTrees == 40 and len({t.numNodes for t in model.trees}) > 1
    assert model.transform(table).where("prediction = label_index").count() > 0.8 * table.count()
    points = search.grid_points({"numTrees": [10, 20], "maxDepth": [3, 30]})
    assert sum(n for *_, n, _ in forests.held_out_counts(table, forest(), points, 2, "label_index", "fold")) == 4 * table.count()


def test_nodes_searched_a_few_at_a_time_split_the_same(ready, monkeypatch):  # noqa: F811
    table = search.in_parts(ready, 1000)
    one = forest(numTrees=5, maxDepth=8)
    whole = search.grow_forest(table, one).toDebugString
    monkeypatch.setattr(forests, "CELLS", 1)
    assert search.grow_forest(table, one).toDebugString.split("\n")[1:] == whole.split("\n")[1:]


def test_constant_features_make_a_leaf_and_missing_numbers_are_refused_as_by_spark(spark):
    from pyspark.ml.functions import array_to_vector

    def table(number):
        vector = array_to_vector(F.array(F.lit(2.0), F.lit(number)))
        return spark.range(40).select(vector.alias("features"), (F.col("id") % 2).cast("double").alias("label_index"), F.lit(1.0).alias("weight"))

    assert [t.numNodes for t in search.grow_forest(table(1.0), forest(numTrees=3)).trees] == [1, 1, 1]
    for number in (float("nan"), float("inf")):
        with pytest.raises(Exception, match="MUST NOT be NaN or Infinity"):
            search.grow_forest(table(number), forest(numTrees=3))
        with pytest.raises(Exception, match="MUST NOT be NaN or Infinity"):
            search.grow_booster(table(number), GBTClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", maxIter=2))
