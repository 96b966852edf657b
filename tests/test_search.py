"""Nested parameter search against Spark's own cross validation, and every fit once on a small table."""

import pytest
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import functions as F

from lanlore.learn import classify, search
from lanlore.session import cut_lineage

from .conftest import SF

NAMES = ["x0", "x1", "x2", "x3"]


@pytest.fixture(scope="module")
def rows(spark):
    x = [F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(NAMES)]
    data = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", *x, (F.col("label") % 2).cast("int").alias("label"))
    return cut_lineage(data.repartition(1))


@pytest.fixture(scope="module")
def ready(rows):
    vector = array_to_vector(F.array(*NAMES))
    return cut_lineage(rows.select(vector.alias("features"), F.col("label").cast("double").alias("label_index"), F.lit(1.0).alias("weight"), F.pmod("vec_id", F.lit(3)).cast("int").alias("fold")))


def test_first_rounds_and_trees_are_the_smaller_candidate(ready):
    params = {"featuresCol": "features", "labelCol": "label_index", "subsamplingRate": 0.8, "maxDepth": 3, "seed": 5}
    large, small = GBTClassifier(maxIter=6, **params).fit(ready), GBTClassifier(maxIter=2, **params).fit(ready)
    both = search.truncated(large, 2, "cut").transform(small.transform(ready))
    assert both.where("cut <> prediction").count() == 0 and "cut" in both.columns
    forest = RandomForestClassifier(featuresCol="features", labelCol="label_index", numTrees=7, seed=5).fit(ready)
    assert search.truncated(forest, 7, "cut").transform(forest.transform(ready)).where("cut <> prediction").count() == 0
    assert len(search.truncated(forest, 3, "cut").trees) == 3


@pytest.mark.parametrize(
    "estimator, grid",
    [
        (lambda: GBTClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", seed=3), {"maxIter": [2, 5], "maxDepth": [2, 3], "stepSize": [0.1, 0.5]}),
        (lambda: RandomForestClassifier(featuresCol="features", labelCol="label_index", seed=3, bootstrap=False), {"numTrees": [1], "maxDepth": [1, 4], "minInstancesPerNode": [1, 20]}),
    ],
)
def test_scores_are_those_of_plain_cross_validation(ready, estimator, grid):
    estimator = estimator()
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    plain = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=classify.MacroF1(labelCol="label_index"), numFolds=3, foldCol="fold").fit(ready)
    want = {tuple(sorted((p.name, v) for p, v in point.items())): m for point, m in zip(plain.getEstimatorParamMaps(), plain.avgMetrics)}
    chosen, score, scores = search.nested_search(ready, estimator, grid, 3, 4)
    got = {tuple(sorted(p.items())): s for p, s in scores}
    assert got == pytest.approx(want) and score == max(got.values()) and dict(chosen) in [p for p, s in scores if s == score]


def test_macro_f1_counts_classes_that_are_only_predicted(spark):
    counts = spark.createDataFrame([(0, 0, 3), (0, 1, 1), (1, 1, 2), (1, 2, 2)], "actual int, predicted int, n long")
    assert search.macro_f1(counts, []).first()[0] == pytest.approx((6 / 7 + 4 / 7 + 0) / 3)


@pytest.mark.parametrize(
    "fit",
    [
        lambda d: classify.random_forest(d, NAMES, trees=5, depth=3),
        lambda d: classify.boosted(d, NAMES, rounds=3, depth=2),
        lambda d: classify.second_booster(d, NAMES, rounds=3, depth=2),
        lambda d: classify.tuned_forest(d, NAMES, "vec_id", grid={"numTrees": [2, 4], "maxDepth": [2, 3]}, folds=2)[0],
        lambda d: classify.tuned_booster(d, NAMES, "vec_id", grid={"maxIter": [1, 3], "stepSize": [0.1]}, folds=2)[0],
    ],
)
def test_every_fit_scores_whole_tables(rows, fit):
    out = fit(rows).score(rows)
    assert out.count() == rows.count()
    assert out.where("abs(aggregate(probabilities, 0d, (a, x) -> a + x) - 1) > 1e-9 or confidence <> array_max(probabilities)").count() == 0
    assert {r[0] for r in out.select("prediction").distinct().collect()} <= {0, 1}
