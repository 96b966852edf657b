"""Parameter search over nested ensembles.

The first 100 of 200 boosting rounds are the smaller candidate exactly: a round depends on the rounds before it and on a
seed of its own. The first 100 and 200 trees of a forest of 300 are smaller forests of the same distribution (not bit for
bit those fitted alone, since bags are drawn for all trees at once). So one fit stands for every size on the grid, and the
largest is cut to the others. All candidates of a fold are scored in one pass over its rows: their predictions stand side
by side and meet in one confusion count per candidate.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Mapping, Sequence
from multiprocessing.pool import ThreadPool

from pyspark.ml.base import Estimator, Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, RandomForestClassificationModel, RandomForestClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from ..session import cut_lineage
from . import boosting, forests

#: Rows that one task of a fit reads; the number of tasks follows the table.
ROWS_PER_TASK = 20_000
#: The same where many trees grow at once: there the counts of nodes weigh more than rows.
FOREST_ROWS_PER_TASK = 200_000
#: What tells two candidates of one nested ensemble apart.
NESTED = {"RandomForestClassifier": "numTrees", "GBTClassifier": "maxIter"}


def in_parts(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """`df` written once in as many even parts as it has rows for, but no more than run at once.

    Each task of a level sends the counts of all the level's nodes, however few rows it has read, so a fit over many small
    files costs a multiple of one over few parts, and a table in one file would be one task's.
    """
    parts = min(-(-df.count() // rows_per_task), df.sparkSession.sparkContext.defaultParallelism)
    return cut_lineage(df.repartition(max(1, parts)))


def in_threads(spark: SparkSession, work: Callable, items: Sequence, threads: int) -> list:
    """`work` of each item, several at a time, in order."""
    with ThreadPool(max(1, min(threads, len(items)))) as pool:
        return pool.map(inheritable_thread_target(spark)(work), items, chunksize=1)


def fit_forest(rows: DataFrame, forest: RandomForestClassifier) -> RandomForestClassificationModel:
    """`forest` fitted as several smaller ones side by side, their trees put together.

    A task sends the counts of every node that grows, so few parts with many fits at once cost less than many parts. Each
    fit draws its bags and features from a seed of its own.
    """
    trees, seed = forest.getNumTrees(), forest.getSeed()
    fits = min(trees, max(1, rows.sparkSession.sparkContext.defaultParallelism // max(1, rows.rdd.getNumPartitions())))
    sizes = [trees // fits + (i < trees % fits) for i in range(fits)]
    jobs = [{forest.numTrees: n, forest.seed: seed + 1_000_003 * i} for i, n in enumerate(sizes)]
    models = in_threads(rows.sparkSession, lambda values: forest.fit(rows, values), jobs, fits)
    if fits == 1:
        return models[0]
    gateway = rows.sparkSession.sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml.classification
    every = [t for m in models for t in m._java_obj.trees()]
    array = gateway.new_array(ml.DecisionTreeClassificationModel, len(every))
    for i, tree in enumerate(every):
        array[i] = tree
    java = ml.RandomForestClassificationModel(models[0].uid, array, models[0].numFeatures, models[0].numClasses)
    out = RandomForestClassificationModel(java)
    models[0]._copyValues(out, {models[0].numTrees: trees, models[0].seed: seed})
    out._transfer_params_to_java()
    return out


def grow_forest(rows: DataFrame, forest: RandomForestClassifier) -> RandomForestClassificationModel:
    """`forest` with whole trees grown in tasks where their rows fit one (`forests.fit`), else as `fit_forest` does.

    Spark's fit sends the counts of every node of every level; here only finished trees leave a task. Bags and features are
    drawn for each tree at the same rates, not bit for bit as in Spark's.
    """
    return forests.fit(rows, forest) or fit_forest(rows, forest)


def grow_booster(rows: DataFrame, booster: GBTClassifier) -> GBTClassificationModel:
    """`booster` with all rounds made by one task where its rows fit one (`boosting.fit`), else by Spark, a job for each level."""
    return boosting.fit(rows, booster) or booster.fit(rows)


def truncated(model: Model, size: int, prediction: str, features: str = "features") -> Model:
    """The first `size` trees of a fitted forest or booster; gives class numbers in the column `prediction` and nothing else."""
    gateway = SparkSession.active().sparkContext._gateway
    ml = gateway.jvm.org.apache.spark.ml
    boosted = isinstance(model, GBTClassificationModel)
    kind = ml.regression.DecisionTreeRegressionModel if boosted else ml.classification.DecisionTreeClassificationModel
    trees, whole = gateway.new_array(kind, size), model._java_obj.trees()
    for i in range(size):
        trees[i] = whole[i]
    if boosted:
        weights = gateway.new_array(gateway.jvm.double, size)
        for i, w in enumerate(model.treeWeights[:size]):
            weights[i] = w
        java, wrap = ml.classification.GBTClassificationModel(f"{model.uid}_{size}", trees, weights, model.numFeatures, model.numClasses), GBTClassificationModel
    else:
        java, wrap = ml.classification.RandomForestClassificationModel(f"{model.uid}_{size}", trees, model.numFeatures, model.numClasses), RandomForestClassificationModel
    for name, value in (("featuresCol", features), ("predictionCol", prediction), ("rawPredictionCol", ""), ("probabilityCol", "")):
        java.set(java.getParam(name), value)
    out = wrap(java)
    out._transfer_params_from_java()
    return out


def grid_points(grid: Mapping[str, Sequence]) -> list[dict]:
    """All combinations, the last name varying fastest."""
    return [dict(zip(grid, values)) for values in itertools.product(*grid.values())]


def confusion(scored: DataFrame, label: str, predictions: Sequence[str]) -> DataFrame:
    """(candidate, actual, predicted, n) for many prediction columns in one aggregate."""
    pairs = F.array(*[F.struct(F.lit(i).alias("candidate"), F.col(c).cast("int").alias("predicted")) for i, c in enumerate(predictions)])
    long = scored.select(F.col(label).cast("int").alias("actual"), F.inline(pairs))
    return long.groupBy("candidate", "actual", "predicted").agg(F.count(F.lit(1)).alias("n"))


def macro_f1(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(*by, macro_f1) of confusion counts: the mean F1 of the classes that are actual or predicted; 0 where a class is never hit."""
    both = counts.withColumn("side", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("class", F.when(F.col("side"), F.col("actual")).otherwise(F.col("predicted")))
    per_class = both.groupBy(*by, "class").agg(
        F.sum("n").alias("sides"), F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits")
    )  # a hit counts on both sides, so hits / sides = 2 tp / (actual + predicted)
    return per_class.groupBy(*by).agg(F.avg(F.col("hits") / F.col("sides")).alias("macro_f1"))


def nested_search(
    prepared: DataFrame, estimator: Estimator, grid: Mapping[str, Sequence], folds: int, parallelism: int, label: str = "label_index", fold: str = "fold"
) -> tuple[dict, float, list[tuple[dict, float]]]:
    """The grid point with the best mean macro F1 over folds (the first of equals), its score, and all scores in grid order.

    `prepared` has `features`, the label, the weight and the fold. It is written once, in as many parts as it has rows for.
    """
    table = in_parts(prepared)
    nested = NESTED[type(estimator).__name__]
    points = grid_points(grid)
    side_by_side = {"maxIter": boosting, "numTrees": forests}[nested]
    if side_by_side.covers(table, estimator, grid):
        counts = table.sparkSession.createDataFrame(
            side_by_side.held_out_counts(table, estimator, points, folds, label, fold), "candidate int, actual int, predicted int, n long, fold int"
        ).where("n > 0")
        return best_point(points, counts)
    rest = [dict(t) for t in dict.fromkeys(tuple((k, v) for k, v in p.items() if k != nested) for p in points)]
    most = max(grid[nested]) if nested in grid else estimator.getOrDefault(nested)

    def fit(job: tuple[int, dict]) -> Model:
        f, params = job
        values = {estimator.getParam(k): v for k, v in {**params, nested: most}.items()}
        return estimator.fit(table.where(F.col(fold) != f), values)

    jobs = [(f, params) for f in range(folds) for params in rest]
    models = dict(zip(((f, tuple(p.items())) for f, p in jobs), in_threads(table.sparkSession, fit, jobs, parallelism)))

    def scored(f: int) -> DataFrame:
        out, names = table.where(F.col(fold) == f), []
        for i, p in enumerate(points):
            model = models[f, tuple((k, v) for k, v in p.items() if k != nested)]
            names.append(f"_prediction{i}")
            out = truncated(model, p.get(nested, most), names[-1]).transform(out)
        return confusion(out, label, names).withColumn("fold", F.lit(f))

    counts = scored(0)
    for f in range(1, folds):
        counts = counts.unionByName(scored(f))
    return best_point(points, counts)


def best_point(points: Sequence[dict], counts: DataFrame) -> tuple[dict, float, list[tuple[dict, float]]]:
    """The first point with the best mean macro F1 over folds, its score, and all scores."""
    means = macro_f1(counts, ["fold", "candidate"]).groupBy("candidate").agg(F.avg("macro_f1").alias("macro_f1"))
    values = {r["candidate"]: r["macro_f1"] for r in means.collect()}
    scores = [(p, float(values.get(i) or 0.0)) for i, p in enumerate(points)]
    best = max(range(len(points)), key=lambda i: scores[i][1])
    return points[best], scores[best][1], scores
