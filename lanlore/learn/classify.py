"""Supervised models as Spark ML pipelines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import IndexToString, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import argmax
from ..operators.balance import fold_column
from ..operators.evaluate import averages, class_report
from ..operators.openset import soft_vote
from ..operators.summary import class_balance, with_class_weight
from ..session import cut_lineage
from .search import FOREST_ROWS_PER_TASK, fit_forest, grow_booster, grow_forest, in_parts, in_threads, nested_search


def standardised(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """MOD1: each feature minus its mean over its population standard deviation; constants give 0.

    All moments come from one aggregate pass and enter as one scalar subquery.
    """
    stats = df.agg(
        F.struct(
            *[
                F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(c)
                for c in features
            ]
        )
    ).scalar()
    work = df.withColumn("_stats", stats)

    def z(c: str):
        m, s = F.col("_stats").getField(c).getField("m"), F.col("_stats").getField(c).getField("s")
        return F.when(s > 0, (F.col(c) - m) / s).otherwise(F.lit(0.0))

    return work.withColumns({c: z(c) for c in features}).drop("_stats")


def preparation(features: Sequence[str], raw: str = "raw_features", out: str = "features") -> list:
    """Assembler and scaler. Spark divides by the sample deviation, a constant factor sqrt(n/(n-1))
    from the population one: no tree split, distance order or network fit depends on it."""
    return [
        VectorAssembler(inputCols=list(features), outputCol=raw, handleInvalid="keep"),
        StandardScaler(inputCol=raw, outputCol=out, withMean=True, withStd=True),
    ]


def indexer(label: str = "label") -> StringIndexer:
    """Compact class numbers in label order, so probability slots match the classes present."""
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep")


class Classifier:
    """A fitted pipeline plus the class label of each probability slot."""

    def __init__(self, model: PipelineModel, classes: Sequence[int]):
        self.model = model
        self.classes = list(classes)

    def score(self, df: DataFrame, prefix: str = "") -> DataFrame:
        """Adds `probabilities` (array, one slot per class), `prediction` and `confidence`."""
        raw = self.model.transform(df)
        ids = F.array(*[F.lit(int(c)) for c in self.classes])
        # the indexer's extra slot for unseen labels never wins; keep the known classes only
        probabilities = F.slice(vector_to_array("probability"), 1, len(self.classes))
        return raw.withColumn("_p", probabilities).select(
            *df.columns,
            F.col("_p").alias(f"{prefix}probabilities"),
            F.get(ids, argmax(F.col("_p"))).alias(f"{prefix}prediction"),
            F.array_max("_p").alias(f"{prefix}confidence"),
        )

    def importances(self) -> DataFrame:
        """MOD7: `feature, importance` of the last stage."""
        from pyspark.sql import SparkSession

        assembler = next(s for s in self.model.stages if isinstance(s, VectorAssembler))
        values = self.model.stages[-1].featureImportances.toArray()
        rows = [(name, float(v)) for name, v in zip(assembler.getInputCols(), values)]
        return SparkSession.getActiveSession().createDataFrame(rows, "feature string, importance double")


def class_list(df: DataFrame, label: str = "label") -> list[int]:
    """The classes present, in the indexer's (alphabetical) order."""
    return sorted((r[0] for r in df.select(label).distinct().collect()), key=str)


def _clean_indexer(label: str) -> StringIndexer:
    return StringIndexer(inputCol=label, outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="skip")


def _fit_classifier(df: DataFrame, features: Sequence[str], label: str, forest: RandomForestClassifier) -> Classifier:
    indexed = _clean_indexer(label).fit(df).transform(df)
    prepared = Pipeline(stages=preparation(features)).fit(indexed)
    rows = in_parts(prepared.transform(indexed).select("features", "label_index", "weight"), FOREST_ROWS_PER_TASK)
    return Classifier(PipelineModel(stages=[*prepared.stages, fit_forest(rows, forest)]), class_list(df, label))


def random_forest(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    trees: int = 300,
    depth: int = 12,
    leaf: int = 2,
    seed: int = 42,
    **params,
) -> Classifier:
    """MOD2: a forest on standardised features with balanced class weights."""
    weighted = with_class_weight(df, label)
    forest = RandomForestClassifier(
        featuresCol="features", labelCol="label_index", weightCol="weight", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=leaf, seed=seed, **{"maxMemoryInMB": 512, **params},
    )
    return _fit_classifier(weighted, features, label, forest)


class OneVersusRest:
    """MOD4: one boosted binary model per class; class probabilities are their shares."""

    def __init__(self, models: Mapping[int, PipelineModel]):
        self.models = dict(models)
        self.classes = list(models)

    def score(self, df: DataFrame, prefix: str = "") -> DataFrame:
        out = df
        for c, model in self.models.items():
            scored = model.transform(out)
            out = scored.withColumn(f"_p{c}", F.get(vector_to_array("probability"), F.lit(1))).drop(
                "probability", "rawPrediction", "prediction_index", "features", "raw_features"
            )
        if len(self.classes) == 2:
            second = self.classes[1]
            shares = F.array(1 - F.col(f"_p{second}"), F.col(f"_p{second}"))
        else:
            total = sum((F.col(f"_p{c}") for c in self.classes[1:]), F.col(f"_p{self.classes[0]}"))
            shares = F.array(*[F.col(f"_p{c}") / total for c in self.classes])
        ids = F.array(*[F.lit(int(c)) for c in self.classes])
        return out.withColumn("_shares", shares).select(
            *df.columns,
            F.col("_shares").alias(f"{prefix}probabilities"),
            F.get(ids, argmax(F.col("_shares"))).alias(f"{prefix}prediction"),
            F.array_max("_shares").alias(f"{prefix}confidence"),
        )


def boosted(
    df: DataFrame,
    features: Sequence[str],
    label: str = "label",
    rounds: int = 200,
    depth: int = 5,
    rate: float = 0.1,
    subsample: float = 1.0,
    weighted: bool = False,
    seed: int = 42,
) -> OneVersusRest:
    """MOD4 and, with `subsample` and `weighted`, MOD5. Two classes need a single model.

    `weighted` gives the second of two classes the weight n_majority / n_minority.
    """
    classes = class_list(df, label)
    counts = {r[label]: r["n"] for r in class_balance(df, label).collect()}
    targets = classes[1:] if len(classes) == 2 else classes
    prepared = Pipeline(stages=preparation(features)).fit(df)
    rows = in_parts(prepared.transform(df).select("features", F.col(label).alias("_label")))

    def fit(c) -> PipelineModel:
        positive = max(counts.values()) / min(counts.values()) if weighted and len(classes) == 2 else 1.0
        binary = rows.select(
            "features", (F.col("_label") == c).cast("double").alias("_target"), F.when(F.col("_label") == c, positive).otherwise(1.0).alias("_weight")
        )
        booster = GBTClassifier(
            featuresCol="features", labelCol="_target", weightCol="_weight", predictionCol="prediction_index", maxIter=rounds,
            maxDepth=depth, stepSize=rate, subsamplingRate=subsample, seed=seed, maxMemoryInMB=512,
        )
        return PipelineModel(stages=[*prepared.stages, booster.fit(binary)])

    # a round's jobs are small and follow each other, so classes are fitted side by side
    models = dict(zip(targets, in_threads(rows.sparkSession, fit, targets, len(targets))))
    ensemble = OneVersusRest(models)
    ensemble.classes = classes
    return ensemble


def second_booster(df: DataFrame, features: Sequence[str], label: str = "label", **params) -> OneVersusRest:
    """MOD5: boosting on 80% row samples, the rarer class weighted up when there are two."""
    return boosted(df, features, label, **{"subsample": 0.8, "weighted": True, **params})


class Ensemble:
    """MOD6: the mean of its members' class probabilities."""

    def __init__(self, members: Sequence[Classifier | OneVersusRest]):
        self.members = list(members)
        self.classes = members[0].classes

    def score(self, df: DataFrame, prefix: str = "") -> DataFrame:
        out = df
        for i, member in enumerate(self.members):
            out = member.score(out, f"_m{i}_")
        ids = F.array(*[F.lit(int(c)) for c in self.classes])
        voted = soft_vote(*[F.col(f"_m{i}_probabilities") for i in range(len(self.members))])
        return out.withColumn("_v", voted).select(
            *df.columns,
            F.col("_v").alias(f"{prefix}probabilities"),
            F.get(ids, argmax(F.col("_v"))).alias(f"{prefix}prediction"),
            F.array_max("_v").alias(f"{prefix}confidence"),
        )


class MacroF1(Evaluator, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Unweighted mean of the classes' F1; Spark's own evaluators only offer the weighted one."""

    @keyword_only
    def __init__(self, labelCol: str = "label", predictionCol: str = "prediction"):
        super().__init__()
        self._setDefault(labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def _evaluate(self, dataset: DataFrame) -> float:
        row = averages(class_report(dataset, self.getLabelCol(), self.getPredictionCol())).first()
        return float(row["macro_f1"] or 0.0)

    def isLargerBetter(self) -> bool:
        return True


# The search grids. Depth None means unlimited, 30 being Spark's own limit;
# Spark has no minimum split size and no per-tree reweighting, so those axes are gone.
FOREST_GRID = {"numTrees": [100, 200, 300], "maxDepth": [8, 10, 12, 30], "minInstancesPerNode": [1, 2, 4]}
BOOSTER_GRID = {"maxIter": [100, 200], "maxDepth": [3, 5, 7], "stepSize": [0.01, 0.1, 0.2], "subsamplingRate": [0.8, 1.0]}


def tuned_forest(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "label",
    grid: Mapping[str, Sequence] = FOREST_GRID,
    folds: int = 5,
    parallelism: int = 8,
    seed: int = 42,
) -> tuple[Classifier, dict]:
    """MOD3: the forest with the best mean macro F1 over stratified folds, and its parameters."""
    forest = RandomForestClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", seed=seed, maxMemoryInMB=512)
    return _tuned(df, features, key, label, forest, grid, folds, parallelism, seed)


def tuned_booster(
    df: DataFrame,
    features: Sequence[str],
    key: str,
    label: str = "label",
    grid: Mapping[str, Sequence] = BOOSTER_GRID,
    folds: int = 3,
    parallelism: int = 8,
    seed: int = 42,
) -> tuple[Classifier, dict]:
    """MOD3 for two classes: the booster with the best macro F1; class weights are balanced."""
    booster = GBTClassifier(featuresCol="features", labelCol="label_index", weightCol="weight", seed=seed, maxMemoryInMB=512)
    return _tuned(df, features, key, label, booster, grid, folds, parallelism, seed)


def _tuned(df, features, key, label, estimator, grid, folds, parallelism, seed):
    prepared = fold_column(with_class_weight(df, label), key, folds, label, seed)
    indexed = _clean_indexer(label).fit(prepared).transform(prepared)
    preparation_model = Pipeline(stages=preparation(features)).fit(indexed)
    ready = cut_lineage(preparation_model.transform(indexed).select("features", "label_index", "weight", "fold"))
    chosen, score, _ = nested_search(ready, estimator, grid, folds, parallelism)
    tuned = estimator.copy({estimator.getParam(k): v for k, v in chosen.items()})
    is_forest = isinstance(tuned, RandomForestClassifier)
    best = grow_forest(in_parts(ready, FOREST_ROWS_PER_TASK), tuned) if is_forest else grow_booster(in_parts(ready), tuned)
    return Classifier(PipelineModel(stages=[*preparation_model.stages, best]), class_list(df, label)), {**chosen, "macro_f1": score}


SAVE_ORDER = ("enhanced_ensemble", "enhanced_rf", "ensemble", "improved_rf", "baseline")
SCORE_ORDER = ("improved_rf", "ensemble", "xgb")


def pick_model(available: Mapping[str, object], order: Sequence[str] = SCORE_ORDER) -> tuple[str, object] | None:
    """MOD23: the first model of `order` that exists; None means rules only."""
    return next(((name, available[name]) for name in order if available.get(name) is not None), None)
