"""Threshold tuning and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import quantile_slice, running

EPSILON = 1e-10


def pr_curve(df: DataFrame, label: str, score: str, positive: int = 1) -> DataFrame:
    """EVA1: precision and recall of ``score >= threshold`` at each distinct score.

    Equal scores collapse first; the cumulative counts then run slice by slice over the
    distinct scores, high to low, so no task has to hold the whole curve.
    """
    hit = F.col(label) == positive
    by_score = df.groupBy(F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(hit).alias("_pos"), F.count(F.lit(1)).alias("_n")
    )
    both = running(
        quantile_slice(by_score, "threshold"),
        {"tp": "_pos", "predicted": "_n"},
        order=[F.desc("threshold")],
        slice_descending=True,
        totals=True,
    )
    precision = F.col("tp") / F.col("predicted")
    recall = F.coalesce(F.try_divide(F.col("tp"), F.col("all_tp")), F.lit(1.0))
    return both.select(
        "threshold",
        F.col("_pos").alias("positives_here"),
        F.col("_n").alias("rows_here"),
        "tp",
        "predicted",
        F.col("all_tp").alias("positives"),
        precision.alias("precision"),
        recall.alias("recall"),
    )


def _objective(metric: str) -> Column:
    p, r = F.col("precision"), F.col("recall")
    if metric == "f1":
        return 2 * p * r / (p + r + EPSILON)
    if metric == "precision":
        return F.when(r > 0.1, p)
    if metric == "recall":
        return F.when(p > 0.1, r)
    if metric == "balanced_f1":
        return 0.5 * p + 0.5 * r
    return F.lit(0.0)


def best_threshold(df: DataFrame, label: str, score: str, positive: int = 1, metric: str = "f1") -> DataFrame:
    """EVA2: the threshold that maximises `metric`; the lowest one on ties.

    The curve also has an end point with precision 1 and recall 0 above the highest score.
    When that point wins, the highest score is returned, as for any point past the last.
    """
    curve = pr_curve(df, label, score, positive).select("threshold", "precision", "recall")
    points = curve.withColumn("_value", _objective(metric)).where(F.col("_value").isNotNull())
    chosen = points.agg(
        F.max_by(F.struct("threshold", "precision", "recall"), F.struct("_value", -F.col("threshold"))).alias("_best"),
        F.max("_value").alias("_value"),
    )
    ends = curve.agg(
        F.max_by(F.struct("threshold", "precision", "recall"), "threshold").alias("_last"),
        F.min_by(F.struct("threshold", "precision", "recall"), "threshold").alias("_first"),
    )
    # the value of the end point under each metric: precision 1 passes no recall test
    end_value = {"f1": 0.0, "balanced_f1": 0.5, "recall": 0.0}.get(metric)
    both = chosen.withColumn("_ends", ends.select(F.struct("_last", "_first")).scalar())
    winner = F.coalesce(F.col("_best"), F.col("_ends._first"))
    if end_value is not None:
        winner = F.when(F.col("_value").isNull() | (F.col("_value") < end_value), F.col("_ends._last")).otherwise(winner)
    return both.withColumn("_w", winner).select(
        F.col("_w.threshold").alias("threshold"),
        F.col("_w.precision").alias("precision"),
        F.col("_w.recall").alias("recall"),
    )


def apply_threshold(score: Column, threshold: float | Column, positive: int = 1) -> Column:
    """EVA3, MOD8: the positive class where the score reaches the threshold, else 0."""
    return F.when(score >= threshold, F.lit(positive)).otherwise(F.lit(0))


def tune_class(df: DataFrame, label: str, score: str, target: int) -> DataFrame:
    """EVA4: the balanced threshold of one class with its precision, recall and F1."""
    threshold = best_threshold(df, label, score, target, "balanced_f1").select("threshold").scalar()
    scored = df.select(label, score).withColumn("_t", threshold)
    predicted, actual = F.col(score) >= F.col("_t"), F.col(label) == target
    # with target 0 every row is predicted as class 0, above the threshold or not
    if target == 0:
        predicted = F.lit(True)
    counts = scored.agg(
        F.max("_t").alias("threshold"),
        F.count_if(predicted & actual).alias("_tp"),
        F.count_if(predicted).alias("_p"),
        F.count_if(actual).alias("_a"),
    )
    p = F.coalesce(F.try_divide(F.col("_tp"), F.col("_p")), F.lit(0.0))
    r = F.coalesce(F.try_divide(F.col("_tp"), F.col("_a")), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("_p") + F.col("_a")), F.lit(0.0))
    return counts.select("threshold", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Counts per (actual, predicted) pair; every metric below starts from this small table."""
    return df.groupBy(F.col(label).cast("int").alias("actual"), F.col(prediction).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_matrix(df: DataFrame, labels: Sequence[int], label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EVA7: one row per actual label, one column per predicted label, -1 included when listed."""
    pairs = confusion(df, label, prediction)
    return pairs.groupBy("actual").pivot("predicted", list(labels)).agg(F.sum("n")).na.fill(0)


def class_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EVA6: precision, recall, F1 and support per class; 0 where a ratio has no base."""
    pairs = confusion(df, label, prediction)
    ends = pairs.select(
        F.explode(
            F.array(
                F.struct(F.col("actual").alias("class"), F.lit(True).alias("as_actual"), F.col("n").alias("n"), (F.col("actual") == F.col("predicted")).alias("hit")),
                F.struct(F.col("predicted").alias("class"), F.lit(False).alias("as_actual"), F.col("n").alias("n"), F.lit(False).alias("hit")),
            )
        ).alias("e")
    ).select("e.*")
    by_class = ends.groupBy("class").agg(
        F.coalesce(F.sum(F.when(F.col("hit"), F.col("n"))), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum(F.when(F.col("as_actual"), F.col("n"))), F.lit(0)).alias("support"),
        F.coalesce(F.sum(F.when(~F.col("as_actual"), F.col("n"))), F.lit(0)).alias("_predicted"),
    )
    zero = F.lit(0.0)
    return by_class.select(
        "class",
        F.coalesce(F.try_divide(F.col("_tp"), F.col("_predicted")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("_tp"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("_tp"), F.col("_predicted") + F.col("support")), zero).alias("f1"),
        "support",
    )


def averages(report: DataFrame) -> DataFrame:
    """EVA6: macro and support-weighted averages of a class report."""
    names = ["precision", "recall", "f1"]
    total = F.sum("support")
    return report.agg(
        *[F.avg(c).alias(f"macro_{c}") for c in names],
        *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), total), F.lit(0.0)).alias(f"weighted_{c}") for c in names],
        total.alias("support"),
    )


def scores(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """EVA5, EVA8, EVA12: accuracy, balanced accuracy, misconfiguration recall and unknown share."""
    pairs = confusion(df, label, prediction)
    hit = F.col("actual") == F.col("predicted")
    by_class = pairs.groupBy("actual").agg(
        F.sum("n").alias("_n"),
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("_hit"),
        F.coalesce(F.sum(F.when(F.col("predicted") != 0, F.col("n"))), F.lit(0)).alias("_flagged"),
        F.coalesce(F.sum(F.when(F.col("predicted") == -1, F.col("n"))), F.lit(0)).alias("_unknown"),
    )
    wrong = F.col("actual") != 0
    return by_class.agg(
        (F.sum("_hit") / F.sum("_n")).alias("accuracy"),
        F.avg(F.col("_hit") / F.col("_n")).alias("balanced_accuracy"),
        F.try_divide(F.sum(F.when(wrong, F.col("_flagged"))), F.sum(F.when(wrong, F.col("_n")))).alias("misconfig_recall"),
        F.sum("_unknown").alias("unknown_count"),
        (F.sum("_unknown") / F.sum("_n")).alias("unknown_share"),
    )


def roc_auc(df: DataFrame, label: str, score: str, positive: int = 1) -> DataFrame:
    """EVA9: area under the ROC curve; tied scores count half."""
    curve = pr_curve(df, label, score, positive)
    negatives_here = F.col("rows_here") - F.col("positives_here")
    # positives above this score, plus half of those at it, per negative at it
    above = F.col("tp") - F.col("positives_here")
    wins = F.sum((above + F.col("positives_here") / 2.0) * negatives_here)
    pairs = F.max("positives") * F.sum(negatives_here)
    return curve.agg(F.try_divide(wins, pairs.cast("double")).alias("roc_auc"))


def average_precision(df: DataFrame, label: str, score: str, positive: int = 1) -> DataFrame:
    """EVA10: step sum of precision over recall gains."""
    curve = pr_curve(df, label, score, positive)
    gain = F.try_divide(F.col("positives_here"), F.col("positives"))
    return curve.agg(F.coalesce(F.sum(gain * F.col("precision")), F.lit(0.0)).alias("average_precision"))


def compare_models(df: DataFrame, predictions: dict[str, str], label: str = "label") -> DataFrame:
    """EVA11: accuracy and balanced accuracy per model, from one pass over one wide table.

    Rows a model marks as unknown (-1) are left out of its own line.
    """
    columns = F.array(*[F.struct(F.lit(name).alias("model"), F.col(c).cast("int").alias("predicted")) for name, c in predictions.items()])
    pairs = (
        df.select(F.col(label).cast("int").alias("actual"), F.explode(columns).alias("_m"))
        .select("actual", "_m.*")
        .where(F.col("predicted") != -1)
        .groupBy("model", "actual")
        .agg(F.count(F.lit(1)).alias("_n"), F.count_if(F.col("actual") == F.col("predicted")).alias("_hit"))
    )
    return pairs.groupBy("model").agg(
        (F.sum("_hit") / F.sum("_n")).alias("accuracy"), F.avg(F.col("_hit") / F.col("_n")).alias("balanced_accuracy")
    )
