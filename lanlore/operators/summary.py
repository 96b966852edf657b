"""Counts, weights and summaries over labelled or scored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .running import percentiles


def label_mode(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """AGG15: the most frequent non-zero label per key, else 0; ties go to the smallest label."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).agg(F.count(F.lit(1)).alias("_n"))
    best = F.struct(F.col(label) != 0, F.col("_n"), -F.col(label))
    return counts.groupBy(*keys).agg(F.max_by(label, best).alias("label"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG16: rows and percent per label."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("percent", F.col("n") * 100.0 / counts.agg(F.sum("n")).scalar())


def class_balance(df: DataFrame, label: str = "label") -> DataFrame:
    """AGG17: count and share per class, with the whole table's imbalance ratio beside it."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = counts.agg(
        F.struct(
            F.sum("n").alias("total"),
            F.count(F.lit(1)).alias("classes"),
            (F.max("n") / F.min("n")).alias("ratio"),
        )
    ).scalar()
    return counts.withColumn("_all", whole).select(
        label,
        "n",
        (F.col("n") / F.col("_all.total")).alias("proportion"),
        F.col("_all.total").alias("total_samples"),
        F.col("_all.classes").alias("n_classes"),
        F.col("_all.ratio").alias("imbalance_ratio"),
    )


def imbalance_ratio(df: DataFrame, label: str = "label") -> float:
    row = class_balance(df, label).select(F.max("imbalance_ratio")).first()
    return float(row[0]) if row[0] is not None else 1.0


def class_weights(df: DataFrame, label: str = "label", num_classes: int | None = None) -> DataFrame:
    """AGG18: weight n / (k * n_c) per class; with `num_classes`, absent classes weigh 1."""
    balance = class_balance(df, label)
    weights = balance.select(label, (F.col("total_samples") / (F.col("n_classes") * F.col("n"))).alias("weight"))
    if num_classes is None:
        return weights
    ids = df.sparkSession.range(num_classes).select(F.col("id").cast(df.schema[label].dataType).alias(label))
    return ids.join(weights, label, "left").na.fill(1.0, ["weight"])


def per_class(table: DataFrame, label: str, value: str, of: Column) -> Column:
    """The `value` of a row's class, from a table of one row per class held as one map.

    A join on the class would shuffle the whole table onto as many partitions as there are classes.
    Rows without a class have no value.
    """
    entries = table.where(F.col(label).isNotNull()).agg(F.map_from_entries(F.collect_list(F.struct(label, value)))).scalar()
    return F.try_element_at(entries, of)


def with_class_weight(df: DataFrame, label: str = "label", out: str = "weight") -> DataFrame:
    """AGG18 as a column of every row."""
    return df.withColumn(out, per_class(class_weights(df, label), label, "weight", F.col(label)))


def type_summary(report: DataFrame, kind: str = "misconfig_type", confidence: str = "confidence_score") -> DataFrame:
    """AGG19: reports and mean confidence per misconfiguration type."""
    return report.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.avg(confidence).alias("mean_confidence"))


def counts_by_window(df: DataFrame, window: str, kind: str, kinds: Sequence) -> DataFrame:
    """AGG20: one column per type, one row per window, gaps 0. The types are given, so no pass looks for them."""
    return df.groupBy(window).pivot(kind, list(kinds)).agg(F.count(F.lit(1))).na.fill(0)


def confidence_quartiles(df: DataFrame, kind: str, confidence: str) -> DataFrame:
    """AGG21: minimum, quartiles and maximum per type."""
    names = ["min", "q1", "median", "q3", "max"]
    table = percentiles(df, confidence, [0.0, 0.25, 0.5, 0.75, 1.0], by=[kind])
    return table.select(kind, *[F.get("percentiles", F.lit(i)).alias(n) for i, n in enumerate(names)])


def batch_summary(results: DataFrame, prediction: str = "prediction", error: str = "error") -> DataFrame:
    """AGG22, FLT5: totals of a scored batch; rows with an error count apart."""
    valid = F.col(error).isNull() & F.col(prediction).isNotNull()
    return results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(valid & (F.col(prediction) == 0)).alias("normal"),
        F.count_if(valid & (F.col(prediction) != 0)).alias("misconfigured"),
        F.coalesce(F.try_divide(F.count_if(valid & (F.col(prediction) != 0)), F.count_if(valid)), F.lit(0.0)).alias("misconfig_rate"),
        F.count_if(~valid).alias("errors"),
    )


def distinct_counts(df: DataFrame, columns: Sequence[str], approx: bool = False) -> DataFrame:
    """AGG23: distinct values of each column, exact or as a mergeable sketch."""
    count = F.approx_count_distinct if approx else F.count_distinct
    return df.agg(*[count(c).alias(f"distinct_{c}") for c in columns])


def top_features(importances: DataFrame, k: int = 10) -> DataFrame:
    """ORD2: the k most important features."""
    return importances.orderBy(F.desc("importance"), "feature").limit(k)


def best_model(scores: DataFrame, metric: str = "balanced_accuracy") -> DataFrame:
    """ORD3: the model with the highest score; ties go to the first name."""
    return scores.select("model", metric).orderBy(F.desc(metric), "model").limit(1)
