"""Deciding which rows belong to no known class."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import array_literal, distance, scale
from .running import percentiles


def nearest_centre(vector: Column, centres: Sequence[Sequence[float]], means: Sequence[float] | None = None, stds: Sequence[float] | None = None) -> Column:
    """MOD16: distance to the nearest of a fixed set of centres, after standardising if asked."""
    at = vector
    if means is not None and stds is not None:
        at = scale(vector, array_literal(means), array_literal(stds))
    return F.least(*[distance(at, array_literal(c)) for c in centres]) if len(centres) > 1 else distance(at, array_literal(centres[0]))


def confidence_of(probabilities: Column) -> Column:
    """MOD22: the largest class probability, 0.5 when there is none."""
    return F.coalesce(F.array_max(probabilities), F.lit(0.5))


def calibrate(df: DataFrame, columns: Sequence[str], share: float = 0.95) -> dict[str, float | None]:
    """MOD19: the 95th percentile of each score on a named calibration table, kept with the model. All scores in one pass."""
    if not columns:
        return {}
    stacked = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("score")) for c in columns])))
    found = {r["name"]: r["percentiles"][0] for r in percentiles(stacked, "score", [share], by=["name"]).collect() if r["percentiles"]}
    return {c: found.get(c) for c in columns}


def unknown_base(
    confidence: Column,
    error: Column | None,
    far: Column | None,
    confidence_threshold: float = 0.7,
    error_threshold: float | Column | None = None,
    distance_threshold: float | Column | None = None,
) -> Column:
    """MOD17: low confidence, and a high reconstruction error or a distant embedding."""
    low = confidence < confidence_threshold
    if error is None and far is None:
        return low
    signs = F.lit(False)
    if error is not None and error_threshold is not None:
        signs = signs | F.coalesce(error > error_threshold, F.lit(False))
    if far is not None and distance_threshold is not None:
        signs = signs | F.coalesce(far > distance_threshold, F.lit(False))
    return low & signs


def unknown_votes(
    confidence: Column,
    error: Column | None = None,
    far: Column | None = None,
    confidence_threshold: float = 0.7,
    error_threshold: float | Column | None = None,
    distance_threshold: float | Column | None = None,
    voting: str = "majority",
) -> Column:
    """MOD18: the same signs as votes: 'majority' (half or more), 'unanimous', or any.

    With two votes a majority is one of them. A missing score casts no vote for unknown.
    """
    votes = [confidence < confidence_threshold]
    if error is not None and error_threshold is not None:
        votes.append(error > error_threshold)
    if far is not None and distance_threshold is not None:
        votes.append(far > distance_threshold)
    flags = [F.coalesce(v, F.lit(False)).cast("int") for v in votes]
    total = sum(flags[1:], flags[0])
    if len(flags) == 1:
        return total > 0
    needed = {"majority": len(flags) / 2, "unanimous": len(flags)}.get(voting, 1)
    return total >= needed


def mark_unknown(prediction: Column, unknown: Column) -> Column:
    """MOD20: -1 in place of the class where the row is unknown."""
    return F.when(unknown, F.lit(-1)).otherwise(prediction)


def thresholded(probabilities: Column, classes: Sequence[int], thresholds: dict[int, float], default: float = 0.5) -> Column:
    """MOD9: the most probable class among those that reach their own threshold, else the argmax."""
    ids = F.array(*[F.lit(int(c)) for c in classes])
    limits = array_literal([thresholds.get(c, default) for c in classes])
    passed = F.zip_with(probabilities, limits, lambda p, t: F.when(p >= t, p).otherwise(F.lit(-1.0)))
    best = F.when(F.array_max(passed) >= 0, F.array_position(passed, F.array_max(passed))).otherwise(
        F.array_position(probabilities, F.array_max(probabilities))
    )
    return F.get(ids, (best - 1).cast("int"))


def soft_vote(*members: Column) -> Column:
    """MOD6: the mean of the members' probability arrays."""
    total = members[0]
    for m in members[1:]:
        total = F.zip_with(total, m, lambda a, b: a + b)
    return F.transform(total, lambda x: x / len(members))
