"""Running totals, ranks and percentiles over a whole table.

``Window.orderBy`` without a partition, or with one as coarse as a class label,
sends everything to one task. Here the order is cut into slices: each slice is
totalled on its own and then shifted by what the slices before it add up to.
The only unsliced work is one row per slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

SLICE_BITS = 10
HASH_BITS = 16


def quantile_slice(df: DataFrame, value: str, out: str = "_slice", bits: int = SLICE_BITS) -> DataFrame:
    """Number each row by which of 2**bits quantile ranges of `value` holds it.

    The cut points come from one mergeable sketch (a scalar subquery); each row finds
    its slice by binary search over them. Equal values always share a slice.
    """
    n = 2**bits
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)], 4 * n)).scalar()
    steps = F.array(*[F.lit(2**b) for b in reversed(range(bits))])
    return (
        df.withColumn("_cuts", cuts)
        .withColumn(
            out,
            F.aggregate(
                steps,
                F.lit(0),
                lambda at, step: F.when(
                    F.get(F.col("_cuts"), at + step - 1) < F.col(value), at + step
                ).otherwise(at),
            ),
        )
        .drop("_cuts")
    )


def joined_by(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys, where null is a key like any other."""
    other = right.withColumnsRenamed({k: f"_k_{k}" for k in keys})
    same = [left[k].eqNullSafe(other[f"_k_{k}"]) for k in keys]
    return left.join(other, same).drop(*[f"_k_{k}" for k in keys])


def running(
    df: DataFrame,
    values: Mapping[str, Column | str],
    order: Sequence[Column | str],
    slice_by: str = "_slice",
    by: Sequence[str] = (),
    func=F.sum,
    slice_descending: bool = False,
    inclusive: bool = True,
    totals: bool = False,
) -> DataFrame:
    """Running `func` (an associative aggregate: sum, max, min) of each value, in `order`.

    `values` maps the new column to what is accumulated. `slice_by` must be monotone in
    `order`; set `slice_descending` when `order` descends. With ``inclusive=False`` the
    current row is left out, and rows with nothing before them get null. With ``totals=True``
    each value's whole-group result comes along as `all_<name>`, taken over the slices.
    """
    keys = [*by, slice_by]
    names = list(values)
    work = df.withColumns({f"_v_{n}": F.col(v) if isinstance(v, str) else v for n, v in values.items()})
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = (
        Window.partitionBy(*by)
        .orderBy(F.desc(slice_by) if slice_descending else F.asc(slice_by))
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    before = (
        work.groupBy(*keys)
        .agg(*[func(f"_v_{n}").alias(f"_t_{n}") for n in names])
        .select(
            *keys,
            *[func(f"_t_{n}").over(across).alias(f"_before_{n}") for n in names],
            *[func(f"_t_{n}").over(Window.partitionBy(*by)).alias(f"all_{n}") for n in names if totals],
        )
    )
    joined = work.withColumns({f"_in_{n}": func(f"_v_{n}").over(inside) for n in names})
    joined = joined_by(joined, before, keys)

    def merged(n: str) -> Column:
        here, earlier = F.col(f"_in_{n}"), F.col(f"_before_{n}")
        if func is not F.sum:
            return (F.greatest if func is F.max else F.least)(here, earlier)  # both skip nulls
        return F.coalesce(here + earlier, here, earlier)

    whole = [f"all_{n}" for n in names] if totals else []
    return joined.select(*df.columns, *[merged(n).alias(n) for n in names], *whole)


def hash_order(keys: Sequence[str | Column], seed: int) -> Column:
    """A repeatable random order: depends on the row's key and the seed, never on its partition."""
    return F.xxhash64(*keys, F.lit(seed))


def ranked(
    df: DataFrame,
    out: str,
    by: Sequence[str] = (),
    order: str | None = None,
    keys: Sequence[str] = (),
    seed: int = 42,
) -> DataFrame:
    """Zero-based row number within `by`, ordered by column `order` or by a hash of `keys`.

    A class may hold nearly all rows, so ranks are counted per slice and shifted.
    Hash order needs no quantiles: the high bits of the hash are the slice.
    """
    if order is None:
        work = df.withColumn("_order", hash_order(keys, seed)).withColumn(
            "_slice", F.shiftright("_order", 64 - HASH_BITS)
        )
        columns: list = ["_order", *keys]
    else:
        work = quantile_slice(df, order)
        columns = [order, *keys]
    inside = Window.partitionBy(*by, "_slice").orderBy(*columns)
    across = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        work.groupBy(*by, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(*by, "_slice", F.coalesce(F.sum("_n").over(across), F.lit(0)).alias("_before"))
    )
    return (
        joined_by(work.withColumn("_in", F.row_number().over(inside)), before, [*by, "_slice"])
        .withColumn(out, F.col("_in") - 1 + F.col("_before"))
        .select(*df.columns, out)
    )


def percentiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Exact linear-interpolation percentiles, one array column `percentiles` per `by`.

    ``percentile()`` keeps every distinct value of a group in one buffer; this counts
    distinct values with partial aggregation and ranks them slice by slice instead. The
    counts are written once, since what they are counted from may be a model's scores.
    """
    counts = cut_lineage(
        df.where(F.col(value).isNotNull())
        .groupBy(*by, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sliced = quantile_slice(counts, "_x")
    upto = running(sliced, {"_hi": "_n"}, order=["_x"], by=by, totals=True).withColumnRenamed("all__hi", "_all")
    picks = []
    for i, p in enumerate(probabilities):
        at = (F.col("_all") - 1) * F.lit(float(p))
        for side, rank in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            holds = (F.col("_hi") - F.col("_n") <= rank) & (rank < F.col("_hi"))
            picks.append(F.max(F.when(holds, F.col("_x"))).alias(f"_{side}{i}"))
    picks.append(F.max("_all").alias("_all"))
    table = upto.groupBy(*by).agg(*picks)
    values = []
    for i, p in enumerate(probabilities):
        at = (F.col("_all") - 1) * F.lit(float(p))
        values.append(F.col(f"_lo{i}") + (at - F.floor(at)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    return table.select(*by, F.array(*values).alias("percentiles"))
