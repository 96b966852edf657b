"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, how often the mix takes it. Among all rates that give each source its target of words and
take no document more than `MOST` times, those closest to one in relative entropy are exponentially tilted and clipped:

    rate = min(MOST, exp(lambda_source * size / mean size of the source))

The multipliers maximise the concave dual, one per source. Newton's method finds them, kept inside a bracket that each
step narrows. Its sums run over the whole table in Spark. Documents of one source and size share a rate, so they run
over counts per source and size: a partial aggregation made once and written, however large a source is. The sums are
taken in whole numbers, so that their order cannot matter and reruns agree. Multipliers stay a table, one row a source.

Rates become copies by carried rounding: a source's sizes are gone through from long to short, and the words that
rounding leaves over or short are carried on to the next size. So the words taken miss the target by about one short
document. Which documents of one size get the copy more, a hash of id and text decides.

Defined results: a null or empty text has size 0, adds nothing and is taken once. A null source is a source and comes
last. A source whose target is MOST times its size is taken MOST times whole. Repeated rows are documents of their own.
An empty table gives an empty table. Columns of the input that bear a name of the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import split_words, without

MOST = 2.0
STEPS = 60
#: Relative miss of a target, beside a ten-thousandth of a word, at which a source counts as solved.
CLOSE = 1e-6
#: Fixed point in which the Newton sums are taken.
UNIT = 1_000_000


def targets(sizes: DataFrame, weights: Sequence[float], percent: int, most: float = MOST) -> DataFrame:
    """(source, source_size, target): the budget shared by weight, no source above `most` times its size.

    `sizes` has a row per source. A source is filled up if the budget, spread by weight over all that are not, gives it
    more than it may have. Sorted by room per weight, the filled ones come first, so one running sum finds them all; the
    first that is not filled knows the level of the rest.
    """
    last = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(last) - 1) % len(weights)))
    numbered = numbered.withColumns({"room": most * F.col("source_size"), "budget": F.sum("source_size").over(Window.partitionBy()) * percent / 100.0})
    by_room = Window.orderBy(F.col("room") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    share = (F.col("budget") - F.coalesce(F.sum("room").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    numbered = numbered.withColumn("share", share).withColumn("full", F.col("share") * F.col("weight") >= F.col("room"))
    level = F.max(F.when(~F.col("full"), F.col("share"))).over(Window.partitionBy())
    return numbered.select("source", "source_size", F.when(F.col("full"), F.col("room")).otherwise(level * F.col("weight")).alias("target"))


def _fixed(x: Column) -> Column:
    return F.sum(F.round(x * UNIT).cast("decimal(38,0)")).cast("double") / UNIT


def _rate(multiplier: Column, size: Column, mean: Column, full: Column, most: float) -> Column:
    return F.when(full, F.lit(most)).otherwise(F.least(F.lit(most), F.exp(F.least(multiplier * size / mean, F.lit(50.0)))))


def solve(counts: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, mean, full, multiplier): the dual's solution. `counts` has (source, size, n), `goals` (source, source_size, target)."""
    documents = counts.groupBy("source").agg(F.sum("n").alias("documents"))
    state = goals.join(documents, goals["source"].eqNullSafe(documents["source"])).select(
        goals["source"],
        "target",
        (F.greatest("source_size", F.lit(1)) / F.col("documents")).alias("mean"),
        (F.col("target") >= most * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("multiplier"),
        F.lit(-1e6).alias("low"),
        F.lit(1e6).alias("high"),
        F.lit(False).alias("solved"),
    )
    state = cut_lineage(state)
    for _ in range(STEPS):
        open_ = state.where(~F.col("solved") & ~F.col("full"))
        rows = counts.withColumnRenamed("source", "_s").join(open_, F.col("_s").eqNullSafe(F.col("source")))
        r = _rate(F.col("multiplier"), F.col("size"), F.col("mean"), F.lit(False), most)
        taken = F.col("n") * F.col("size") * r
        free = F.when(r < most, taken * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = rows.groupBy(F.col("source").alias("_s")).agg(_fixed(taken).alias("taken"), _fixed(free).alias("slope"))
        step = state.join(sums, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
        miss = F.col("taken") - F.col("target")
        done = F.col("solved") | F.col("full") | (F.abs(miss) <= CLOSE * F.col("target") + 1e-4)
        low, high = F.when(miss < 0, F.col("multiplier")).otherwise(F.col("low")), F.when(miss > 0, F.col("multiplier")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("multiplier") - miss / F.col("slope"))
        inside = (newton > low) & (newton < high)
        # out of the bracket, or no slope: halve it, reaching out tenfold where one end is still open
        middle = F.when(high >= 1e6, F.greatest(2 * low, F.lit(0.5))).when(low <= -1e6, F.least(2 * high, F.lit(-0.5))).otherwise((low + high) / 2)
        state = cut_lineage(
            step.select(
                "source", "target", "mean", "full",
                F.when(F.coalesce(done, F.lit(True)), F.col("multiplier")).when(inside, newton).otherwise(middle).alias("multiplier"),
                low.alias("low"), high.alias("high"), F.coalesce(done, F.lit(True)).alias("solved"),
            )
        )
        if state.where(~F.col("solved")).isEmpty():
            break
    return state.select("source", "mean", "full", "multiplier")


def _carried(rows: pd.DataFrame, most: int) -> pd.DataFrame:
    """One source's sizes, from long to short: what rounding leaves over or short in words goes on to the next size."""
    rows = rows.sort_values("size", ascending=False, ignore_index=True)
    base, extra, short = [], [], 0
    for size, n, units in zip(rows["size"].tolist(), rows["n"].tolist(), rows["units"].tolist()):
        short += n * units * size
        copies = min(max(round(short / (size * UNIT)), 0), most * n) if size else n
        short -= copies * size * UNIT
        base.append(copies // n)
        extra.append(copies % n)
    return rows.assign(base=base, extra=extra)[["source", "size", "base", "extra"]]


def copies_per_size(counts: DataFrame, solved: DataFrame, most: float = MOST) -> DataFrame:
    """(source, size, base, extra): copies that every document of a source and size gets, and how many of them get one more.

    A group is a source's distinct sizes with their counts, no more rows than its longest text has words.
    """
    rows = counts.join(solved.withColumnRenamed("source", "_s"), counts["source"].eqNullSafe(F.col("_s"))).drop("_s")
    rows = rows.withColumn("rate", _rate(F.col("multiplier"), F.col("size"), F.col("mean"), F.col("full"), most))
    rows = rows.withColumn("units", F.round(F.col("rate") * UNIT).cast("long"))
    kind = dict(counts.dtypes)["source"]
    carried = lambda group: _carried(group, int(most))
    return rows.select("source", "size", "n", "units").groupBy("source").applyInPandas(carried, f"source {kind}, size long, base int, extra long")


def mix(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = (5, 2, 1), percent: int = 150, most: float = MOST
) -> DataFrame:
    """The documents with `size`, `source_size`, `target` and `copies`.

    Which documents of one source and size get a copy more is decided by rank in a hash of the id and the text, found in
    parts: a group of thousands of equal size is cut by leading hash bits, counted, and only the part that the limit
    falls into is ranked.
    """
    sized = without(docs, "size", "source_size", "target", "copies").withColumn("size", F.size(split_words(text)).cast("long"))
    counts = cut_lineage(sized.groupBy(F.col(source).alias("source"), "size").agg(F.count(F.lit(1)).alias("n")))
    goals = cut_lineage(targets(counts.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, percent, most))
    plan = copies_per_size(counts, solve(counts, goals, most), most)
    plan = plan.join(goals.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        F.col("source").alias("_mix_source"), F.col("size").alias("_mix_size"), "base", "extra", "source_size", "target"
    )
    plan = cut_lineage(plan)
    drawn = sized.withColumn("_mix_hash", F.xxhash64(F.col(doc), F.col(text))).withColumn("_mix_part", F.shiftright("_mix_hash", 48))
    parts = drawn.groupBy(F.col(source).alias("_s"), F.col("size").alias("_z"), F.col("_mix_part").alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("_s", "_z").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    here = F.col("_s").eqNullSafe(F.col("_mix_source")) & (F.col("_z") == F.col("_mix_size"))
    parts = parts.join(plan, here).withColumn("up", F.least(F.greatest(F.col("extra") - F.col("before"), F.lit(0)), F.col("n")))
    whole = parts.select("_s", "_z", "_p", "base", "source_size", "target", F.col("n").alias("_n"), F.col("up").alias("_up"))
    joined = drawn.join(whole, F.col(source).eqNullSafe(F.col("_s")) & (F.col("size") == F.col("_z")) & (F.col("_mix_part") == F.col("_p")))
    split = (F.col("_up") > 0) & (F.col("_up") < F.col("_n"))
    rank = F.row_number().over(Window.partitionBy(F.when(split, F.col("_s")), F.when(split, F.col("_z")), F.when(split, F.col("_p")).otherwise(F.col("_mix_hash"))).orderBy("_mix_hash"))
    raised = F.when(split, rank <= F.col("_up")).otherwise(F.col("_up") > 0)
    out = joined.withColumn("copies", F.col("base") + raised.cast("int"))
    return out.drop("_s", "_z", "_p", "base", "_n", "_up", "_mix_hash", "_mix_part")
