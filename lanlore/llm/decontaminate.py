"""Benchmark decontamination over a distributed positional inverted index, in DataFrame operations only.

`positional_index` stores where the terms of the test items stand in the training texts: one row per term, document and
position. Every window of an item names its `LISTS` rarest terms, by their counts over all training texts. Their
posting lists, each shifted by the term's offset in the window, are intersected: a start that all lists agree on is a
candidate. Candidates meet their text once more, where the whole window is compared, so what is reported as exact is
exact. With `slop`, lists may disagree by so many words, and what does not match exactly is reported as near.

Only terms that a window calls on enter the index, rows are spread by document and start, and a frequent term is called
on only by windows that have nothing rarer. Terms and windows of the test items are broadcast if they are small, which
is measured; else the joins shuffle.

Defined results: a null or empty text has no words and no hits. An item without words has no window. Repeated items
count once; a null item id is the item ''. Items that share an id with different texts each have their windows. Rows that share a document id, or have none, are judged by their own text.
Columns of the input that bear a name of the operator's own are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import NOT_BARE, lower_ascii, split_words, where_settled, without

WINDOW = 13
#: How many of a window's posting lists are intersected before its candidates meet the text.
LISTS = 3
#: Bytes of terms or windows up to which they are sent to every executor.
BROADCAST_BYTES = 32_000_000
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20


def bare_words(text: str) -> Column:
    return split_words(lower_ascii(text), NOT_BARE)


def if_small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """`df` marked for broadcast if its values take at most `limit` bytes, as measured; else as it is."""
    width = sum((F.length(c) if t == "string" else F.lit(64) if t.startswith("array") else F.lit(8)) + 16 for c, t in df.dtypes)
    size = df.agg(F.sum(F.coalesce(width, F.lit(32 * len(df.columns))))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def item_windows(items: DataFrame, item: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(item, at, key, terms): every run of `window` words of each item; an item of fewer words is one window.

    `key`, a hash of the terms, tells apart windows of items that share an id.
    """
    words = items.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("item"), bare_words(text).alias("words")).where(F.size("words") > 0)
    last = F.greatest(F.size("words") - window, F.lit(0))
    return words.select("item", "words", F.explode(F.sequence(F.lit(0), last)).alias("at")).select("item", "at", F.slice("words", F.col("at") + 1, window).alias("terms")).distinct().select("item", "at", F.xxhash64("terms").alias("key"), "terms")


def positional_index(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, doc, pos): where each of `terms` (one column, distinct) stands in each document."""
    places = docs.select(F.col(doc).alias("doc"), F.posexplode(bare_words(text)).alias("pos", "term"))
    return places.join(if_small(terms), "term").select("term", "doc", "pos")


def rarest_terms(docs: DataFrame, windows: DataFrame, text: str = "text", lists: int = LISTS) -> DataFrame:
    """(term, item, at, key, offset, rank, n_lists): the terms whose postings find each window. Windows with a term that no text has are left out."""
    placed = windows.select("item", "at", "key", F.posexplode("terms").alias("offset", "term"))
    words = docs.select(F.explode(bare_words(text)).alias("term"))
    counted = words.join(if_small(placed.select("term").distinct()), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("item", "at", "key")
    ranked = (
        placed.join(counted, "term", "left")
        .withColumn("gap", F.max(F.col("n").isNull()).over(of))
        .where(~F.col("gap"))
        .withColumn("rank", F.row_number().over(of.orderBy("n", "offset")))
        .where(F.col("rank") <= lists)
        .withColumn("n_lists", F.count(F.lit(1)).over(of))
    )
    return cut_lineage(ranked.select("term", "item", "at", "key", "offset", "rank", "n_lists"))


def candidates(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, slop: int = 0) -> DataFrame:
    """(doc, found): per document the windows whose rarest terms stand at one start, each with its item, start and terms."""
    windows = item_windows(items, item, item_text, window)
    calls = rarest_terms(docs, windows, text)
    index = positional_index(docs, calls.select("term").distinct(), doc, text)
    shifts = F.array(*[F.lit(d) for d in range(-slop, slop + 1)])
    starts = index.join(if_small(calls), "term").withColumn("start", F.col("pos") - F.col("offset"))
    if slop:  # the rarest term says where the window starts; the others may stand a little off
        starts = starts.withColumn("start", F.explode(F.when(F.col("rank") == 1, F.array("start")).otherwise(F.transform(shifts, lambda d: F.col("start") + d))))
    agreed = (
        starts.groupBy("doc", "item", "at", "key", "start")
        .agg(F.count_distinct("rank").alias("n"), F.max("n_lists").alias("n_lists"), F.max((F.col("rank") == 1).cast("int")).alias("led"))
        .where((F.col("n") == F.col("n_lists")) & (F.col("led") == 1))
    )
    return agreed.join(if_small(windows), ["item", "at", "key"]).groupBy("doc").agg(F.collect_list(F.struct("item", "at", "start", "terms")).alias("found"))


def with_matches(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with `n_words` and `matches`: (item, at, start, len, exact) for every phrase found, near ones only with `slop`."""
    found = candidates(docs, items, doc, text, **how).withColumnRenamed("doc", "_found_doc")
    slop = how.get("slop", 0)
    joined = without(docs, "n_words", "matches").join(found, F.col(f"`{doc}`").eqNullSafe(F.col("_found_doc")), "left").withColumn("_words", bare_words(text))

    def judged(c: Column) -> Column:
        here = (c["start"] >= 0) & F.coalesce(F.slice("_words", F.greatest(c["start"], F.lit(0)) + 1, F.size(c["terms"])) == c["terms"], F.lit(False))
        return F.struct(c["item"].alias("item"), c["at"].alias("at"), c["start"].alias("start"), F.size(c["terms"]).alias("len"), here.alias("exact"))

    matches = F.transform(F.coalesce("found", F.array().cast(found.schema["found"].dataType)), judged)
    if not slop:
        matches = F.filter(matches, lambda m: m["exact"])
    return joined.withColumns({"n_words": F.size("_words").cast("long"), "matches": matches}).drop("_found_doc", "found", "_words")


def with_verdict(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", share: int = SHARE, **how) -> DataFrame:
    """The documents with `n_words`, `n_hit`, `items` (ids as sorted strings) and `contaminated`.

    A word is hit if an exact match covers it. Matches are swept in order of start within their document's row.
    """
    df = with_matches(without(docs, "n_hit", "items", "contaminated"), items, doc, text, **how)
    df = df.withColumn("_exact", F.filter("matches", lambda m: m["exact"])).withColumn(
        "_spans", F.array_sort(F.array_distinct(F.transform("_exact", lambda m: F.struct(m["start"].alias("start"), (m["start"] + m["len"]).alias("end")))))
    )
    swept = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["end"]), F.lit(0))).alias("n"), F.greatest(s["end"], acc["end"]).alias("end")),
    )
    df = df.withColumns({"n_hit": F.coalesce(swept["n"], F.lit(0)).cast("long"), "items": F.array_sort(F.array_distinct(F.transform("_exact", lambda m: m["item"])))})
    return df.withColumn("contaminated", (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))).drop("_exact", "_spans")


def keep_clean(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with their own columns only."""
    whole = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in (doc, text)]).alias("_rest"))
    kept = where_settled(with_verdict(whole, items, "_doc", "_text", **how), ~F.col("contaminated"))
    return kept.select(*[F.col({doc: "_doc", text: "_text"}.get(c, f"_rest.`{c}`")).alias(c) for c in docs.columns])
