"""Importance resampling of documents towards a target, with hashed n-gram models and Gumbel top-k.

Words and word pairs are hashed into `BUCKETS` cells. Two generative models, one of the target texts and one of all raw
texts, are categorical distributions over the cells. A document's log weight is the mean over its n-grams of
log p_target - log p_raw, times `LENGTH`: without that scaling, long documents would be taken or left for their length.
A Gumbel draw, made from a hash of the id and a seed, is added, and the k largest sums are a sample without replacement
in proportion to the weights.

The raw model counts all documents. The target model counts at most `TARGET_DOCS` of the target documents, drawn by a
hash of the id, so that their ids can be broadcast. The models are two arrays of fixed length. The k-th largest sum is
found by narrowing a histogram of at most 4,096 cells, never by sorting.

Defined results: a null or empty text has weight 0. Sums that tie with the k-th are all taken, so repeated rows stay or
go together. Without target documents every weight is 0. Without labels everything is kept. A null id gets a draw too.
Columns of the input that bear a name of the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import lower_ascii, split_words, without

BUCKETS = 2**17
LENGTH = 256
TARGET_DOCS = 10_000
SEED = 17
#: Sums are compared in millionths.
UNIT = 1_000_000
BINS = 4096


def word_hashes(text: Column | str) -> Column:
    return F.transform(split_words(lower_ascii(text)), lambda w: F.xxhash64(w))


def cells_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of all words and pairs of a block, the rows they belong to, and n-grams per row."""
    offsets = np.asarray(words.offsets).astype(np.int64)
    h = np.asarray(words.values)[offsets[0] : offsets[-1]].view(np.uint64)
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        pair = (h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        within = row[:-1] == row[1:]
        cells = np.concatenate([h, (pair ^ (pair >> np.uint64(32)))[within]]) % np.uint64(BUCKETS)
    return cells.astype(np.int64), np.concatenate([row, row[:-1][within]]), sizes + np.maximum(sizes - 1, 0)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's counts: (cell, raw, target)."""
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        cells, row, _ = cells_of(batch.column(0))
        raw += np.bincount(cells, minlength=BUCKETS)
        target += np.bincount(cells[np.asarray(batch.column(1).fill_null(False).to_numpy(zero_copy_only=False))[row]], minlength=BUCKETS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], ["cell", "raw", "target"])


def fit(docs: DataFrame, target_ids: DataFrame, doc: str = "doc_id", text: str = "text", target_docs: int = TARGET_DOCS) -> np.ndarray:
    """log p_target - log p_raw per cell. `target_ids` has one column."""
    ids = target_ids.toDF("_target").distinct().orderBy(F.xxhash64("_target"), "_target").limit(target_docs).withColumn("_is", F.lit(True))
    flagged = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text")).join(F.broadcast(ids), F.col("_doc") == F.col("_target"), "left")
    rows = flagged.select(word_hashes("_text").alias("words"), "_is").mapInArrow(_counted, "cell long, raw long, target long")
    counts = rows.groupBy("cell").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[counts["cell"]], target[counts["cell"]] = counts["raw"], counts["target"]
    if not target.sum():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def log_ratio(text: Column | str, ratios: np.ndarray, spark) -> Column:
    """Mean log ratio over a text's n-grams; 0 for a text without words."""
    shared = spark.sparkContext.broadcast(ratios)

    @F.arrow_udf("double")
    def score(words: pa.Array) -> pa.Array:
        cells, row, n = cells_of(words)
        return pa.array(np.bincount(row, shared.value[cells], minlength=len(n)) / np.maximum(n, 1))

    return score(word_hashes(text))


def gumbel(doc: Column | str, seed: int = SEED) -> Column:
    """A standard Gumbel draw that depends on the id and the seed only."""
    u = (F.shiftrightunsigned(F.xxhash64(doc, F.lit(seed)), 12) + 0.5) / float(2**52)
    return -F.log(-F.log(u))


def kth_largest(df: DataFrame, value: str, k: int) -> int | None:
    """The k-th largest whole number of a column; None if there are fewer."""
    low, high, n = df.agg(F.min(value), F.max(value), F.count(value)).first()
    if n < k or k < 1:
        return None
    while low < high:
        width = max(1, -(-(high - low + 1) // BINS))
        bins = df.where(F.col(value).between(low, high)).groupBy(F.floor((F.col(value) - low) / width).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
        for at, size in sorted(((r["bin"], r["n"]) for r in bins.collect()), reverse=True):
            if size >= k:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            k -= size
        else:
            return None
        if width == 1:
            return low
    return low


def resample(docs: DataFrame, ratios: np.ndarray, share: float, doc: str = "doc_id", text: str = "text", seed: int = SEED) -> DataFrame:
    """(doc, log_ratio, log_weight, draw, kept): a sample of `share` of all rows, by weight."""
    scored = docs.select(F.col(doc).alias("doc"), log_ratio(text, ratios, docs.sparkSession).alias("log_ratio"))
    scored = scored.withColumn("log_weight", LENGTH * F.col("log_ratio")).withColumn("draw", F.col("log_weight") + gumbel("doc", seed))
    scored = cut_lineage(scored.withColumn("_key", F.round(F.col("draw") * UNIT).cast("long")))
    limit = kth_largest(scored, "_key", round(share * scored.count()))
    kept = F.lit(share >= 1) if limit is None else F.col("_key") >= limit
    return scored.withColumn("kept", kept).drop("_key")


def good_share(labels: DataFrame, good: Column) -> float:
    """The share of labelled documents that are good; 1 without labels."""
    found = labels.agg(F.avg(good.cast("double"))).first()[0]
    return 1.0 if found is None else float(found)


def keep_likely(docs: DataFrame, labels: DataFrame, good: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`resample` towards the good labelled documents, for as large a share of all documents as is good among the labelled."""
    ratios = fit(without(docs, "kept"), labels.where(good).select(doc), doc, text)
    return resample(docs, ratios, good_share(labels, good), doc, text)
