"""Ranked lexical search over posting lists that are cut into blocks of similar documents.

A document's score for an item is a sum over the item's terms, repeats included, of weight times impact, whole numbers all:

    weight  floor(1000 * ln((2 N + 2) / (2 df + 1)))
    impact  (10^9 tf) div (1000 tf + 8 m),  m = 100 - 75 + (75 n N) div L

Every document is indexed, in shards of a bounded number of postings that tasks hold one at a time:

1. Each posting list is clustered by document similarity: random projections of the documents' weighted impacts, seeds
   taken along the list, and every document of the list goes to its nearest seed. A cluster is cut to blocks.
2. A block's summary is the coordinatewise maximum of its documents' impacts, over the terms that meet the list's own term
   in some item. Items times summary is an exact upper bound for each document of the block.
3. An item goes through its lists from the largest bound down. What an earlier list held is settled, so a block's bound
   leaves earlier terms out. Blocks are opened from the highest bound on and skipped only when the bound fails, that is
   when it is below the k-th best score so far (an equal one is opened, for the tie). Lists end when even all their
   maxima together fail. Open blocks are scored whole.
4. The k best of every task meet per item.

A list is clustered when an item first opens it. Items come in batches of a bounded number of terms, one pass each; only a
batch's terms are looked up in the documents, and it alone is broadcast.

Defined results: a null text has no term and is no hit. Ties go to the smaller doc_id (a number), null last, then to a
hash of the text. Rows that share a doc_id are documents of their own. Items are the distinct pairs of id and text; rows
of one id with different texts are ranked apart. An empty table on either side gives an empty table. Other columns are
not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, scratch_path
from .text import lower_ascii

#: What parts the terms of a text whose A-Z are lower-cased.
NOT_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Distinct terms of items that one pass looks up.
BATCH_TERMS = 500_000
#: Postings of a shard, documents of a block, dimensions of the projections.
SHARD = 600_000
BLOCK = 32
DIMENSIONS = 16
SEED = 7


class Blocks:
    """One posting list: documents by block, where blocks begin, and the summaries over `columns`."""

    def __init__(self, docs: np.ndarray, starts: np.ndarray, columns: np.ndarray, summary: np.ndarray):
        self.docs, self.starts, self.columns, self.summary = docs, starts, columns, summary
        self.ends = np.append(starts[1:], len(docs))


class Shard:
    """Index of some documents. `offsets`, `terms`, `impacts`: their vectors; `together[t]`: terms that meet t in some item."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray, together: dict[int, np.ndarray]):
        self.offsets, self.terms, self.impacts, self.together = offsets, terms, impacts, together
        self.sizes = np.diff(offsets)
        self.weights = weights
        of = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(terms, kind="stable")
        self.list_docs = of[order]
        self.list_at = np.searchsorted(terms[order], np.arange(len(weights) + 1))
        self.most = np.zeros(len(weights), np.int64)
        held = np.flatnonzero(np.diff(self.list_at))
        if len(held):
            self.most[held] = np.maximum.reduceat(impacts[order], self.list_at[held])
        self.place = self._projected(of)
        self.lists: dict[int, Blocks] = {}
        self.item = np.zeros(len(weights), np.int64)
        self.column = np.full(len(weights), -1, np.int64)
        self.blocks_met = self.blocks_opened = 0

    def _projected(self, of: np.ndarray) -> np.ndarray:
        signs = np.random.default_rng(SEED).choice(np.array([-1.0, 1.0], np.float32), (len(self.weights), DIMENSIONS))
        values = (self.impacts * self.weights[self.terms]).astype(np.float32)
        place = np.zeros((len(self.sizes), DIMENSIONS), np.float32)
        for d in range(DIMENSIONS):
            place[:, d] = np.bincount(of, values * signs[self.terms, d], len(self.sizes))
        norm = np.linalg.norm(place, axis=1, keepdims=True)
        return place / np.where(norm > 0, norm, 1)

    def _spread(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the vectors of `docs` stand, and whose they are."""
        sizes = self.sizes[docs]
        begins = np.cumsum(sizes) - sizes
        return np.arange(sizes.sum()) + np.repeat(self.offsets[docs] - begins, sizes), begins

    def blocks(self, term: int) -> Blocks:
        if term not in self.lists:
            docs = self.list_docs[self.list_at[term] : self.list_at[term + 1]]
            if len(docs) > BLOCK:
                seeds = docs[:: BLOCK // 2]
                near = self.place[docs] @ self.place[seeds].T
                label, close = near.argmax(axis=1), near.max(axis=1)
                order = np.lexsort((-close, label))
                docs, label = docs[order], label[order]
                first = np.flatnonzero(np.diff(label, prepend=-1))
                inside = np.arange(len(docs)) - np.repeat(first, np.diff(np.append(first, len(docs))))
                starts = np.flatnonzero(inside % BLOCK == 0)
            else:
                starts = np.zeros(1, np.int64)
            columns = self.together[term]
            self.column[columns] = np.arange(len(columns))
            at, _ = self._spread(docs)
            block = np.repeat(np.searchsorted(starts, np.arange(len(docs)), side="right") - 1, self.sizes[docs])
            column = self.column[self.terms[at]]
            known = column >= 0
            summary = np.zeros((len(starts), len(columns)), np.int64)
            np.maximum.at(summary, (block[known], column[known]), self.impacts[at[known]])
            self.column[columns] = -1
            self.lists[term] = Blocks(docs, starts, columns, summary)
        return self.lists[term]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        at, begins = self._spread(docs)
        return np.add.reduceat(self.impacts[at] * self.item[self.terms[at]], begins)

    def search(self, terms: np.ndarray, weights: np.ndarray, floor: int, keep) -> None:
        """Hand documents that may be among the best to keep(docs, scores), which returns the score to reach from then on."""
        bounds = self.most[terms] * weights
        order = np.argsort(-bounds, kind="stable")
        order = order[bounds[order] > 0]
        terms, weights, bounds = terms[order], weights[order], bounds[order]
        rest = np.cumsum(bounds[::-1])[::-1]
        self.item[terms] = weights
        seen = np.zeros(len(self.sizes), bool)
        for j, term in enumerate(terms.tolist()):
            if rest[j] < max(floor, 1):
                break
            b = self.blocks(term)
            # documents that hold an earlier term are settled
            most = b.summary[:, np.searchsorted(b.columns, terms[j:])] @ weights[j:]
            self.blocks_met += len(most)
            waiting, step = np.argsort(-most, kind="stable"), 4
            while len(waiting := waiting[: np.searchsorted(-most[waiting], -max(floor, 1), side="right")]):
                now, waiting = waiting[:step], waiting[step:]
                self.blocks_opened += len(now)
                docs = np.concatenate([b.docs[b.starts[k] : b.ends[k]] for k in now.tolist()])
                docs = docs[~seen[docs]]
                seen[docs] = True
                if len(docs):
                    floor = keep(docs, self.scores(docs))
                step *= 2
        self.item[terms] = 0


class Best:
    """The k best documents of one item so far."""

    def __init__(self, k: int):
        self.k = k
        self.rows = np.zeros((4, 0), np.int64)  # score, 1 if without id, id, tie

    @property
    def floor(self) -> int:
        return int(self.rows[0, -1]) if self.rows.shape[1] == self.k else 0

    def add(self, rows: np.ndarray) -> int:
        rows = rows[:, rows[0] >= max(self.floor, 1)]
        if rows.shape[1]:
            both = np.concatenate([self.rows, rows], axis=1)
            self.rows = both[:, np.lexsort((both[3], both[2], both[1], -both[0]))[: self.k]]
        return self.floor


def _vectors(docs: DataFrame, doc: str, text: str, vocabulary) -> DataFrame:
    """(doc, tie, n, terms, tfs) of every document with a term; n counts all its terms, the lists those of the vocabulary."""
    ready = docs.select(F.col(doc).cast("long").alias("doc"), F.xxhash64(text).alias("tie"), lower_ascii(F.coalesce(text, F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary.value)}.get
        for batch in batches:
            sizes, terms, tfs, texts = [], [], [], batch.column("text")
            for i in range(batch.num_rows):
                words = TERM.findall(texts[i].as_py())
                sizes.append(len(words))
                found, tf = np.unique(np.fromiter((k for k in map(number, words) if k is not None), np.int32), return_counts=True)
                terms.append(found)
                tfs.append(tf.astype(np.int32))
            ends = pa.array(np.concatenate([[0], np.cumsum([len(t) for t in terms])]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x or [np.zeros(0, np.int32)]))) for x in (terms, tfs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(sizes, pa.int64()), *lists], names=["doc", "tie", "n", "terms", "tfs"])

    path = scratch_path(docs.sparkSession, "vectors")
    ready.mapInArrow(count, "doc long, tie long, n long, terms array<int>, tfs array<int>").where("n > 0").write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """doc, null, tie, n, offsets, terms, tfs of at most `most` postings, or one document."""
    for batch in batches:
        col = {c: batch.column(c) for c in ("doc", "tie", "n", "terms", "tfs")}
        ends = col["terms"].offsets.to_numpy().astype(np.int64)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + most, side="right")) - 1)
            part = slice(begin, end)
            values = [col[c].values.to_numpy()[ends[begin] : ends[end]] for c in ("terms", "tfs")]
            doc = col["doc"][part]
            yield (
                doc.fill_null(0).to_numpy(), doc.is_null().to_numpy(zero_copy_only=False).astype(np.int64), col["tie"][part].to_numpy(), col["n"][part].to_numpy(),
                ends[begin : end + 1] - ends[begin], values[0].astype(np.int64), values[1].astype(np.int64),
            )
            begin = end


def impact(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    m = 100 - 75 + (75 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _best_of(vectors: DataFrame, shared, k: int, shard_size: int) -> DataFrame:
    """(item, doc, tie, score): the best of every task."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, items, together, documents, n_terms = shared.value
        best = [Best(k) for _ in items]
        for doc, null, tie, n, offsets, terms, tfs in _shards(batches, shard_size):
            sizes = np.diff(offsets)
            shard = Shard(offsets, terms, impact(tfs, np.repeat(n, sizes), documents, n_terms), weights, together)
            for (wanted, counts), b in zip(items, best):
                keep = lambda docs, scores, b=b: b.add(np.stack([scores, null[docs], doc[docs], tie[docs]]))
                shard.search(wanted, counts * weights[wanted], b.floor, keep)
        rows = [(i, *r) for i, b in enumerate(best) for r in b.rows.T.tolist()]
        if rows:
            item, score, null, doc, tie = (list(x) for x in zip(*rows))
            doc = [None if z else d for d, z in zip(doc, null)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, tie, score)], names=["item", "doc", "tie", "score"])

    return vectors.mapInArrow(search, "item long, doc long, tie long, score long")


def _batch(docs: DataFrame, rows: list, kind: str, doc: str, text: str, k: int, shard_size: int) -> DataFrame:
    """The k best documents of some items; `rows` holds (item key, item id, term, count)."""
    spark = docs.sparkSession
    keys = {key: i for i, key in enumerate(dict.fromkeys(r["key"] for r in rows))}
    names = {keys[r["key"]]: r["id"] for r in rows}
    vocabulary = sorted({r["term"] for r in rows})
    number = {t: i for i, t in enumerate(vocabulary)}
    vectors = _vectors(docs, doc, text, spark.sparkContext.broadcast(vocabulary))
    size = vectors.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    held = vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.floor(1000 * F.log(F.lit(2.0 * size["documents"] + 2) / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(vocabulary), np.int64)
    for r in held.select("term", weight.alias("weight")).toLocalIterator():
        weights[r["term"]] = r["weight"]

    wanted: list[dict[int, int]] = [{} for _ in keys]
    for r in rows:
        wanted[keys[r["key"]]][number[r["term"]]] = r["n"]
    items = [(np.array(sorted(w), np.int64), np.array([w[t] for t in sorted(w)], np.int64)) for w in wanted]
    pairs: dict[int, set[int]] = {}
    for terms, _ in items:
        for t in terms.tolist():
            pairs.setdefault(t, set()).update(terms.tolist())
    together = {t: np.array(sorted(with_), np.int64) for t, with_ in pairs.items()}
    found = _best_of(vectors, spark.sparkContext.broadcast((weights, items, together, size["documents"], size["terms"])), k, shard_size)
    named = spark.createDataFrame([(i, n) for i, n in names.items()], f"item long, item_id {kind}")
    return found.join(F.broadcast(named), "item")


def ranked_search(
    docs: DataFrame, items: DataFrame, k: int = 10, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
    batch_terms: int = BATCH_TERMS, shard_size: int = SHARD,
) -> DataFrame:
    """(item_id, rank, doc_id, score): for every item its k best documents with a score above 0."""
    spark = docs.sparkSession
    kind = items.schema[item].dataType.simpleString()
    split = F.array_remove(F.split(lower_ascii(F.coalesce(item_text, F.lit(""))), NOT_TERM), "")
    listed = items.select(F.col(item).alias("id"), F.sha2(F.coalesce(item_text, F.lit("")), 256).alias("hash"), split.alias("terms")).dropDuplicates(["id", "hash"])
    listed = listed.withColumn("key", F.concat(F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")), F.lit(" "), "hash"))
    counted = cut_lineage(listed.select("key", "id", F.explode("terms").alias("term")).groupBy("key", "id", "term").agg(F.count(F.lit(1)).alias("n")))
    batches = -(-counted.count() // batch_terms)
    out = spark.createDataFrame([], f"item long, doc long, tie long, score long, item_id {kind}, batch int")
    for b in range(batches):
        rows = counted.where(F.pmod(F.xxhash64("key"), F.lit(batches)) == b).collect()
        if rows:
            found = _batch(docs, rows, kind, doc, text, k, shard_size).withColumn("batch", F.lit(b))
            out = out.unionByName(found)
    order = Window.partitionBy("batch", "item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last(), "tie")
    best = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("item_id", "rank", F.col("doc").alias("doc_id"), "score")
