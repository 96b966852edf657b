"""Repeated word windows across documents, by compressed FM-indexes over shards.

A window is `WINDOW` consecutive words. It is a repeat if its word sequence also starts earlier, in a document with a
smaller id or further up in the same one; the words of repeats go. Streaming every document against every shard would
grow with the square of the corpus, so text is routed to shards by content:

1. The anchor of a window is the smallest hash of the runs of `GRAM` words inside it. Equal windows have equal anchors,
   and successive windows mostly share theirs. Anchors are counted; a window whose anchor occurs once cannot repeat.
2. Stretches of windows with a common, repeated anchor are cut out and dealt to shards by anchor, with their words. An
   anchor with more than `HOT` stretches is dealt to several shards.
3. Each shard is laid out in order of document and position and gets an FM-index: the Burrows-Wheeler transform in a
   wavelet matrix of packed bits with block counts. Backward search extends all windows by one word a step, and drops a
   window as soon as its interval holds only itself. An interval left after `WINDOW` steps is a match; all of its window
   but the earliest are reported. Equal stretches are indexed once; what is no first copy is reported whole.
4. Windows of a hot anchor that were first in their shard meet again in shards by their whole content, where at most one
   of each first-round shard is left, so the second round has no hot key.

The suffixes are sorted by 32 words, which backward search for up to 32 words cannot tell from a full sort.

Defined results: a null text has no words. Rows with the same id and text are one document and are treated alike; rows
with the same id and other texts are told apart and ordered by a hash. A null id comes before all others. Columns of the
input that bear a name of the operator's own are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import split_words, without

WINDOW = 20
GRAM = 6
#: Stretches of one anchor that share a shard.
HOT = 2000
#: Stretches a shard is meant to hold.
SHARD = 4000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def stretches(words: pa.Array, count: bool = False) -> tuple[np.ndarray, ...]:
    """Of a block of documents (lists of word hashes): word hashes, and of each stretch of windows with one anchor the
    row, its first word in the row and in the block, its number of words, the anchor, and how often it occurs inside
    (on demand): in a text that repeats itself at short range, a single stretch holds an anchor several times."""
    offsets = np.asarray(words.offsets).astype(np.int64)
    h = np.asarray(words.values)[offsets[0] : offsets[-1]].view(np.uint64)
    offsets = offsets - offsets[0]
    empty = np.empty(0, np.int64)
    if len(h) < WINDOW:
        return h, empty, empty, empty, empty, empty, empty
    with np.errstate(over="ignore"):
        g, power, m = np.zeros(len(h) - GRAM + 1, np.uint64), np.uint64(1), _mixed(h)
        for k in range(GRAM):
            g += m[k : k + len(g)] * power
            power *= np.uint64(0x9E3779B97F4A7C15)
        low = grams = _mixed(g)
    span, reach = WINDOW - GRAM + 1, 1
    while reach * 2 <= span:  # sliding minimum by doubling
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(low)]
    whole = np.arange(len(low)) + WINDOW <= offsets[row + 1]
    begins = whole.copy()
    begins[1:] &= ~whole[:-1] | (low[1:] != low[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(begins)
    ends = whole.copy()
    ends[:-1] &= begins[1:] | ~whole[1:]
    last = np.flatnonzero(ends)
    size, times = last - first + WINDOW, empty
    if count and len(first):
        inside = size - GRAM + 1
        runs = np.cumsum(inside) - inside
        same = grams[np.arange(int(inside.sum())) + np.repeat(first - runs, inside)] == np.repeat(low[first], inside)
        times = np.add.reduceat(same, runs, dtype=np.int64)
    return h, row[first], first - offsets[row[first]], first, size, low[first].view(np.int64), times


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, row, _, _, _, anchor, times = stretches(batch.column(2), count=True)
        row, anchor = np.repeat(row, times), np.repeat(anchor, times)
        yield pa.RecordBatch.from_arrays([pa.array(anchor), batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))], ["anchor", "doc", "key"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of a block whose anchor is among the repeated ones of their document."""
    for batch in batches:
        _, row, at, _, size, anchor, _ = stretches(batch.column(2))
        lists = batch.column(3)
        offsets = np.asarray(lists.offsets).astype(np.int64)
        repeated = lists.values.flatten() if isinstance(lists.values, pa.StructArray) else None
        anchors, counts = (np.asarray(x)[offsets[0] : offsets[-1]] for x in repeated)
        owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
        pairs = np.stack([owner.astype(np.int64), anchors], axis=1).view([("row", np.int64), ("anchor", np.int64)]).ravel()
        order = np.argsort(pairs, order=("row", "anchor"))
        pairs, counts = pairs[order], counts[order]
        mine = np.stack([row.astype(np.int64), anchor], axis=1).view([("row", np.int64), ("anchor", np.int64)]).ravel() if len(row) else pairs[:0]
        place = np.minimum(np.searchsorted(pairs, mine), max(len(pairs) - 1, 0))
        keep = np.flatnonzero(pairs[place] == mine) if len(pairs) and len(mine) else np.empty(0, np.int64)
        tokens, words, of = [], [], -1
        for r, a, s in zip(row[keep].tolist(), at[keep].tolist(), size[keep].tolist()):
            if r != of:
                words, of = batch.column(4)[r].as_py().encode("utf-8", "replace").split(), r
            tokens.append(b" ".join(words[a : a + s]))
        rows = pa.array(row[keep])
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor[keep]), pa.array(counts[place[keep]]), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at[keep]), pa.array(tokens, pa.binary())],
            ["anchor", "n", "doc", "key", "at", "tokens"],
        )


class Bits:
    """A bit vector with rank: packed words and the number of ones before each."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int32)[:-1]]).astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def ones(self, i: np.ndarray) -> np.ndarray:
        word = i >> 6
        below = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class FMIndex:
    """Backward search over a text of small whole numbers. Patterns have at most 32 symbols."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        rank = text.astype(np.int64)
        for step in (1, 2, 4, 8, 16):
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            pair = rank * (int(rank.max(initial=0)) + int(after.max(initial=0)) + 2) + after
            order = np.argsort(pair, kind="stable")
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.concatenate([[0], pair[order][1:] != pair[order][:-1]]))
        self.places = np.argsort(rank, kind="stable")
        last = text[self.places - 1]
        size = int(text.max(initial=0)) + 1
        self.smaller = np.searchsorted(np.sort(text), np.arange(size + 1))
        self.levels: list[Bits] = []
        origin = np.zeros(size, np.int64)  # where each symbol's walk from position 0 ends
        symbols = np.arange(size)
        for bit in range(max(size - 1, 1).bit_length() - 1, -1, -1):
            bits = (last >> bit) & 1
            level = Bits(bits)
            self.levels.append(level)
            last = np.concatenate([last[bits == 0], last[bits == 1]])
            ones = level.ones(origin)
            origin = np.where((symbols >> bit) & 1, level.zeros + ones, origin - ones)
        self.origin = origin

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol stands before position i of the transform."""
        bit = len(self.levels)
        at = i
        for level in self.levels:
            bit -= 1
            ones = level.ones(at)
            at = np.where((symbol >> bit) & 1, level.zeros + ones, at - ones)
        return at - self.origin[symbol]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with one more symbol in front."""
        base = self.smaller[symbol]
        both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return base + both[: len(low)], base + both[len(low) :]


def repeated_windows(tokens: list[bytes]) -> list[np.ndarray]:
    """For stretches (words joined by spaces) in order: at which of its windows each repeats a window of an earlier
    stretch, or of itself further up."""
    seen: dict[bytes, int] = {}
    fresh = [i for i, t in enumerate(tokens) if seen.setdefault(t, i) == i]
    words = [tokens[i].split(b" ") for i in fresh]
    sizes = np.array([len(w) for w in words])
    number: dict[bytes, int] = {}
    symbols = np.fromiter((number.setdefault(w, len(number)) for x in words for w in x), np.int64, int(sizes.sum()))
    begins = np.cumsum(sizes + 1) - sizes - 1
    text = np.zeros(int(sizes.sum()) + len(sizes), np.int64)  # a 0 behind each stretch
    text[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))] = symbols + 1
    windows = sizes - WINDOW + 1
    start = np.repeat(begins - np.cumsum(windows) + windows, windows) + np.arange(int(windows.sum()))
    index = FMIndex(text)
    alive = np.arange(len(start))
    symbol = text[start + WINDOW - 1]
    low, high = index.smaller[symbol], index.smaller[symbol + 1]
    for k in range(WINDOW - 2, -1, -1):
        several = high - low > 1
        alive, low, high = alive[several], low[several], high[several]
        if not len(alive):
            break
        low, high = index.extend(text[start[alive] + k], low, high)
    several = high - low > 1
    alive, low, high = alive[several], low[several], high[several]
    repeat = np.zeros(len(start), bool)
    if len(alive):
        lows, first = np.unique(low, return_index=True)
        earliest = np.minimum.reduceat(np.append(index.places, len(text)), np.stack([lows, high[first]], axis=1).ravel())[::2]
        repeat[alive] = start[alive] > earliest[np.searchsorted(lows, low)]
    parts = dict(zip(fresh, np.split(repeat, np.cumsum(windows)[:-1])))
    return [parts[i] if i in parts else np.ones(t.count(b" ") + 2 - WINDOW, bool) for i, t in enumerate(tokens)]


def _spans(found: np.ndarray) -> list[tuple[int, int]]:
    """Runs of True as (first, behind the last)."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], found, [False]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _searched(table: pa.Table, hot: int | None) -> pa.Table:
    """One shard: removed spans of words (tokens null), and the windows that were not removed of anchors with over `hot` stretches."""
    done = table.filter(table.column("tokens").is_null())
    work = table.filter(table.column("tokens").is_valid()).sort_by([("doc", "ascending"), ("key", "ascending"), ("at", "ascending")])
    docs, keys, at, n = (work.column(c).to_pylist() for c in ("doc", "key", "at", "n"))
    order = [i for i in range(len(at)) if i == 0 or (docs[i], keys[i], at[i]) != (docs[i - 1], keys[i - 1], at[i - 1])]
    order = [i for i in order if docs[i] is None] + [i for i in order if docs[i] is not None]
    tokens = work.column("tokens").to_pylist()
    out: list[tuple] = []
    for i, found in zip(order, repeated_windows([tokens[i] for i in order]) if order else []):
        out += [(docs[i], keys[i], at[i] + a, at[i] + b + WINDOW - 1, 0, None) for a, b in _spans(found)]
        if hot is not None and n[i] > hot:
            words = tokens[i].split(b" ")
            out += [(docs[i], keys[i], at[i] + w, 0, 0, b" ".join(words[w : w + WINDOW])) for w in np.flatnonzero(~found).tolist()]
    kept = ["doc", "key", "at", "until", "n", "tokens"]
    new = pa.table({c: pa.array([r[k] for r in out], table.schema.field(c).type) for k, c in enumerate(kept)})
    return pa.concat_tables([done.select(kept), new])


def repeats(keyed: DataFrame) -> DataFrame:
    """(doc, key, spans) of documents (doc, key, text) with repeats: the spans of words, end exclusive, that go."""
    kinds = dict(keyed.dtypes)
    ids = f"doc {kinds['doc']}, key long"
    hashes = F.transform(split_words("text"), lambda w: F.xxhash64(w)).alias("words")
    met = keyed.select("doc", "key", hashes).mapInArrow(_anchors, f"anchor long, {ids}")
    twice = cut_lineage(met.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    shards = max(1, round((twice.agg(F.sum("n")).first()[0] or 0) / SHARD))
    same = lambda a, b: a["doc"].eqNullSafe(b["doc"]) & (a["key"] == b["key"])
    wanted = met.join(twice, "anchor").groupBy("doc", "key").agg(F.collect_set(F.struct("anchor", "n")).alias("anchors"))
    cut = keyed.join(wanted, same(keyed, wanted)).select(keyed["doc"], keyed["key"], hashes, "anchors", "text")
    pieces = cut.mapInArrow(_cut, f"anchor long, n long, {ids}, at long, tokens binary")
    part = F.pmod(F.xxhash64("doc", "key"), F.ceil(F.col("n") / HOT))
    dealt = pieces.select(F.pmod(F.xxhash64("anchor", part), F.lit(shards)).alias("shard"), "doc", "key", "at", F.lit(0).cast("long").alias("until"), "n", "tokens")
    schema = f"{ids}, at long, until long, n long, tokens binary"
    hot = HOT
    once = dealt.groupBy("shard").applyInArrow(lambda t: _searched(t, hot), schema)
    meet = F.when(F.col("tokens").isNotNull(), F.xxhash64("tokens")).otherwise(F.xxhash64("doc", "key", "at"))
    dealt = once.select(F.pmod(meet, F.lit(shards)).alias("shard"), "doc", "key", "at", "until", "n", "tokens")
    spans = dealt.groupBy("shard").applyInArrow(lambda t: _searched(t, None), schema)
    return spans.groupBy("doc", "key").agg(F.collect_list(F.struct("at", "until")).alias("spans"))


def _kept(texts: pa.Array, spans: pa.Array) -> pa.Array:
    counts, removed, kept = [], [], []
    for text, gone in zip(texts.to_pylist(), spans.to_pylist()):
        words = (text or "").encode("utf-8", "replace").split()
        keep = np.ones(len(words), bool)
        for s in gone or []:
            keep[s["at"] : s["until"]] = False
        counts.append(len(words))
        removed.append(len(words) - int(keep.sum()))
        kept.append(b" ".join([w for w, k in zip(words, keep.tolist()) if k] if gone else words))
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["n_words", "n_removed", "kept_text"])


def without_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with `n_words`, `n_removed` and `kept_text`, the words that are left joined by single spaces.

    Without further columns, the texts are dealt by id once: the cutting of stretches and the removal read the same shuffle.
    """

    @F.arrow_udf("struct<n_words: bigint, n_removed: bigint, kept_text: string>")
    def remove(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return _kept(texts, spans)

    own = without(docs, "n_words", "n_removed", "kept_text")
    rest = [c for c in own.columns if c not in (doc, text)]
    keyed = own.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text)).alias("key"), F.col(text).alias("text"), *([F.struct(*[F.col(f"`{c}`") for c in rest]).alias("rest")] if rest else []))
    found = repeats(keyed.select("doc", "key", "text")).withColumnsRenamed({"doc": "_gone_doc", "key": "_gone_key"})
    joined = keyed.join(found, F.col("doc").eqNullSafe(F.col("_gone_doc")) & (F.col("key") == F.col("_gone_key")), "left")
    out = joined.withColumn("_kept", remove(F.col("text"), F.col("spans")))
    return out.select(*[F.col({doc: "doc", text: "text"}.get(c, f"rest.`{c}`")).alias(c) for c in own.columns], "_kept.n_words", "_kept.n_removed", "_kept.kept_text")
