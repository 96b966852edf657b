"""Trie of conversation prefixes, read off sorted conversations by range minima over their common prefixes.

A conversation is a row: `conv_id`, `key` (16 bytes of SHA-256 a turn) and `lens` (code points of each turn's text). Sorted
by key and id, the conversations that start with one sequence of turns lie side by side. Between neighbours stands the
number of turns they share; a sparse table over these numbers answers a range minimum in one look. Every prefix of every
conversation then looks for its left and its right end by itself, by binary search in jumps of powers of two, as far as
the minimum stays at its depth or above. The conversation at the left end reports the node. No stack is kept, and no
candidate waits for another.

The order is cut into blocks of a bounded number of turns. Each knows what its first and last conversation share with
the neighbours outside, so it counts only nodes that begin in it. A node that ends inside its block is whole; one that
reaches over an edge (at most as many a block as its two outer conversations have turns) is added up from its parts.
Everything a node has is a sum over the conversations of its interval, so that parts simply add:

    leaves      conversations that share less with the next one than their own length
    children    conversations that begin a node one deeper
    saved       code points of all turns at the node's depth or below, less those of the nodes that begin there

Defined results: rows without a conv_id belong to no conversation and are left out; null role or text is empty; turns
of equal number stand in the order of their SHA-256; repeated rows are turns of their own. An empty table gives an empty
table. Other columns are not read. A conversation's key, 16 bytes a turn, has to fit into a row, its texts do not.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

WIDTH = 16
#: Prefixes that one block looks up at once.
BLOCK = 300_000
#: Conversation ids in one piece of a list that is still to be hashed.
PIECE = 1_000

NODE = "first long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
PART = "block long, at long, state string, key binary, parent_key binary, parent_at long, piece long, ends string"
SCHEMA = f"{NODE}, {PART}"


def _digest() -> Column:
    """16 bytes that tell one (role, text) from any other; the role's length keeps the two apart."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    return F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 2 * WIDTH))


def own_turns(conversations: DataFrame, shared: int = 100) -> DataFrame:
    """(base, conv_id, turns) with one shuffle, by the conversation `base` whose first turns it is to begin with."""
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), (F.col("conv_id") - F.col("conv_id") % shared).cast("long").alias("base"), F.col("turn"),
        _digest().alias("digest"), F.length(F.coalesce("text", F.lit(""))).alias("n"),
    )
    return turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "n"))).alias("turns"))


def as_keys(turns: Column) -> list[Column]:
    digests = F.unhex(F.array_join(F.transform(turns, lambda t: F.hex(t["digest"])), ""))
    return [digests.alias("key"), F.transform(turns, lambda t: t["n"]).alias("lens")]


def rebuilt(conversations: DataFrame, shared: int = 100, most: int = 6) -> DataFrame:
    """(conv_id, key, lens): the first h turns of the conversation's base, then its own after its first h; h = crc32 of its id modulo `most`."""
    own = own_turns(conversations, shared)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    first = F.max(F.when(F.col("conv_id") == F.col("base"), F.slice("turns", 1, most))).over(Window.partitionBy("base"))
    own = own.withColumn("first", first).withColumn("h", h)
    head = F.slice(F.coalesce("first", F.slice("turns", 1, 0)), 1, F.col("h"))
    whole = own.select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))
    return whole.select("conv_id", *as_keys(F.col("turns")))


class Sparse:
    """Range minima of `values` in two looks; level k holds the minima of 2**k values each."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 * (half := 1 << (len(self.levels) - 1)) <= len(values):
            last = self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima over low..high, both inclusive."""
        out = np.empty(len(low), self.levels[0].dtype)
        power = np.frexp(high - low + 1)[1] - 1
        for k, level in enumerate(self.levels):
            at = np.flatnonzero(power == k)
            out[at] = np.minimum(level[low[at]], level[high[at] - (1 << k) + 1])
        return out

    def reach(self, start: np.ndarray, floor: np.ndarray, right: bool) -> np.ndarray:
        """How far from position `start` values stay at `floor` or above: value i stands between positions i and i + 1."""
        at, n = start.copy(), len(self.levels[0])
        if not n:
            return at
        for k in range(len(self.levels) - 1, -1, -1):
            low = at if right else at - (1 << k)
            fits = (low >= 0) & (low + (1 << k) <= n)
            level = self.levels[k]
            go = fits & (level[np.clip(low, 0, len(level) - 1)] >= floor)
            at[go] += (1 << k) if right else -(1 << k)
        return at


def shared_turns(words: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each conversation but the first, with how many turns it begins as the one before it."""
    both = np.minimum(lengths[:-1], lengths[1:])
    starts = np.cumsum(both) - both
    step = np.arange(both.sum()) - np.repeat(starts, both)
    before, here = np.repeat(offsets[:-1][: len(both)], both) + step, np.repeat(offsets[1:][: len(both)], both) + step
    differ_at = np.where((words[before] != words[here]).any(axis=1), step, np.iinfo(np.int64).max)
    some = both > 0
    out = both.copy()
    if some.any():
        out[some] = np.minimum(both[some], np.minimum.reduceat(differ_at, starts[some]))
    return out


def common(a: bytes | None, b: bytes | None) -> int:
    """Turns that two keys share from the start; -1 where there is no neighbour."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // WIDTH
    x, y = (np.frombuffer(k[: n * WIDTH], np.uint64).reshape(n, 2) for k in (a, b))
    differ = (x != y).any(axis=1)
    return int(differ.argmax()) if differ.any() else n


def _key(key: bytes, depth: int) -> bytes:
    return hashlib.blake2b(key[: depth * WIDTH], digest_size=16, salt=depth.to_bytes(8, "little")).digest()


def block_nodes(ids: np.ndarray, keys: list[bytes], lens: list[np.ndarray], before: int, after: int, block: int, row: int) -> dict[str, list]:
    """The nodes that a block of sorted conversations meets. `before` and `after`: turns shared with the neighbours outside."""
    m = len(ids)
    lengths = np.array([len(k) // WIDTH for k in keys], np.int64)
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    words = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
    lcp = shared_turns(words, offsets[:-1], lengths)  # between i and i + 1
    begins = np.concatenate([[before], lcp])  # turns shared with the conversation before, outside included
    follows = np.concatenate([lcp, [after]])
    # prefixes: conversation i at depths 0..length, in this order
    first_of = np.concatenate([[0], np.cumsum(lengths + 1)])
    of = np.repeat(np.arange(m), lengths + 1)
    depth = np.arange(first_of[-1]) - first_of[of]
    table = Sparse(lcp)
    left, right = table.reach(of, depth, False), table.reach(of, depth, True)
    chars = np.concatenate([np.asarray(x, np.int64) for x in lens]) if offsets[-1] else np.zeros(0, np.int64)
    summed = np.concatenate([[0], np.cumsum(chars)])
    upto = lambda i, d: summed[offsets[i] + d] - summed[offsets[i]]  # noqa: E731  code points of the first d turns
    total = upto(np.arange(m), lengths)
    begun = total - upto(np.arange(m), np.clip(begins, 0, None))  # of the nodes that begin with a conversation
    total_upto, begun_upto = np.concatenate([[0], np.cumsum(total)]), np.concatenate([[0], np.cumsum(begun)])
    leaves_upto = np.concatenate([[0], np.cumsum(follows < lengths)])

    nodes = np.flatnonzero(left == of)
    parent = np.where(depth > 0, first_of[left[np.maximum(np.arange(len(of)) - 1, 0)]] + depth - 1, -1)
    new = nodes[depth[nodes] > begins[of[nodes]]]  # not the parts of nodes that began in an earlier block
    children = np.bincount(parent[new][parent[new] >= 0], minlength=len(of))
    l, r, d = left[nodes], right[nodes], depth[nodes]
    n = r - l + 1
    above = upto(l, np.maximum(d - 1, 0))
    own = total[l] - upto(l, np.maximum(np.maximum(d - 1, begins[l]), 0))
    saved = total_upto[r + 1] - total_upto[l] - n * above - (begun_upto[r + 1] - begun_upto[l + 1]) - own
    least = Sparse(ids).least(l, r)
    least_at = np.full(len(of), -1, np.int64)
    least_at[nodes] = least
    open_ = ((l == 0) & (d <= before)) | ((r == m - 1) & (d <= after))
    is_open = np.zeros(len(of), bool)
    is_open[nodes] = open_
    above_at = parent[nodes]
    waits = (above_at >= 0) & is_open[above_at]
    leaves = leaves_upto[r + 1] - leaves_upto[l]
    # the conversations that end at a node are the first of its interval
    same = np.concatenate([(lcp == lengths[:-1]) & (lengths[1:] == lengths[:-1]), [False]])
    last_same = np.flatnonzero(~same)
    ends = np.where(lengths[l] == d, last_same[np.searchsorted(last_same, l)] - l + 1, 0)

    empty = hashlib.sha256(b"").hexdigest()
    names = np.array(ids.astype(str), object)
    out: dict[str, list] = {c.split()[0]: [] for c in SCHEMA.split(", ")}
    plain = {"first": row + l, "depth": d, "n_convs": n, "n_children": children[nodes], "n_leaves": leaves, "saved_tokens": saved, "at": nodes, "conv_id": least}
    plain = {c: v.tolist() for c, v in plain.items()}
    rows = zip(l.tolist(), ends.tolist(), open_.tolist(), waits.tolist(), above_at.tolist(), d.tolist())
    for k, (begin, e, is_part, waiting, up, deep) in enumerate(rows):
        pieces: list[str | None] = [None]
        sha = None
        if is_part:
            pieces = [",".join(names[s : min(s + PIECE, begin + e)]) for s in range(begin, begin + e, PIECE)] or [None]
        elif e:
            sha = hashlib.sha256(",".join(names[begin : begin + e]).encode()).hexdigest()
        else:
            sha = empty
        for p, piece in enumerate(pieces):
            for c, v in plain.items():  # a list in several pieces is counted once
                out[c].append(0 if p and c.startswith("n_") or p and c == "saved_tokens" else v[k])
            out["parent_conv_id"].append(None if deep == 0 or waiting else int(least_at[up]))
            out["ends_sha256"].append(sha)
            out["block"].append(block)
            out["state"].append("part" if is_part else "waits" if waiting else "whole")
            out["key"].append(_key(keys[begin], deep) if is_part else None)
            out["parent_key"].append(_key(keys[begin], deep - 1) if is_part and deep else None)
            out["parent_at"].append(up if waiting else None)
            out["piece"].append(p)
            out["ends"].append(piece)
    return out


def _in_blocks(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Cut a partition's sorted conversations into blocks. One block is held back, for what it shares with the next."""
    ids: list[int] = []
    keys: list[bytes] = []
    lens: list[np.ndarray] = []
    weight, part, before, after, number, row = 0, 0, -1, -1, 0, 0

    def emit(shared_after: int) -> pa.RecordBatch:
        found = block_nodes(np.array(ids, np.int64), keys, lens, before, shared_after, (part << 32) | number, row)
        return pa.RecordBatch.from_pydict(found, schema=schema)

    for batch in batches:
        col = {c: batch.column(c) for c in ("part", "before", "after", "first_row", "conv_id", "key", "lens")}
        if not batch.num_rows:
            continue
        if not ids:
            part, before, after, row = (col[c][0].as_py() for c in ("part", "before", "after", "first_row"))
        sizes = col["lens"]
        at, flat = sizes.offsets.to_numpy(), sizes.values.to_numpy(zero_copy_only=False)
        for i, (c, k) in enumerate(zip(col["conv_id"].to_pylist(), col["key"].to_pylist())):
            if ids and weight + len(k) // WIDTH + 1 > most:
                shared = common(keys[-1], k)
                yield emit(shared)
                row, number, before, weight = row + len(ids), number + 1, shared, 0
                ids, keys, lens = [], [], []
            ids.append(c)
            keys.append(k)
            lens.append(flat[at[i] : at[i + 1]].copy())
            weight += len(k) // WIDTH + 1
    if ids:
        yield emit(after)


def _shared_sql(a: str, b: str) -> Column:
    n = (F.least(F.octet_length(a), F.octet_length(b)) / WIDTH).cast("int")
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substring(a, F.lit(1), i * WIDTH) == F.substring(b, F.lit(1), i * WIDTH))
    return F.coalesce(F.size(same) - 1, F.lit(-1))


def _edges(ordered: DataFrame) -> DataFrame:
    """(part, before, after, first_row): what a partition's outer conversations share with their neighbours; one row a partition."""
    ends = ordered.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high"), F.count(F.lit(1)).alias("n"))
    by = Window.orderBy("part")
    ends = ends.withColumns({"_high": F.lag("high").over(by), "_low": F.lead("low").over(by), "first_row": F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    before, after = (F.when(F.col(there).isNull(), -1).otherwise(_shared_sql(there, here)) for there, here in (("_high", "low"), ("_low", "high")))
    return ends.select("part", before.alias("before"), after.alias("after"), "first_row")


def _merged(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Parts of nodes, sorted by key and block, to whole nodes. The hash of a list goes on from piece to piece, so no list is held."""
    now: dict | None = None
    sha = hashlib.sha256()
    done: list[dict] = []

    def close() -> dict:
        return {**now, "ends_sha256": sha.hexdigest()}

    for batch in batches:
        for p in batch.to_pylist():
            if now is None or p["key"] != now["key"]:
                if now is not None:
                    done.append(close())
                now, sha, listed = {k: p[k] for k in schema.names if k != "ends_sha256"}, hashlib.sha256(), False
            else:
                for k in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[k] += p[k]
                for k in ("conv_id", "first"):
                    now[k] = min(now[k], p[k])
            if p["ends"] is not None:
                sha.update((("," if listed else "") + p["ends"]).encode())
                listed = True
        if len(done) >= 1_000:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
            done = []
    if now is not None:
        done.append(close())
    if done:
        yield pa.RecordBatch.from_pylist(done, schema=schema)


def in_order(convs: DataFrame) -> DataFrame:
    """The conversations sorted by key and id, `part` being the partition; written once, so that a lost executor changes nothing."""
    ordered = cut_lineage(convs.select("conv_id", "key", "lens").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id"))
    return ordered.withColumn("part", F.spark_partition_id())


def prefix_trie(convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row for each distinct prefix of the conversations (conv_id, key, lens).

    conv_id: the smallest member. first: its members are the conversations first .. first + n_convs - 1 of the order by
    key and id, counted from 0. ends_sha256: hash of the ids of the members that end here, ascending, joined by commas;
    a list can be as long as the table and is hashed piece by piece.
    """
    arrow = lambda ddl: pa.schema([pa.field(n, {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[t]) for n, t in (c.split() for c in ddl.split(", "))])
    whole, ordered = arrow(SCHEMA), in_order(convs)
    placed = ordered.join(F.broadcast(_edges(ordered)), "part")
    found = cut_lineage(placed.mapInArrow(lambda batches: _in_blocks(batches, whole, block), SCHEMA))
    names = [c.split()[0] for c in NODE.split(", ")]

    parts = found.where("state = 'part'")
    merging = f"key binary, parent_key binary, {NODE}"
    merging_schema = arrow(merging)
    ready = parts.select(*[c.split()[0] for c in merging.split(", ")], "block", "piece", "ends").repartition("key").sortWithinPartitions("key", "block", "piece")
    merged = cut_lineage(ready.mapInArrow(lambda batches: _merged(batches, merging_schema), merging))
    ids = merged.select(F.col("key").alias("_key"), F.col("conv_id").alias("_least"))
    open_nodes = merged.join(ids, F.col("parent_key") == F.col("_key"), "left").withColumn("parent_conv_id", F.col("_least"))

    known = parts.where("piece = 0").select("block", F.col("at").alias("parent_at"), "key").join(ids, F.col("key") == F.col("_key")).select("block", "parent_at", "_least")
    waiting = found.where("state = 'waits'").join(known, ["block", "parent_at"]).withColumn("parent_conv_id", F.col("_least"))
    return found.where("state = 'whole'").select(*names).unionByName(waiting.select(*names)).unionByName(open_nodes.select(*names))
