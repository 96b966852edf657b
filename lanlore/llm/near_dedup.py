"""MinHash near-duplicate groups with b-bit signatures, confirmed on full shingle sets.

1. Texts with equal shingle sets are one class, told by the set's size and a 128-bit sum, and stand in as its smallest
   id. A group of copies, however large, is one node from here on.
2. Each node gets `BANDS * ROWS` minima. Nodes that share all minima of a band meet in a bucket. A pair at the threshold
   of 0.8 is missed with probability (1 - 0.8^5)^36 = 6e-7. Only the lowest `BITS` bits of the minima are kept, packed.
3. Within a bucket every node is paired with one node only, drawn anew in each bucket. The share of equal b-bit fields,
   corrected for chance, estimates the similarity; pairs more than six standard errors below the threshold go.
4. Each node's most promising pair is confirmed on full sets and what holds is joined into components; again for what
   still runs between components.
5. Buckets that still hold several components are worked off completely: every node outside a bucket's largest
   component is held against all nodes of other components there. So no link between different components is left
   untried, and a group of thousands of near copies, one component by then, costs nothing more. Large buckets are worked
   off in blocks, so that no task holds a whole bucket and no pair becomes a row unless it is a link.

Defined results: a text without words has an empty set and is linked with nothing; so is a row without an id, whose
component is null and which is kept. Rows that share an id are one document, linked if any of its texts is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import lower_ascii, split_words

BANDS = 36
ROWS = 5
BITS = 2
SEED = 20240229
FIELDS = 64 // BITS
#: Standard errors of the estimate that a pair may lie below the threshold and still be confirmed on full sets.
MARGIN = 6.0
#: Nodes up to which a bucket's pairs are rows, and nodes of one side of a block beyond that.
SMALL = 16
BLOCK = 1000
#: Rows of a table of links that one task reads.
ROWS_PER_TASK = 50_000
#: Rounds in which each node tries its best pair before whole buckets are worked off.
ROUNDS = 1


def shingle_set(text: Column | str, size: int) -> Column:
    """Distinct shingles of `size` words, as 64-bit hashes; a shorter text is one shingle, a text without words none."""
    words = split_words(lower_ascii(text))
    of = lambda w: F.when(
        F.size(w) >= size, F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(size)])))
    ).otherwise(F.when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>")))
    return F.get(F.transform(F.array(words), of), F.lit(0))  # the words are bound once, not once per use


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _minima(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The minima (texts x hashes) of sets that lie one behind the other in `values`. Sets are not empty."""
    draw = np.random.default_rng(SEED)
    factors = draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = draw.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64)
    ends = np.append(starts[1:], len(values))
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    first = 0
    while first < len(starts):  # some tens of thousands of values at a time stay in the cache; one long set may be more
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + 65_536, "right")))
        part = values[starts[first] : ends[last - 1]]
        at, buffer = starts[first:last] - starts[first], np.empty(len(part), np.uint64)
        for k in range(BANDS * ROWS):
            np.multiply(part, factors[k], out=buffer)
            buffer += shifts[k]
            out[first:last, k] = np.minimum.reduceat(buffer, at)
        first = last
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = -(-BANDS * ROWS // FIELDS)
    for batch in batches:
        sets = batch.column(1)
        offsets = np.asarray(sets.offsets).astype(np.int64)
        values = np.asarray(sets.values).view(np.uint64)[offsets[0] : offsets[-1]]
        sizes = np.diff(offsets)
        full = np.flatnonzero(sizes)
        starts = offsets[:-1][full] - offsets[0]
        bands, packed, sums = np.zeros((len(sizes), BANDS), np.uint64), np.zeros((len(sizes), longs), np.uint64), np.zeros((2, len(sizes)), np.uint64)
        if len(full):
            minima = _minima(values, starts)
            keys = np.zeros((len(full), BANDS), np.uint64)
            for r in range(ROWS):
                keys = _mixed(keys ^ minima[:, r::ROWS], r + 1)
            bands[full] = _mixed(keys + np.arange(BANDS, dtype=np.uint64), 99)
            bits = _mixed(minima, 7) & np.uint64(2**BITS - 1)
            for k in range(BANDS * ROWS):
                packed[full, k // FIELDS] |= bits[:, k] << np.uint64(BITS * (k % FIELDS))
            for k in range(2):
                sums[k, full] = np.add.reduceat(_mixed(values, 11 + k), starts)
        lists = [pa.ListArray.from_arrays(np.arange(len(sizes) + 1, dtype=np.int32) * x.shape[1], x.view(np.int64).ravel()) for x in (bands, packed)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes), *[pa.array(x.view(np.int64)) for x in sums], *lists], ["doc", "n", "fp1", "fp2", "bands", "packed"])


def signatures(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 5) -> DataFrame:
    """(doc, n, fp1, fp2, bands, packed) per row: set size, set fingerprint, band keys and packed b-bit minima."""
    sets = docs.select(F.col(doc).alias("doc"), shingle_set(text, size).alias("set"))
    return sets.mapInArrow(_signed, f"doc {dict(sets.dtypes)['doc']}, n long, fp1 long, fp2 long, bands array<long>, packed array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from two packed signatures: the share of equal 2-bit fields, less those that chance makes equal."""
    odd = F.lit(int("01" * FIELDS, 2))
    differ = F.lit(0)
    for k in range(-(-BANDS * ROWS // FIELDS)):
        x = F.get(F.col(a), F.lit(k)).bitwiseXOR(F.get(F.col(b), F.lit(k)))
        differ = differ + F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(odd))
    chance = 2.0**-BITS
    return (1.0 - differ / F.lit(float(BANDS * ROWS)) - chance) / (1.0 - chance)


def least_estimate(threshold: float) -> float:
    chance = 2.0**-BITS
    equal = chance + (1 - chance) * threshold
    return threshold - MARGIN * (equal * (1 - equal) / (BANDS * ROWS)) ** 0.5 / (1 - chance)


def compact(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read by as many tasks as its rows are worth.

    Tables of links are small beside the texts. Left on as many partitions as the texts were shuffled to, each further
    shuffle of them would write that many files times as many.
    """
    df = cut_lineage(df)
    return df.coalesce(max(1, -(-df.count() // ROWS_PER_TASK)))


def components(links: DataFrame) -> DataFrame:
    """(node, component) of linked pairs (a, b): the smallest node reached, by alternating large and small stars.

    Every round is written, so neither the plan nor a lost executor reaches back further.
    """
    current = compact(links.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).where("hi <> lo").distinct())
    tasks, seen = current.rdd.getNumPartitions(), None
    while True:
        both = current.union(current.select(F.col("lo").alias("hi"), F.col("hi").alias("lo"))).toDF("u", "v").coalesce(tasks)
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v <> m").select(F.col("v").alias("hi"), F.col("m").alias("lo")).coalesce(tasks)
        large = large.distinct().coalesce(tasks)
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(lowest, "hi")
        small = joined.select("hi", "m").union(joined.where("lo <> m").select("lo", "m")).toDF("hi", "lo").coalesce(tasks)
        current = cut_lineage(small.distinct().coalesce(tasks))
        state = tuple(current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if state == seen:
            return current.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component")).coalesce(tasks)
        seen = state


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    one, two = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    both = pairs.select("a", "b").join(one, "a").join(two, "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
    return both.where(100 * F.col("common") >= percent * (F.size("set_a") + F.size("set_b") - F.col("common"))).select("a", "b").distinct()


def _labelled(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    return df.join(labels.toDF(node, "_label"), node, "left").withColumn(out, F.coalesce("_label", node)).drop("_label")


def _overlaps(left: pa.Table, right: pa.Table, percent: int) -> pa.Table:
    """Links of one block that join components: every left set against all right sets, through an inverted index of the right ones.

    Nodes of one label are joined already, so as many links as join all labels that are linked here say the same as all of them.
    """
    sets = right.column("set").combine_chunks()
    offsets = np.asarray(sets.offsets).astype(np.int64)
    values = np.asarray(sets.values)[offsets[0] : offsets[-1]]
    sizes = np.diff(offsets)
    owners = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(values, kind="stable")
    values, owners = values[order], owners[order]
    nodes = np.asarray(right.column("node"))
    own = pa.chunked_array(left.column("label").chunks + right.column("label").chunks).combine_chunks().dictionary_encode().indices.to_numpy()
    own, labels = own[: left.num_rows], own[left.num_rows :]
    above = list(range(1 + max(own.max(initial=-1), labels.max(initial=-1))))

    def top(label: int) -> int:
        while above[label] != label:
            above[label] = label = above[above[label]]
        return label

    one, two = [], []
    for node, label, members in zip(left.column("node").to_pylist(), own.tolist(), left.column("set")):
        mine = np.asarray(members.values)
        lo, hi = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
        counts = hi - lo
        at = np.repeat(lo - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        common = np.bincount(owners[at], minlength=len(sizes))
        linked = np.flatnonzero((labels != label) & (100 * common >= percent * (len(mine) + sizes - common)))
        for other, first in zip(*(x.tolist() for x in np.unique(labels[linked], return_index=True))):
            if top(label) != top(other):
                above[top(label)] = top(other)
                one.append(node)
                two.append(nodes[linked[first]])
    return pa.table({"a": pa.array(one, left.schema.field("node").type), "b": pa.array(two, left.schema.field("node").type)})


def _between(shared: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Linked pairs (a, b) of one bucket and different components. A bucket's largest component is only ever the other side.

    Pairs of small buckets are held against the estimate first. A large bucket is cut into blocks on both sides, and each
    pair of blocks is one small group whose sets are counted against each other; only links that join components come out.
    """
    members = _labelled(shared.select("key", "node"), labels, "node", "label")
    parts = members.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy("key").agg(F.max(F.struct("n", "label")).alias("most"), F.count(F.lit(1)).alias("parts"), F.sum("n").alias("all")).where("parts > 1")
    members = compact(members.join(mixed.select("key", F.col("most.label").alias("major"), "all", (F.col("all") - F.col("most.n")).alias("few")), "key"))

    small = members.where(F.col("all") <= SMALL).join(nodes.select("node", "packed"), "node").select("key", "node", "label", "major", "packed")
    few = small.where(F.col("label") != F.col("major")).select("key", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("packed").alias("packed_a"))
    pairs = few.join(small, "key").where(
        (F.col("label_a") != F.col("label")) & ((F.col("label") == F.col("major")) | (F.col("a") < F.col("node"))) & (estimate("packed_a", "packed") >= least_estimate(percent / 100))
    )
    pairs = pairs.select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct().join(tried, ["a", "b"], "left_anti")

    large = members.where(F.col("all") > SMALL).join(sets, "node")
    across, down = F.ceil(F.col("few") / BLOCK).cast("int"), F.ceil(F.col("all") / BLOCK).cast("int")
    deal = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")  # noqa: E731  of the same type as `every`: else the two sides of a block are hashed to different tasks
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = large.where(F.col("label") != F.col("major")).select("key", deal(across).alias("i"), every(down).alias("j"), "node", "label", "set")
    right = large.select("key", every(across).alias("i"), deal(down).alias("j"), "node", "label", "set")
    kind = dict(members.dtypes)["node"]
    names = ["key", "i", "j", "node", "label", "set"]
    blocks = left.toDF(*names).groupBy("key", "i", "j").cogroup(right.toDF(*names).groupBy("key", "i", "j"))
    return confirmed(pairs, sets, percent).union(blocks.applyInArrow(lambda a, b: _overlaps(a, b, percent), f"a {kind}, b {kind}")).distinct()


def _components(nodes: DataFrame, sets_of, ties: DataFrame, percent: int) -> DataFrame:
    """(node, component) of every node that is linked with another, by similarity or by `ties`."""
    least = least_estimate(percent / 100)
    keys = nodes.select("node", F.explode("bands").alias("key")).distinct()
    met = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("node", "key").alias("h"), "node"))["node"].alias("rep")).where("n > 1")
    shared = compact(keys.join(met.select("key", "rep"), "key"))
    sets = cut_lineage(sets_of(shared.select("node").distinct()))
    signed = nodes.select("node", "packed")
    tries = shared.where("node <> rep").select("node", "rep").distinct().join(signed, "node").join(signed.toDF("rep", "packed_rep"), "rep")
    tries = compact(tries.withColumn("est", estimate("packed", "packed_rep")).where(F.col("est") >= least).groupBy("node", "rep").agg(F.max("est").alias("est")))
    links = tried = tries.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b")).limit(0)
    labels = tries.select("node", F.col("node").alias("component")).limit(0)
    for _ in range(ROUNDS):
        across = _labelled(_labelled(tries, labels, "node", "label"), labels, "rep", "label_rep").where("label <> label_rep")
        across = across.select(F.least("node", "rep").alias("a"), F.greatest("node", "rep").alias("b"), "node", "est").join(tried, ["a", "b"], "left_anti")
        best = compact(across.groupBy("node").agg(F.max(F.struct("est", "a", "b")).alias("t")).select("t.a", "t.b").distinct())
        links = compact(links.union(confirmed(best, sets, percent)))
        tried = tried.union(best)
        labels = compact(components(links))
    return components(links.union(_between(shared, labels, nodes, sets, tried, percent)).union(ties))


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(doc, n, component, kept) per row: set size, smallest id reachable over links, and whether it is the row's own."""
    signed = cut_lineage(signatures(docs, doc, text, size))
    same = ["n", "fp1", "fp2"]
    classes = signed.where("n > 0").groupBy(*same).agg(F.min("doc").alias("node"), F.min_by(F.struct("bands", "packed"), "doc").alias("s"))
    nodes = cut_lineage(classes.where("node IS NOT NULL").select("node", *same, "s.bands", "s.packed"))

    def sets_of(ids: DataFrame) -> DataFrame:
        texts = docs.select(F.col(doc).alias("node"), F.col(text).alias("_text")).join(ids, "node", "left_semi")
        return texts.select("node", shingle_set("_text", size).alias("set"))

    # an id whose rows have different texts ties the classes of those texts together
    within = signed.where("n > 0 AND doc IS NOT NULL").join(nodes.select("node", *same), same).select("doc", "node").distinct()
    several = within.groupBy("doc").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc")
    ties = within.join(several, "doc").select(F.col("node").alias("a"), F.col("doc").alias("b"))
    labels = _components(nodes, sets_of, ties, percent)
    label = _labelled(nodes.select(*same, "node"), labels, "node", "component").select(*same, "component")
    out = signed.select("doc", *same).join(label, same, "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "doc")).otherwise(F.col("doc"))
    return out.select("doc", "n", F.when(F.col("doc").isNotNull(), component).alias("component")).withColumn("kept", F.col("doc").eqNullSafe(F.col("component")))


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents with one of each group: those whose id is their group's smallest."""
    found = near_duplicates(docs, doc, text, **how)
    gone = found.where(~F.col("kept")).select(F.col("doc").alias("_gone")).distinct()
    return docs.join(gone, F.col(f"`{doc}`") == F.col("_gone"), "left_anti")
