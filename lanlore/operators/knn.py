"""Exact nearest neighbours and eps-neighbourhoods as block joins.

Equal vectors are one point: copies are counted and their first few ids kept. Reference
points are grouped around pivots, the groups packed or hash-split into blocks of bounded
size, and each query visits only the blocks that can still hold one of its neighbours by
the triangle inequality. A block is compared with a bounded batch of queries in numpy and
returns the best few per query, so pairs are never written out.

Inside a block both sides are cut into leaves by medians. Leaves whose boxes are too far
apart are skipped, the others compared by products in single precision; whatever is within
the rounding of a limit is measured exactly, by differences in double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Points of a block: an eighth of the table, so that all cores have work, within these bounds.
BLOCK_POINTS = (4_096, 65_536)
MAX_PIVOTS = 512
QUERY_LEAF, REFERENCE_LEAF, TRIED_LEAVES = 512, 1_024, 8
#: Columns of a leaf that are left to look for a limit in, at least.
FOLDED = 64
#: Rows that one step of routing gives at most.
ROUTED_ROWS = 16_384


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a few rows of `a` at a time."""
    out = np.empty((len(a), len(b)))
    step = max(1, 4_000_000 // max(1, b.size))
    for i in range(0, len(a), step):
        diff = a[i : i + step, None, :] - b[None, :, :]
        out[i : i + step] = np.sqrt(np.einsum("ijk,ijk->ij", diff, diff))
    return out


def vectors_of(table: pa.Table | pa.RecordBatch, column: str = "vec") -> np.ndarray:
    """A list column as a matrix, without an object per row."""
    lists = table.column(column)
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).astype(np.float64, copy=False)


def pairs_of(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns that are true; faster than `nonzero` where few are, eight being looked at as one number."""
    flat = hit.ravel()
    whole = len(flat) // 8 * 8
    near = (np.flatnonzero(flat[:whole].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    found = np.concatenate([near[flat[near]], whole + np.flatnonzero(flat[whole:])])
    return np.divmod(found, hit.shape[1])


def folded(half: np.ndarray, k: int) -> np.ndarray:
    """Minima of groups of columns, few enough to be sorted out cheaply: their `k`-th smallest is no less than that of all.

    Neighbours rarely share a group, so it is hardly more either.
    """
    while half.shape[1] >= 2 * max(FOLDED, 8 * k):
        m = half.shape[1] // 2
        half = np.minimum(half[:, :m], half[:, m : 2 * m])
    return half


class Leaves:
    """Points in the order of leaves of at most `size`, with the leaves' bounds and boxes.

    `at` holds the rows of the table in that order, `x` their vectors.
    """

    def __init__(self, x: np.ndarray, size: int):
        order, edges, waiting = [], [0], [np.arange(len(x))]
        while waiting:
            rows = waiting.pop()
            if len(rows) <= size:
                order.append(rows)
                edges.append(edges[-1] + len(rows))
                continue
            part, half = x[rows], len(rows) // 2
            split = np.argpartition(part[:, np.ptp(part, axis=0).argmax()], half)
            waiting += [rows[split[half:]], rows[split[:half]]]
        self.at, self.edges = np.concatenate(order), np.array(edges)
        self.x = x[self.at]
        self.lo, self.hi = np.minimum.reduceat(self.x, self.edges[:-1]), np.maximum.reduceat(self.x, self.edges[:-1])

    def __iter__(self) -> Iterator[tuple[int, slice]]:
        return ((i, slice(self.edges[i], self.edges[i + 1])) for i in range(len(self.edges) - 1))

    def span(self, i: int) -> slice:
        return slice(self.edges[i], self.edges[i + 1])


class Pairing:
    """Queries and references of one call, around a common centre and scaled to norms of at most 1.

    `half(i, rows, references, wide)` is half the squared distance less half the query's squared norm, true to `error(wide)`.
    """

    def __init__(self, queries: np.ndarray, references: np.ndarray):
        self.q, self.r = Leaves(queries, QUERY_LEAF), Leaves(references, REFERENCE_LEAF)
        self.finite = bool(np.isfinite(queries).all() and np.isfinite(references).all())
        if not self.finite:
            return
        centre = references.mean(axis=0)
        q, r = self.q.x - centre, self.r.x - centre
        self.scale = float(np.sqrt(max(np.einsum("ij,ij->i", q, q).max(), np.einsum("ij,ij->i", r, r).max()))) or 1.0
        if not 1e-100 < self.scale < 1e100:
            self.finite = False
            return
        q /= self.scale
        r /= self.scale
        self.own = np.einsum("ij,ij->i", q, q) / 2
        self.products = {True: (np.column_stack([-q, np.ones(len(q))]), np.column_stack([r, np.einsum("ij,ij->i", r, r) / 2]).T.copy())}
        self.products[False] = tuple(m.astype(np.float32) for m in self.products[True])

    def error(self, wide: bool) -> float:
        return (self.q.x.shape[1] + 8) * (1e-15 if wide else 4e-7)

    def half(self, queries: slice, references: slice, wide: bool) -> np.ndarray:
        q, r = self.products[wide]
        return q[queries] @ r[:, references]

    def exact(self, queries: np.ndarray, references: np.ndarray) -> np.ndarray:
        """Distances of pairs, by position."""
        out = np.empty(len(queries))
        for i in range(0, len(queries), 16_384):
            diff = self.q.x[queries[i : i + 16_384]] - self.r.x[references[i : i + 16_384]]
            out[i : i + 16_384] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        return out

    def box_distances(self, i: int) -> np.ndarray:
        """The least distance that a point of query leaf `i` can have to one of each reference leaf."""
        gap = np.maximum(np.maximum(self.r.lo - self.q.hi[i], self.q.lo[i] - self.r.hi), 0.0)
        return np.sqrt(np.einsum("ij,ij->i", gap, gap)) * (1 - 1e-9)

    def box_reaches(self, i: int) -> np.ndarray:
        """The greatest one."""
        far = np.maximum(self.r.hi - self.q.lo[i], self.q.hi[i] - self.r.lo)
        return np.sqrt(np.einsum("ij,ij->i", far, far)) * (1 + 1e-9)

    def within(self, eps: float) -> Iterator[tuple[slice, slice, np.ndarray | None]]:
        """(queries, references, which pairs lie within eps) for each pair of leaves that has any; None for all."""
        for i, rows in self.q:
            if not self.finite:
                for first in range(rows.start, rows.stop, 64):
                    few = slice(first, min(first + 64, rows.stop))
                    yield few, slice(0, len(self.r.x)), distances(self.q.x[few], self.r.x) <= eps
                continue
            near, whole = self.box_distances(i), self.box_reaches(i) <= eps
            limit = eps * eps / (2 * self.scale * self.scale)
            wide = self.error(False) > 0.01 * limit
            bound, slack = (limit - self.own[rows])[:, None], self.error(wide)
            # bounds are rounded outwards, so that a comparison in single precision leaves no pair out
            upper, lower = bound + slack, bound - slack
            if not wide:
                upper, lower = np.nextafter(upper.astype(np.float32), np.float32(np.inf)), np.nextafter(lower.astype(np.float32), np.float32(-np.inf))
            for j in np.flatnonzero(near <= eps):
                span = self.r.span(j)
                if whole[j]:
                    yield rows, span, None
                    continue
                half = self.half(rows, span, wide)
                hit = half <= upper
                a, b = pairs_of(hit)
                if not len(a):
                    continue
                doubt = half[a, b] > lower[a, 0]
                a, b = a[doubt], b[doubt]
                hit[a, b] = self.exact(a + rows.start, b + span.start) <= eps
                yield rows, span, hit

    def best(self, k: int, ties: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, reference, distance) of the `k` nearest references of each query, by distance and `ties`; rows of the tables."""
        ties = ties[self.r.at]
        for i, rows in self.q:
            if self.finite:
                a, b = self._candidates(i, rows, k)
                found = [(a, b, self.exact(a, b))]
            else:
                found = []
                for first in range(rows.start, rows.stop, 64):
                    few = np.arange(first, min(first + 64, rows.stop))
                    found.append((np.repeat(few, len(ties)), np.tile(np.arange(len(ties)), len(few)), distances(self.q.x[few], self.r.x).ravel()))
            for a, b, d in found:
                order = np.lexsort((ties[b], d, a))
                a, b, d = a[order], b[order], d[order]
                starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
                place = np.arange(len(a)) - np.repeat(starts, np.diff(np.r_[starts, len(a)]))
                kept = place < k
                yield self.q.at[a[kept]], self.r.at[b[kept]], d[kept]

    def _candidates(self, i: int, rows: slice, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that hold the `k` nearest references of each query of leaf `i`."""
        near = self.box_distances(i)
        order = np.argsort(near, kind="stable")
        sizes = np.diff(self.r.edges)[order]
        first = int(np.searchsorted(np.cumsum(sizes), k)) + 1
        limit, reach, halves, wide = self._limit(rows, order[:first], k)
        tried = min(TRIED_LEAVES, len(order))
        if near[order[min(4 * TRIED_LEAVES, len(order)) - 1]] <= reach and first < tried:
            first = tried  # boxes rule little out: a sharper limit leaves fewer pairs to measure
            limit, reach, halves, wide = self._limit(rows, order[:first], k)
        a, b = [], []
        for n, j in enumerate(order):
            if n >= first and near[j] > reach:
                break
            span = self.r.span(j)
            x, y = pairs_of((halves[n] if n < first else self.half(rows, span, wide)) <= limit[:, None])
            a.append(x + rows.start)
            b.append(y + span.start)
        return np.concatenate(a), np.concatenate(b)

    def _limit(self, rows: slice, leaves: np.ndarray, k: int) -> tuple[np.ndarray, float, list[np.ndarray], bool]:
        """Limits of `half` and of the distance that no `k`-th neighbour of these queries exceeds, by some of the leaves."""
        for wide in (False, True):
            slack = self.error(wide)
            halves = [self.half(rows, self.r.span(j), wide) for j in leaves]
            few = [folded(h, k) for h in halves]
            both = np.concatenate(few, axis=1) if len(few) > 1 else few[0]
            limit = np.partition(both, k - 1, axis=1)[:, k - 1]
            if slack <= 0.01 * float(np.median(limit + self.own[rows])):
                break
        reach = self.scale * float(np.sqrt(2 * max(0.0, np.max(limit + self.own[rows]) + 3 * slack)))
        limit = limit + 2 * slack
        return limit if wide else np.nextafter(limit.astype(np.float32), np.float32(np.inf)), reach, halves, wide


@dataclass
class Layout:
    """Pivots, the size and reach of their cells, and which blocks hold each cell."""

    pivots: np.ndarray
    radius: np.ndarray
    nearest: np.ndarray
    gaps: np.ndarray
    first_block: np.ndarray
    splits: np.ndarray
    blocks: int
    block_points: int = BLOCK_POINTS[1]

    def cells(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = distances(vectors, self.pivots)
        cell = d.argmin(axis=1)
        return cell, d[np.arange(len(d)), cell]

    def visits(self, vectors: np.ndarray, reach: float | None) -> np.ndarray:
        """Which blocks each query must visit (queries x blocks): all within `reach`, or within its k-th neighbour bound."""
        d = distances(vectors, self.pivots)
        home = d.argmin(axis=1)
        own = d[np.arange(len(d)), home]
        if reach is None:
            bounds = (d[:, :, None] + self.nearest[None, :, :]).reshape(len(d), -1)
            k = self.nearest.shape[1]
            reach_of = np.partition(bounds, k - 1, axis=1)[:, k - 1]
        else:
            reach_of = np.full(len(d), reach)
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (d**2 - own[:, None] ** 2) / (2 * self.gaps[home])
        plane[~np.isfinite(plane)] = 0.0
        lower = np.maximum(d - self.radius[None, :], plane)
        slack = 1e-9 * (1.0 + np.abs(d))
        # not "near": a bound that is not a number rules nothing out
        near = ~(lower > reach_of[:, None] + slack) & (self.splits > 0)[None, :]
        held = np.zeros((len(self.pivots), self.blocks), dtype=np.float32)
        for c in np.flatnonzero(self.splits):
            held[c, self.first_block[c] : self.first_block[c] + self.splits[c]] = 1
        return near.astype(np.float32) @ held > 0


def points_of(df: DataFrame, id: str, vector: str, keep: int, payload: str | None = None) -> DataFrame:
    """Distinct vectors: `pid` (smallest id), `vec`, copies `weight`, and the `keep` smallest ids.

    The ids are cut by rank before they are gathered, and Spark applies that limit
    map-side, so a vector shared by a third of the rows costs no more than any other.
    """
    rows = df.select(
        F.col(id).alias("id"),
        F.col(vector).cast("array<double>").alias("vec"),
        (F.col(payload).cast("int") if payload else F.lit(0)).alias("payload"),
    )
    order = Window.partitionBy("vec").orderBy("id")
    first = (
        rows.withColumn("_r", F.row_number().over(order))
        .where(F.col("_r") <= keep)
        .groupBy("vec")
        .agg(F.sort_array(F.collect_list(F.struct("id", "payload"))).alias("ids"))
    )
    weights = rows.groupBy("vec").agg(F.count(F.lit(1)).alias("weight"))
    joined = first.join(weights, "vec")
    return joined.select(F.get("ids", F.lit(0))["id"].alias("pid"), "vec", "weight", "ids")


def _layout(points: DataFrame, k: int, block_points: int | None) -> tuple[Layout, DataFrame]:
    """Choose pivots by hash, assign each point to the nearest, and pack the cells into blocks.

    The driver sees only per-pivot numbers: at most MAX_PIVOTS vectors and k distances each.
    """
    n = points.count()
    block_points = block_points or min(max(BLOCK_POINTS[0], -(-n // 8)), BLOCK_POINTS[1])
    wanted = 1 if n <= block_points else int(min(MAX_PIVOTS, max(2, np.sqrt(n))))
    chosen = points.select("pid", "vec").orderBy(F.xxhash64("pid"), "pid").limit(wanted).collect()
    pivots = np.array([r["vec"] for r in chosen], dtype=np.float64).reshape(len(chosen), -1)
    base = Layout(pivots, *[np.zeros(0)] * 2, distances(pivots, pivots), *[np.zeros(0, int)] * 2, 0)
    schema = f"pid {points.schema['pid'].dataType.simpleString()}, vec array<double>, weight bigint, cell int, reach double"

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, reach = base.cells(matrix(pdf["vec"]))
                yield pdf.assign(cell=cell.astype("int32"), reach=reach)

    placed = cut_lineage(points.select("pid", "vec", "weight").mapInPandas(assign, schema))
    close = Window.partitionBy("cell").orderBy("reach", "pid")
    nearest_rows = (
        placed.select("cell", "reach", "pid")
        .withColumn("_r", F.row_number().over(close))
        .where(F.col("_r") <= k)
        .groupBy("cell")
        .agg(F.sort_array(F.collect_list("reach")).alias("near"))
    )
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("far"))
    p = len(pivots)
    radius, sizes, nearest = np.zeros(p), np.zeros(p, int), np.full((p, k), np.inf)
    for row in stats.join(nearest_rows, "cell").collect():
        radius[row["cell"]], sizes[row["cell"]] = row["far"], row["n"]
        nearest[row["cell"], : len(row["near"])] = row["near"]
    first_block, splits, block, filled = np.zeros(p, int), np.zeros(p, int), 0, 0
    for c in np.argsort(base.gaps[0], kind="stable"):
        if sizes[c] == 0:
            continue
        if sizes[c] > block_points:
            block, filled = (block + 1, 0) if filled else (block, 0)
            splits[c] = -(-sizes[c] // block_points)
            first_block[c] = block
            block += splits[c]
            continue
        if filled and filled + sizes[c] > block_points:
            block, filled = block + 1, 0
        first_block[c], splits[c], filled = block, 1, filled + sizes[c]
    layout = Layout(pivots, radius, nearest, base.gaps, first_block, splits, int(block + 1 if filled or not block else block), block_points)
    return layout, placed


def _placed_blocks(placed: DataFrame, layout: Layout) -> DataFrame:
    first = F.array(*[F.lit(int(b)) for b in layout.first_block])
    splits = F.array(*[F.lit(int(max(1, s))) for s in layout.splits])
    return placed.withColumn(
        "block", (F.get(first, F.col("cell")) + F.pmod(F.xxhash64("pid"), F.get(splits, F.col("cell")))).cast("int")
    )


def block_join(
    queries: DataFrame,
    placed: DataFrame,
    layout: Layout,
    compare: Callable[[pa.Table, pa.Table], pa.Table],
    schema: str,
    reach: float | None = None,
    columns: Sequence[str] = ("weight",),
) -> DataFrame:
    """Run `compare(queries, references)` for every block with each batch of its visitors.

    Both sides of a call are bounded: blocks by construction, visitors by a hash split of
    each block's visitor count, with the block repeated per split. Visits are counted in a pass of
    their own, so queries go straight to their blocks and are not written in between. `queries` is read twice.
    """
    id_type = queries.schema["pid"].dataType.simpleString()
    step = max(1, ROUTED_ROWS // max(1, layout.blocks))

    def visits(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
        vectors = vectors_of(batch)
        for i in range(0, len(vectors), step):
            yield i, layout.visits(vectors[i : i + step], reach)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(layout.blocks, dtype=np.int64)
        for batch in batches:
            for _, met in visits(batch):
                total += met.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(layout.blocks, dtype=np.int32)), pa.array(total)], ["block", "n"])

    loads = np.zeros(layout.blocks, dtype=np.int64)
    for row in queries.select("vec").mapInArrow(count, "block int, n long").groupBy("block").agg(F.sum("n").alias("n")).collect():
        loads[row["block"]] = row["n"]
    batches_of = -(-loads // layout.block_points)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order = batch.column("h").to_numpy()
            for i, met in visits(batch):
                rows, block = np.nonzero(met)
                if len(rows):
                    found = batch.slice(i, len(met)).take(pa.array(rows))
                    part = np.mod(order[rows + i], batches_of[block])
                    yield pa.RecordBatch.from_arrays(
                        [found.column("pid"), found.column("vec"), pa.array(block.astype(np.int32)), pa.array(part.astype(np.int32))], ["pid", "vec", "block", "batch"]
                    )

    # by number, since few bytes can mean much work here and partitions are not to be merged by size
    calls = int(batches_of.sum())
    parts = max(1, min(2 * calls, calls + 1000))
    q = queries.select("pid", "vec", F.xxhash64("pid").alias("h")).mapInArrow(route, f"pid {id_type}, vec array<double>, block int, batch int")
    last = F.get(F.array(*[F.lit(int(b) - 1) for b in batches_of]), F.col("block"))
    r = (
        _placed_blocks(placed, layout)
        .select("pid", "vec", *columns, "block")
        .where(last >= 0)
        .withColumn("batch", F.explode(F.sequence(F.lit(0), last)))
    )
    names = ["block", "batch"]
    return q.repartition(parts, *names).groupBy(*names).cogroup(r.repartition(parts, *names).groupBy(*names)).applyInArrow(compare, schema)


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("pid").to_numpy()


def ranks_of(ids: np.ndarray) -> np.ndarray:
    """The place of each id in their order."""
    out = np.empty(len(ids), dtype=np.int64)
    out[np.argsort(ids, kind="stable")] = np.arange(len(ids))
    return out


def _best_of_block(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["qid", "rid", "distance"]
        if not left.num_rows or not right.num_rows:
            return pa.table([left.column("pid").slice(0, 0), right.column("pid").slice(0, 0), pa.array([], pa.float64())], names)
        parts = [*Pairing(vectors_of(left), vectors_of(right)).best(min(k, right.num_rows), ranks_of(ids_of(right)))]
        a, b, d = (np.concatenate(c) for c in zip(*parts))
        return pa.table([left.column("pid").take(pa.array(a)), right.column("pid").take(pa.array(b)), pa.array(d)], names)

    return compare


def nearest(
    queries: DataFrame,
    references: DataFrame,
    k: int,
    id: str = "id",
    vector: str = "features",
    payload: str | None = None,
    block_points: int | None = None,
) -> DataFrame:
    """BAL9: each query's exact `k` nearest references other than itself.

    Returns the query id and ``neighbors``, an array of (distance, id, payload) by distance
    and id. `payload` is an int column of the references carried along, such as a label.
    Queries are matched with themselves by id, so both tables must share one id space.
    """
    keep = k + 1
    refs = cut_lineage(points_of(references, id, vector, keep, payload))
    layout, placed = _layout(refs, keep, block_points)
    asked = queries.select(F.col(vector).cast("array<double>").alias("vec"), F.col(id).alias("id"))
    probes = cut_lineage(asked.groupBy("vec").agg(F.min("id").alias("pid")))
    kind = refs.schema["pid"].dataType.simpleString()
    hits = block_join(probes, placed, layout, _best_of_block(keep), f"qid {kind}, rid {kind}, distance double", columns=())
    ranked = Window.partitionBy("qid").orderBy("distance", "rid")
    best = hits.withColumn("_r", F.row_number().over(ranked)).where(F.col("_r") <= keep).drop("_r")
    copies = best.join(refs.select(F.col("pid").alias("rid"), "ids"), "rid")
    lists = (
        copies.groupBy("qid")
        .agg(
            F.flatten(
                F.collect_list(
                    F.transform("ids", lambda x: F.struct(F.col("distance").alias("distance"), x["id"].alias("id"), x["payload"].alias("payload")))
                )
            ).alias("all")
        )
        .select(F.col("qid").alias("pid"), F.slice(F.array_sort("all"), 1, keep).alias("all"))
    )
    by_vector = probes.join(lists, "pid").select("vec", "all")
    return asked.join(by_vector, "vec").select(
        F.col("id").alias(id), F.slice(F.filter("all", lambda x: x["id"] != F.col("id")), 1, k).alias("neighbors")
    )
