"""Document scores from a gated recurrent language model, with a class-factored output softmax.

Words are lower-cased (A-Z) and end with an end token. The model's vocabulary is the end token and the most frequent
training words; every other word is one token for the network and then drawn from the smoothed frequencies of the words
outside the vocabulary, so the probabilities of all texts sum to one. An output is a class, then a word of that class.

Training is truncated backpropagation in numpy, one pass over all training documents. A hash deals them to rounds and
replicas. In each round every replica goes on from the average of all, over documents of its own; averages are taken in
pieces on the executors, in two steps. A replica sees about `REPLICA_TOKENS` in a round, so their number follows the input
without a bound, and every size is trained alike.

Scoring reads every text whole. Documents are laid end to end in lanes; a lane's state starts anew with each document and
is carried from window to window within one. Counts of the training words are a table, joined to the words of the texts:
only the `KNOWN` most frequent are sent along, every other word meets its count in a shuffle.

Defined results: a null or empty text is its end token alone. Repeated rows get a row each. Without training texts all
counts are 0 and the network scores all of its tokens alike. A null id is an id.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .resampling import kth_largest
from .text import lower_ascii, split_words

CLASSES, PER_CLASS = 32, 32
HIDDEN = 16
WINDOW = 32
LANES, TRAIN_LANES = 512, 256
ROUNDS = 4
RATE = 0.01
#: Tokens that a lane trains on without a break; longer documents go to several lanes, so that none runs on alone.
STRETCH = 1024
#: Tokens a replica is meant to see in a round.
REPLICA_TOKENS = 1_000_000
#: Tokens of documents that a replica lays out in lanes at a time.
HELD_TOKENS = 4_000_000
#: Words whose counts are sent to every executor.
KNOWN = 2**18
END, OTHER = 0, 1
VOCABULARY = CLASSES * PER_CLASS
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
PIECE = 4096


@dataclass
class Words:
    """What is known of the training tokens: ids of the network's words, counts of the most frequent, and totals."""

    ids: dict[bytes, int]
    counts: dict[bytes, int]
    ends: int
    total: int
    distinct: int
    outside: int
    outside_distinct: int
    priors: np.ndarray


def fresh(priors: np.ndarray) -> dict[str, np.ndarray]:
    """Parameters whose first predictions are the unigram frequencies."""
    draw = np.random.default_rng(5)
    small = lambda *shape: (draw.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
    p = priors.reshape(CLASSES, PER_CLASS)
    return {
        "embed": draw.standard_normal((VOCABULARY + 1, HIDDEN)).astype(np.float32) * np.float32(0.3), "wx": small(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
        "wh": small(HIDDEN, 3 * HIDDEN), "uc": small(HIDDEN, CLASSES) * np.float32(0.1), "bc": np.log(p.sum(axis=1)).astype(np.float32),
        "uw": small(CLASSES, HIDDEN, PER_CLASS) * np.float32(0.1), "bw": np.log(p / p.sum(axis=1, keepdims=True)).astype(np.float32),
    }


def forward(p: dict, table: np.ndarray, inputs: np.ndarray, begins: np.ndarray, state: np.ndarray):
    """Hidden states of a window (hidden x steps x lanes), what `backward` needs, and the last state (hidden x lanes).

    `table` has what each input word adds to the gates. Lanes come last, so that every gate is one piece of memory.
    """
    columns = np.ascontiguousarray(table.T)
    alive = (~begins).astype(table.dtype)
    recurrent, keep = np.ascontiguousarray(p["wh"].T), []
    hidden = np.empty((HIDDEN, *inputs.shape), table.dtype)
    for t in range(len(inputs)):
        before, x = state * alive[t], columns.take(inputs[t], axis=1)
        g = recurrent @ before
        zr = np.maximum(x[: 2 * HIDDEN] + g[: 2 * HIDDEN], -60)
        np.negative(zr, zr)
        np.exp(zr, zr)
        zr += 1
        np.reciprocal(zr, zr)
        z, r, m = zr[:HIDDEN], zr[HIDDEN:], g[2 * HIDDEN :]
        n = r * m
        n += x[2 * HIDDEN :]
        np.tanh(n, n)
        keep.append((before, z, r, m, n))
        state = before - n
        state *= z
        state += n
        hidden[:, t] = state
    return hidden, keep, state


def _softmax(x: np.ndarray, target: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Log probability of each column's target; with `want`, the gradient of minus their sum, too."""
    x -= x.max(axis=0)
    at = np.arange(x.shape[1])
    picked = x[target, at]
    np.exp(x, x)
    total = x.sum(axis=0)
    logs = picked - np.log(total)
    if not want:
        return logs, None
    x /= total
    x[target, at] -= 1
    return logs, x


def outputs(p: dict, hidden: np.ndarray, targets: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Natural log probability of each target (hidden x targets); with `grads`, adds to them and returns the gradient of the hidden states."""
    order = np.argsort(targets.astype(np.uint16), kind="stable")
    sorted_ = targets[order]
    hidden, group, place = hidden.take(order, axis=1), sorted_ // PER_CLASS, sorted_ % PER_CLASS
    want = grads is not None
    logs, d = _softmax(p["uc"].T @ hidden + p["bc"][:, None], group, want)
    logs = logs.astype(np.float64)
    back = None
    if want:
        grads["uc"] += hidden @ d.T
        grads["bc"] += d.sum(axis=1)
        back = p["uc"] @ d
    cuts = np.searchsorted(group, np.arange(CLASSES + 1))
    for c in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[c], cuts[c + 1])
        h = hidden[:, part]
        inside, d = _softmax(p["uw"][c].T @ h + p["bw"][c][:, None], place[part], want)
        logs[part] += inside
        if want:
            grads["uw"][c] += h @ d.T
            grads["bw"][c] += d.sum(axis=1)
            back[:, part] += p["uw"][c] @ d
    out = np.empty_like(logs)
    out[order] = logs
    if want:
        mixed = back
        back = np.empty_like(mixed)
        back[:, order] = mixed
    return out, back


def backward(p: dict, grads: dict, inputs: np.ndarray, begins: np.ndarray, keep: list, back: np.ndarray) -> None:
    """Truncated backpropagation through one window; `back` is the loss's gradient of the hidden states."""
    d_state = np.zeros_like(back[:, 0])
    alive = (~begins).astype(back.dtype)
    gates = np.empty((3 * HIDDEN, *inputs.shape), back.dtype)
    recurrent = np.empty((3 * HIDDEN, inputs.shape[1]), back.dtype)
    for t in range(len(inputs) - 1, -1, -1):
        before, z, r, m, n = keep[t]
        d = back[:, t] + d_state
        d_n = d * (1 - z)
        d_n *= 1 - n * n
        recurrent[:HIDDEN] = d * (before - n) * z * (1 - z)
        recurrent[HIDDEN : 2 * HIDDEN] = d_n * m * r * (1 - r)
        gates[: 2 * HIDDEN, t], gates[2 * HIDDEN :, t] = recurrent[: 2 * HIDDEN], d_n
        recurrent[2 * HIDDEN :] = d_n * r
        grads["wh"] += before @ recurrent.T
        d_state = (d * z + p["wh"] @ recurrent) * alive[t]
    flat, words = gates.reshape(3 * HIDDEN, -1), inputs.ravel()
    grads["b"] += flat.sum(axis=1)
    grads["wx"] += p["embed"].take(words, axis=0).T @ flat.T
    for k, column in enumerate(p["wx"] @ flat):  # far faster than adding rows one by one
        grads["embed"][:, k] += np.bincount(words, column, VOCABULARY + 1)


def in_lanes(documents: list[np.ndarray], lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(targets, begins, owner), steps x lanes: documents end to end, long ones first, each to the lane that is shortest. -1 is padding."""
    lanes = max(1, min(lanes, len(documents)))  # lanes stand by falling length
    sizes = np.array([len(d) for d in documents])
    load, plan = np.zeros(lanes, np.int64), [[] for _ in range(lanes)]
    order = np.argsort(-sizes, kind="stable")
    for first in range(0, len(order), lanes):  # the next longest documents to the emptiest lanes
        for lane, d in zip(np.argsort(load, kind="stable"), order[first : first + lanes]):
            plan[lane].append(d)
            load[lane] += sizes[d]
    plan = [plan[lane] for lane in np.argsort(-load, kind="stable")]
    targets, owner = (np.full((load.max(), lanes), -1, np.int32) for _ in range(2))
    begins = np.ones((load.max(), lanes), bool)
    for lane, mine in enumerate(plan):
        at = 0
        for d in mine:
            targets[at : at + sizes[d], lane], owner[at : at + sizes[d], lane] = documents[d], d
            begins[at + 1 : at + sizes[d], lane] = False
            at += sizes[d]
    return targets, begins, owner


def _windows(targets: np.ndarray, begins: np.ndarray):
    """(part, inputs, begins) of each window, without the lanes that have ended: the token before, or the start mark (`VOCABULARY`) where a document begins."""
    lasts = (targets >= 0).sum(axis=0)
    for first in range(0, len(targets), WINDOW):
        part = slice(first, first + WINDOW), slice(0, int((lasts > first).sum()))
        starts = begins[part]
        before = targets[max(first - 1, 0) : first + WINDOW - 1, part[1]]
        if not first:
            before = np.concatenate([np.full((1, before.shape[1]), -1, np.int32), before[: len(starts) - 1]])
        before = before[: len(starts)]
        yield part, np.where(starts | (before < 0), np.int32(VOCABULARY), before), starts


def scores(p: dict, documents: list[np.ndarray]) -> np.ndarray:
    """Natural log probability of every whole document."""
    if not documents:
        return np.empty(0)
    targets, begins, owner = in_lanes(documents, LANES)
    table = p["embed"] @ p["wx"] + p["b"]
    state = np.zeros((HIDDEN, targets.shape[1]), np.float32)
    total = np.zeros(len(documents))
    for part, inputs, starts in _windows(targets, begins):
        hidden, _, state = forward(p, table, inputs, starts, state[:, : inputs.shape[1]])
        real = targets[part] >= 0
        logs, _ = outputs(p, hidden.reshape(HIDDEN, -1).take(np.flatnonzero(real), axis=1), targets[part][real])
        total += np.bincount(owner[part][real], logs, len(documents))
    return total


def _mixed(documents: Iterable[np.ndarray], seed: int) -> Iterator[list[np.ndarray]]:
    """All documents in mixed order, in groups that end once they hold `HELD_TOKENS`."""
    draw = np.random.default_rng(seed)
    held, tokens = [], 0
    for d in documents:
        held.append(d)
        tokens += len(d)
        if tokens >= HELD_TOKENS:
            yield [held[i] for i in draw.permutation(len(held))]
            held, tokens = [], 0
    if held:
        yield [held[i] for i in draw.permutation(len(held))]


def trained(p: dict, documents: Iterable[np.ndarray], seed: int = 0) -> tuple[dict, int]:
    """The parameters after one pass of truncated backpropagation with Adam over the documents, and their tokens."""
    p = {k: v.copy() for k, v in p.items()}
    mean, square = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    step = tokens = 0
    for group in _mixed((d[i : i + STRETCH] for d in documents for i in range(0, len(d), STRETCH)), seed):
        tokens += sum(map(len, group))
        targets, begins, _ = in_lanes(group, TRAIN_LANES)
        state = np.zeros((HIDDEN, targets.shape[1]), np.float32)
        for part, inputs, starts in _windows(targets, begins):
            real = targets[part] >= 0
            n = int(real.sum())
            grads = {k: np.zeros_like(v) for k, v in p.items()}
            hidden, keep, state = forward(p, p["embed"] @ p["wx"] + p["b"], inputs, starts, state[:, : inputs.shape[1]])
            at = np.flatnonzero(real)
            _, d = outputs(p, hidden.reshape(HIDDEN, -1).take(at, axis=1), targets[part][real], grads)
            back = np.zeros_like(hidden)
            back.reshape(HIDDEN, -1)[:, at] = d
            backward(p, grads, inputs, starts, keep, back)
            step += 1
            size = np.sqrt(sum(float((g * g).sum()) for g in grads.values())) / n
            scale = np.float32(min(1.0, 1.0 / max(size, 1e-9)) / n)
            rate = np.float32(RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step))
            for k, g in grads.items():
                g *= scale
                mean[k] += np.float32(0.1) * (g - mean[k])
                square[k] += np.float32(0.01) * (g * g - square[k])
                p[k] -= rate * mean[k] / (np.sqrt(square[k]) + np.float32(1e-7))
    return p, tokens


def _flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in sorted(p)])


def _shaped(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape).astype(np.float32)
        at += like[k].size
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(LOWER).split()


def ids_of(words: list[bytes], ids: dict[bytes, int]) -> np.ndarray:
    get = ids.get
    return np.array([*[get(w, OTHER) for w in words], END], np.int32)


def count_words(training: DataFrame, text: str = "text") -> DataFrame:
    """(word, c) of the training words; the empty word stands for the end tokens, one per text."""
    tokens = training.select(F.explode(F.concat(split_words(lower_ascii(text)), F.array(F.lit("")))).alias("word"))
    return cut_lineage(tokens.groupBy("word").agg(F.count(F.lit(1)).alias("c")))


def most_frequent(counts: DataFrame, most: int) -> list[tuple[str, int]]:
    """At most `most` words, more frequent than any other, by falling count; ties at the edge stay out together."""
    real = counts.where("word <> ''")
    edge = kth_largest(real, "c", most + 1)
    return [(r["word"], r["c"]) for r in sorted((real if edge is None else real.where(F.col("c") > edge)).collect(), key=lambda r: (-r["c"], r["word"]))]


def learn_words(counts: DataFrame, known: int = KNOWN) -> Words:
    total, distinct, ends = counts.agg(F.sum("c"), F.count("c"), F.sum(F.when(F.col("word") == "", F.col("c")))).first()
    total, ends = total or 0, ends or 0
    frequent = most_frequent(counts, known)
    network = frequent[: VOCABULARY - 2]
    inside = sum(c for _, c in network)
    priors = np.full(VOCABULARY, 0.5)
    priors[END], priors[OTHER] = ends + 0.5, total - ends - inside + 0.5
    priors[2 : 2 + len(network)] += [c for _, c in network]
    ids = {w.encode(): i + 2 for i, (w, _) in enumerate(network)}
    return Words(ids, {w.encode(): c for w, c in frequent}, ends, total, distinct, total - ends - inside, distinct - len(network) - (ends > 0), priors / priors.sum())


def _averaged(rows: list[tuple[float, bytes]]) -> tuple[float, bytes]:
    """Parameters summed by their weights, and the sum of the weights."""
    total = sum(w for w, _ in rows)
    return total, (sum(w / total * np.frombuffer(x, np.float64) for w, x in rows)).tobytes()


def _average(pieces: DataFrame) -> np.ndarray | None:
    """The parameters' mean over replicas by their tokens: first in groups of about the root of their number, then whole."""

    def mean(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("replica", "tokens", "weights"))))
        total, flat = _averaged([(w, x) for _, w, x in rows])
        return pa.table({"piece": table.column("piece")[:1], "part": table.column("part")[:1], "replica": table.column("replica")[:1], "tokens": [total], "weights": [flat]})

    schema = "piece long, part long, replica long, tokens double, weights binary"
    parts = pieces.groupBy("piece", "part").applyInArrow(mean, schema)
    rows = sorted((r["piece"], r["weights"]) for r in parts.groupBy("piece").applyInArrow(mean, schema).collect())
    return np.concatenate([np.frombuffer(w, np.float64) for _, w in rows]) if rows else None


def train(training: DataFrame, words: Words, doc: str = "doc_id", text: str = "text") -> dict:
    """The network's parameters after all rounds. Documents travel as ids of two bytes a word."""
    p = fresh(words.priors)
    if not words.total:
        return p
    spark = training.sparkSession
    replicas = max(1, round(words.total / ROUNDS / REPLICA_TOKENS))
    spread = max(1, round(replicas**0.5))
    ids_now = spark.sparkContext.broadcast(words.ids)

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = ids_now.value
        for b in batches:
            found = [ids_of(words_of(t), ids).astype(np.uint16).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["draw", "ids"])

    drawn = training.select(F.xxhash64(F.xxhash64(F.col(doc), F.lit(3)), F.col(text)).alias("draw"), F.col(text).alias("text")).mapInArrow(to_ids, "draw long, ids binary")
    dealt = drawn.withColumn("round", F.pmod("draw", F.lit(ROUNDS)).cast("int"))
    replica_of = F.pmod(F.xxhash64("draw"), F.lit(replicas)).cast("int")
    dealt = cut_lineage(dealt.withColumn("replica", replica_of).repartitionById(replicas, F.col("replica")).sortWithinPartitions("round", "draw", "ids"))
    for number in range(ROUNDS):
        shared = spark.sparkContext.broadcast(p)

        def replica(batches: Iterator[pa.RecordBatch], shared=shared, number=number) -> Iterator[pa.RecordBatch]:
            me = []

            def documents() -> Iterator[np.ndarray]:
                for b in batches:
                    if b.num_rows:
                        me[:] = [b.column(0)[0].as_py()]
                    for ids in b.column(1).to_pylist():
                        yield np.frombuffer(ids, np.uint16).astype(np.int32)

            after, tokens = trained(shared.value, documents(), number)
            if tokens:
                flat = _flat(after).astype(np.float64)
                pieces = [flat[i : i + PIECE] for i in range(0, len(flat), PIECE)]
                n = len(pieces)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(n)), pa.array([me[0] % spread] * n), pa.array(me * n, pa.int64()), pa.array([float(tokens)] * n), pa.array([x.tobytes() for x in pieces])],
                    ["piece", "part", "replica", "tokens", "weights"],
                )

        mine = dealt.where(F.col("round") == number).select("replica", "ids")
        flat = _average(mine.mapInArrow(replica, "piece long, part long, replica long, tokens double, weights binary"))
        if flat is not None:
            p = _shaped(flat, p)
    return p


def score_documents(docs: DataFrame, counts: DataFrame, words: Words, p: dict, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_tokens, n_known, base_score, score) per row, log10 of the probabilities."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pickle.dumps((p, words)))
    kind = dict(docs.select(doc).dtypes)[doc]
    log = np.log10

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        params, known = pickle.loads(shared.value)
        get, in_network = known.counts.get, known.ids
        for batch in batches:
            n = batch.num_rows
            documents, stats, at, rare = [], np.zeros((5, n)), [], []
            for i, t in enumerate(batch.column(2).to_pylist()):
                mine = words_of(t)
                documents.append(ids_of(mine, in_network))
                c = np.array([*[get(w, -1) for w in mine], known.ends], np.int64)
                seen = c >= 0
                logs = log(np.maximum(c, 0) + 0.5)
                other = documents[-1] == OTHER
                stats[:, i] = len(c), (c > 0).sum(), logs[seen].sum(), other.sum(), logs[seen & other].sum()
                if not seen.all():
                    few = [mine[j] for j in np.flatnonzero(~seen)]
                    at += [i] * len(few)
                    rare += few
            network = scores(params, documents) / np.log(10)
            index = pa.array(np.concatenate([np.arange(n), np.array(at, np.int64)]))
            keys = [batch.column(0).take(index), batch.column(1).take(index)]
            # a row of figures for each document, under a word that no text has, then its rarer words
            marks = [f" {k}" for k in batch.column(1).to_pylist()]
            word = pa.concat_arrays([pa.array(marks, pa.string()), pa.array(rare, pa.binary()).cast(pa.string())])
            figures = [pa.concat_arrays([pa.array(x), pa.nulls(len(rare), pa.float64())]) for x in (*stats, network)]
            yield pa.RecordBatch.from_arrays([*keys, word, *figures], ["doc", "key", "word", *names])

    names = ["n_tokens", "n_known", "log_seen", "n_other", "log_other", "network"]
    keyed = docs.select(F.col(doc).alias("doc"), F.xxhash64(F.col(text), F.col(text).isNull()).alias("key"), F.col(text).alias("text"))
    emitted = keyed.mapInArrow(rows, f"doc {kind}, key long, word string, {', '.join(f'{x} double' for x in names)}")
    rare = emitted.join(counts.withColumnRenamed("word", "_word"), F.col("word") == F.col("_word"), "left")
    is_rare = F.col("n_tokens").isNull()
    per_document = rare.groupBy("doc", "key").agg(
        F.count("n_tokens").alias("rows"), *[F.max(x).alias(x) for x in names], F.count(F.when(is_rare, F.col("c"))).alias("rare_known"),
        F.sum(F.when(is_rare, F.log10(F.coalesce("c", F.lit(0)) + 0.5))).alias("rare_log"),
    )
    one = lambda x: F.coalesce(F.col(x) / F.col("rows"), F.lit(0.0))  # noqa: E731  repeated rows are alike
    base = F.col("log_seen") + one("rare_log") - F.col("n_tokens") * F.lit(float(log(words.total + 0.5 * (words.distinct + 1))))
    outside = F.col("log_other") + one("rare_log") - F.col("n_other") * F.lit(float(log(words.outside + 0.5 * (words.outside_distinct + 1))))
    out = per_document.select(
        "doc", F.col("n_tokens").cast("long").alias("n_tokens"), (F.col("n_known") + one("rare_known")).cast("long").alias("n_known"), base.alias("base_score"),
        (F.col("network") + outside).alias("score"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("_row"),
    )
    return out.drop("_row")


def language_scores(docs: DataFrame, training: Column, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """`score_documents` of all documents by a model of those where `training` holds, with `train_tokens`."""
    learned = docs.where(training)
    counts = count_words(learned, text)
    words = learn_words(counts)
    p = train(learned, words, doc, text)
    return score_documents(docs, counts, words, p, doc, text).withColumn("train_tokens", F.lit(words.total).cast("long"))
