"""Language identification by interpolated Kneser-Ney character models, one per language.

The models are fitted on at most `PER_LANGUAGE` labelled documents of each language, drawn by a hash of their id; this
bound also bounds what is broadcast. Spark counts the sample's n-grams; the highest order keeps its counts, each lower
one counts distinct left neighbours. The fitted models are sorted arrays of n-gram hashes with the probabilities that
each language gives, and of context hashes with each language's weight for falling back to the next shorter context.

Texts are lower-cased and every run of other characters than letters becomes one space. The language with the lowest
cross-entropy per character wins, over the whole text. A tenth of the sample is held back from counting. On it, the
temperature of the posterior and, per language, a limit of the cross-entropy are calibrated; a text beyond its
language's limit is `rejected`, which lowers its score, while its language is still the best guess.

Defined results: a null text, or one without a letter, is `und` with score 0 and rejected; so is every text if nothing
could be learned. Ties go to the language first by code point. Rows are judged one by one, repeated ones alike.
Documents without text or language are not learned from. `language` replaces a column of that name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import without

ORDER = 4
#: Documents of each language that the models are fitted on at most.
PER_LANGUAGE = 2000
DISCOUNT = 0.75
#: One in so many sampled documents is for calibration.
HELD_BACK = 10
BASE = np.uint64(0x9E3779B97F4A7C15)


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one behind the other, each between single spaces, and where each begins (one more at the end)."""
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer((" ".join(lowered) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in lowered])])
    letter = _letters()[codes]
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a letter, or the first character behind one
    keep[starts[:-1]] |= ~letter[starts[:-1]]
    out = np.where(letter, codes, np.uint32(32))[keep]
    return out, np.concatenate([[0], np.cumsum(keep)])[starts]


def hashes(codes: np.ndarray, starts: np.ndarray, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """h[k, i]: hash of the k + 1 characters that end at i; context[k, i]: of the k before i. Texts begin with spaces only."""
    c = codes.astype(np.uint64) + np.uint64(1)
    h = np.empty((order, len(c)), np.uint64)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    offset = np.arange(len(c)) - starts[text]
    power = np.uint64(1)
    total = np.zeros(len(c), np.uint64)
    for k in range(order):
        back = np.full(len(c), 33, np.uint64)  # spaces before the text
        back[k:] = c[: len(c) - k] if k else c
        back[offset < k] = 33
        total = total + back * power
        power = power * BASE
        h[k] = total + np.uint64(k + 1)
    context = np.zeros_like(h)
    for k in range(1, order):
        context[k, 1:] = h[k - 1, :-1]
        first = np.uint64(k) + np.uint64(33) * sum((BASE**np.uint64(j) for j in range(k)), np.uint64(0))
        context[k][offset == 0] = first
    return h, context


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch and language: every n-gram of the highest order with its hashes of all orders and its count."""
    for batch in batches:
        frame = batch.to_pandas()
        pieces = frame["text"].str.len().cumsum() // 1_000_000
        for (lang, _), rows in frame.groupby(["lang", pieces], sort=True):
            codes, starts = normalised(rows["text"].tolist())
            with np.errstate(over="ignore"):
                h, context = hashes(codes, starts)
            _, first, counts = np.unique(h[-1], return_index=True, return_counts=True)
            columns = [pa.array(x[first].view(np.int64)) for x in [*h, *context[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *columns, pa.array(counts)], ["lang", *_names(), "n"])


def _names() -> list[str]:
    return [*[f"h{k}" for k in range(ORDER)], *[f"c{k}" for k in range(1, ORDER)]]


@dataclass
class Models:
    """Probabilities and fall-back weights of all languages side by side, by sorted hashes; `limits` in nats per character."""

    languages: list[str]
    grams: list[np.ndarray] = field(default_factory=list)
    chance: list[np.ndarray] = field(default_factory=list)
    contexts: list[np.ndarray] = field(default_factory=list)
    weight: list[np.ndarray] = field(default_factory=list)
    unseen: np.ndarray | None = None
    temperature: float = 1.0
    limits: np.ndarray | None = None
    spread: np.ndarray | None = None

    def logs(self, h: np.ndarray, context: np.ndarray) -> np.ndarray:
        """log p of each n-gram's last character after the others, a column per language."""
        p = np.broadcast_to(self.unseen, (h.shape[1], len(self.languages)))
        for k in range(h.shape[0]):
            if k:
                at, found = _find(self.contexts[k], context[k])
                p = np.where(found[:, None], self.weight[k][at], 1.0) * p
            at, found = _find(self.grams[k], h[k])
            known = self.chance[k][at]
            # a language that has not seen the n-gram falls back as if nobody had
            p = np.where(found[:, None] & (known > 0), known, p)
        return np.log(p)

    def cross_entropies(self, texts: list[str]) -> np.ndarray:
        """Nats per character of each text, a column per language."""
        out = np.empty((len(texts), len(self.languages)))
        ends = np.cumsum([len(t) for t in texts])
        first = 0
        while first < len(texts):  # some hundred thousand characters at a time; one long text may be more
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + 300_000)))
            codes, starts = normalised(texts[first:last])
            with np.errstate(over="ignore"):
                h, context = hashes(codes, starts)
            which, _ = pd.factorize(h[-1])
            index = np.empty(which.max() + 1, np.int64)
            index[which[::-1]] = np.arange(len(which))[::-1]
            logs = self.logs(h[:, index], context[:, index])
            for j in range(len(self.languages)):
                out[first:last, j] = -np.add.reduceat(logs[:, j][which], starts[:-1]) / np.diff(starts)
            first = last
        return out


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), max(len(keys) - 1, 0))
    return at, keys[at] == wanted


def _smoothed(counts: pd.DataFrame, languages: list[str]) -> Models:
    """Interpolated Kneser-Ney from (lang, hashes, n) of the highest order."""
    models, size = Models(languages), len(languages)
    lang = np.searchsorted(languages, counts["lang"].to_numpy(str))
    h = np.stack([counts[f"h{k}"].to_numpy().view(np.uint64) for k in range(ORDER)])
    c = np.stack([np.zeros(len(counts), np.uint64), *[counts[f"c{k}"].to_numpy().view(np.uint64) for k in range(1, ORDER)]])
    tables = [(lang, h, c, counts["n"].to_numpy(float))]
    for k in range(ORDER - 2, -1, -1):  # types of the next shorter order, each counted once per distinct left neighbour
        l_, h_, c_, _ = tables[0]
        _, first, times = np.unique(np.stack([l_.astype(np.uint64), h_[k]]), axis=1, return_index=True, return_counts=True)
        tables.insert(0, (l_[first], h_[: k + 1, first], c_[: k + 1, first], times.astype(float)))
    letters = len(np.unique(tables[0][1][0])) + 1
    models.unseen = np.full(size, 1.0 / letters)
    for k, (l_, h_, c_, n) in enumerate(tables):
        contexts, place = np.unique(c_[k], return_inverse=True)
        total, kinds = np.zeros((len(contexts), size)), np.zeros((len(contexts), size))
        np.add.at(total, (place, l_), n)
        np.add.at(kinds, (place, l_), 1)
        weight = np.where(total > 0, DISCOUNT * kinds / np.maximum(total, 1), 1.0)
        if k == 0:
            lower = np.broadcast_to(models.unseen, (len(n), size))[np.arange(len(n)), l_]
            models.unseen = models.unseen * weight[0]
        else:
            at, _ = _find(models.grams[k - 1], h_[k - 1])
            lower = models.chance[k - 1][at, l_]
        p = np.maximum(n - DISCOUNT, 0) / total[place, l_] + weight[place, l_] * lower
        grams, where = np.unique(h_[k], return_inverse=True)
        chance = np.zeros((len(grams), size))
        chance[where, l_] = p
        models.grams.append(grams)
        models.chance.append(chance)
        models.contexts.append(contexts)
        models.weight.append(weight)
    return models


def _held_entropies(held: DataFrame, models: Models) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropies of the texts under all languages, and each text's own; the texts stay on the executors."""
    shared = held.sparkSession.sparkContext.broadcast(models)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                entropy = np.asarray(shared.value.cross_entropies(batch.column(1).to_pylist()), np.float64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(entropy.tolist(), pa.list_(pa.float64()))], ["lang", "entropy"])

    found = held.select("lang", "text").mapInArrow(judged, "lang string, entropy array<double>").where(F.col("lang").isin(models.languages)).collect()
    truth = np.searchsorted(models.languages, np.array([r["lang"] for r in found], str))
    return np.array([r["entropy"] for r in found]), truth


def _calibrated(models: Models, entropy: np.ndarray, truth: np.ndarray) -> None:
    own = entropy[np.arange(len(truth)), truth]
    best = (np.inf, 1.0)
    for t in np.geomspace(0.5, 64, 15):
        z = -entropy * t
        z -= z.max(axis=1, keepdims=True)
        best = min(best, (-(z[np.arange(len(truth)), truth] - np.log(np.exp(z).sum(axis=1))).mean(), float(t)))
    models.temperature = best[1]
    for j in range(len(models.languages)):
        mine = own[truth == j] if (truth == j).any() else own
        models.limits[j] = np.quantile(mine, 0.99) + 0.25
        models.spread[j] = max(float(mine.std()), 0.05)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", doc: str = "doc_id", per_language: int = PER_LANGUAGE) -> Models | None:
    """Models of all languages among the documents, or None if there is nothing to learn from."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(F.col(doc)).alias("draw"))
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return None
    # thin out each language before its sample is put in order, so that no task sees a whole language
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, 2.0 * per_language / n))])
    thin = usable.where(F.pmod(F.col("draw"), F.lit(1_000_003)) < share[F.col("lang")] * 1_000_003)
    from pyspark.sql import Window

    drawn = thin.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "text"))).where(F.col("rank") <= per_language)
    counting = drawn.where(F.col("rank") % HELD_BACK != 0).select("lang", "text")
    columns = ", ".join(f"{n} long" for n in _names())
    grams = counting.mapInArrow(_counted, f"lang string, {columns}, n long").groupBy("lang", *_names()).agg(F.sum("n").alias("n"))
    counts = grams.toPandas().sort_values(["lang", *_names()], ignore_index=True)
    languages = sorted(counts["lang"].unique())
    models = _smoothed(counts, languages)
    models.limits, models.spread = np.full(len(languages), np.inf), np.ones(len(languages))
    entropy, truth = _held_entropies(drawn.where(F.col("rank") % HELD_BACK == 0), models)
    if len(truth):
        _calibrated(models, entropy, truth)
    return models


KIND = "struct<lang: string, score: double, cross_entropy: double, rejected: boolean>"


def language(text: Column | str, models: Models | None, spark) -> Column:
    """(lang, score, cross_entropy, rejected) of a text."""
    shared = spark.sparkContext.broadcast(models)
    arrow = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("cross_entropy", pa.float64()), ("rejected", pa.bool_())])

    @F.arrow_udf(KIND)
    def judge(texts: pa.Array) -> pa.Array:
        m, plain = shared.value, texts.to_pylist()
        rows = [i for i, t in enumerate(plain) if t and any(map(str.isalpha, t))] if m else []
        langs, score, entropy, rejected = ["und"] * len(plain), np.zeros(len(plain)), [None] * len(plain), np.ones(len(plain), bool)
        if rows:
            e = m.cross_entropies([plain[i] for i in rows])
            best = e.argmin(axis=1)
            low = e[np.arange(len(rows)), best]
            posterior = 1.0 / np.exp(-(e - low[:, None]) * m.temperature).sum(axis=1)
            inside = 1.0 / (1.0 + np.exp(np.clip((low - m.limits[best]) / m.spread[best], -50, 50)))
            score[rows], rejected[rows] = posterior * inside, low > m.limits[best]
            for i, b, x in zip(rows, best, low.tolist()):
                langs[i], entropy[i] = m.languages[b], x
        return pa.StructArray.from_arrays([pa.array(langs), pa.array(score), pa.array(entropy, pa.float64()), pa.array(rejected)], fields=list(arrow))

    return judge(text)


def with_language(docs: DataFrame, models: Models | None, text: str = "text") -> DataFrame:
    """The documents with `language`."""
    return without(docs, "language").withColumn("language", language(text, models, docs.sparkSession))
