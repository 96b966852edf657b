"""Packing documents into training sequences: cutting stock by column generation.

1. Documents are tokenized once; ids lie in a scratch table, 4 bytes each. A document is cut into pieces of a whole sequence
   and a rest.
2. Pieces are counted by length in classes `WIDTH` tokens wide: a histogram of at most `SIZE / WIDTH` numbers.
3. A linear program over the histogram finds how often each pattern of classes fills a sequence. Its columns are generated:
   the simplex duals price the classes, a knapsack by dynamic programming finds the pattern worth most, and that enters
   until none is worth more than a sequence, or Farley's bound says that the rest is worth less than a ten-thousandth.
   What rounding down leaves is filled first fit, largest first.
4. Pieces are ranked within their class by a hash, in slices. The rank says which pattern, which sequence and which place.
5. Classes round up, so sequences have some room left. Documents of a few hash buckets, as many as the room takes, are held
   out of the histogram as filler: laid end to end, they are cut where the rooms of the sequences, laid end to end, begin
   and end. What filler is left makes sequences of its own; the last tokens go to sequences of a power of two. So nothing
   is padded, and only filler is cut other than at multiples of a sequence.

The driver sees the histogram by bucket (at most 256 x 256 counts) and the patterns.

Defined results: a null or empty text is its end token alone. Repeated rows are documents of their own, also under one id
or none. An empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.running import ranked, running
from ..session import cut_lineage, scratch_path

SIZE = 4096
WIDTH = 16
BUCKETS = 256
END = 2
#: Relative gap to the linear program's bound at which columns stop.
GAP = 1e-4
#: Cells into which filler and rooms are cut to meet, in tokens.
CELL = 512
#: Words that a tokenizer remembers, and bytes of ids that it hands on at once.
REMEMBERED = 600_000
BATCH_BYTES = 16_000_000

#: Letters that neither compose nor split, and marks that follow them as a token run of their own.
PLAIN_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-įı-ɏ]+)([.,;:!?]*)")
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
ASCII_SPACE = re.compile("[ \t\n\r\x0b\x0c]+")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for a byte: itself where it prints, else the next one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    return {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}


class Words:
    """Ids of whole texts, word by word, for a tokenizer that drops white space; words seen are remembered.

    Nothing such a tokenizer does reaches over white space, so a text's ids are its words' ids one after the other. Ids are
    32-bit little-endian, as machines that Spark runs on write them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.letters = _byte_letters()

    def _learn(self, words: set[str]) -> None:
        known, tokenize, letters, odd = self.known, self.whole.model.tokenize, self.letters, []
        for w in words:
            m = PLAIN_WORD.fullmatch(w)
            if m is None:
                odd.append(w)
                continue
            core, tail = m.groups()
            low = core.lower()
            ids = known.get(low)
            if ids is None:
                found = tokenize(low if low.isascii() else low.encode().decode("latin-1").translate(letters))
                ids = known[low] = array("I", [t.id for t in found]).tobytes()
            if tail:
                if tail not in known:
                    self._learn_whole([tail])
                ids += known[tail]
            known[w] = ids
        self._learn_whole(odd)

    def _learn_whole(self, texts: list[str]) -> None:
        if texts:
            found = self.whole.encode_batch_fast(texts, add_special_tokens=False)
            self.known.update((t, array("I", e.ids).tobytes()) for t, e in zip(texts, found))

    def ids(self, text: str) -> bytes:
        words = ASCII_SPACE.split(text) if ODD_SPACE.search(text) else text.split()
        out = []
        for at in range(0, len(words), REMEMBERED // 4):
            some = words[at : at + REMEMBERED // 4]
            if len(self.known) > REMEMBERED:
                self.known = {}
            missing = {w for w in set(some) if w not in self.known}
            if missing:
                self._learn(missing)
            out.append(b"".join(map(self.known.__getitem__, some)))
        return b"".join(out)


@cache
def words_of(path: str) -> Words:
    """One per Python worker, so that a worker's later tasks find the words of its earlier ones."""
    return Words(path)


def tokenized(docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END) -> DataFrame:
    """(row, doc, bucket, n, ids): a number for each row, its ids with the end token as little-endian 32-bit numbers; written once."""
    kind = docs.schema[doc].dataType.simpleString()
    ready = docs.select(F.col(doc).alias("doc"), F.pmod(F.xxhash64(doc, text), F.lit(BUCKETS)).cast("int").alias("bucket"), F.coalesce(text, F.lit("")).alias("text"))
    last = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if tokenizer is None:
            import public_tokenizers

            words = words_of(public_tokenizers.path("word_bpe_49k.json"))
        else:
            words = words_of(tokenizer)
        for batch in batches:
            at, size, ids = 0, 0, []
            texts = batch.column("text")
            for i in range(batch.num_rows):
                ids.append(words.ids(texts[i].as_py()) + last)
                size += len(ids[-1])
                if size > BATCH_BYTES or i + 1 == batch.num_rows:
                    n = pa.array([len(x) // 4 for x in ids], pa.int64())
                    part = batch.slice(at, len(ids))
                    yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("bucket"), n, pa.array(ids, pa.binary())], names=["doc", "bucket", "n", "ids"])
                    at, size, ids = i + 1, 0, []

    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    ready.mapInArrow(encode, f"doc {kind}, bucket int, n long, ids binary").withColumn("row", F.monotonically_increasing_id()).write.option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


# The linear program


def best_pattern(sizes: np.ndarray, prices: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The worth and the counts of the pattern that is worth most: an unbounded knapsack."""
    worth, choice = np.zeros(room + 1), np.full(room + 1, -1)
    upto = np.searchsorted(sizes, np.arange(room + 1), side="right")
    for c in range(1, room + 1):
        worth[c] = worth[c - 1]
        if upto[c]:
            gains = worth[c - sizes[: upto[c]]] + prices[: upto[c]]
            k = int(gains.argmax())
            if gains[k] > worth[c] + 1e-12:
                worth[c], choice[c] = gains[k], k
    counts, c = np.zeros(len(sizes), np.int64), room
    while c > 0:
        if choice[c] < 0:
            c -= 1
        else:
            counts[choice[c]] += 1
            c -= int(sizes[choice[c]])
    return float(worth[room]), counts


def column_generation(sizes: np.ndarray, counts: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (one a column) and how often each is used so that all pieces are used up with the fewest sequences."""
    m = len(sizes)
    basis = np.diag(room // sizes).astype(float)
    inverse = np.diag(1.0 / np.diag(basis)) if m else np.zeros((0, 0))
    used = inverse @ counts
    for step in range(60 * m):
        prices = inverse.sum(axis=0)
        worth, pattern = best_pattern(sizes, prices, room)
        if worth <= 1 + 1e-9 or used.sum() * (1 - 1 / worth) <= GAP * used.sum():
            break
        direction = inverse @ pattern
        ratios = np.where(direction > 1e-9, used / np.where(direction > 1e-9, direction, 1.0), np.inf)
        out = int(ratios.argmin())
        basis[:, out] = pattern
        if step % 100 == 99:
            inverse = np.linalg.inv(basis)
            used = inverse @ counts
        else:
            inverse[out] /= direction[out]
            others = np.arange(m) != out
            inverse[others] -= np.outer(direction[others], inverse[out])
            t = ratios[out]
            used = used - t * direction
            used[out] = t
        used = np.maximum(used, 0.0)
    return basis.round().astype(np.int64), used


@dataclass
class Plan:
    """`patterns`: (counts by class, how many sequences); `held_out`: buckets below it are filler."""

    sizes: np.ndarray
    patterns: list[tuple[np.ndarray, int]]
    sequences: int
    held_out: int
    room: int
    filler: int


def patterns_for(sizes: np.ndarray, counts: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Whole patterns that use every piece: the linear program's, rounded down, and first fit for what is left."""
    columns, used = column_generation(sizes, counts, room)
    left, out = counts.copy(), []
    for pattern, x in zip(columns.T, used):
        times = int(np.floor(x + 1e-6))
        if pattern.any():
            times = min(times, int((left[pattern > 0] // pattern[pattern > 0]).min()))
            if times > 0:
                out.append((pattern.copy(), times))
                left -= times * pattern
    while left.any():
        free, pattern = room, np.zeros(len(sizes), np.int64)
        for k in range(len(sizes) - 1, -1, -1):
            pattern[k] = min(left[k], free // sizes[k])
            free -= pattern[k] * sizes[k]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        out.append((pattern, times))
        left -= times * pattern
    return out


def make_plan(histogram: np.ndarray, tokens: np.ndarray, size: int = SIZE, width: int = WIDTH) -> Plan:
    """`histogram[bucket, class]` counts pieces and `tokens[bucket]` sums them. As few buckets are held out as fill all rooms."""
    held, upto = 0, np.concatenate([[0], np.cumsum(tokens)])
    while True:
        counts = histogram[held:].sum(axis=0)
        classes = np.flatnonzero(counts)
        patterns = patterns_for(classes, counts[classes], size // width)
        sequences = sum(t for _, t in patterns)
        room = sequences * size - int(upto[-1] - upto[held])
        if room <= upto[held]:
            return Plan(classes, patterns, sequences, held, room, int(upto[held]))
        held = min(max(held + 1, int(np.searchsorted(upto, room))), len(tokens))


def _layout(plan: Plan) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, rank after the last, pieces a sequence, first sequence) for each pattern and class."""
    rows, at, sequence = [], dict.fromkeys(plan.sizes.tolist(), 0), 0
    for pattern, times in plan.patterns:
        for size, n in zip(plan.sizes.tolist(), pattern.tolist()):
            if n:
                rows.append((size, at[size], at[size] + n * times, n, sequence))
                at[size] += n * times
        sequence += times
    return rows


def _pieces(tokens: DataFrame, size: int, width: int) -> DataFrame:
    """(row, doc, bucket, n, start, length, crc, class): whole sequences and the rest of each document."""
    cut = lambda k: F.struct(
        (k * size).alias("start"), F.least(F.lit(size), F.col("n") - k * size).alias("length"),
        F.crc32(F.substring("ids", (k * (4 * size) + 1).cast("int"), F.lit(4 * size))).alias("crc"),
    )
    parts = F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / size)), cut)
    out = tokens.select("row", "doc", "bucket", "n", F.inline(parts))
    return out.withColumn("class", F.ceil(F.col("length") / width).cast("int"))


def _overlaid(filler: DataFrame, rooms: DataFrame) -> DataFrame:
    """Cut filler (row, doc, n, begin, end) where rooms (sequence, at, begin, end) on the same axis begin and end."""
    in_cells = lambda df: df.withColumn("cell", F.explode(F.sequence(F.floor(F.col("begin") / CELL), F.floor((F.col("end") - 1) / CELL))))
    other = in_cells(rooms.select("sequence", "at", "begin", "end")).withColumnsRenamed({"begin": "_begin", "end": "_end"})
    low, high = F.greatest("begin", "_begin"), F.least("end", "_end")
    met = in_cells(filler).join(other, "cell").where((low < high) & (F.floor(low / CELL) == F.col("cell")))
    return met.select("row", "doc", "n", (low - F.col("begin")).alias("start"), (high - low).alias("length"), "sequence", (F.col("at") + low - F.col("_begin")).alias("offset"))


def pack(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, end: int = END, size: int = SIZE, width: int = WIDTH
) -> DataFrame:
    """(doc, start, length, crc, n, sequence, offset): one row for each piece. `crc` is the CRC-32 of its ids, `n` the document's tokens."""
    spark = docs.sparkSession
    tokens = tokenized(docs, doc, text, tokenizer, end)
    per_doc = tokens.select("bucket", "n", F.floor(F.col("n") / size).alias("whole"), F.ceil((F.col("n") % size) / width).cast("int").alias("class"))
    per_class = per_doc.groupBy("bucket", "class").agg(F.count(F.lit(1)).alias("pieces"), F.sum("whole").alias("whole"), F.sum("n").alias("tokens"))
    histogram, sums = np.zeros((BUCKETS, size // width + 1), np.int64), np.zeros(BUCKETS, np.int64)
    for r in per_class.collect():
        histogram[r["bucket"], -1] += r["whole"]
        sums[r["bucket"]] += r["tokens"]
        if r["class"]:
            histogram[r["bucket"], r["class"]] += r["pieces"]
    plan = make_plan(histogram, sums, size, width)

    pieces = ranked(_pieces(tokens.where(F.col("bucket") >= plan.held_out), size, width), "rank", by=["class"], keys=["row", "start"])
    layout = spark.createDataFrame(_layout(plan), "_class int, low long, high long, each long, first long")
    inside = (F.col("class") == F.col("_class")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    placed = pieces.join(F.broadcast(layout), inside).withColumn("sequence", F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")))
    by = Window.partitionBy("sequence").orderBy(F.desc("length"), "row", "start")
    placed = placed.withColumn("offset", F.sum("length").over(by) - F.col("length"))
    placed = cut_lineage(placed.select("doc", "start", "length", "crc", "n", "sequence", "offset"))

    rooms = placed.groupBy("sequence").agg(F.max(F.col("offset") + F.col("length")).alias("at")).where(F.col("at") < size)
    rooms = running(rooms.withColumn("_slice", F.floor(F.col("sequence") / SIZE)).withColumn("room", size - F.col("at")), {"end": "room"}, ["sequence"])
    rooms = rooms.select("sequence", "at", (F.col("end") - F.col("room")).alias("begin"), "end")
    left = plan.filler - plan.room
    more = spark.range(left // size).select(
        (F.col("id") + plan.sequences).alias("sequence"), F.lit(0).cast("long").alias("at"), (F.col("id") * size + plan.room).alias("begin"), (F.col("id") * size + size + plan.room).alias("end")
    )
    last, begin = [], plan.filler - left % size
    for bit in (b for b in range(size.bit_length() - 1, -1, -1) if left % size >> b & 1):
        last.append((plan.sequences + left // size + len(last), 0, begin, begin + (1 << bit)))
        begin += 1 << bit
    rooms = rooms.unionByName(more).unionByName(spark.createDataFrame(last, "sequence long, at long, begin long, end long"))

    filler = tokens.where(F.col("bucket") < plan.held_out)
    laid = running(filler.select("row", "doc", "n").withColumn("_slice", F.shiftright("row", 33)), {"end": "n"}, ["row"]).withColumn("begin", F.col("end") - F.col("n"))
    cut = _overlaid(laid.select("row", "doc", "n", "begin", "end"), rooms).join(filler.select(F.col("row"), "ids"), "row")
    crc = F.crc32(F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")))
    names = ["doc", "start", "length", "crc", "n", "sequence", "offset"]
    return placed.select(*names).unionByName(cut.withColumn("crc", crc).select(*names))
