"""Quality rules whose limits come from the data: one mergeable quantile sketch per language, source and signal.

A sketch is a sparse histogram over values cut to their six leading bits, so its relative error is at most 1/32, its
size has a bound (64 cells and 32 more for each further doubling), and sketches merge by adding counts. Spark builds
them by a partial aggregation in each task, so a source with a third of all rows moves no more cells than a small one.
The limit of a group is Tukey's outer fence of its sketch, after the sketch of the group's language was merged in
with the weight of `PRIOR` documents: small groups lean on their language, large ones speak for themselves.

Defined results: a null text has no words and fails the base rule; an empty text likewise. A null language or source
is a value of its own. Repeated rows are judged one by one and alike. An empty table gives an empty table. Columns of
the input that bear a name of the operator's own are replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import split_words, stripped_of, where_settled, without

#: Documents' worth of weight that the language's sketch has in each of its sources' sketches.
PRIOR = 100
#: How many spreads above the upper quartile the limit lies.
FENCE = 3
#: Signal -> least spread. Shares are in hundredths of a percent, word length in hundredths of a character.
SIGNALS = {"symbol_share": 200, "dup_line_share": 1500, "upper_share": 1000, "word_length": 100}
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20

_OWN = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", *SIGNALS]


def _covered(words: str, hashes: str, df: DataFrame) -> DataFrame:
    """Adds `n_repeat_words`: words inside a window that occurs twice or more in its text.

    Windows are told apart by a 64-bit hash within one text only. Only texts that repeat a window get sorted.
    """
    n = F.size(words)
    at = lambda i, k: F.get(F.col(words), i + k)
    df = df.withColumn(hashes, F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))))
    repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
    df = df.withColumn("_qr_sorted", F.when(repeats, F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda s, k: F.coalesce(F.get(F.col("_qr_sorted"), k)["h"] == s["h"], F.lit(False))
    df = df.withColumn(
        "_qr_at",
        F.sort_array(F.transform(F.filter("_qr_sorted", lambda s, k: same(s, k - 1) | same(s, k + 1)), lambda s: s["i"])),
    )
    swept = F.aggregate(
        "_qr_at",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"), (p + WINDOW).alias("end")),
    )
    return df.withColumn("n_repeat_words", F.coalesce(swept["n"], F.lit(0)).cast("long"))


def with_signals(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with counts, the base rule's verdict and the signals that the sketches are made of."""
    df = without(docs, *_OWN).withColumn("_qr_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_qr_words", split_words("_qr_text")).withColumn(
        "_qr_lines", F.filter(F.split("_qr_text", "\n"), lambda line: F.length(F.translate(line, " \t\x0b\x0c\r", "")) > 0)
    )
    df = df.withColumns(
        {
            "n_words": F.size("_qr_words").cast("long"),
            "word_chars": F.length(F.array_join("_qr_words", "")).cast("long"),
            "n_symbols": stripped_of(F.col("_qr_text"), r"[#*$%&|<>]+"),
            "n_dup_lines": (F.size("_qr_lines") - F.size(F.array_distinct("_qr_lines"))).cast("long"),
            "_qr_n_lines": F.size("_qr_lines").cast("long"),
            "_qr_upper": stripped_of(F.col("_qr_text"), r"[A-ZÀ-ÖØ-Þ]+"),
        }
    )
    df = _covered("_qr_words", "_qr_hashes", df)

    def share(part: str, whole: str, unit: int) -> Column:
        return F.floor(F.lit(unit) * F.col(part) / F.greatest(F.col(whole), F.lit(1))).cast("long")

    df = df.withColumns(
        {
            "base_failed": (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
            "symbol_share": share("n_symbols", "word_chars", 10_000),
            "dup_line_share": share("n_dup_lines", "_qr_n_lines", 10_000),
            "upper_share": share("_qr_upper", "word_chars", 10_000),
            "word_length": share("word_chars", "n_words", 100),
        }
    )
    return df.drop(*[c for c in df.columns if c.startswith("_qr_")])


def cell(value: Column) -> Column:
    """A whole number cut to its six leading bits: the sketch's cell."""
    spare = F.greatest(F.length(F.bin(value)) - 6, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, spare), spare)


def sketches(signals: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, signal, cell, n): every group's sketches as rows; sketches merge by adding `n` per cell."""
    named = F.array(*[F.struct(F.lit(s).alias("signal"), F.col(s).alias("value")) for s in SIGNALS])
    return (
        signals.select(*groups, F.explode(named).alias("s"))
        .groupBy(*groups, F.col("s.signal").alias("signal"), cell(F.col("s.value")).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n].eqNullSafe(right[n]) for n in names])


def limits(sketch: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """One row per language and source: the limit of every signal."""
    whole = sketch.groupBy(F.col(lang).alias("_l"), F.col("signal").alias("_s"), F.col("cell").alias("_c")).agg(F.sum("n").alias("_n"))
    whole = whole.withColumn("_all", F.sum("_n").over(Window.partitionBy("_l", "_s")))
    groups = sketch.select(lang, source, "signal").distinct()
    leant = groups.join(whole, groups[lang].eqNullSafe(whole["_l"]) & (groups["signal"] == whole["_s"])).select(
        lang, source, "signal", F.col("_c").alias("cell"), F.lit(0).cast("long").alias("n"), (PRIOR * F.col("_n")).cast("double").alias("lean"), F.col("_all").cast("double").alias("of")
    )
    own = sketch.select(lang, source, "signal", "cell", "n", F.lit(0.0).alias("lean"), F.lit(0.0).alias("of"))
    merged = own.unionByName(leant).groupBy(lang, source, "signal", "cell").agg(F.sum("n").alias("n"), F.sum("lean").alias("lean"), F.max("of").alias("of"))
    group = Window.partitionBy(lang, source, "signal")
    # whole numbers throughout: a cell's own count times the language's size, plus the leaning part
    merged = merged.withColumn("mass", F.col("n") * F.max("of").over(group) + F.col("lean"))
    merged = merged.withColumns({"upto": F.sum("mass").over(group.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("mass").over(group)})
    quartiles = merged.groupBy(lang, source, "signal").agg(
        *[F.min(F.when(4 * F.col("upto") >= k * F.col("total"), F.col("cell"))).alias(name) for k, name in ((1, "q1"), (3, "q3"))]
    )
    least = F.create_map(*[F.lit(x) for pair in SIGNALS.items() for x in pair])
    fence = F.col("q3") + FENCE * F.greatest(F.col("q3") - F.col("q1"), least[F.col("signal")])
    return quartiles.groupBy(lang, source).agg(*[F.max(F.when(F.col("signal") == s, fence)).alias(f"limit_{s}") for s in SIGNALS])


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents with counts, signals, limits of their group, `base_failed` and `kept`.

    Two passes over the texts: one for the sketches, which does not compute what only the base rule needs, and one for
    the verdict. The limits are joined by language and source; Spark broadcasts them where they turn out small and
    splits hot groups where they do not.
    """
    found = limits(sketches(with_signals(docs, text), [lang, source]), lang, source)
    found = found.withColumnsRenamed({lang: "_qr_lang", source: "_qr_source"})
    judged = without(with_signals(docs, text), *[f"limit_{s}" for s in SIGNALS])
    joined = judged.join(found, judged[lang].eqNullSafe(found["_qr_lang"]) & judged[source].eqNullSafe(found["_qr_source"]), "left").drop("_qr_lang", "_qr_source")
    within = reduce(lambda a, b: a & b, [F.col(s) <= F.col(f"limit_{s}") for s in SIGNALS])
    return joined.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(within, F.lit(True))))


def keep_good(docs: DataFrame, **columns: str) -> DataFrame:
    """The documents that the rules keep, with their own columns only."""
    marked = docs.withColumn("_whole_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    return where_settled(quality_rules(marked, **columns), F.col("kept")).select("_whole_row.*")
