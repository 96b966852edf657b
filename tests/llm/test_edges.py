"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing column names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lanlore.llm import decontaminate, gru_lm, html_text, language_id, mixing, near_dedup, quality_rules, resampling, secret_scan, substring_dedup

LONG = " ".join(f"word{i % 977} other{i % 1009}" for i in range(15_000))
PLAIN = "The quick brown fox jumps over the lazy dog while the old farmer watches from the gate and then goes home to eat"
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, kept boolean, n_words long, words string, doc long, key string, "
    "spans string, copies int, size string, secrets string, language string, main string, matches string, items string, n_hit int, node string, label string, rest string"
)
ROWS = [
    (1, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (2, PLAIN, "en", "a"), (3, None, "en", "a"), (4, "", None, "b"), (5, LONG, "en", None), (6, LONG + " end", "en", "a"),
    (None, "password = abcdefgh12 " + PLAIN, None, None), (7, "x", "de", "b"), (7, "y z", "de", "b"), (8, " \n\t ", "de", "b"), (9, "ß 漢字 é", "zz", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), *[None] * 17) for r in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("i1", PLAIN), ("i1", PLAIN), (None, "x"), ("i2", None), ("i3", "")], "item_id string, text string")


def by_id(df, column, name="doc_id"):
    out = {}
    for r in df.select(name, column).collect():
        out.setdefault(r[0], []).append(r[1])
    return {k: sorted(v) for k, v in out.items()}


def test_quality_rules(docs, none):
    out = quality_rules.quality_rules(docs)
    assert out.count() == len(ROWS) and quality_rules.quality_rules(none).count() == 0
    assert by_id(out, "n_words") == {1: [23], 2: [23, 23], 3: [0], 4: [0], 5: [30_000], 6: [30_001], None: [26], 7: [1, 2], 8: [0], 9: [3]}
    assert by_id(out, "base_failed")[3] == [True] and by_id(out, "base_failed")[1] == [False]
    assert quality_rules.keep_good(docs).columns == docs.columns


def test_decontamination(docs, none, items):
    out = decontaminate.with_verdict(docs, items)
    assert out.count() == len(ROWS) and decontaminate.with_verdict(none, items).count() == 0
    assert by_id(out, "n_hit") == {1: [23], 2: [23, 23], 3: [0], 4: [0], 5: [0], 6: [0], None: [23], 7: [0, 1], 8: [0], 9: [0]}
    assert by_id(out.withColumn("items", F.array_join("items", ",")), "items")[7] == ["", ""]  # the item without an id is ''
    assert by_id(out, "contaminated")[7] == [False, True]
    assert decontaminate.with_verdict(docs, items.limit(0)).where("contaminated").count() == 0
    kept = decontaminate.keep_clean(docs, items)
    assert kept.columns == docs.columns and kept.count() == 7


def test_items_that_share_an_id_are_all_looked_for(spark):
    first, second, third = (" ".join(f"{c}{i}" for i in range(20)) for c in "pqr")
    docs = spark.createDataFrame([(1, f"so {first} on"), (2, f"and {second} on"), (3, f"or {third} on"), (4, "so and or on")], "doc_id long, text string")
    for ids in (None, None, None), ("i", "i", "i"):
        shared = spark.createDataFrame(list(zip(ids, (first, second, third + " unheard of"))), "item_id string, text string")
        out = decontaminate.with_verdict(docs, shared)
        assert by_id(out, "n_hit") == {1: [20], 2: [20], 3: [20], 4: [0]} and by_id(out, "contaminated") == {1: [True], 2: [True], 3: [True], 4: [False]}
        assert [r["doc_id"] for r in decontaminate.keep_clean(docs, shared).collect()] == [4]


def test_decontamination_finds_near_phrases(docs, items):
    wide = decontaminate.with_matches(docs.withColumn("text", F.regexp_replace("text", "goes home", "goes back home")), items.where("text is not null"), slop=2)
    found = wide.where("doc_id = 1").select(F.explode("matches").alias("m")).select("m.*")
    assert found.where("exact").count() > 0 and found.where("not exact").count() > 0


def test_near_duplicates(docs, none):
    out = near_dedup.near_duplicates(docs, size=2)
    assert out.count() == len(ROWS) and near_dedup.near_duplicates(none).count() == 0
    component = by_id(out, "component", "doc")
    assert component[2] == [1, 1] and component[6] == [5] and component[3] == [3] and component[4] == [4] and component[None] == [None]
    assert by_id(out, "n", "doc")[7] == [1, 1] and by_id(out, "kept", "doc")[None] == [True]
    kept = near_dedup.keep_one(docs, size=2)
    assert kept.columns == docs.columns and set(by_id(kept, "n_chars")) == {None, 1, 3, 4, 5, 7, 8, 9}


def test_an_id_with_two_texts_ties_their_classes(spark):
    df = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert by_id(near_dedup.near_duplicates(df, size=2), "component", "doc") == {1: [1], 2: [1], 3: [1, 1]}


def test_secrets(docs, none):
    out = secret_scan.with_secrets(docs)
    assert out.count() == len(ROWS) and secret_scan.with_secrets(none).count() == 0
    assert [s["kind"] for s in out.where("doc_id is null").first()["secrets"]] == ["assign"]
    assert out.where("doc_id is not null and size(secrets) > 0").count() == 0
    masked = secret_scan.masked(docs)
    assert masked.columns == docs.columns and masked.where("doc_id is null").first()["text"] == "[assign] " + PLAIN
    assert masked.where("doc_id = 3").first()["text"] is None


def test_mixing(docs, none):
    out = mixing.mix(docs)
    assert out.count() == len(ROWS) and mixing.mix(none).count() == 0
    assert all(0 <= r["copies"] <= 2 for r in out.collect())
    by = {r["source"]: r for r in out.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.expr("copies * size")).alias("k"), F.max("size").alias("m")).collect()}
    assert set(by) == {"a", "b", "c", None} and all(abs(r["k"] - r["t"]) <= r["m"] for r in by.values())


def test_substring_dedup(docs, none):
    out = substring_dedup.without_repeats(docs)
    assert out.count() == len(ROWS) and substring_dedup.without_repeats(none).count() == 0
    removed = by_id(out, "n_removed")
    assert removed[1] == [23] and removed[2] == [23, 23] and removed[3] == [0] and removed[None] == [0] and removed[6] == [30_000]
    assert by_id(out, "kept_text")[6] == ["end"] and by_id(out, "n_words")[7] == [1, 2]


def test_language(docs, none):
    models = language_id.fit(docs)
    out = language_id.with_language(docs, models).select("doc_id", "language.*")
    assert out.count() == len(ROWS) and language_id.with_language(none, models).count() == 0
    assert by_id(out, "lang")[3] == ["und"] and by_id(out, "lang")[8] == ["und"] and by_id(out, "lang")[5] == ["en"]
    assert all(0 <= r["score"] <= 1 for r in out.collect())
    assert language_id.fit(none) is None and set(by_id(language_id.with_language(docs, None).select("doc_id", "language.*"), "lang")[1]) == {"und"}


def test_resampling(docs, none, spark):
    labels = spark.createDataFrame([(1, 1), (7, 0), (None, 1), (3, None)], "doc_id long, quality int")
    out = resampling.keep_likely(docs, labels, F.col("quality") == 1)
    assert out.count() == len(ROWS) and resampling.keep_likely(none, labels, F.col("quality") == 1).count() == 0
    assert by_id(out, "log_weight", "doc")[3] == [0.0]
    assert resampling.keep_likely(docs, labels.limit(0), F.col("quality") == 1).where("kept").count() == len(ROWS)


def test_language_model(docs, none):
    out = gru_lm.language_scores(docs, F.col("lang").isNotNull())
    assert out.count() == len(ROWS)
    assert by_id(out, "n_tokens", "doc") == {1: [24], 2: [24, 24], 3: [1], 4: [1], 5: [30_001], 6: [30_002], None: [27], 7: [2, 3], 8: [1], 9: [4]}
    assert gru_lm.language_scores(none, F.lit(True)).count() == 0
    unlearned = gru_lm.language_scores(docs, F.lit(False)).collect()
    assert len(unlearned) == len(ROWS) and all(r["n_known"] == 0 and r["score"] < 0 for r in unlearned)


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, "k"), (2, "", None), (3, "<p>" + "a < b &amp; the  end " * 20_000, None), (3, "no tags", None)], "page_id long, html string, main string")
    out = html_text.with_main_text(pages)
    assert out.columns == pages.columns and html_text.with_main_text(pages.limit(0)).count() == 0
    texts = by_id(out.select("page_id", "main.text"), "text", "page_id")
    assert texts[1] == [""] and texts[2] == [""] and "no tags" in texts[3] and max(map(len, texts[3])) == len("a < b & the end ") * 20_000 - 1


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, none, name, stage, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([("i1", PLAIN)], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    for table in (docs, none):
        out = stage(spark, table, folder)
        last = name == corpus_pipeline.STAGES[-1][0]
        assert out.columns == ([c for c in docs.columns if c != "copy"] + ["copy"] if last else docs.columns)
        assert out.count() <= 2 * table.count()
    own = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).select(
        "doc_id", "text", "lang", "source", "n_chars", F.concat(F.lit("s"), "doc_id").alias("size"), (F.col("doc_id") * 2).alias("source_size"), F.lit(1.5).alias("target"), F.lit(-3).alias("copies"), F.lit(True).alias("kept")
    )
    rows = {r["doc_id"]: r for r in own.collect()}
    for r in stage(spark, own, folder).collect():
        assert all(r[c] == rows[r["doc_id"]][c] for c in own.columns if c not in ("text", "n_chars"))
