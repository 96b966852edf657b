"""The operators as queries over the driver's tables, with their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

WORDS = r"[^\x20\x09-\x0D]+"


def query(sql: str | None = None):
    """Register the decorated function under its own name."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# 1. Quality rules


def quality_sql(keep: str = "", docs: str = "documents") -> str:
    """The rules in SQL. `keep` prefixes the names of the steps, so that the pipeline can hold several."""
    from .quality_rules import FENCE, LEAST_WORDS, MOST_REPEATED, PRIOR, SIGNALS

    least = " ".join(f"WHEN '{s}' THEN {v}" for s, v in SIGNALS.items())
    stacked = " UNION ALL ".join(f"SELECT lang, source, '{s}' AS signal, {s} AS value FROM {keep}signals" for s in SIGNALS)
    limit = ", ".join(f"max(CASE WHEN signal = '{s}' THEN fence END) AS limit_{s}" for s in SIGNALS)
    within = " AND ".join(f"s.{s} <= l.limit_{s}" for s in SIGNALS)
    return f"""
{keep}texts AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM {docs}),
{keep}split AS (SELECT *, regexp_extract_all(text, '{WORDS}') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORDS}')) AS lines FROM {keep}texts),
{keep}grams AS (SELECT doc_id, i, list_slice(words, i, i + 4) AS gram FROM {keep}split, unnest(range(1, len(words) - 3)) AS r(i)),
{keep}twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM {keep}grams) WHERE n > 1),
{keep}covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM {keep}twice, unnest(range(0, 5)) AS r(k) GROUP BY doc_id),
{keep}counts AS (
    SELECT s.doc_id, s.lang, s.source, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]+', '', 'g')) AS BIGINT) AS n_upper,
        CAST(len(lines) AS BIGINT) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
    FROM {keep}split s LEFT JOIN {keep}covered c ON s.doc_id = c.doc_id),
{keep}signals AS (
    SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
        10000 * n_symbols // greatest(word_chars, 1) AS symbol_share, 10000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share,
        10000 * n_upper // greatest(word_chars, 1) AS upper_share, 100 * word_chars // greatest(n_words, 1) AS word_length FROM {keep}counts),
{keep}stacked AS ({stacked}),
{keep}own AS (SELECT lang, source, signal, (value >> greatest(length(bin(value)) - 6, 0)) << greatest(length(bin(value)) - 6, 0) AS cell, count(*) AS n
    FROM {keep}stacked GROUP BY ALL),
{keep}whole AS (SELECT *, sum(n) OVER (PARTITION BY lang, signal) AS total FROM (SELECT lang, signal, cell, sum(n) AS n FROM {keep}own GROUP BY ALL)),
{keep}leant AS (SELECT g.lang, g.source, g.signal, w.cell, 0 AS n, {PRIOR} * w.n AS lean, w.total AS size
    FROM (SELECT DISTINCT lang, source, signal FROM {keep}own) g JOIN {keep}whole w ON g.lang IS NOT DISTINCT FROM w.lang AND g.signal = w.signal),
{keep}merged AS (SELECT lang, source, signal, cell, sum(n) AS n, sum(lean) AS lean, max(size) AS size FROM (
    SELECT lang, source, signal, cell, n, 0 AS lean, 0 AS size FROM {keep}own UNION ALL SELECT * FROM {keep}leant) GROUP BY ALL),
{keep}mass AS (SELECT *, n * max(size) OVER (PARTITION BY lang, source, signal) + lean AS m FROM {keep}merged),
{keep}upto AS (SELECT *, sum(m) OVER (PARTITION BY lang, source, signal ORDER BY cell ROWS UNBOUNDED PRECEDING) AS below,
    sum(m) OVER (PARTITION BY lang, source, signal) AS total FROM {keep}mass),
{keep}quartiles AS (SELECT lang, source, signal, min(CASE WHEN 4 * below >= total THEN cell END) AS q1, min(CASE WHEN 4 * below >= 3 * total THEN cell END) AS q3
    FROM {keep}upto GROUP BY ALL),
{keep}fences AS (SELECT lang, source, signal, q3 + {FENCE} * greatest(q3 - q1, CASE signal {least} END) AS fence FROM {keep}quartiles),
{keep}limits AS (SELECT lang, source, {limit} FROM {keep}fences GROUP BY lang, source),
{keep}judged AS (SELECT s.*, NOT base_failed AND {within} AS kept
    FROM {keep}signals s JOIN {keep}limits l ON s.lang IS NOT DISTINCT FROM l.lang AND s.source IS NOT DISTINCT FROM l.source)"""


@query(f"WITH {quality_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged")
def op1_quality_rules(spark, sf):
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


# 6. Benchmark decontamination

ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BARE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def contamination_sql(keep: str = "", docs: str = "documents") -> str:
    return f"""
{keep}doc_words AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{BARE}') AS words FROM {docs}),
{keep}item_words AS (SELECT item_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{BARE}') AS words FROM benchmark),
{keep}item_grams AS (SELECT DISTINCT item_id, least(len(words), 13) AS n, list_slice(words, i, i + least(len(words), 13) - 1) AS gram
    FROM {keep}item_words, unnest(range(1, greatest(len(words) - 12, 1) + 1)) AS r(i) WHERE len(words) > 0),
{keep}doc_grams AS (SELECT d.doc_id, i, n, list_slice(words, i, i + n - 1) AS gram
    FROM {keep}doc_words d, (SELECT DISTINCT n FROM {keep}item_grams) s, unnest(range(1, len(words) - n + 2)) AS r(i)),
{keep}found AS (SELECT d.doc_id, d.i, d.n, g.item_id FROM {keep}doc_grams d JOIN {keep}item_grams g ON d.n = g.n AND d.gram = g.gram),
{keep}hits AS (SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM {keep}found, unnest(range(0, n)) AS r(k) GROUP BY doc_id),
{keep}named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, array_to_string(list_sort(list(DISTINCT CAST(item_id AS VARCHAR))), ',') AS items FROM {keep}found GROUP BY doc_id),
{keep}verdict AS (SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
    coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
    FROM {keep}doc_words w LEFT JOIN {keep}hits h ON w.doc_id = h.doc_id LEFT JOIN {keep}named i ON w.doc_id = i.doc_id)"""


@query(f"WITH {contamination_sql()} SELECT * FROM verdict")
def op6_decontamination(spark, sf):
    from pyspark.sql import functions as F

    from .decontaminate import with_verdict

    judged = with_verdict(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


# 9. MinHash near-dedup


def near_sql(keep: str = "", docs: str = "documents", size: int = 2) -> str:
    shorter = f"list_slice(words, i, i + least({size}, len(words)) - 1)"
    return f"""
{keep}near_words AS (SELECT doc_id, regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{WORDS}') AS words FROM {docs}),
{keep}shingles AS (SELECT DISTINCT doc_id, {shorter} AS s FROM {keep}near_words, unnest(range(1, greatest(len(words) - {size - 2}, 2))) AS r(i) WHERE len(words) > 0),
{keep}sizes AS (SELECT doc_id, count(*) AS n FROM {keep}shingles GROUP BY doc_id),
{keep}common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM {keep}shingles a JOIN {keep}shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
{keep}links AS (SELECT a, b FROM {keep}common JOIN {keep}sizes x ON x.doc_id = a JOIN {keep}sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
{keep}two_way AS (SELECT a, b FROM {keep}links UNION ALL SELECT b, a FROM {keep}links),
{keep}reach AS (SELECT doc_id AS node, doc_id AS seen FROM {docs} UNION SELECT r.node, b.b FROM {keep}reach r JOIN {keep}two_way b ON r.seen = b.a),
{keep}groups AS (SELECT node, min(seen) AS component_id FROM {keep}reach GROUP BY node)"""


@query(
    f"WITH RECURSIVE {near_sql()} SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept "
    "FROM documents d JOIN groups g ON d.doc_id = g.node LEFT JOIN sizes s ON d.doc_id = s.doc_id"
)
def op9_minhash_near_dedup(spark, sf):
    from pyspark.sql import functions as F

    from .near_dedup import near_duplicates

    found = near_duplicates(table(spark, sf, "documents"), size=2, percent=80)
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), "kept")


# 7. Mixing sources to target weights


@query()
def op7_entropy_mixing(spark, sf):
    from pyspark.sql import functions as F

    from .mixing import mix

    mixed = mix(table(spark, sf, "documents"), weights=(5, 2, 1), percent=150)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


# 2. Secret scans


def secrets_sql(keep: str = "", docs: str = "documents") -> str:
    """Every rule's matches with their places: the pieces between matches tell where each begins."""
    from .secret_scan import RULES

    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    steps = []
    for order, r in enumerate(RULES):
        steps.append(
            f"SELECT doc_id, {order} AS kind_no, '{r.kind}' AS kind, regexp_split_to_array(text, {quoted(r.pattern)}) AS pieces, "
            f"regexp_extract_all(text, {quoted(r.pattern)}) AS found, regexp_extract_all(text, {quoted(r.pattern)}, {r.group}) AS judged, {r.least} AS least FROM {keep}scanned"
        )
    return f"""
{keep}scanned AS (SELECT doc_id, coalesce(text, '') AS text FROM {docs}),
{keep}matched AS ({" UNION ALL ".join(steps)}),
{keep}spans AS (SELECT doc_id, kind_no, kind, length(found[i]) AS size,
    length(array_to_string(list_slice(pieces, 1, i), '')) + length(array_to_string(list_slice(found, 1, i - 1), '')) AS begins
    FROM {keep}matched, unnest(range(1, len(found) + 1)) AS r(i) WHERE length(judged[i]) >= least),
{keep}listed AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(kind || ':' || begins || ':' || (begins + size), ',' ORDER BY begins, kind_no) FILTER (kind_no < 3) AS base,
    string_agg(kind || ':' || begins || ':' || (begins + size), ',' ORDER BY begins, kind_no) AS spans FROM {keep}spans GROUP BY doc_id)"""


@query(
    f"WITH {secrets_sql()} SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, "
    "sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN listed l ON d.doc_id = l.doc_id"
)
def op2_secret_scan(spark, sf):
    from pyspark.sql import functions as F

    from .secret_scan import BASE, with_secrets

    found = with_secrets(table(spark, sf, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    counts = [F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE]
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))


# 8. Language ID


def remainder(doc_id="doc_id"):
    from pyspark.sql import functions as F

    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5  # no id counts as empty text: 0


@query()
def op8_language_id(spark, sf):
    from .language_id import fit, with_language

    docs = table(spark, sf, "documents")
    models = fit(docs.where(remainder() != 0).select("doc_id", "text", "lang"))
    judged = with_language(docs.select("doc_id", "text"), models)
    return judged.select("doc_id", (remainder() == 0).alias("held_out"), judged["language.lang"].alias("lang_pred"), judged["language.score"].alias("score"), judged["language.cross_entropy"], judged["language.rejected"])


# 5. HTML extraction


@query()
def op5_html_extraction(spark, sf):
    from pyspark.sql import functions as F

    from .html_text import with_main_text

    found = with_main_text(table(spark, sf, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", found["main.text"].alias("text"), F.length(found["main.text"]).cast("long").alias("n_chars"), found["main.n_blocks"], found["main.n_kept"])


# 3. Quality classifier


@query()
def op3_importance_resampling(spark, sf):
    from pyspark.sql import functions as F

    from .resampling import keep_likely

    labels = table(spark, sf, "labels")
    return keep_likely(table(spark, sf, "documents"), labels, F.col("quality") == 1).withColumnRenamed("doc", "doc_id")


# 10. LM scoring


@query()
def op10_gru_scoring(spark, sf):
    from .gru_lm import language_scores

    scored = language_scores(table(spark, sf, "documents").select("doc_id", "text"), remainder() != 1).withColumnRenamed("doc", "doc_id")
    return scored.select("doc_id", (remainder() == 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


# 4. Substring dedup


def repeats_sql(keep: str = "", docs: str = "documents", window: int = 20) -> str:
    return f"""
{keep}plain AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') AS words FROM {docs}),
{keep}windows AS (SELECT doc_id, i, list_slice(words, i, i + {window - 1}) AS w FROM {keep}plain, unnest(range(1, len(words) - {window - 2})) AS r(i)),
{keep}again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS k FROM {keep}windows) WHERE k > 1),
{keep}gone AS (SELECT doc_id, list(DISTINCT i + k) AS places FROM {keep}again, unnest(range(0, {window})) AS r(k) GROUP BY doc_id)"""


@query(
    f"WITH {repeats_sql()} SELECT p.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_removed, "
    "sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_filter(words, lambda w, i: NOT list_contains(places, i)) END, ' ')) AS kept_sha256 "
    "FROM plain p LEFT JOIN gone g ON p.doc_id = g.doc_id"
)
def op4_substring_dedup(spark, sf):
    from pyspark.sql import functions as F

    from .substring_dedup import without_repeats

    left = without_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


# 13. Conversation prefix trie


def trie_sql() -> str:
    """CRC-32 bit by bit, prefixes as lists of turns, and for each node the nodes above it."""
    bits = "list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))"
    codes = "list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))"
    crc = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {codes}), lambda acc, b: {bits}), 4294967295)"
    return f"""
turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn NULLS FIRST, sha256(CAST(octet_length(CAST(role AS BLOB)) AS VARCHAR) || ':' || role || text)) AS turns
    FROM turns GROUP BY conv_id),
drawn AS (SELECT conv_id, turns, {crc} % 6 AS h FROM own),
rebuilt AS (SELECT d.conv_id, list_concat(coalesce(list_slice(b.turns, 1, h), []), list_slice(d.turns, h + 1, len(d.turns))) AS turns
    FROM drawn d LEFT JOIN own b ON b.conv_id = d.conv_id - d.conv_id % 100),
prefixes AS (SELECT conv_id AS c, d, len(turns) AS n, list_slice(turns, 1, d) AS prefix, turns[d].text AS last FROM rebuilt, unnest(range(0, len(turns) + 1)) AS r(d)),
members AS (SELECT c, d, n, last, min(c) OVER (PARTITION BY d, prefix) AS node FROM prefixes),
nodes AS (SELECT node, d, count(*) AS n_convs, bool_and(n = d) AS childless, CASE WHEN d = 0 THEN 0 ELSE max(length(last)) END AS chars,
    sha256(coalesce(string_agg(CASE WHEN n = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c), '')) AS ends FROM members GROUP BY node, d),
above AS (SELECT m.node AS top, m.d AS top_d, n.* FROM nodes n JOIN members m ON m.c = n.node AND m.d <= n.d),
sums AS (SELECT top, top_d, count(*) FILTER (d = top_d + 1) AS n_children, count(*) FILTER (childless) AS n_leaves, sum((n_convs - 1) * chars) AS saved FROM above GROUP BY top, top_d)"""


@query(
    f"WITH {trie_sql()} SELECT n.node AS conv_id, CAST(n.d AS BIGINT) AS depth, p.node AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends AS ends_sha256 "
    "FROM nodes n JOIN sums s ON n.node = s.top AND n.d = s.top_d LEFT JOIN members p ON p.c = n.node AND p.d = n.d - 1"
)
def op13_prefix_trie(spark, sf):
    from .prefix_trie import prefix_trie, rebuilt

    trie = prefix_trie(rebuilt(table(spark, sf, "conversations")))
    return trie.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


# 12. Packing


@query()
def op12_packing(spark, sf):
    from .packing import pack

    names = {"doc": "doc_id", "crc": "ids_crc32", "n": "doc_tokens", "sequence": "sequence_id"}
    return pack(table(spark, sf, "documents")).withColumnsRenamed(names)


# 11. Ranked lexical search


def search_sql(k: int = 10) -> str:
    """Every document scored for every item."""
    terms = f"regexp_extract_all({ASCII_LOWER.format("coalesce(text, '')")}, '{BARE}')"
    return f"""
texts AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS terms FROM documents),
sized AS (SELECT r, doc_id, len(terms) AS n FROM texts WHERE len(terms) > 0),
totals AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM sized),
items AS (SELECT row_number() OVER () AS i, item_id, {terms} AS terms FROM (SELECT DISTINCT item_id, coalesce(text, '') AS text FROM benchmark)),
wanted AS (SELECT i, term, count(*) AS c FROM (SELECT i, unnest(terms) AS term FROM items) GROUP BY i, term),
postings AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(terms) AS term FROM texts) WHERE term IN (SELECT term FROM wanted) GROUP BY r, term),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * max(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, totals GROUP BY term),
hits AS (SELECT i, r, CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * n_docs) // n_terms)))) AS BIGINT) AS score
    FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN sized USING (r), totals GROUP BY i, r),
placed AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank
    FROM hits JOIN items USING (i) JOIN sized USING (r) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM placed WHERE rank <= {k}"""


@query(f"WITH {search_sql()}")
def op11_ranked_search(spark, sf):
    from .ranked_search import ranked_search

    return ranked_search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), k=10)
