"""Ranked search, packing and the prefix trie against plain versions, and on odd input."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanlore.llm import packing, prefix_trie, ranked_search
from lanlore.llm.queries import QUERIES

from ..conftest import SF

# 11. Ranked lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_ranking(docs, items, k):
    bags = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    bags = [(d, b, sum(b.values())) for d, b in bags if b]
    n_docs, n_terms, df = len(bags), sum(n for *_, n in bags), Counter(t for _, b, _ in bags for t in b)
    out = defaultdict(list)
    for item, text in set(items):
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for d, b, n in bags:
            m = 25 + 75 * n * n_docs // n_terms
            s = sum(c * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 8 * m)) for t, c in wanted.items() if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out[item].append([(None if none else d, -s) for s, none, d in sorted(scored)[:k]])
    return {i: sorted(v, key=str) for i, v in out.items() if any(v)}


def as_ranking(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r["item_id"]].append((r["rank"], r["doc_id"], r["score"]))
    return {i: [[(d, s) for _, d, s in sorted(v, key=lambda x: x[0])]] for i, v in out.items()}


@pytest.fixture(scope="module")
def crowd():
    """Common and rare words, copies in numbers, a document with nearly everything."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    zipf = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, zipf, k=rng.randint(1, 60)))) for i in range(900)]
    docs += [(1000 + i, docs[3][1]) for i in range(300)] + [(5000, " ".join(words)), (5001, None), (5002, ""), (None, docs[4][1]), (7, docs[8][1]), (7, docs[8][1])]
    items = [(f"i{k}", " ".join(rng.choices(words, k=rng.randint(1, 12)))) for k in range(25)] + [("none", None), ("", "..."), ("alien", "neverseen"), (None, "w3 w399 W3"), ("i1", "w1 w1 w17")]
    return docs, items


@pytest.mark.parametrize("batch, shard", [(500_000, 600_000), (40, 2_000)])
def test_ranking_is_that_of_scoring_everything(spark, crowd, batch, shard):
    docs, items = crowd
    shown = spark.createDataFrame([(*d, 3, None) for d in docs], "doc_id long, text string, rank int, score string").repartition(5)
    got = ranked_search.ranked_search(shown, spark.createDataFrame(items, "item_id string, text string"), k=10, batch_terms=batch, shard_size=shard)
    want = plain_ranking(docs, items, 10)
    once = {i: v for i, v in as_ranking(got).items() if i != "i1"}
    assert once == {i: v for i, v in want.items() if i != "i1"}
    twice = Counter((r["rank"], r["doc_id"], r["score"]) for r in got.where("item_id = 'i1'").collect())  # two texts under one id
    assert twice == Counter((k + 1, d, s) for v in want["i1"] for k, (d, s) in enumerate(v))


def test_no_documents_and_no_items(spark, crowd):
    docs, items = (spark.createDataFrame(x, f"{i} {kind}, text string") for x, i, kind in zip(crowd, ("doc_id", "item_id"), ("long", "string")))
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.limit(0), items.limit(0))):
        assert ranked_search.ranked_search(d, i).collect() == []


def test_blocks_bound_their_documents_and_are_skipped(crowd):
    docs, items = crowd
    bags = [Counter(t.split()) for _, t in docs if t]
    vocabulary = {t: k for k, t in enumerate(sorted({t for b in bags for t in b}))}
    terms = [np.array(sorted(vocabulary[t] for t in b)) for b in bags]
    names = list(vocabulary)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    flat = np.concatenate(terms)
    impacts = np.array([100 * b[names[t]] // sum(b.values()) + 1 for b, ts in zip(bags, terms) for t in ts])
    weights = np.arange(len(names)) + 1
    wanted = [np.array(sorted({vocabulary[t] for t in text.split() if t in vocabulary})) for _, text in items if text]
    together = defaultdict(set)
    for w in wanted:
        for t in w.tolist():
            together[t] |= set(w.tolist())
    shard = ranked_search.Shard(offsets, flat, impacts, weights, {t: np.array(sorted(v)) for t, v in together.items()})
    dense = np.zeros((len(bags), len(names)), np.int64)
    dense[np.repeat(np.arange(len(bags)), np.diff(offsets)), flat] = impacts
    for t in together:
        b = shard.blocks(t)
        assert sorted(b.docs.tolist()) == np.flatnonzero(dense[:, t]).tolist() and max(b.ends - b.starts) <= ranked_search.BLOCK
        for s, e, summary in zip(b.starts, b.ends, b.summary):
            assert (dense[b.docs[s:e]][:, b.columns].max(axis=0) == summary).all()
    for w in wanted:
        if len(w):
            best = ranked_search.Best(5)
            shard.search(w, weights[w], 0, lambda docs, scores: best.add(np.stack([scores, 0 * docs, docs, 0 * docs])))
            scores = dense[:, w] @ weights[w]
            assert best.rows[0].tolist() == sorted(scores[scores > 0].tolist(), reverse=True)[:5]
    assert 0 < shard.blocks_opened < shard.blocks_met


# 12. Packing


def ids_of(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    return [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts]


def assert_packed(pieces, docs, size=4096):
    """Every id lies in one piece, sequences have no gap, and only full ones or powers of two exist."""
    ids, by_doc, by_sequence = dict(zip([d for d, _ in docs], ids_of([t for _, t in docs]))), defaultdict(list), defaultdict(list)
    for r in pieces:
        by_doc[r["doc"]].append((r["start"], r["length"], r["crc"], r["n"]))
        by_sequence[r["sequence"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(ids)
    for d, found in by_doc.items():
        at = 0
        for start, length, crc, n in sorted(found):
            assert start == at and length > 0 and n == len(ids[d]) and crc == zlib.crc32(ids[d][start : start + length].tobytes())
            at += length
        assert at == len(ids[d])
    for found in by_sequence.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)


ODD = [
    "a b", "", None, "<|endoftext|> <|startoftext|>x", "don't 'stand they'll 'S", "é H̱ ẞ İI ǅ", "x\x1cy z\x85w 　q r\xa0s", "..., ;;hello!!) 12a3,4", "漢字 かな 한국어 🙂👍🏽 é.",
    "Ünïcödé, ŠĐ! ß?", "\t\n \x0b", "word " * 9000, "ΑΣ Σ", "a‍b", "naïve's’t",
]


def test_words_give_the_ids_of_whole_texts(spark):
    import public_tokenizers

    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    words = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    for text, ids in zip(texts, ids_of(texts)):
        assert words.ids(text or "") == ids[:-1].tobytes(), text


@pytest.mark.parametrize("size, width", [(4096, 16), (64, 4)])
def test_packing_keeps_every_id_and_pads_nothing(spark, size, width):
    docs = [(i, t) for i, t in enumerate(ODD * 3 + ["the same text again"] * 300 + ["some other " * k for k in range(60)])]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, sequence string, offset int").repartition(4)
    pieces = packing.pack(df, size=size, width=width).collect()
    assert_packed(pieces, docs, size)
    tokens = sum(map(len, ids_of([t for _, t in docs])))
    assert len({r["sequence"] for r in pieces}) <= tokens // size + size.bit_length()


def test_packing_of_the_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    pieces = [r.asDict() for r in QUERIES["op12_packing"](spark, SF).collect()]
    assert_packed([{**r, "doc": r["doc_id"], "crc": r["ids_crc32"], "n": r["doc_tokens"], "sequence": r["sequence_id"]} for r in pieces], docs)


def test_packing_of_repeated_rows_null_ids_and_nothing(spark):
    df = spark.createDataFrame([(1, "a b c")] * 3 + [(None, "d"), (None, None)], "doc_id long, text string")
    pieces = packing.pack(df).collect()
    whole = Counter()
    for r in pieces:
        whole[(r["doc"], r["n"])] += r["length"]
    assert whole == {(1, 4): 12, (None, 2): 2, (None, 1): 1}
    assert packing.pack(df.limit(0)).collect() == []


def test_the_linear_program_reaches_its_bound():
    rng = np.random.default_rng(2)
    sizes = np.arange(1, 65)
    counts = rng.integers(1, 500, 64)
    patterns, used = packing.column_generation(sizes, counts, 64)
    assert (patterns.T @ sizes <= 64).all() and np.allclose(patterns @ used, counts) and (used >= 0).all()
    prices = np.linalg.inv(patterns).sum(axis=0)
    assert math.isclose(prices @ counts, used.sum()) and packing.best_pattern(sizes, prices, 64)[0] <= 1 + 2 * packing.GAP  # duals show that no plan is better
    whole = packing.patterns_for(sizes, counts, 64)
    assert (sum(t * p for p, t in whole) == counts).all() and sum(t for _, t in whole) <= used.sum() * 1.02 + 2
    worth, pattern = packing.best_pattern(np.array([3, 5, 7]), np.array([3.0, 5.5, 7.2]), 16)
    assert math.isclose(worth, 5.5 * 2 + 3.0 * 2) and pattern.tolist() == [2, 2, 0]


# 13. Conversation prefix trie


def plain_trie(rows):
    """Every prefix in a dict."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16], (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in own.items()}
    whole = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        whole[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    out = {}
    for prefix, convs in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(prefix))
        out[min(convs), len(prefix)] = (
            min(members[prefix[:-1]]) if prefix else None, len(convs), sum(len(p) == len(prefix) + 1 for p in below),
            sum(all(len(whole[c]) == len(p) for c in members[p]) for p in below), sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p), hashlib.sha256(ends.encode()).hexdigest(),
        )
    return out


def hot_conversations(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * n), n):
        kind = rng.random()
        if kind < 0.3:
            turns = [("user", "hello"), ("assistant", "yes é"), ("user", "bye")]  # a third are copies
        elif kind < 0.7:
            turns = [("user", "hello")] + [(rng.choice("ua"), rng.choice(["x", "yy", ""])) for _ in range(rng.randint(0, 9))]
        else:
            turns = [(rng.choice("ua"), rng.choice(["x", "yy", "z" * 30])) for _ in range(rng.randint(1, 8))]
        if c % 50 == 0:
            turns = turns[: rng.randint(1, 3)]
        rows += [(c, t, *turn) for t, turn in enumerate(turns)]
    rows += [(7_000_000, t, "u", f"{t % 3}") for t in range(80)] + [(None, 1, "u", "x"), (7_000_001, None, None, None), (7_000_001, None, "u", None), (7_000_001, 1, "", "b"), (7_000_001, 1, "", "a")]
    rows += [(7_000_002, 0, "user", "again")] * 2
    return rows


@pytest.mark.parametrize("block", [1, 12, 60, 300_000])
def test_trie_is_that_of_all_prefixes(spark, block):
    rows = hot_conversations(block, 260)
    df = spark.createDataFrame([(*r, 0) for r in rows], "conv_id long, turn long, role string, text string, depth int").repartition(7)
    got = prefix_trie.prefix_trie(prefix_trie.rebuilt(df), block=block).collect()
    found = {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got}
    assert len(found) == len(got) and found == plain_trie(rows)


def test_trie_members_are_an_interval_of_the_order(spark):
    rows = hot_conversations(3, 150)
    convs = prefix_trie.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    order = sorted(((bytes(r["key"]), r["conv_id"]) for r in convs.collect()))
    for r in prefix_trie.prefix_trie(convs, block=30).collect():
        inside = order[r["first"] : r["first"] + r["n_convs"]]
        prefix = inside[0][0][: 16 * r["depth"]]
        assert min(c for _, c in inside) == r["conv_id"] and [x for x in order if x[0].startswith(prefix)] == inside


def test_trie_of_nothing(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert prefix_trie.prefix_trie(prefix_trie.rebuilt(none)).collect() == []


def test_ranges_by_sparse_table():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 5, 37)
    table = prefix_trie.Sparse(values)
    low = rng.integers(0, 37, 200)
    high = np.minimum(36, low + rng.integers(0, 37, 200))
    assert table.least(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]
    start, floor = rng.integers(0, 38, 200), rng.integers(0, 6, 200)
    for right in (True, False):
        for s, f, got in zip(start, floor, table.reach(start, floor, right)):
            at = s
            while (at < 37 and values[at] >= f) if right else (at > 0 and values[at - 1] >= f):
                at += 1 if right else -1
            assert at == got
