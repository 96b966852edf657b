"""Secret scans through a trigram inverted index.

From each rule's regular expression a Boolean query of trigrams is derived that every match must satisfy. Each block of
texts (one Arrow batch) gets a positional-free inverted index of the trigrams that any rule asks for; a rule's postings
are intersected and united as its query says, and only the texts left over are searched with the expression itself. A
rule that no trigram is mandatory for is searched for in every text of the block. Blocks are bounded by Spark's batch
size, tasks hold one block at a time, nothing is shuffled, and a lost executor costs its blocks only.

Spans count code points, end exclusive. Within a rule they are leftmost and do not overlap; matches that are too short
are dropped. Defined results: a null text is empty and has no spans; repeated rows are searched one by one. `secrets`
replaces a column of that name; all other columns of the input stay as they are, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .text import without


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c.lower()}]" if c.isalpha() else c for c in word)


@dataclass(frozen=True)
class Rule:
    """`group` of a match must have at least `least` characters; the span is the whole match."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


#: The three base rules, in the order in which equal starts are listed.
BASE = (
    Rule(
        "assign",
        "(" + "|".join(either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key")) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8,
        2,
    ),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),
)
#: Publicly documented formats of keys and tokens.
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pay_key", "[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("map_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/@]+@"),
)
RULES = BASE + MORE

# Boolean queries: True (no condition), a trigram as text, ("and", parts) or ("or", parts).

Query = bool | str | tuple
MOST_STRINGS = 64


def _both(parts: Sequence[Query]) -> Query:
    flat = [q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])]
    parts = frozenset(p for p in flat if p is not True)
    return True if not parts else next(iter(parts)) if len(parts) == 1 else ("and", parts)


def _either(parts: Sequence[Query]) -> Query:
    parts = frozenset(parts)
    return True if True in parts or not parts else next(iter(parts)) if len(parts) == 1 else ("or", parts)


def _of_strings(strings: set[str]) -> Query:
    return _either([_both([s[i : i + 3] for i in range(len(s) - 2)]) for s in strings])


@dataclass
class _Known:
    """What is known of a part's matches: all of them (`exact`), or how they start and end and what else they must hold."""

    exact: set[str] | None
    start: set[str]
    end: set[str]
    must: Query = True

    def query(self) -> Query:
        return _both([self.must, _of_strings(self.exact)]) if self.exact is not None else self.must

    def opened(self) -> _Known:
        return self if self.exact is None else _Known(None, self.exact, self.exact, self.query())


_NOTHING = {""}


def _anything() -> _Known:
    return _Known(None, _NOTHING, _NOTHING)


def _ends(a: set[str], b: set[str], of: slice) -> set[str]:
    joined = {x + y for x, y in product(a, b)}
    return joined if len(joined) <= MOST_STRINGS else {s[of] for s in joined} if len({s[of] for s in joined}) <= MOST_STRINGS else _NOTHING


def _then(a: _Known, b: _Known) -> _Known:
    if a.exact is not None and b.exact is not None and len(a.exact) * len(b.exact) <= MOST_STRINGS:
        return _Known({x + y for x, y in product(a.exact, b.exact)}, _NOTHING, _NOTHING, _both([a.must, b.must]))
    left, right = a.opened(), b.opened()
    seam = {x[-2:] + y[:2] for x, y in product(left.end, right.start)}
    start = _ends(a.exact, right.start, slice(0, 3)) if a.exact is not None else left.start
    end = _ends(left.end, b.exact, slice(-3, None)) if b.exact is not None else right.end
    return _Known(None, start, end, _both([left.must, right.must, _of_strings(seam) if len(seam) <= MOST_STRINGS else True]))


def _or(parts: list[_Known]) -> _Known:
    if all(p.exact is not None for p in parts) and sum(len(p.exact) for p in parts) <= MOST_STRINGS:
        return _Known(set().union(*(p.exact for p in parts)), _NOTHING, _NOTHING, _either([p.must for p in parts]))
    parts = [p.opened() for p in parts]
    return _Known(None, set().union(*(p.start for p in parts)), set().union(*(p.end for p in parts)), _either([p.must for p in parts]))


def _sequence(nodes) -> _Known:
    known = _Known({""}, _NOTHING, _NOTHING)
    for kind, value in nodes:
        known = _then(known, _part(str(kind), value))
    return known


def _part(kind: str, value) -> _Known:
    if kind == "LITERAL":
        c = chr(value).lower()
        return _Known({c}, _NOTHING, _NOTHING) if value < 128 else _anything()
    if kind == "IN":
        if all(str(k) == "LITERAL" and v < 128 for k, v in value) and len(value) <= 8:
            return _Known({chr(v).lower() for _, v in value}, _NOTHING, _NOTHING)
        return _anything()
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        return _or([_sequence(nodes) for nodes in value[1]])
    if kind == "AT":
        return _Known({""}, _NOTHING, _NOTHING)
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        least, most, nodes = value
        inner = _sequence(nodes)
        known = _Known({""}, _NOTHING, _NOTHING)
        for _ in range(min(least, 8)):
            known = _then(known, inner)
        if (least, most) == (0, 1):
            return _or([known, inner])
        return known if least == most <= 8 else _then(known, _anything())
    return _anything()


def trigram_query(pattern: str) -> Query:
    """A condition on lower-case trigrams that every text with a match of `pattern` meets; True if there is none."""
    return _sequence(re._parser.parse(pattern)).query()


def trigrams_of(query: Query) -> set[str]:
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1])) if isinstance(query, tuple) else set()


def _code(trigram: str) -> int:
    return int.from_bytes(trigram.encode("ascii"), "big")


def postings(texts: pa.Array, wanted: set[str]) -> dict[str, np.ndarray]:
    """Trigram -> the sorted rows whose lower-cased text holds it, for the wanted trigrams of one block."""
    big = texts.cast(pa.large_string())
    offsets = np.frombuffer(big.buffers()[1], np.int64)[big.offset : big.offset + len(big) + 1]
    bytes_ = np.frombuffer(big.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    known = np.zeros(2**24, bool)
    known[[_code(t) for t in wanted]] = True
    rows, codes = [], []
    for first in range(0, max(len(bytes_) - 2, 0), 1 << 20):  # a piece at a time, to bound what is held beside the texts
        piece = lower[bytes_[first : first + (1 << 20) + 2]].astype(np.int32)
        code = piece[:-2] << 16 | piece[1:-1] << 8 | piece[2:]
        at = np.flatnonzero(known[code])
        row = np.searchsorted(offsets - offsets[0], at + first, "right") - 1
        inside = at + first + 3 <= offsets[row + 1] - offsets[0]
        rows.append(row[inside])
        codes.append(code[at[inside]])
    if not rows:
        return {t: np.empty(0, np.int64) for t in wanted}
    rows, codes = np.concatenate(rows), np.concatenate(codes)
    return {t: np.unique(rows[codes == _code(t)]) for t in wanted}


def matching_rows(query: Query, index: dict[str, np.ndarray], n: int) -> np.ndarray:
    """The rows of a block that meet a query: lists are intersected shortest first, and united."""
    if query is True:
        return np.arange(n)
    if isinstance(query, str):
        return index[query]
    parts = sorted((matching_rows(q, index, n) for q in query[1]), key=len)
    out = parts[0]
    for rows in parts[1:]:
        out = np.intersect1d(out, rows, assume_unique=True) if query[0] == "and" else np.union1d(out, rows)
    return out


def spans_in(texts: pa.Array, rules: Sequence[Rule]) -> list[list[tuple[int, int, str]]]:
    """Per text of a block (start, end, kind), by start and then in the order of the rules."""
    queries = [trigram_query(r.pattern) for r in rules]
    index = postings(texts, set().union(*map(trigrams_of, queries)))
    found: list[list] = [[] for _ in range(len(texts))]
    for order, (rule, query) in enumerate(zip(rules, queries)):
        search = re.compile(rule.pattern).finditer
        for row in matching_rows(query, index, len(texts)).tolist():
            found[row] += [(m.start(), order, m.end(), rule.kind) for m in search(texts[row].as_py()) if len(m[rule.group]) >= rule.least]
    return [[(start, end, kind) for start, _, end, kind in sorted(x)] for x in found]


SPANS = "array<struct<start: bigint, end: bigint, kind: string>>"


def secrets(text: Column | str, rules: Sequence[Rule] = RULES) -> Column:
    """The secrets of a text as an array of (start, end, kind)."""
    rules = tuple(rules)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    @F.arrow_udf(SPANS)
    def scan(texts: pa.Array) -> pa.Array:
        found = spans_in(texts.fill_null(""), rules)
        return pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in x] for x in found], kind)

    return scan(text)


def with_secrets(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with `secrets`."""
    return without(docs, "secrets").withColumn("secrets", secrets(text, rules))


@F.arrow_udf(StringType())
def _masked(texts: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for text, found in zip(texts.to_pylist(), spans.to_pylist()):
        parts, done = [], 0
        for s in sorted(found or [], key=lambda s: (s["start"], -s["end"])):
            if s["start"] >= done:
                parts += [text[done : s["start"]], f"[{s['kind']}]"]
            done = max(done, s["end"])
        out.append(text if text is None else "".join([*parts, text[done:]]))
    return pa.array(out, pa.string())


def masked(docs: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The documents with each secret replaced by its kind in brackets; documents without any stay as they are."""
    found = docs.withColumn("_secret_spans", secrets(text, rules))
    mask = F.when(F.size("_secret_spans") > 0, _masked(F.col(text), F.col("_secret_spans"))).otherwise(F.col(text))
    return found.withColumn(text, mask).drop("_secret_spans")
