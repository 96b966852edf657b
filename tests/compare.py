"""Run queries on Spark and DuckDB and compare the rows.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def differences(spark, con, fn, sql, sf):
    """None when equal, else a short description."""
    df = fn(spark, sf)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    want_cols, want = [d[0] for d in cur.description], cur.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    types = dict(df.dtypes)
    kinds = {d[0]: str(d[1]) for d in cur.description}
    odd = {c: (types[c], kinds[c]) for c in got_cols if (types[c] in ("bigint", "int")) != (kinds[c] in ("BIGINT", "INTEGER", "NUMBER") or "INT" in kinds[c])}
    hugeint = {c: kinds[c] for c in want_cols if kinds[c] == "HUGEINT" or kinds[c].startswith("DECIMAL")}
    a, b = rows_of(got_cols, got), rows_of(want_cols, want)
    if a != b:
        only_a, only_b = list((a - b).items())[:3], list((b - a).items())[:3]
        return f"{sum((a - b).values())} rows differ\n    spark {only_a}\n    sql   {only_b}\n    types {odd}"
    if hugeint or odd:
        return f"types {hugeint} {odd}"
    return None


def main(argv=None) -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="/root/testdata/sf0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args(argv)
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as entry
    from lanlore.session import get_session

    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(args.sf)
    oracle, bad = entry.oracle_sql(), 0
    for name, fn in entry.queries().items():
        if args.names and not any(name.startswith(n) for n in args.names):
            continue
        start = time.time()
        try:
            if name in oracle:
                problem = differences(spark, con, fn, oracle[name], args.sf)
                note = "ok" if problem is None else f"DIFF {problem}"
            else:
                note = f"rows {fn(spark, args.sf).count()}"
        except Exception as error:  # noqa: BLE001
            note = "FAIL " + str(error)[:600]
        bad += note.startswith(("DIFF", "FAIL"))
        print(f"{name:45s} {time.time() - start:6.2f}s {note}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
