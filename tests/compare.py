"""Runs registered queries and their SQL side by side: ``python tests/compare.py SF_DIR [NAME...]``."""

from __future__ import annotations

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def views(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(os.listdir(sf)):
        if f.endswith(".parquet"):
            at = f"{sf}/{f}/*.parquet" if os.path.isdir(f"{sf}/{f}") else f"{sf}/{f}"
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{at}')")
    return con


def _cell(v):
    if v is None:
        return "\0null"
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, list):
        return "[" + ",".join(map(_cell, v)) + "]"
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differs(spark, con, query, sql: str, sf: str) -> str:
    """Empty if both give the same columns and rows, else what differs."""
    got = query(spark, sf)
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    if sorted(got.columns) != sorted(names):
        return f"columns {sorted(got.columns)} and {sorted(names)}"
    a, b = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
    if a == b:
        return ""
    only_a, only_b = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; only Spark {only_a}; only SQL {only_b}"


def main(sf: str, names: list[str]) -> int:
    import __spark_entry__ as entry

    from verslog.session import local_session

    spark, con, bad = local_session(), views(sf), 0
    queries, oracle = entry.queries(), entry.oracle_sql()
    for name in names or queries:
        began = time.time()
        try:
            said = differs(spark, con, queries[name], oracle[name], sf) if name in oracle else f"no SQL, {queries[name](spark, sf).count()} rows"
        except Exception as e:
            said = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(said) and name in oracle
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
