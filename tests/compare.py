"""Run registered queries beside their SQL texts and compare whole results.

    python tests/compare.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET threads TO 8")
    for name in TABLES:
        if Path(f"{folder}/{name}.parquet").exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def family(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, dt.datetime):
        return "timestamp"
    if isinstance(value, dt.date):
        return "date"
    return type(value).__name__


def canonical(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "~"
    if isinstance(value, float):
        return f"{value + 0.0:.9g}"
    return str(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = sorted(tuple(canonical(r[i]) for i in order) for r in rows)
    kinds = {names[i]: {family(r[i]) for r in rows} - {None} for i in order}
    return [names[i] for i in order], out, kinds


def compare(spark, con, folder, name, queries, oracles):
    """(status, detail) of one query."""
    t0 = time.time()
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    t1 = time.time()
    names, left, kinds = rows_of(df.columns, got)
    if name not in oracles:
        return ("ROWS" if left else "EMPTY"), f"{len(left)} rows", t1 - t0, 0.0
    cur = con.execute(oracles[name])
    want = cur.fetchall()
    wnames, right, wkinds = rows_of([d[0] for d in cur.description], want)
    took = time.time() - t1
    if names != wnames:
        return "COLUMNS", f"{sorted(set(names) ^ set(wnames))}", t1 - t0, took
    if len(left) != len(right):
        return "COUNT", f"spark {len(left)} sql {len(right)}", t1 - t0, took
    bad = [c for c in names if kinds[c] and wkinds[c] and kinds[c] != wkinds[c]]
    if left != right:
        a, b = set(left) - set(right), set(right) - set(left)
        x, y = sorted(a)[:1], sorted(b)[:1]
        diff = [(n, p, q) for n, p, q in zip(names, x[0], y[0]) if p != q] if x and y else (x, y)
        return "VALUES", f"{len(a)} differ: {diff}", t1 - t0, took
    if bad:
        return "TYPES", f"{[(c, kinds[c], wkinds[c]) for c in bad]}", t1 - t0, took
    return ("OK" if left else "OK-EMPTY"), f"{len(left)} rows", t1 - t0, took


def main(folder: str, prefixes: list[str]) -> int:
    import __spark_entry__ as entry
    from demandloom.session import local_session

    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = local_session(cores=8), connect(folder)
    failed = 0
    for name in queries:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            status, detail, a, b = compare(spark, con, folder, name, queries, oracles)
        except Exception as error:  # noqa: BLE001 - report and go on
            status, detail, a, b = "ERROR", str(error).split("\n\nJVM")[0][:600], 0.0, 0.0
        failed += status not in ("OK", "ROWS")
        print(f"{status:8} {name:34} spark {a:6.2f}s sql {b:6.2f}s  {detail}", flush=True)
    print(f"not ok: {failed}")
    return failed


if __name__ == "__main__":
    args = sys.argv[1:]
    where = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.001"
    sys.exit(1 if main(where, [a for a in args if not a.startswith("/")]) else 0)
