"""Run registered queries against their SQL in DuckDB and compare the results.

python tests/compare.py [--sf 0.001] [names...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def data_dir(sf: str) -> str:
    return f"/root/testdata/sf{sf}"


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(value):
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, int):
        return repr(float(value)) if abs(value) < 2**53 else repr(value)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def run(spark, con, name, fn, sql, sf_dir):
    """(ok, message, spark rows)"""
    t0 = time.time()
    df = fn(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return True, f"{len(got)} rows only, {took:.1f}s", len(got)
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(cols):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(cols, want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [x for x in a if x not in in_b][:3]
        only_b = [x for x in b if x not in in_a][:3]
        return False, f"{len(a)} vs {len(b)} rows; {sorted(cols)}\n  spark {only_a}\n  sql   {only_b}", len(got)
    return True, f"{len(got)} rows, {took:.1f}s", len(got)


def main(argv):
    sf = "0.001"
    if "--sf" in argv:
        i = argv.index("--sf")
        sf = argv[i + 1]
        argv = argv[:i] + argv[i + 2:]
    from tapeline.plans.catalog import load
    from tapeline.session import build_session

    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                          "spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = load()
    con = duck(data_dir(sf))
    bad = []
    for name in argv or queries:
        try:
            ok, msg, n = run(spark, con, name, queries[name], oracles.get(name), data_dir(sf))
        except Exception as exc:  # report and go on to the next query
            ok, msg, n = False, f"{type(exc).__name__}: {str(exc)[:900]}", 0
        print("ok  " if ok and n else "EMPTY" if ok else "FAIL", name, msg, flush=True)
        if not ok or not n:
            bad.append(name)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
