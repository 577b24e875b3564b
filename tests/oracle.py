"""Runs named queries next to their SQL twins: ``python tests/oracle.py [sf] [name ...]``."""

import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
DATA = os.environ.get("TESTDATA", "/root/testdata")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET threads=8")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return str(v)


def compare(spark, con, name, query, sql, sf_dir):
    """None when rows, columns and values agree, else what differs."""
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    cols = df.columns
    if sql is None:
        return None if got or cols else "nothing"
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    if sorted(cols) != sorted(want_cols):
        return f"columns {sorted(cols)} != {sorted(want_cols)}"
    order = sorted(cols)
    a = sorted(tuple(norm(r[cols.index(c)]) for c in order) for r in got)
    b = sorted(tuple(norm(r[want_cols.index(c)]) for c in order) for r in want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None


if __name__ == "__main__":
    from threadloom.plans import load_catalog
    from threadloom.session import local_session

    sf, names = sys.argv[1] if len(sys.argv) > 1 else "0.01", sys.argv[2:]
    queries, oracles = load_catalog()
    spark = local_session("oracle")
    spark.sparkContext.setLogLevel("ERROR")
    sf_dir = f"{DATA}/sf{sf}"
    con = connect(sf_dir)
    bad = 0
    for name, query in queries.items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__} {str(e)[:700]}"
        bad += problem is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if problem is None else 'BAD'} {kind:4} {time.time() - start:6.1f}s {name} {problem or ''}", flush=True)
    print("bad:", bad)
