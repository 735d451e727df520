"""Compare registered queries with DuckDB: python -m tests.compare [name ...]."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    if hasattr(value, "tolist"):
        return norm(value.tolist())
    return value


def rows_of(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    out = sorted(repr(tuple(norm(r[i]) for i in order)) for r in data)
    return names, out


def compare(spark, name, query, sql, sf_dir) -> tuple[bool, str]:
    start = time.time()
    frame = query(spark, sf_dir)
    got = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    spark_s = time.time() - start
    if sql is None:
        return True, f"rows-only n={len(got[1])} spark={spark_s:.1f}s"
    start = time.time()
    con = duck(sf_dir)
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    note = f"n={len(got[1])}/{len(want[1])} spark={spark_s:.1f}s duckdb={time.time() - start:.1f}s"
    if got[0] != want[0]:
        return False, f"columns {got[0]} vs {want[0]}"
    if got[1] != want[1]:
        a = [r for r in got[1] if r not in set(want[1])][:2]
        b = [r for r in want[1] if r not in set(got[1])][:2]
        return False, note + "\n   spark:  " + "\n           ".join(x[:400] for x in a) + "\n   duckdb: " + "\n           ".join(x[:400] for x in b)
    return True, note


def main(names):
    from kbspark import catalog
    from kbspark.session import local_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = catalog.queries(), catalog.oracle_sql()
    failed = []
    for name in names or queries:
        try:
            ok, note = compare(spark, name, queries[name], oracles.get(name), sf_dir)
        except Exception as error:
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)


if __name__ == "__main__":
    main(sys.argv[1:])
