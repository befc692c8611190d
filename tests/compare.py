"""Run a registered query and its SQL twin and compare the values."""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "is_integer") or type(v).__name__ == "Decimal":
        v = float(v)
        return None if math.isnan(v) else (int(v) if v.is_integer() else v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)


def check(spark, con, name, query, sql, sf_dir, verbose=False):
    t = time.time()
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    took = time.time() - t
    if sql is None:
        return True, f"{name}: {len(got[1])} rows, no sql, {took:.1f}s"
    res = con.execute(sql)
    want = rows_of([c[0] for c in res.description], res.fetchall())
    ok = got == want
    note = f"{name}: {len(got[1])} rows, {took:.1f}s {'ok' if ok else 'DIFF'}"
    if not ok:
        if got[0] != want[0]:
            note += f" columns {got[0]} vs {want[0]}"
        else:
            a, b = set(map(repr, got[1])), set(map(repr, want[1]))
            note += f" {len(want[1])} expected; spark only {sorted(a - b)[:3]}; sql only {sorted(b - a)[:3]}"
    return ok, note


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    import __spark_entry__ as entry
    from cotejo.session import local_session

    sf = sys.argv[1]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    queries, oracle = entry.queries(), entry.oracle_sql()
    wanted = sys.argv[2:] or list(queries)
    bad = 0
    for name in wanted:
        try:
            ok, note = check(spark, con, name, queries[name], oracle.get(name), sf_dir)
        except Exception as e:  # report and go on with the next query
            ok, note = False, f"{name}: ERROR {str(e)[:600]}"
        bad += not ok
        print(note, flush=True)
    print("failed", bad, "of", len(wanted))
