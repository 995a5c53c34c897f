"""Compare each query with its SQL counterpart: columns, row count and values.

    python tests/compare.py sf0.01 [name …]
"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{round(v, 6) + 0.0:.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a sentence saying what differs."""
    df = fn(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} vs {want_cols}"
    if got == want:
        return None if got else "EMPTY on both sides"
    a, b = set(got), set(want)
    return (f"{len(got)} vs {len(want)} rows; only spark {len(a - b)} {sorted(a - b)[:2]}; "
            f"only sql {len(b - a)} {sorted(b - a)[:2]}")


def main():
    import __spark_entry__ as entry
    from tallywise.session import local_session
    sf = sys.argv[1] if len(sys.argv) > 1 else "sf0.01"
    sf_dir = f"/root/testdata/{sf}"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    q, o = entry.queries(), entry.oracle_sql()
    names = [n for n in q if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    bad = 0
    for n in names:
        t = time.time()
        try:
            problem = compare(spark, con, n, q[n], o.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:700]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - t:5.1f}s {n}"
              f"{'' if n in o else ' (rows only)'} {problem or ''}", flush=True)
    print(f"{len(names) - bad}/{len(names)} agree")


if __name__ == "__main__":
    main()
