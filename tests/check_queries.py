"""Compare registered queries with their checking SQL: python tests/check_queries.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

from replyforge.plans.fixtures import TABLES


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, int):
        return repr(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    got_columns, got = table(df.columns, df.collect())
    answer = con.execute(sql)
    want_columns, want = table([d[0] for d in answer.description], answer.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} rows differ: {str(bad[0][0])[:400]} | {str(bad[0][1])[:400]}" if bad else None


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from replyforge.session import local_session

    args = sys.argv[1:]
    sf_dir = args.pop(0) if args and os.path.isdir(args[0]) else "/root/testdata/sf0.01"
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = duck(sf_dir), oracle_sql(), []
    for name, build in queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            df = build(spark, sf_dir)
            if name in sqls:
                problem, rows = compare(df, con, sqls[name]), ""
            else:
                problem, rows = None, f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s {problem or rows}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
