"""Compares queries() with oracle_sql() on DuckDB: names, row counts, values."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from collections import Counter

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return con


def norm(value):
    if value is None or isinstance(value, (bool, str)):
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(norm(v) for v in value)
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(norm(r[i]) for i in order) for r in rows)


def compare(spark, name, run, sql, sf_dir, con=None):
    con = con or connect(sf_dir)
    start = time.time()
    df = run(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    spark_s = time.time() - start
    rel = con.sql(sql)
    cols = rel.columns
    want = rows_of(cols, rel.fetchall())
    duck_s = time.time() - start - spark_s
    problems = []
    if sorted(cols) != sorted(df.columns):
        problems.append(f"columns spark={sorted(df.columns)} oracle={sorted(cols)}")
    elif got != want:
        extra, missing = list((got - want).items())[:3], list((want - got).items())[:3]
        problems.append(f"{sum(got.values())} vs {sum(want.values())} rows\n  cols={sorted(cols)}\n  only spark: {extra}\n  only oracle: {missing}")
    return problems, sum(got.values()), spark_s, duck_s


def main(argv):
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as entry
    from vaxframe.plans.session import local_session

    sf_dir = f"/root/testdata/sf{argv[1]}"
    spark = local_session()
    runs, sqls = entry.queries(), entry.oracle_sql()
    con = connect(sf_dir)
    bad = 0
    for name in argv[2:] or runs:
        try:
            if name in sqls:
                problems, n, s, d = compare(spark, name, runs[name], sqls[name], sf_dir, con)
            else:
                start = time.time()
                n, problems, d = len(runs[name](spark, sf_dir).collect()), [], 0.0
                s = time.time() - start
        except Exception as err:  # report and go on with the next query
            problems, n, s, d = [f"{type(err).__name__}: {str(err)[:1500]}"], -1, 0.0, 0.0
        bad += bool(problems) or n == 0
        print(f"{'BAD ' if problems else 'EMPTY' if n == 0 else 'ok  '} {name:28s} rows={n:8d} spark={s:6.2f}s duck={d:5.2f}s"
              f"{'' if name in sqls else ' (rows only)'}", flush=True)
        for p in problems:
            print("   ", p, flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv)
