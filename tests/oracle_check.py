"""Run registered queries beside their SQL and compare all values.

    python tests/oracle_check.py [folder] [name prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as e

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float, decimal.Decimal)):
        return format(float(v), ".9g")
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def compare(spark, con, folder, name):
    """(message or None, rows, spark seconds, sql seconds)"""
    t = time.time()
    df = e.queries()[name](spark, folder)
    names, mine = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - t
    sql = e.oracle_sql().get(name)
    if sql is None:
        return None, len(mine), spent, 0.0
    t = time.time()
    cur = con.execute(sql)
    other_names, other = rows_of([d[0] for d in cur.description], cur.fetchall())
    took = time.time() - t
    if names != other_names:
        return f"columns {names} / {other_names}", len(mine), spent, took
    if mine != other:
        gone, extra = sorted(set(other) - set(mine)), sorted(set(mine) - set(other))
        return (f"{len(mine)} / {len(other)} rows; only spark {extra[:2]}; only sql {gone[:2]}",
                len(mine), spent, took)
    return None, len(mine), spent, took


if __name__ == "__main__":
    from veilspark.session import local_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.001"
    wanted = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(folder)
    bad = 0
    for name in e.queries():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        try:
            message, n, spent, took = compare(spark, con, folder, name)
        except Exception as error:  # keep going, show what broke
            message, n, spent, took = str(error)[:700], -1, 0.0, 0.0
        bad += message is not None
        print(f"{'ok ' if message is None else 'BAD'} {name:28} {n:7} {spent:6.2f}s {took:6.2f}s "
              f"{'' if name in e.oracle_sql() else '(no sql)'} {message or ''}"[:1500], flush=True)
    print("bad:", bad)
