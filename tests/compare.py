"""Run registered queries next to their SQL and report differences.

Usage: python tests/compare.py FOLDER [name ...]
"""

import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def canonical(value):
    if isinstance(value, bool) or value is None:
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        value = float(value)
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return str(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def connect(folder):
    con = duckdb.connect()
    for name in os.listdir(folder):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{folder}/{name}'")
    return con


def compare(spark, con, folder, name, fn, sql):
    df = fn(spark, folder)
    got = normal(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None, len(got[1]), None
    cur = con.execute(sql)
    want = normal([c[0] for c in cur.description], cur.fetchall())
    if got == want:
        return True, len(got[1]), None
    if got[0] != want[0]:
        return False, len(got[1]), f"columns {got[0]} vs {want[0]}"
    a, b = set(got[1]) - set(want[1]), set(want[1]) - set(got[1])
    return False, len(got[1]), f"rows {len(got[1])} vs {len(want[1])}; only here {sorted(a)[:2]}; only in SQL {sorted(b)[:2]}"


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries
    from cloakframe.session import local_session

    spark = local_session("compare", cpus=8)
    spark.sparkContext.setLogLevel("ERROR")
    folder, names = sys.argv[1], sys.argv[2:]
    con, sqls, bad = connect(folder), oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            ok, n, note = compare(spark, con, folder, name, fn, sqls.get(name))
        except Exception as error:  # noqa: BLE001
            ok, n, note = False, -1, str(error)[:600]
        print(f"{'rows' if ok is None else 'ok' if ok else 'BAD'} {name} {n} {time.time() - start:.1f}s {note or ''}", flush=True)
        if ok is False:
            bad.append(name)
    print("bad:", bad)
