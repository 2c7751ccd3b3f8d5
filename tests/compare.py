"""Runs queries beside their SQL: ``python tests/compare.py FOLDER [NAME...]``."""

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def connection(folder):
    con = duckdb.connect()
    for f in sorted(os.listdir(folder)):
        path = f"{folder}/{f}" + ("/*.parquet" if os.path.isdir(f"{folder}/{f}") else "")
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])

    def cell(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return str(v) if v is not None else "~"

    return sorted(tuple(cell(r[k]) for k in order) for r in rows), [names[k] for k in order]


def difference(spark, con, name, function, sql, folder):
    """None if equal, else what differs."""
    df = function(spark, folder)
    mine, columns = canonical(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    other, others = canonical([c[0] for c in result.description], result.fetchall())
    if columns != others:
        return f"columns {columns} {others}"
    if mine != other:
        a, b = set(mine), set(other)
        return f"rows {len(mine)} {len(other)}; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
    types = {t for _, t in df.dtypes}
    return None if len(mine) or types else "empty"


if __name__ == "__main__":
    from veilmark.session import local_session

    import __spark_entry__ as entry

    folder, names = sys.argv[1], sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connection(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, function in entry.queries().items():
        if names and name not in names or name not in sql:
            continue
        at = time.time()
        try:
            found = difference(spark, con, name, function, sql[name], folder)
        except Exception as e:  # noqa: BLE001
            found = f"{type(e).__name__}: {str(e)[:600]}"
        bad += found is not None
        print(f"{'ok ' if found is None else 'BAD'} {name} {time.time() - at:.1f}s" + (f" {found}" if found else ""), flush=True)
    print("bad", bad)
