"""Compare registered queries with their SQL in an in-process database."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def spark_rows(df):
    order = sorted(df.columns)
    return order, Counter(tuple(plain(v) for v in row) for row in df.select(*order).collect())


def oracle_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    idx = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in idx], Counter(tuple(plain(row[i]) for i in idx) for row in cur.fetchall())


def compare(spark, con, fn, sql, sf_dir):
    names, got = spark_rows(fn(spark, sf_dir))
    want_names, want = oracle_rows(con, sql)
    assert names == want_names, f"columns {names} != {want_names}"
    extra, lacking = got - want, want - got
    assert got == want, (
        f"rows {sum(got.values())} != {sum(want.values())}; extra {list(extra.items())[:3]}; "
        f"lacking {list(lacking.items())[:3]}"
    )
    return sum(got.values())


if __name__ == "__main__":
    sys.path.insert(0, __file__.rsplit("/", 2)[0])
    from __spark_entry__ import oracle_sql, queries
    from pharmalith.session import build_session

    sf = sys.argv[1]
    names = sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    bad = 0
    for key, fn in queries().items():
        if names and key not in names:
            continue
        start = time.time()
        try:
            if key in oracle_sql():
                n = compare(spark, con, fn, oracle_sql()[key], sf)
                print(f"ok   {key:32s} {n:8d} rows {time.time() - start:6.2f} s", flush=True)
            else:
                n = fn(spark, sf).count()
                print(f"rows {key:32s} {n:8d} rows {time.time() - start:6.2f} s", flush=True)
        except Exception as e:  # report and go on
            bad += 1
            print(f"FAIL {key}: {str(e)[:1200]}", flush=True)
    print("failed:", bad)
