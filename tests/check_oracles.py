"""Compare every query with its SQL twin on one data folder.

python tests/check_oracles.py [sf_dir] [name ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402


def normal(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(repr(tuple(normal(r[i]) for i in order)) for r in rows)


def connect(sf_dir):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def compare(spark, con, sf_dir, name, fn, sql):
    df = fn(spark, sf_dir)
    got = rows_of(df.columns, df.collect())
    if sql is None:
        return True, f"{len(got)} rows (no SQL)"
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(rel.columns)}"
    if got != want:
        g, w = set(got), set(want)
        return False, f"{len(got)} vs {len(want)} rows; spark {sorted(g - w)[:2]} sql {sorted(w - g)[:2]}"
    return len(got) > 0, f"{len(got)} rows"


def main():
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    import __spark_entry__ as entry

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if names and not any(name.startswith(n) for n in names):
            continue
        t = time.time()
        try:
            ok, note = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as e:  # report and go on
            ok, note = False, f"{type(e).__name__}: {str(e)[:400]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - t:6.1f}s {note}", flush=True)
        if not ok:
            bad.append(name)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
