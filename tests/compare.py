"""Run registered queries next to their DuckDB oracles and compare order-insensitively."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb

TESTDATA = "/root/testdata"


timings: dict[str, float] = {}


def duck(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str)):
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (0.0 if value == 0 else value)
    if isinstance(value, (datetime.datetime, datetime.date)):
        return str(value)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return str(value)


def as_bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), Counter(tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows)


def compare(spark, con, name, query, sql, sf_dir):
    """None when equal, otherwise a short description of the difference."""
    start = time.time()
    df = query(spark, sf_dir)
    got_cols, got = as_bag(df.columns, [tuple(r) for r in df.collect()])
    timings[name] = time.time() - start
    if sql is None:
        return None if sum(got.values()) > 0 else "no rows"
    result = con.execute(sql)
    want_cols, want = as_bag([d[0] for d in result.description], result.fetchall())
    if got_cols != want_cols:
        return f"columns differ: {got_cols} / {want_cols}"
    if got != want:
        extra, lacking = list((got - want).items())[:2], list((want - got).items())[:2]
        return f"rows {sum(got.values())} / {sum(want.values())}\n   spark only {str(extra)[:900]}\n   sql only   {str(lacking)[:900]}"
    return None if sum(want.values()) > 0 else "no rows on either side"


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf_dir = f"{TESTDATA}/{argv[0]}" if argv else f"{TESTDATA}/sf0.01"
    wanted = argv[1:]
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    con, oracles, bad = duck(sf_dir), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, name, query, oracles.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        mark = "ok  " if problem is None else "BAD "
        print(f"{mark}{name} {time.time() - start:.2f}s (spark {timings.get(name, 0):.2f}s){'' if name in oracles else ' (rows only)'}", flush=True)
        if problem:
            print("   ", problem, flush=True)
    print(f"{bad} differing")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
