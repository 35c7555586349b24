"""The split forms of the building blocks agree with the plain ones, with one hot key."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfspark.operators import skew


def _rows(spark):
    rng = random.Random(3)
    data, order = [], 0
    for _ in range(600):
        order += rng.randint(1, 9)
        key = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", "c", None])
        data.append((key, order, rng.choice(["x", "y", None])))
    return data, spark.createDataFrame(data, "k string, o long, v string")


def test_numbered_split_equals_plain(spark):
    data, df = _rows(spark)
    split = skew.numbered(df, ["k"], ["o"], "n", max_group=0, rows=20)
    plain = skew.numbered(df, ["k"], ["o"], "n")
    assert sorted(map(str, split.collect())) == sorted(map(str, plain.collect()))
    whole = skew.numbered(df, [], ["o"], "n").orderBy("o").collect()
    assert [r["n"] for r in whole] == list(range(1, len(data) + 1))


def test_carry_forward_split_equals_plain(spark):
    data, df = _rows(spark)
    split = skew.carry_forward(df, ["k"], ["o"], F.col("v"), "seen", max_group=0, rows=20)
    last, want = {}, {}
    for k, o, v in sorted(data, key=lambda d: d[1]):
        want[o] = last.get(k)
        last[k] = v if v is not None else last.get(k)
    plain = skew.carry_forward(df, ["k"], ["o"], F.col("v"), "seen")
    assert {r["o"]: r["seen"] for r in split.collect()} == want == {r["o"]: r["seen"] for r in plain.collect()}


def test_nest_in_parts_keeps_every_item_in_order(spark):
    data, df = _rows(spark)
    nested = skew.nest_in_parts(df, ["k"], ["o"], F.col("o"), "items", part_size=50)
    got: dict = {}
    for r in nested.orderBy("k", "part").collect():
        assert len(r["items"]) <= 50
        got.setdefault(r["k"], []).extend(r["items"])
    for key in {d[0] for d in data}:
        assert got[key] == sorted(d[1] for d in data if d[0] == key)


def test_bounded_rows_tells_large_tables_apart(spark):
    assert len(skew.bounded_rows(spark.range(5), 5)) == 5
    assert skew.bounded_rows(spark.range(6), 5) is None


def test_global_numbers_follow_the_order(spark):
    data, df = _rows(spark)
    for partitions in (1, 7):
        got = skew.globally_numbered(df.repartition(partitions), [F.desc_nulls_last("k"), "o"], "n").orderBy("n").collect()
        assert [r["n"] for r in got] == list(range(1, len(data) + 1))
        hot, rest = [r for r in got if r["k"] is not None], [r for r in got if r["k"] is None]
        assert [r["n"] for r in rest] == list(range(len(hot) + 1, len(data) + 1))
        assert [(r["k"], -r["o"]) for r in hot] == sorted(((r["k"], -r["o"]) for r in hot), reverse=True)
    assert skew.globally_numbered(df.limit(0), ["o"], "n").collect() == []


def test_cut_points_bound_buckets_whatever_the_values(spark):
    rng = random.Random(9)
    spread = {"small": lambda i: i, "sparse": lambda i: i * 10**9, "bent": lambda i: 1.5**i if i < 60 else 10**12 + i, "nulls": lambda i: None if i % 50 == 0 else i}
    for name, value in spread.items():
        rows = [("hot", value(i) if value(i) is None else int(value(i)), i) for i in range(3000)] + [(rng.choice("ab"), i, i) for i in range(100)]
        df = spark.createDataFrame(rows, "k string, o long, tie long")
        cut = skew.in_order_buckets(df, ["k"], ["o", "tie"], rows=100)
        sizes = {(r["k"], r["_bucket"]): r["count"] for r in cut.groupBy("k", "_bucket").count().collect()}
        assert len(sizes) > 12 and max(sizes.values()) < 1200, name
        assert [r for r in sizes if r[0] != "hot"] and all(b == 0 for k, b in sizes if k != "hot")
        ordered = cut.filter("k = 'hot'").orderBy(F.asc_nulls_first("o"), "tie").collect()
        assert [r["_bucket"] for r in ordered] == sorted(r["_bucket"] for r in ordered)
