from __future__ import annotations

import math
import random
from collections import Counter

from shelfspark.llm import queries, topk
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, rank string, score int"


def plain(rows, every, k):
    good = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for i, v in good if i % every == 0), default=0)
    out = Counter()
    for i, v in good:
        if i % every == 0:
            found = sorted((-sum(a * b for a, b in zip(v, c[:width])), j) for j, c in good if j != i)
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(found[:k]))
    return out


def run(spark, rows, every, k, **options):
    table = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], SCHEMA)
    return Counter(tuple(r) for r in topk.top_k(table, every, k, **options).collect())


def test_query_equals_brute_force(llm_spark):
    rows = [(r.vec_id, r.embedding) for r in llm_spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    got = queries.QUERIES["op6_exact_top_k"](llm_spark, SMALL)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, 50, 5)


def test_ties_blocks_and_wide_scores(llm_spark):
    rng = random.Random(1)
    rows = [(i, [float(rng.randint(-2, 2)) for _ in range(3)]) for i in range(300)]
    assert run(llm_spark, rows, 7, 4) == plain(rows, 7, 4)
    assert run(llm_spark, rows, 7, 4, block_bytes=200) == plain(rows, 7, 4)
    wide = [(i, [rng.uniform(-9000, 9000) for _ in range(4)]) for i in range(120)]
    wide = [(i, [float(int(x)) for x in v]) for i, v in wide]
    assert run(llm_spark, wide, 10, 5) == plain(wide, 10, 5)
    same = [(i, [1.0, 0.5]) for i in range(200)]
    assert run(llm_spark, same, 50, 5) == plain(same, 50, 5)


def test_odd_rows(llm_spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [nan, 1.0]), (3, [1.0, None]), (4, [inf, 0.0]), (5, []), (None, [9.0, 9.0])]
    rows += [(6, [0.5]), (7, [1.0, 1.0, 7.0]), (10, [0.0, 0.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0]), (0, [1.0, 2.0])]
    assert run(llm_spark, rows, 5, 3) == plain(rows, 5, 3)
    assert run(llm_spark, rows, 5, 100) == plain(rows, 5, 100)
    assert run(llm_spark, rows, 1000, 3) == plain(rows, 1000, 3)
    assert run(llm_spark, [], 5, 3) == Counter()
    assert run(llm_spark, [(1, [1.0])], 5, 3) == run(llm_spark, [(5, [1.0])], 5, 3) == Counter()
