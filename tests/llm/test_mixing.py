from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

from shelfspark.llm import mixing, queries
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, source string, size int, taken string"


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, free = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while free and left > 1e-9:
        share = left / sum(weight[s] for s in free)
        full = {s for s in free if target[s] + share * weight[s] > most * sizes[s]}
        for s in free - full:
            target[s] += share * weight[s]
        left -= share * sum(weight[s] for s in free - full)
        for s in full:
            left -= most * sizes[s] - target[s]
            target[s] = float(most * sizes[s])
        free -= full
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(rows, out, slack):
    by_source = defaultdict(int)
    for _, text, source in rows:
        by_source[source] += words(text)
    targets = plain_targets(by_source)
    assert Counter((d, words(t), s) for d, t, s in rows) == Counter((r.doc_id, r.size, r.source) for r in out)
    taken = defaultdict(int)
    for r in out:
        assert r.source_size == by_source[r.source]
        assert r.target == pytest.approx(targets[r.source], rel=1e-9, abs=1e-6)
        assert r.size == 0 or r.taken % r.size == 0
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in by_source:
        assert abs(taken[s] - targets[s]) <= slack, s


def test_query_meets_targets(llm_spark, small_docs):
    rows = [(r.doc_id, r.text, r.source) for r in small_docs.select("doc_id", "text", "source").collect()]
    out = queries.QUERIES["op8_mix_sources"](llm_spark, SMALL).collect()
    check(rows, out, slack=30)
    again = queries.QUERIES["op8_mix_sources"](llm_spark, SMALL).collect()
    assert Counter(map(tuple, out)) == Counter(map(tuple, again))


def test_many_buckets_and_hot_source(llm_spark, monkeypatch):
    monkeypatch.setattr(mixing, "FAN", 3)
    rng = random.Random(5)
    rows = [(i, "w " * rng.randint(1, 60), rng.choice(["a", "a", "a", "b", "ü", None])) for i in range(900)]
    docs = llm_spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    sized = mixing.mix_groups(docs)
    assert sized.count() == 900
    units = llm_spark.createDataFrame(
        [(0, str(i), rng.randint(1, 50), 0.4, 900) for i in range(900)],
        "source_no long, unit string, size long, prob double, n_units long",
    )
    flown = mixing.balanced_sample(units, bucket_rows=20).collect()
    assert Counter(r.unit for r in flown) == Counter(str(i) for i in range(900))
    assert {r.prob for r in flown} == {0.0, 1.0}
    assert abs(sum(r.prob for r in flown) - 360) <= 2
    assert abs(sum(r.prob * r.size for r in flown) - 0.4 * sum(r.size for r in flown)) <= 30
    check(rows, mixing.mix(docs).collect(), slack=30)


def test_odd_rows(llm_spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "a b c", "x"), (2, None, "y"), (3, "", None), (4, "one", None)]
    rows += [(None, "k " * 50_000, "z"), (None, "k", "z"), (5, "k", "")]
    docs = llm_spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    check(rows, mixing.mix(docs).collect(), slack=25_001)
    assert mixing.mix(docs.limit(0)).count() == 0
    blank = docs.filter("doc_id in (2, 3)")
    assert {r.taken for r in mixing.mix(blank).collect()} == {0}


def test_mixed_rows_follow_the_mix(llm_spark, small_docs):
    docs = small_docs.union(small_docs.limit(5))
    taken = defaultdict(int)
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    got = defaultdict(int)
    for r in mixed.collect():
        got[r.doc_id] += words(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(got)


def test_flight_keeps_totals():
    rng = random.Random(1)
    sizes = [rng.randint(1, 30) for _ in range(300)]
    probs = [rng.random() for _ in sizes]
    out = mixing.flight(probs, sizes, 7)
    assert sum(0 < p < 1 for p in out) <= 2
    assert sum(out) == pytest.approx(sum(probs))
    assert sum(p * s for p, s in zip(out, sizes)) == pytest.approx(sum(p * s for p, s in zip(probs, sizes)))
    landed = mixing.settled(probs, sizes, 7, land=True)
    assert set(landed) == {0.0, 1.0}
    assert abs(sum(x * s for x, s in zip(landed, sizes)) - sum(p * s for p, s in zip(probs, sizes))) <= 1
    assert mixing.settled([], [], 1, True) == []


@pytest.mark.parametrize("name", ["sf0.01", "sf0.1"])
def test_query_meets_targets_at_larger_sizes(llm_spark, name):
    folder = SMALL.replace("sf0.001", name)
    docs = llm_spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source")
    out = queries.QUERIES["op8_mix_sources"](llm_spark, folder).collect()
    check([tuple(r) for r in docs.collect()], out, slack=20)


def test_one_very_long_document(llm_spark):
    rng = random.Random(6)
    rows = [(i, "w " * rng.randint(150, 230), "a") for i in range(500)] + [(999, "w " * 60_000, "a")]
    rows += [(1000 + i, "w " * rng.randint(150, 230), "b") for i in range(2_500)] + [(5000, "w " * 40_000, "b")]
    docs = llm_spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)
    check(rows, mixing.mix(docs).collect(), slack=5)


def test_landing_covers_a_long_open_unit():
    sizes = [20_000, *range(100, 300)]
    wanted = 20_000 * 0.4 + sum(sizes[1:101])
    landed = mixing.landing([0.4, *[1.0] * 100, *[0.0] * 100], sizes, wanted)
    assert set(landed) == {0.0, 1.0}
    assert abs(sum(x * s for x, s in zip(landed, sizes, strict=True)) - wanted) <= 1
