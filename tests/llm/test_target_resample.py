from __future__ import annotations

import hashlib
import math
import random
import re
import zlib

import numpy as np

from shelfspark.llm import queries, target_resample
from tests.compare import compare, duck
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_features(text, least=1, most=1):
    words = plain_words(text)
    return [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def plain_resample(rows, targets, least=1, most=1, n_buckets=10_000, percent=10, least_words=20):
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = [0] * n_buckets, [0] * n_buckets
    for _, text in rows:
        for f in plain_features(text, least, most):
            s[bucket(f)] += 1
    for text in targets:
        for f in plain_features(text, least, most):
            t[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + n_buckets) / ((a + 1) * (sum(t) + n_buckets)))) for a, b in zip(s, t, strict=True)]
    out = []
    for d, text in rows:
        features = plain_features(text, least, most)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"2024:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(plain_words(text)), len(features), weight, score, None])
    able = sorted((x for x in out if x[1] >= least_words), key=lambda x: (-x[4], x[0] is None, x[0] or 0, -x[2]))
    for k, x in enumerate(able[: len(able) * percent // 100], start=1):
        x[5] = k
    return sorted(map(str, out))


def texts(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(60)] + ["Éa", "naïve", "中文", "x_y", "İ", "ß", "__", "a--b"]
    between = [" ", "\n", "  ", ", ", "\t", "-", ". "]
    return ["".join(rng.choice(vocabulary) + rng.choice(between) for _ in range(rng.choice([0, 1, 5, 25, 60]))) for _ in range(n)]


def test_spans_are_all_runs_of_words():
    pairs = target_resample.Buckets(1 << 30)
    for text in [*texts(200), "", " . ", "a", "a b", None]:
        for least, most in [(1, 1), (1, 3), (2, 2)]:
            want = [zlib.crc32(f.encode()) % (1 << 30) for f in plain_features(text, least, most)]
            assert target_resample.feature_buckets(target_resample.collapsed(text), least, most, pairs) == want


def test_gain_of_empty_counts():
    assert target_resample.gains(np.zeros(4, np.int64), np.zeros(4, np.int64)) == [0, 0, 0, 0]


def result(df):
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted(str([r[c] for c in columns]) for r in df.collect())


def test_rows_equal_brute_force(llm_spark):
    all_texts = texts(400)
    rows = list(enumerate(all_texts)) + [(None, all_texts[3]), (None, "lost " * 30), (None, None), (7, None), (9, ""), (9, "word " * 40_000)]
    targets = [*texts(20, seed=9), None, ""]
    docs = llm_spark.createDataFrame(rows, SCHEMA)
    target = llm_spark.createDataFrame([(t,) for t in targets], "text string")
    assert result(target_resample.resample(docs, target)) == plain_resample(rows, targets)
    wide = target_resample.resample(docs, target, lengths=(1, 2), n_buckets=97, percent=35, least_words=5)
    assert result(wide) == plain_resample(rows, targets, 1, 2, 97, 35, 5)
    none = target.limit(0)
    assert result(target_resample.resample(docs, none)) == plain_resample(rows, [])
    assert target_resample.resample(docs.limit(0), target).count() == 0


def test_ties_go_to_the_smaller_id_and_names_may_clash(llm_spark):
    clashing = ["row", "id", "s", "place", "out", "rank", "score", "bucket"]
    docs = llm_spark.createDataFrame([(5, "a " * 30), (2, "b " * 30)] * 4, SCHEMA).selectExpr("*", *[f"7 AS {c}" for c in clashing])
    out = target_resample.resample(docs, docs.select("text"), percent=100)
    assert out.columns == ["doc_id", "row", "id", "s", "place", "out", "bucket", "n_words", "n_features", "weight", "score", "rank"]
    got = sorted((r["rank"], r["doc_id"], r["score"]) for r in out.collect())
    assert [g[0] for g in got] == list(range(1, 9)) and len({g[1] for g in got[:4]}) == 1
    assert all(r[c] == 7 for r in out.collect() for c in ["row", "id", "s", "place", "out", "bucket"])


def test_query_equals_brute_force_and_sql(llm_spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    targets = [r.text for r in llm_spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    got = sorted(str([r.doc_id, r.n_features, r.weight, r.score, r["rank"]]) for r in queries.op11(llm_spark, SMALL).collect())
    want = plain_resample(rows, targets)
    assert got == sorted(str([x[0], *x[2:]]) for x in map(eval, want))
    assert compare(llm_spark, duck(SMALL), "op11", queries.op11, queries.OP11_SQL, SMALL) is None
