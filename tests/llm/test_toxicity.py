from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from shelfspark.llm import queries, toxicity

SCHEMA = "doc_id long, text string, score string, toxic int"
LARGE = "/root/testdata/sf0.1"


def plain_ftrl(documents, labels, passes):
    """The textbook update, one coordinate at a time."""
    z, n, bias = {}, {}, [0.0, 0.0, 0.0]
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2

    def weight(i):
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((b + n[i] ** 0.5) / a + l2)

    for _ in range(passes):
        for features, y in zip(documents, labels):
            w = {i: weight(i) for i in features}
            g = 1 / (1 + np.exp(-(sum(w.values()) + bias[2]))) - y
            for i in features:
                old = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / a * w[i]
                n[i] = old + g * g
            bias[0] += g - ((bias[1] + g * g) ** 0.5 - bias[1] ** 0.5) / a * bias[2]
            bias[1] += g * g
            bias[2] = -bias[0] / ((b + bias[1] ** 0.5) / a)
    return {i: weight(i) for i in z if weight(i)}, bias[2]


def test_updates_equal_the_plain_form():
    rng = random.Random(3)
    documents = [np.array(sorted(rng.sample(range(40), rng.randint(1, 12)))) for _ in range(150)]
    labels = [int(3 in d or 7 in d) for d in documents]
    model = toxicity.fit_ftrl(documents, labels, passes=3, bits=6)
    want, bias = plain_ftrl([d.tolist() for d in documents], labels, 3)
    assert dict(zip(model.index.tolist(), model.value)) == pytest.approx(want)
    assert model.bias == pytest.approx(bias)
    assert len(want) < 40


def test_features_hold_words_pairs_and_skips():
    h = toxicity.Hasher()
    assert len(h.features(None)) == len(h.features("")) == len(h.features(" ,.!")) == 0
    assert len(h.features("One two, THREE four")) == 4 + 3 + 2 + 1
    assert set(h.features("a b c")) & set(h.features("A x C")) >= set(h.features("a")) | set(h.features("c"))
    assert h.features("w " * 100_000).max() < 1 << toxicity.BITS


def test_query_finds_held_out_toxic_documents(llm_spark):
    out = {r.doc_id: r for r in queries.QUERIES["op10_ftrl_toxicity"](llm_spark, LARGE).collect()}
    assert len(out) == llm_spark.read.parquet(f"{LARGE}/documents.parquet").count()
    for r in out.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    labels = [(x.toxic, out[x.doc_id]) for x in llm_spark.read.parquet(f"{LARGE}/labels.parquet").collect()]
    toxic = [r.predicted for y, r in labels if y and r.held_out]
    clean = [r.predicted for y, r in labels if not y and r.held_out]
    assert sum(toxic) >= 0.75 * len(toxic)
    assert sum(clean) <= 0.01 * len(clean)


def test_odd_rows_and_labels(llm_spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "you fool"), (4, "you fool"), (None, "you fool"), (5, "word " * 60_000)]
    docs = llm_spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    labels = llm_spark.createDataFrame([(4, 1), (4, 0), (5, 0), (1, None), (None, 1)], "doc_id long, toxic int")
    out = toxicity.score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in toxicity.score(docs, labels.limit(0)).collect()} == {0.5}
