from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest

from shelfspark.llm import quality_crf as crf
from shelfspark.llm import queries, supervised
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, score string, quality int"
MEDIUM = "/root/testdata/sf0.01"


def enumerated(scores, field):
    total, good, stays = 0.0, np.zeros(len(scores)), np.zeros(2)
    for labels in itertools.product((0, 1), repeat=len(scores)):
        energy = sum(s for s, y in zip(scores, labels) if y) + field.first * labels[0]
        pairs = list(zip(labels, labels[1:]))
        both_bad, both_good = pairs.count((0, 0)), pairs.count((1, 1))
        weight = np.exp(energy + both_bad * field.stay[0] + both_good * field.stay[1])
        total += weight
        good += weight * np.array(labels)
        stays += weight * np.array([both_bad, both_good])
    return good / total, stays / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    for _ in range(20):
        field = crf.Field(rng.normal(size=len(crf.FEATURES)), rng.normal(size=2), float(rng.normal()))
        chains = [rng.normal(size=n) * 2 for n in (1, 2, 5, 7)]
        scores, sizes = crf._padded(chains)
        found, stays = crf.forward_backward(scores, sizes, field)
        want = [enumerated(c, field) for c in chains]
        for row, (good, _) in zip(found, want):
            assert row[: len(good)] == pytest.approx(good)
        assert stays == pytest.approx(sum(s for _, s in want))


def test_line_features_see_neighbours():
    rows = crf.line_features(["plain words here.", "BAD!! LINE!! NOW!!", "plain words here."])
    at = crf.FEATURES.index
    assert rows.shape == (3, len(crf.FEATURES)) and (rows >= 0).all() and (rows <= 1).all()
    assert rows[1, at("capitals")] == 1 == rows[0, at("after_capitals")] == rows[2, at("before_capitals")]
    assert [r[at("copy")] for r in rows] == [0, 0, 1]
    assert crf.line_features([]).shape == (0, len(crf.FEATURES))


def test_fit_finds_the_bad_lines_of_bad_documents():
    good, bad = "some quiet words of prose, and more.", "WIN!! BIG!! NOW!! ### $$$ |"
    texts = ["\n".join([good] * 4), "\n".join([good, good[5:]])] * 10 + ["\n".join([good, bad, bad, good])] * 10
    features = [crf.line_features(crf.lines_of(t)) for t in texts]
    field = crf.fit_field(features, [1] * 20 + [0] * 10)
    (found,) = crf.marginals([features[-1]], field)
    assert found[1] < 0.5 and found[2] < 0.5 and found[0] > found[1]
    assert crf.good_share(iter([None, "", " \n "]), field).tolist() == [0, 0, 0]
    assert crf.good_share(iter(["\n".join(f"line {i} of words." for i in range(3000))]), field)[0] > 0.5


def test_query_on_held_out_documents(llm_spark):
    out = {r.doc_id: r for r in queries.QUERIES["op5_line_field_quality"](llm_spark, MEDIUM).collect()}
    labels = llm_spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()
    assert len(out) == llm_spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    for r in out.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    unseen = [(x.quality, out[x.doc_id]) for x in labels if out[x.doc_id].held_out]
    assert sum(q == r.predicted for q, r in unseen) >= 0.95 * len(unseen)


def test_odd_rows_and_labels(llm_spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "one plain line of words."), (4, "one plain line of words."), (None, "x")]
    rows += [(5, "GO!! " * 40_000), (6, "SPAM!! SPAM!!\n" * 40), (7, "calm words in a line.\n" * 3)]
    docs = llm_spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    labels = llm_spark.createDataFrame(
        [(4, 1), (5, 0), (6, 0), (6, 0), (7, 1), (7, None), (None, 1)], "doc_id long, quality int"
    )
    out = crf.score(docs, labels).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert crf.score(docs.limit(0), labels).count() == 0
    assert {r.score for r in crf.score(docs, labels.limit(0)).collect()} == {0.5}
    kept = crf.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert all(r.doc_id is not None or r.text for r in kept.collect())


def test_sample_is_bounded_and_leaves_out_the_fold(llm_spark):
    docs = llm_spark.range(500).selectExpr("id AS doc_id", "'a b' AS text")
    labels = docs.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")
    sample = supervised.labelled_sample(docs, labels, "quality", 4, 2, 60, 20).collect()
    assert len(sample) == 60
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in sample)


def test_a_very_long_text_costs_memory_by_its_own_length():
    import tracemalloc

    field = crf.Field(np.linspace(-1, 1, len(crf.FEATURES)), np.array([0.4, 0.3]), 0.1)
    rng = np.random.default_rng(1)
    chains = [rng.random((n, len(crf.FEATURES))) for n in [1] * 300 + [50_000]]
    tracemalloc.start()
    found = crf.marginals(chains, field)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [len(f) for f in found] == [len(c) for c in chains]
    assert peak < 300 * 50_000  # bytes: some hundred a line, not a line for each of 300 texts
    for k in (0, 300):
        alone, _ = crf.forward_backward((chains[k] @ field.weights)[None, :], np.array([len(chains[k])]), field)
        assert np.allclose(alone[0], found[k])


def test_repeated_ids_are_one_row_of_the_sample(llm_spark):
    docs = llm_spark.createDataFrame([(1, f"text {i % 5}") for i in range(100)] + [(3, "b")], "doc_id long, text string")
    labels = llm_spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    sample = supervised.labelled_sample(docs, labels, "quality", 4, -1, 10, 1)
    assert sorted((r.doc_id, r.text, r.label) for r in sample.collect()) == [(1, "text 0", 1), (3, "b", 0)]
    assert sorted(r.shard for r in sample.collect()) == [0, 1]
