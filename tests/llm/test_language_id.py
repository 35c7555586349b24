from __future__ import annotations

import itertools
import zlib

import numpy as np
import pandas as pd
import pytest

from shelfspark.llm import language_id as lid
from shelfspark.llm import queries

SCHEMA = "doc_id long, text string, lang string, score int"
MEDIUM = "/root/testdata/sf0.01"

EN = "the quick brown fox jumps over the lazy dog and then with that there"
DE = "der schnelle braune fuchs springt über den faulen hund und nicht ohne"
RU = "быстрая коричневая лиса прыгает через ленивую собаку и потом"


@pytest.fixture(scope="module")
def train_rows():
    return [(100 + i, f"{t} {i}", lang, 1) for i in range(40) for t, lang in ((EN, "en"), (DE, "de"), (RU, "ru"))]


def value(scores, path, switch):
    return sum(scores[i][k] for i, k in enumerate(path)) - switch * sum(a != b for a, b in zip(path, path[1:]))


def test_path_is_best_of_all():
    rng = np.random.default_rng(2)
    for trial in range(150):
        n, k = int(rng.integers(1, 7)), 3
        scores = -rng.random((n, k)) * rng.choice([0.5, 3.0])
        switch = float(rng.choice([0.2, 1.0, 2.5]))
        best = max(value(scores, p, switch) for p in itertools.product(range(k), repeat=n))
        assert value(scores, lid.best_path(scores, switch).tolist(), switch) == pytest.approx(best), trial


def test_two_languages_beat_a_third_that_is_never_best():
    half = np.array([[0.0, -4.0, -1.9]] * 5)
    scores = np.vstack([half, half[:, [1, 0, 2]]])
    assert lid.best_path(scores, 12.0).tolist() == [0] * 5 + [1] * 5
    rng = np.random.default_rng(8)
    for _ in range(60):
        scores = -np.abs(rng.normal(size=(8, 3))) * [1.0, 1.0, 0.5]
        switch = float(rng.choice([0.5, 1.0, 2.0, 4.0]))
        best = max(value(scores, p, switch) for p in itertools.product(range(3), repeat=8))
        assert value(scores, lid.best_path(scores, switch).tolist(), switch) == pytest.approx(best)


def test_ngrams_stay_inside_words():
    one, owner = lid.grams(["ab", "c"])
    assert sorted(one[owner == 1].tolist()) == sorted(lid.grams(["c"])[0].tolist())
    assert len(one[owner == 0]) == 4 + 3 + 2 + 1
    assert lid.scripts_of(["abc", "ж", "中", "ü"]).tolist() == [lid.SCRIPTS.index(x) for x in ("Latin", "Cyrillic", "Han", "Latin")]


def test_scripts_narrow_the_languages():
    counts = [("en", "script", lid.SCRIPTS.index("Latin"), 100), ("ru", "script", lid.SCRIPTS.index("Cyrillic"), 90)]
    counts += [("ru", "script", lid.SCRIPTS.index("Latin"), 10), ("en", "gram", 1, 5), ("ru", "gram", 2, 5)]
    model = lid.fit(pd.DataFrame(counts, columns=["lang", "kind", "at", "n"]))
    assert model.languages == ["en", "ru"]
    assert model.allowed[lid.SCRIPTS.index("Cyrillic")].tolist() == [False, True]
    assert model.allowed[lid.SCRIPTS.index("Latin")].all() and model.allowed[lid.SCRIPTS.index("Thai")].all()
    assert lid.word_scores(["жук"], model).tolist() == [[lid.LEAST_SCORE, 0.0]]


def test_spans_of_mixed_text(llm_spark, train_rows):
    docs = llm_spark.createDataFrame(train_rows, SCHEMA)
    model = lid.train(docs)
    mixed = llm_spark.createDataFrame([(1, f"{EN}. {DE}! {RU}", None, 1), (2, None, None, 1), (3, "12 !", None, 1)], SCHEMA)
    rows = {r.doc_id: r.s for r in mixed.select("doc_id", lid.spans(mixed.text, model).alias("s")).collect()}
    assert [(s.start, s.end, s.lang) for s in rows[1]] == [
        (0, len(EN), "en"), (len(EN) + 2, len(EN + DE) + 2, "de"), (len(EN + DE) + 4, len(EN + DE + RU) + 4, "ru")
    ]
    assert rows[2] == rows[3] == []


def test_odd_rows(llm_spark, train_rows):
    rows = [(1, None, "en", 1), (2, "", None, 1), (3, " 12 -- \n", "de", 1), (4, DE, None, 1), (4, DE, None, 1)]
    rows += [(None, EN, "ru", 1), (5, "ไทย", None, 1), (6, (EN + "\n") * 5000, None, 1), (7, RU, "ru", 1)]
    docs = llm_spark.createDataFrame(train_rows + rows, SCHEMA)
    out = [r for r in lid.identify(docs).collect() if r.doc_id is None or r.doc_id < 100]
    got = sorted(((r.doc_id or 0, r.lang_pred) for r in out))
    assert got[:5] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (4, "de")]
    assert [x for d, x in got if d in (6, 7)] == ["en", "ru"] and len(out) == len(rows)
    assert all(x in ("en", "de", "ru") for d, x in got if d == 5)
    assert all(0 <= r.score <= 1 for r in out)
    assert lid.identify(docs.limit(0)).count() == 0
    bare = lid.identify(docs.selectExpr("doc_id", "text", "cast(null AS string) AS lang")).collect()
    assert {r.lang_pred for r in bare} == {"und"}


def test_query_on_held_out_documents(llm_spark):
    docs = {r.doc_id: r.lang for r in llm_spark.read.parquet(f"{MEDIUM}/documents.parquet").collect()}
    out = queries.QUERIES["op1_language_id"](llm_spark, MEDIUM).collect()
    assert {r.doc_id for r in out} == set(docs) and len(out) == len(docs)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in out if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id] for r in unseen) >= 0.98 * len(unseen)
