from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.llm import pieces, queries
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string"
ODD = [
    "", " ", "  ", "\n", "\n\n", " \n", "\n ", " \n \n", "a", " a", "a ", "  a  b   ", "a\nb", "a \nb", "a\n b", "\n a\n\n  b \n",
    "a▁b", "▁", "▁▁\n▁", "x▁ ▁y", "\t a\t\tb\r\nc", "</s> <s> <unk> <0x41>", "a\x00b", "　x​",
    "中文 \U0001f469‍\U0001f4bb é ½ﬁ", "café naïve " * 3, "--- ... !!!", "http://a.example/?q=1&b=2",
]


@pytest.fixture(scope="module")
def model():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=queries.PIECES)


def random_texts(n, seed=3):
    rng = random.Random(seed)
    letters = " \n▁ab.,é中\U0001f600\tStheing01"
    return ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


def test_chunks_give_the_ids_of_the_whole_text(model):
    cutter = pieces.cutter(queries.PIECES)
    assert cutter.cuts
    for text in ODD + random_texts(5000):
        chunks = cutter.cut(text)
        assert [i for ids in cutter.ids(chunks) for i in ids] == model.encode(text), text


@pytest.mark.parametrize(("max_hot", "sample"), [(0, 10), (40, pieces.SAMPLE), (pieces.MAX_HOT, 60), (pieces.MAX_HOT, pieces.SAMPLE)])
def test_ids_and_texts_equal_the_library(llm_spark, model, max_hot, sample):
    texts = ODD + random_texts(300) + ["long " * 20_000, "x" * 30_000, "a b " * 5000 + "\n" * 200]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, None), (None, "a b"), (None, None), (5, "a \nb"), (5, "a \nb")]
    rows += [(k, "copied text with q" + "z" * 90 + " in it") for k in range(50)]
    docs = llm_spark.createDataFrame(rows, SCHEMA)
    out = pieces.encode(docs, queries.PIECES, max_hot=max_hot, sample=sample).withColumn("back", pieces.decode(F.col("ids"), queries.PIECES))
    want = []
    for d, t in rows:
        ids = model.encode(t or "", add_eos=True)
        want.append((str(d), ids, model.decode(ids)))
    assert sorted((str(r.doc_id), r.ids, r.back) for r in out.collect()) == sorted(want)


def test_other_columns_and_empty_tables(llm_spark, model):
    docs = llm_spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    clashing = ["row", "key", "chunk", "n", "k", "text_", "level", "ids"]
    wide = docs.selectExpr("*", *[f"7 AS {c}" for c in clashing])
    out = pieces.encode(wide, queries.PIECES, end=False)
    assert out.columns == ["doc_id", *clashing[:-1], "ids"]
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].ids == model.encode("a b") and got[2].ids == []
    assert all(r[c] == 7 for r in got.values() for c in clashing[:-1])
    assert pieces.encode(docs.limit(0), queries.PIECES).count() == 0
    assert [r.ids for r in pieces.encode(docs.select("text"), queries.PIECES, end=False).collect() if r.ids] == [model.encode("a b")]


def test_query_equals_brute_force(llm_spark, small_docs, model):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13(llm_spark, SMALL).collect()}
    want = {}
    for r in small_docs.collect():
        ids = model.encode(r.text or "", add_eos=True)
        want[r.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(model.decode(ids)))
    assert got == want
