from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from shelfspark.llm import bpe, packing, queries
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, start string, length int"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(queries.TOKENIZER)


def check(rows, out, tokenizer, window=2048):
    want = defaultdict(list)
    for doc, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        want[doc].append(np.array(ids, dtype="<u4").tobytes())
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in out:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc, texts in want.items():
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[doc], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(texts[0]) // 4
                assert r.ids_crc32 == zlib.crc32(texts[0][at * 4 : (at + r.length) * 4])
                at += r.length
            assert at == len(texts[0]) // 4
        else:
            assert sum(r.length for r in pieces[doc]) == sum(len(t) // 4 for t in texts)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at == window or at & (at - 1) == 0 and at < window
    return sequences


def test_query_round_trip(llm_spark, small_docs, tokenizer):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    out = queries.QUERIES["op9_sum_of_squares_packing"](llm_spark, SMALL).collect()
    sequences = check(rows, out, tokenizer)
    assert sum(sum(n for _, n in s) < 2048 for s in sequences.values()) <= 11


def test_odd_rows(llm_spark, tokenizer):
    rows = [(1, None), (2, ""), (3, " \n\n "), (4, "word " * 9000), (5, "x"), (6, "<|endoftext|> a"), (None, "null id")]
    rows += [(7, "same"), (7, "same"), (8, "日本語 \t é🎉")]
    docs = llm_spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA).repartition(3)
    check(rows, packing.pack(docs, queries.TOKENIZER).collect(), tokenizer)
    check(rows, packing.pack(docs, queries.TOKENIZER, window=64, max_open=2).collect(), tokenizer, window=64)
    assert packing.pack(docs.limit(0), queries.TOKENIZER).count() == 0


def test_word_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(2)
    letters = ["a", "B", "é", "ß", "1", "²", "½", "_", "'s", "'", "-", "!!", " ", " ", " ", "\n", "\t", " ", "中", "🎉", "|", "ǅ", "́", "\x1c", "\x85"]
    encoder = bpe.WordEncoder(queries.TOKENIZER, max_words=200)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 30)))
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_level_array_minimises_squares():
    rng = random.Random(4)
    packer = packing.SumOfSquares(window=32)
    for n in range(400):
        size = rng.randint(1, 31)
        before = packer.levels.copy()
        packer.add((n, 0, b"\0\0\0\0" * size, size))
        best = None
        for level in range(0, 32 - size + 1):
            if level and not before[level]:
                continue
            after = before.copy()
            if level:
                after[level] -= 1
            if level + size < 32:
                after[level + size] += 1
            best = min(best, int((after**2).sum())) if best is not None else int((after**2).sum())
        assert int((packer.levels**2).sum()) == best
        assert packer.n_open == packer.levels.sum() == sum(map(len, packer.open.values()))
    packer.finish()
    assert sum(packing.n_ids(p) for _, w in packer.done for p in w) == sum(p[3] for p in {x[0]: x for _, w in packer.done for x in w}.values())


def test_added_tokens_are_read_as_the_tokenizer_reads_them(llm_spark, tokenizer):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\ny", "<|endoftext|><|endoftext|> z", "<|endoftext |>", "a <|endoftext"]
    encoder = bpe.encoder(queries.TOKENIZER)
    for text in texts:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(texts[0]), "<u4").tolist() == [64, 220, 50256, 275]
    rows = list(enumerate(texts))
    docs = llm_spark.createDataFrame([(d, t, "s", 1) for d, t in rows], SCHEMA)
    check(rows, packing.pack(docs, queries.TOKENIZER, window=8, end_id=1).collect(), tokenizer, window=8)


def test_a_very_long_document_is_cut_in_one_pass():
    packer = packing.SumOfSquares(window=64)
    ids = np.arange(3_000_001, dtype="<u4").tobytes()
    packer.add((1, 0, ids, 3_000_001))
    assert len(packer.done) == 3_000_001 // 64 and packer.n_open == 1
    assert b"".join(p[2] for _, ps in packer.done for p in ps) == ids[: 3_000_001 // 64 * 64 * 4]


def test_few_closed_windows_wait_for_their_rows():
    packer = packing.SumOfSquares(window=64)
    texts = pa.RecordBatch.from_pydict({"doc_id": list(range(5000)), "text": ["x" * 255] * 5000})
    out = packing.packed_batches(iter([texts]), lambda t: t.encode() * 4, packer, b"\1\0\0\0", 7)
    waiting = [(len(packer.done), b.num_rows) for b in out]
    assert sum(n for _, n in waiting) == 20000 and max(n for _, n in waiting) <= 2 * packing.WINDOWS_PER_BATCH
