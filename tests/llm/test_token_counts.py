from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from shelfspark.llm import queries, token_counts
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, source string, lang string, tokenizer string, op string, n_tokens long, n_docs string"


def plain(batches):
    state, nameless = {}, []
    for batch in batches:
        best, gone = {}, set()
        for doc, source, lang, tok, op, n in batch:
            key = (doc, source, lang, tok)
            if doc is None:
                nameless += [(*key[1:], n or 0)] if op == "insert" else []
            elif op == "delete":
                gone.add(key)
            else:
                best[key] = max(best.get(key, 0), n or 0)
        for key in gone:
            state.pop(key, None)
        state.update(best)
    totals = defaultdict(lambda: [0, 0])
    for *group, n in [(*key[1:], n) for key, n in state.items()] + nameless:
        totals[tuple(group)][0] += 1
        totals[tuple(group)][1] += n
    return {k: tuple(v) for k, v in totals.items()}


def totals(ledger):
    return {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}


@pytest.fixture
def ledger(llm_spark, tmp_path):
    return token_counts.Ledger(llm_spark, str(tmp_path / "ledger"))


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def test_random_batches(llm_spark, ledger):
    rng = random.Random(6)
    batches = []
    for b in range(4):
        rows = [
            (rng.choice([None, *range(15)]), rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.choice(["t1", "t2"]),
             rng.choice(["insert", "revise", "delete"]), rng.choice([None, 0, 3, 8]))
            for _ in range(40)
        ]
        batches.append(rows + rows[:5])
        assert ledger.apply(f"b{b}", frame(llm_spark, batches[-1]))
        assert totals(ledger) == plain(batches)
    assert ledger.batches() == ["b0", "b1", "b2", "b3"]
    for b in range(4):
        assert not ledger.apply(f"b{b}", frame(llm_spark, batches[0]))
    assert totals(ledger) == plain(batches)


def test_empty_and_broken_batches(llm_spark, ledger):
    assert totals(ledger) == {} and ledger.batches() == []
    assert ledger.apply("none", frame(llm_spark, []))
    assert not ledger.apply("none", frame(llm_spark, []))
    row = [(1, "s", "en", "t", "insert", 5)]
    frame(llm_spark, [(9, "s", "en", "t", "insert", 7)]).selectExpr(
        "doc_id", "source", "lang", "tokenizer", "1L AS d_docs", "7L AS d_tokens", "0 AS bucket"
    ).write.partitionBy("bucket").parquet(f"{ledger.path}/deltas/batch=late")
    assert totals(ledger) == {}
    assert ledger.apply("late", frame(llm_spark, row))
    assert totals(ledger) == {("s", "en", "t"): (1, 5)}
    assert ledger.apply("undo", frame(llm_spark, [(1, "s", "en", "t", "delete", None), (2, "s", "en", "t", "delete", 1)]))
    assert totals(ledger) == {} and ledger.current().count() == 0


def test_query_equals_brute_force(llm_spark, small_docs):
    tokenizer = Tokenizer.from_file(queries.TOKENIZER)
    want = Counter()
    n_docs = Counter()
    for r in small_docs.collect():
        n = len(tokenizer.encode(r.text, add_special_tokens=False).ids)
        if n:
            want[r.source, r.lang] += n + 1
            n_docs[r.source, r.lang] += 1
    got = {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in queries.QUERIES["op2_token_rollups"](llm_spark, SMALL).collect()}
    assert got == {k: (n_docs[k], want[k]) for k in want}


def test_null_and_repeated_ids_are_all_counted(llm_spark, ledger):
    rows = [(None, "a", "en", "t", "insert", 3), (None, "a", "en", "t", "insert", 3), (1, "a", "en", "t", "insert", 4), (1, "b", "en", "t", "insert", 5)]
    assert ledger.apply("1", frame(llm_spark, rows))
    assert totals(ledger) == {("a", "en", "t"): (3, 10), ("b", "en", "t"): (1, 5)}
    assert ledger.apply("2", frame(llm_spark, [(1, "b", "en", "t", "revise", 9), (None, "a", "en", "t", "delete", 3)]))
    assert totals(ledger) == {("a", "en", "t"): (3, 10), ("b", "en", "t"): (1, 9)}


def test_a_small_batch_reads_only_the_folders_of_its_documents(llm_spark, ledger):
    ledger.apply("1", frame(llm_spark, [(d, "a", "en", "t", "insert", 1) for d in range(200)]))
    named = llm_spark.createDataFrame([(7, "a", "en", "t")], "doc_id long, source string, lang string, tokenizer string")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(token_counts.BUCKETS)).cast("int").alias("bucket")
    found = ledger.current(named.select("*", bucket))
    assert [tuple(r) for r in found.collect()] == [(7, "a", "en", "t", 1)]
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", scan)
