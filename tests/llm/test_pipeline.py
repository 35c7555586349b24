from __future__ import annotations

from collections import Counter, defaultdict

import corpus_pipeline
from tests.llm import test_mixing, test_near_copies, test_packing, test_quality_rules
from tests.llm.conftest import SMALL
from tests.llm.test_packing import tokenizer  # noqa: F401


def through(spark, docs, tmp_path):
    """Results of all stages, each written and read again."""
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SMALL).write.parquet(f"{tmp_path}/{k}")
        out.append(spark.read.parquet(f"{tmp_path}/{k}"))
    return out


def test_each_stage_equals_brute_force(llm_spark, small_docs, tmp_path, tokenizer):  # noqa: F811
    docs, rules, good, once, mixed, packed = through(llm_spark, small_docs, tmp_path)
    for df in (rules, good, once, mixed):
        assert df.columns == docs.columns
    text = {r.doc_id: r.text for r in docs.collect()}
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    kept = ids(rules)
    short = {d for d, t in text.items() if len(t) < 4000}
    assert kept & short == {d for d in short if test_quality_rules.plain(text[d])[-1]}
    labels = {r.doc_id: r.quality for r in llm_spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    judged = kept & set(labels)
    assert ids(good) <= kept
    assert sum((d in ids(good)) == labels[d] for d in judged) >= 0.9 * len(judged)
    rows = [(d, text[d]) for d in sorted(ids(good))]
    assert sorted(r.doc_id for r in once.collect()) == test_near_copies.plain_kept(rows)
    by_source = defaultdict(int)
    for r in once.collect():
        by_source[r.source] += test_mixing.words(r.text)
    targets, taken = test_mixing.plain_targets(by_source), defaultdict(int)
    for r in mixed.collect():
        taken[r.source] += test_mixing.words(r.text)
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 0.1 * target + 50
    assert max(Counter(r.doc_id for r in mixed.collect()).values()) <= 3
    test_packing.check([(r.doc_id, r.text) for r in mixed.collect()], packed.collect(), tokenizer)


def test_run_goes_through_all_stages(llm_spark, small_docs, tmp_path):
    want = through(llm_spark, small_docs, tmp_path)[-1].drop("sequence_id", "offset")
    got = corpus_pipeline.run(llm_spark, SMALL).drop("sequence_id", "offset")
    assert got.groupBy("doc_id").sum("length").exceptAll(want.groupBy("doc_id").sum("length")).isEmpty()


def test_odd_documents_do_not_break_a_stage(llm_spark, small_docs, tmp_path):
    odd = [(None, None, None, None, None), (None, "", None, "s", 0), (1, None, "en", None, None), (2, "x", "en", "s", 1)]
    odd += [(3, "word " * 30_000, None, "s", 3), (4, " ".join(f"w{i}" for i in range(60)), None, None, 1)] * 2
    docs = llm_spark.createDataFrame(odd, small_docs.schema)
    out = through(llm_spark, docs, tmp_path / "odd")
    assert all(df.columns == docs.columns for df in out[:-1])
    assert {r.doc_id for r in out[1].collect()} == {4}
    assert through(llm_spark, docs.limit(0), tmp_path / "none")[-1].count() == 0
    for _, stage in corpus_pipeline.STAGES:
        stage(llm_spark, docs, SMALL).collect()
    clashing = ["row", "size", "component_id", "score", "counts", "fp", "n", "id", "copies", "kept_id"]
    wide = docs.selectExpr("*", *[f"7 AS {c}" for c in clashing])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(llm_spark, wide, SMALL)
        assert out.columns == wide.columns
        assert all(r[c] == 7 for r in out.collect() for c in clashing)
    assert corpus_pipeline.STAGES[-1][1](llm_spark, wide, SMALL).count() > 0
