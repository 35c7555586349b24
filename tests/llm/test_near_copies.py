from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from pyspark.sql import functions as F

from shelfspark.llm import near_copies, scratch
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, lang string, source string, n int"


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def plain_kept(rows, least=0.8):
    group, sets = list(range(len(rows))), [shingles(t) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j], least):
                old = group[i]
                group = [group[j] if g == old else g for g in group]
    return sorted(min(rows[i][0] for i in range(len(rows)) if group[i] == g) for g in set(group))


def alike(a, b, least):
    shared = len(a & b)
    return shared >= least * (len(a) + len(b) - shared)


def edited(rng, words, low, high):
    """A copy with changed words whose similarity lies between the bounds."""
    out = list(words)
    while True:
        s = similarity(" ".join(words), " ".join(out))
        if s < low:
            out = list(words)
        elif s <= high:
            return out
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**9)}"


def kept_of(spark, rows):
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    return sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SMALL).collect())


def test_edited_copies_at_several_similarities(llm_spark):
    rng, rows, drop = random.Random(4), [], set()
    for group in range(30):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([120, 300, 600]))]
        rows.append((group * 10, " ".join(words)))
        for k, (low, high) in enumerate([(0.8, 0.83), (0.9, 0.93), (0.95, 0.99)], start=1):
            rows.append((group * 10 + k, " ".join(edited(rng, words, low, high))))
            drop.add(group * 10 + k)
        rows.append((group * 10 + 4, " ".join(edited(rng, words, 0.6, 0.7))))
    assert set(kept_of(llm_spark, rows)) & drop == set()
    assert kept_of(llm_spark, rows) == plain_kept(rows)


def test_a_large_group_and_a_chain(llm_spark):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, base, 0.84, 0.97))) for i in range(80)]
    at = [f"c{i}" for i in range(200)]
    for i in range(25):
        at = at[6:] + [f"d{i}_{k}" for k in range(6)]
        rows.append((1000 + i, " ".join(at)))
    assert kept_of(llm_spark, rows) == plain_kept(rows) == [0, 1000]


def test_odd_rows(llm_spark):
    rows = [(5, None), (3, ""), (7, "One two"), (6, "one  TWO"), (1, "a b c d e f"), (1, "a b c d e f"), (None, "lost"), (None, "LOST")]
    docs = llm_spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    kept = near_copies.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 6]
    assert near_copies.keep_one(docs.limit(0)).count() == 0


def compared_pairs(monkeypatch):
    """The number of pairs of each round, as they are compared."""
    seen, plain = [], near_copies._alike

    def counting(pairs, sets, least):
        seen.append(pairs.count())
        return plain(pairs, sets, least)

    monkeypatch.setattr(near_copies, "_alike", counting)
    return seen


def template(rng, n, changed):
    base, rows = [f"t{i}" for i in range(60)], []
    for i in range(n):
        words = list(base)
        for at in rng.sample(range(60), changed):
            words[at] = f"own{i}_{at}"
        rows.append((i, " ".join(words)))
    return rows


def test_texts_of_one_template_do_not_meet_in_pairs(llm_spark, monkeypatch):
    rows, seen = template(random.Random(5), 250, 2), compared_pairs(monkeypatch)
    assert kept_of(llm_spark, rows) == plain_kept(rows)
    assert sum(seen) < 10 * len(rows)


def test_a_linked_template_closes_after_few_leaders(llm_spark, monkeypatch):
    rows, seen = template(random.Random(6), 250, 1), compared_pairs(monkeypatch)
    assert kept_of(llm_spark, rows) == plain_kept(rows)
    assert sum(seen) < 20 * len(rows)


def test_every_link_of_a_given_table_is_found(llm_spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.collect()]
    assert kept_of(llm_spark, rows) == plain_kept(rows)


def test_prefix_is_as_long_as_it_must_be(llm_spark):
    for least in (0.5, 0.8, 0.9):
        lengths = llm_spark.range(1, 400).select("id", near_copies.prefix_length(F.col("id"), least).alias("p")).collect()
        # Two sets of n that are similar enough share s >= least * n, so the n - s others never fill a prefix.
        assert all(r.p == r.id - next(s for s in range(r.id + 1) if s >= least * r.id - 1e-9) + 1 for r in lengths)


def test_parities_never_exclude_a_similar_pair():
    rng = np.random.default_rng(3)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 63, size=int(rng.integers(1, 400)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 63, size=5, dtype=np.uint64)]))
        bits = [np.array(near_copies.parity(x), np.int64).view(np.uint8) for x in (a, b)]
        assert np.unpackbits(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_nothing_but_the_result_stays_in_the_shared_folder(llm_spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scratch, "scratch_path", lambda spark, name: f"{tmp_path}/{name}-{random.randrange(10**12)}")
    assert kept_of(llm_spark, template(random.Random(7), 30, 1))
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["kept"]


def test_close_fingerprints_are_linked_by_the_operator_and_then_checked(llm_spark, monkeypatch):
    rng, base, rows = random.Random(11), [f"w{i}" for i in range(400)], []
    for group in range(4):
        words = [f"{w}_{group}" for w in base]
        rows += [(group * 10 + k, " ".join(edited(rng, words, 0.97, 0.99))) for k in range(5)]
    rows.append((90, "one two"))
    checked, plain = [], near_copies._alike

    def seeing(pairs, sets, least):
        checked.append({frozenset(r) for r in pairs.select("lead", "other").collect()})
        return plain(pairs, sets, least)

    monkeypatch.setattr(near_copies, "_alike", seeing)
    assert kept_of(llm_spark, rows) == plain_kept(rows) == [0, 10, 20, 30, 90]
    fps = [near_copies.fingerprint_of(near_copies.all_hashes(near_copies.words_of(t))) for _, t in rows]
    close = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 2]
    assert close and 0 < len(checked[0]) <= len(close)


def test_batches_are_small_only_while_the_stage_runs(llm_spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = llm_spark.conf.get(name)
    with scratch.rows_per_batch(llm_spark, 7):
        assert llm_spark.conf.get(name) == "7"
    assert llm_spark.conf.get(name) == before


def test_two_that_share_many_keys_meet_once(llm_spark, monkeypatch):
    rng, rows = random.Random(21), []
    for group in range(3):
        words = [f"w{group}_{i}" for i in range(200)]
        rows += [(group * 100 + k, " ".join(edited(rng, words, 0.72, 0.9))) for k in range(20)]
    seen, plain = [], near_copies._meetings

    def counting(rooted, leads, least):
        met = plain(rooted, leads, least)
        both = {(r.lead, r.other) for r in met.collect()}
        member, root = {}, {}
        for r in rooted.collect():
            member.setdefault(r.h, {})[r.cls] = r
            root[r.cls] = r.root
        often = [(r.cls, o) for r in leads.collect() for o in member[r.h] if root[o] != root[r.cls]]
        seen.append((met.count(), len(both), len(often)))
        assert both <= set(often)
        return met

    monkeypatch.setattr(near_copies, "_meetings", counting)
    assert kept_of(llm_spark, rows) == plain_kept(rows)
    assert all(met == both for met, both, _ in seen)
    assert sum(often for _, _, often in seen) > 5 * sum(met for met, _, _ in seen) > 0


def test_more_keys_than_are_named_lose_no_pair(llm_spark, monkeypatch):
    monkeypatch.setattr(near_copies, "KEYS_SEEN", 1)
    rows = template(random.Random(22), 60, 1) + [(1000 + d, t) for d, t in template(random.Random(23), 60, 2)]
    assert kept_of(llm_spark, rows) == plain_kept(rows)
