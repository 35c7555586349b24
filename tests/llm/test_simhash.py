from __future__ import annotations

import random
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from shelfspark.llm import components as cc
from shelfspark.llm import queries, simhash
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, fp string, n int"


def plain_fingerprint(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words)] if len(words) < 3 else [" ".join(words[i : i + 3]) for i in range(len(words) - 2)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def plain_components(rows, radius=2):
    prints = [plain_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                label[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return [(doc, format(prints[i], "016x"), least.get(root(i))) for i, (doc, _) in enumerate(rows)]


def run(spark, rows):
    docs = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    out = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits(F.col("fp")), "component_id")
    return Counter(tuple(r) for r in out.collect())


def test_query_equals_brute_force(llm_spark, small_docs):
    rows = [(r.doc_id, r.text) for r in small_docs.select("doc_id", "text").collect()]
    got = Counter(tuple(r) for r in queries.QUERIES["op4_simhash_near_duplicates"](llm_spark, SMALL).collect())
    assert got == Counter(plain_components(rows))


def test_odd_rows(llm_spark):
    long = " ".join(f"w{i % 977}" for i in range(70_000))
    rows = [(5, None), (3, ""), (4, " \n\t"), (7, "One two"), (6, "one  TWO"), (9, "É a b c"), (8, "é a b c")]
    rows += [(1, "a b c d"), (1, "a b c d"), (None, "lost row here now"), (2, long), (12, long + " end")]
    assert run(llm_spark, rows) == Counter(plain_components(rows))
    assert run(llm_spark, []) == Counter()


def test_covering_masks_miss_no_pair():
    masks = simhash.covering_masks(2)
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i) & 1 and not (m >> j) & 1 for m in masks)


def test_links_over_close_fingerprints(llm_spark):
    rng = random.Random(3)
    prints = set()
    for _ in range(12):
        seed = rng.getrandbits(64)
        prints.add(seed)
        for _ in range(25):
            near = seed
            for b in rng.sample(range(64), rng.choice([1, 2, 3, 4])):
                near ^= 1 << b
            prints.add(near)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    for radius in (1, 2):
        label = {p: p for p in signed}
        for p in signed:
            for q in signed:
                if bin((p ^ q) & ((1 << 64) - 1)).count("1") <= radius and label[p] != label[q]:
                    old, new = label[p], label[q]
                    label = {k: new if v == old else v for k, v in label.items()}
        links = simhash.linked_fingerprints(llm_spark.createDataFrame([(p,) for p in signed], "fp long"), radius)
        assert all(bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 2 for a, b in links.collect())
        got = {r.id: r.root for r in cc.components(links).collect()}
        groups = Counter(label.values())
        assert set(got) == {p for p in signed if groups[label[p]] > 1}
        for p in got:
            assert {q for q in got if got[q] == got[p]} == {q for q in signed if label[q] == label[p]}


def test_components_of_a_chain_and_a_star(llm_spark):
    chain = [(i, i + 1) for i in range(1, 200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    edges = llm_spark.createDataFrame(chain + star + [(5, 5), (7, 7), (2, 1)], "a long, b long")
    sizes = Counter(r.root for r in cc.components(edges).collect())
    assert sorted(sizes.values()) == [200, 300]
    assert cc.components(edges.limit(0)).count() == 0


def test_keep_one(llm_spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "A B C D"), (3, "p q r s t u"), (4, None), (5, "")]
    docs = llm_spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    once = docs.filter("doc_id <> 1")
    assert sorted(r.doc_id for r in simhash.keep_one(once).collect()) == [2, 3, 4]
