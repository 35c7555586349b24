from __future__ import annotations

import random
import re
from collections import Counter

import numpy as np

from shelfspark.llm import quality_rules, queries
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, n_words string, kept int"


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    n = len(words)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    repeated = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    longest = [0] * n
    for i in range(n):
        for j in range(i):
            k = 0
            while i + k < n and words[i + k] == words[j + k]:
                k += 1
            longest[i], longest[j] = max(longest[i], k), max(longest[j], k)
    spans = {i + k for i in range(n) if longest[i] >= 8 for k in range(longest[i])}
    most = max(longest, default=0)
    failed = n < 50 or 100 * len(repeated) > 50 * n
    kept = not failed and len(spans) <= 0.3 * n and not (most >= 8 and most > 0.25 * n)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return n, sum(map(len, words)), symbols, dup, len(repeated), len(spans), most, failed, kept


def texts(seed):
    rng = random.Random(seed)
    some = [None, "", " \n\t\r", "x", "a b c", "a a a a a a", "é# <b> | x\n\nx\nx \nx", "one\x0btwo\x85three four"]
    for _ in range(60):
        vocabulary = ["".join(rng.choice("abé#|") for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([2, 5, 40, 400]))]
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 160))]
        if rng.random() < 0.5:
            at = rng.randrange(len(words))
            words += words[at : at + rng.randint(1, 90)]
        some.append("".join(w + rng.choice([" ", " ", " ", "\n", "  "]) for w in words))
    return some


def test_counts_equal_brute_force(llm_spark):
    rows = [*enumerate(texts(1)), (5, "a b c"), (None, "x y"), (5, "a b c")]
    docs = llm_spark.createDataFrame([(d, t, "x", 1) for d, t in rows], SCHEMA)
    got = Counter(tuple(r) for r in quality_rules.assess(docs).collect())
    assert got == Counter((d, *plain(t)) for d, t in rows)
    assert quality_rules.assess(docs.limit(0)).count() == 0
    kept = quality_rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(d for d, t in rows if plain(t)[-1])


def test_query_equals_brute_force(llm_spark, small_docs):
    rows = {r.doc_id: r.text for r in small_docs.collect() if len(r.text) < 4000}
    columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    out = queries.QUERIES["op7_quality_rules"](llm_spark, SMALL).collect()
    assert len(out) == small_docs.count()
    for r in out:
        if r.doc_id in rows:
            want = plain(rows[r.doc_id])
            assert [r[c] for c in columns] == [*want[:5]]
            assert (r.base_failed, r.kept) == want[-2:]


def test_very_long_and_periodic_texts():
    same, period = ["w"] * 30_000, ["a", "b", "c"] * 20_000
    (one,) = quality_rules.text_counts(iter([" ".join(same), " ".join(period)]))
    assert one[0].tolist() == [30_000, 30_000, 0, 0, 30_000, 30_000, 29_999]
    assert one[1].tolist()[4:] == [60_000, 60_000, 59_997]


def test_suffix_array_order():
    rng = random.Random(9)
    for _ in range(50):
        parts = [[rng.randrange(3) + 10 * k for _ in range(rng.randint(1, 12))] for k in range(3)]
        flat = np.array(sum(parts, []))
        ends = np.repeat(np.cumsum([len(p) for p in parts]), [len(p) for p in parts])
        ranks = quality_rules.suffix_ranks(flat, ends)[-1]
        suffixes = [(tuple(flat[i : ends[i]]), i) for i in range(len(flat))]
        assert [i for _, i in sorted(suffixes)] == np.argsort(ranks).tolist()
