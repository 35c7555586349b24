from __future__ import annotations

import random
import re
from itertools import permutations

from shelfspark.llm import filter_audit, queries
from tests.compare import compare, duck
from tests.llm.conftest import SMALL

SCHEMA = "doc_id long, text string, source string"


def plain_fails(rows):
    first = {}
    for d, t, _ in rows:
        if d is not None:
            first[t or ""] = min(first.get(t or "", d), d)
    out = []
    for d, t, s in rows:
        text = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": text in first and (d is None or d > first[text]),
        }
        out.append((s or "", d, {k for k, v in fails.items() if v}))
    return out


def plain_audit(rows, labels):
    good, toxic = {d for d, q, _ in labels if q == 1}, {d for d, _, t in labels if t == 1}
    failed, out = plain_fails(rows), []
    for part in {p for p, _, _ in failed}:
        mine, shapley, steps = [(d, f) for p, d, f in failed if p == part], dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for step, x in enumerate(order, start=1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[x] += len(gone)
                again = sum(x in f for _, f in mine) - len(gone)
                lost = sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone)
                steps.append((part, order, step, len(left), len(gone), again, sum(f == {x} for _, f in mine), *lost))
        out += [(*s, shapley[s[1][s[2] - 1]]) for s in steps]
    return sorted(out)


def made_rows(n, seed=2):
    rng = random.Random(seed)
    rows = []
    for d in range(n):
        words = [rng.choice(["aa", "Bb", "cé", f"x{rng.randrange(200)}", "\U0001f600"]) for _ in range(rng.choice([0, 5, 49, 50, 51, 120]))]
        text = rng.choice([" ", "\n", "\t "]).join(words) + rng.choice(["", "", " #", "UP"])
        rows.append((d, rng.choice([text, text, rows[rng.randrange(len(rows))][1] if rows else ""]), rng.choice(["s", "t", None, ""])))
    return rows


def test_rows_equal_brute_force(llm_spark):
    rows = made_rows(150) + [(None, None, "n"), (None, "", None), (None, "only null ids", "n"), (None, "only null ids", "n")]
    rows += [(3, "same id", "s"), (3, "same id", "s"), (4, "same id", "t"), (7, "Word " * 40_000, "long"), (8, None, None)]
    labels = [(d, d % 2, d % 3) for d in range(0, 90)] + [(5, 0, 1), (5, 1, 0), (6, None, None), (None, 1, 1), (999, 1, 1)]
    docs = llm_spark.createDataFrame(rows, SCHEMA)
    given = llm_spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, filter_audit.audit(docs, given).collect()))
    known = [(d, q, t) for d, q, t in labels if d is not None]
    assert got == plain_audit(rows, known)
    wide = docs.selectExpr("*", "7 AS part", "7 AS mask", "7 AS digest", "7 AS n", "7 AS good", "7 AS toxic", "7 AS first_id")
    assert sorted(map(tuple, filter_audit.audit(wide, given.withColumn("part", given.toxic)).collect())) == got
    assert filter_audit.audit(docs.limit(0), given).count() == 0
    assert filter_audit.audit(docs, given.limit(0)).agg({"good_lost": "sum"}).first()[0] == 0


def test_potential_gives_the_mean_over_orders():
    rng = random.Random(5)
    v = [0, *(rng.randrange(100) for _ in range(31))]
    scaled = filter_audit.potentials(v, 5)
    for i in range(5):
        total = 0
        for order in permutations(range(5)):
            before = sum(1 << j for j in order[: order.index(i)])
            total += v[before | 1 << i] - v[before]
        assert scaled[31] - scaled[31 ^ 1 << i] == total


def test_query_equals_brute_force_and_sql(llm_spark, small_docs):
    rows = [(r.doc_id, r.text, r.source) for r in small_docs.collect()]
    labels = [(r.doc_id, r.quality, r.toxic) for r in llm_spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    assert sorted(map(tuple, queries.op12(llm_spark, SMALL).collect())) == plain_audit(rows, labels)
    assert compare(llm_spark, duck(SMALL), "op12", queries.op12, queries.OP12_SQL, SMALL) is None
