from __future__ import annotations

import itertools
import random
import re

import pytest

from shelfspark.llm import chat, queries
from tests.llm.conftest import SMALL

SCHEMA = "conv_id long, turn int, role string, text string, seq string, piece int"
COSTS, TEMPLATE = chat.Costs(), chat.Template()
LEGAL = re.compile(r"s?(ua)+")


def plain_cost(roles):
    """Cheapest repair over all role assignments, merges and up to two inserted messages per gap."""
    if not roles:
        return 0
    best = 1 << 60
    gaps = ["", "u", "a", "ua", "au"]
    for new in itertools.product("sua", repeat=len(roles)):
        change = sum(0 if n == r else COSTS.unknown if r == "?" else COSTS.relabel for n, r in zip(new, roles))
        reach = {"": change}
        for k, n in enumerate(new):
            step = {}
            for text, cost in reach.items():
                if k and text.endswith(n):
                    step[text] = min(step.get(text, 1 << 60), cost + COSTS.merge)
                for gap in gaps:
                    grown = text + gap + n
                    if re.fullmatch(r"s?(ua)*u?", grown):
                        step[grown] = min(step.get(grown, 1 << 60), cost + COSTS.insert * len(gap))
            reach = step
        for text, cost in reach.items():
            for gap in gaps:
                if LEGAL.fullmatch(text + gap):
                    best = min(best, cost + COSTS.insert * len(gap))
    return best


def cost_of(rows):
    """Cost of a repair from its rows, and the rendered roles."""
    total = 0
    for r in rows:
        number = {"system": 1, "user": 2, "assistant": 3}.get(chat.ALIASES.get((r.role or "").lower().strip(), (r.role or "").lower().strip()), 0)
        if not number:
            total += COSTS.unknown
        elif chat.ROLES[number] != r.new_role:
            total += COSTS.relabel
        total += COSTS.merge * (r.action == chat.MERGE) + COSTS.insert * len([x for x in r.inserted.split(",") if x])
    return total


def run(spark, rows):
    out = chat.repair(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    by = {}
    for r in sorted(out, key=lambda r: r.seq):
        by.setdefault(r.conv_id, []).append(r)
    return by


def rendered(rows):
    return "".join(r.piece for r in rows)


def roles_of(text):
    parts = re.findall(r"<\|im_start\|>(\w+)\n(.*?)<\|im_end\|>\n", text, flags=re.S)
    assert "".join(f"<|im_start|>{a}\n{b}<|im_end|>\n" for a, b in parts) == text
    return "".join(a[0] for a, _ in parts)


def test_every_short_conversation_is_repaired_at_least_cost(llm_spark):
    names = {"s": "system", "u": "user", "a": "assistant", "?": "tool"}
    cases = [c for n in range(1, 5) for c in itertools.product("sua?", repeat=n)]
    rows = [(k, t, names[r], f"t{t}") for k, c in enumerate(cases) for t, r in enumerate(c)]
    by = run(llm_spark, rows)
    assert set(by) == set(range(len(cases)))
    for k, c in enumerate(cases):
        assert LEGAL.fullmatch(roles_of(rendered(by[k]))), c
        assert cost_of(by[k]) == plain_cost(c), c
        assert re.findall(r"t\d", rendered(by[k])) == [f"t{t}" for t in range(len(c))]


@pytest.mark.parametrize("bits", [1, 3])
def test_blocks_give_the_same_repair(llm_spark, monkeypatch, bits):
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), rng.randrange(400), rng.choice(["user", "Human ", "gpt", "assistant", "system", "x", None]), rng.choice(["", None, "hi", "yo"])) for _ in range(300)]
    whole = run(llm_spark, rows)
    monkeypatch.setattr(chat, "BLOCK_BITS", bits)
    cut = run(llm_spark, rows)
    assert set(whole) == set(cut) == {1, 2, 3, None}
    assert sum(map(len, cut.values())) == sum(map(len, whole.values())) == len(rows)
    for k in whole:
        assert cost_of(whole[k]) == cost_of(cut[k])
        assert LEGAL.fullmatch(roles_of(rendered(cut[k])))


def test_odd_rows(llm_spark):
    assert run(llm_spark, []) == {}
    rows = [(None, None, None, None), (1, None, "assistant", "z"), (1, 1, "user", "a"), (1, 1, "user", "a"), (2, 0, "system", "x" * 300_000)]
    by = run(llm_spark, rows)
    assert rendered(by[None]) == "<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert rendered(by[1]) == "<|im_start|>user\na\na<|im_end|>\n<|im_start|>assistant\nz<|im_end|>\n"
    assert roles_of(rendered(by[2])) == "sua"


def test_query_covers_the_table(llm_spark):
    turns = llm_spark.read.parquet(f"{SMALL}/conversations.parquet").collect()
    by = {}
    for r in sorted(queries.QUERIES["op3_chat_role_repair"](llm_spark, SMALL).collect(), key=lambda r: r.seq):
        by.setdefault(r.conv_id, []).append(r)
    assert sorted((r.conv_id, r.turn) for rows in by.values() for r in rows) == sorted((t.conv_id, t.turn) for t in turns)
    texts = {}
    for t in sorted(turns, key=lambda t: (t.conv_id, t.turn)):
        texts.setdefault(t.conv_id, []).append(t)
    for conv, rows in by.items():
        assert LEGAL.fullmatch(roles_of(rendered(rows)))
        assert cost_of(rows) == plain_cost([t.role[0] for t in texts[conv]][:5]) or len(rows) > 5
        at = 0
        for t in texts[conv]:
            at = rendered(rows).index(t.text, at) + len(t.text)
