"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system message, then user and assistant in turn, ending with the
assistant. Every turn is given a legal role, joins the message before it or starts one, with empty
messages inserted where the automaton needs them; dynamic programming finds the cheapest way.

Costs compose: a run of turns is a matrix of the cheapest costs from state to state, and runs combine
by (min, +) products. Turns are sorted across partitions and cut into blocks of bounded size, each
with many conversations. Only the first and last conversation of a block can reach beyond it; the
matrices of those combine in a tree, states at block borders are read off on the way down, and each
block then traces its own turns. So one endless conversation spreads over as many tasks as any other rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.scratch import written

START, SYSTEM, USER, ASSISTANT = range(4)
ROLES = ["", "system", "user", "assistant"]
#: Other names of the roles, in lower case.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "ai": "assistant", "gpt": "assistant"}
NEVER = 1 << 40
BLOCK_BITS = 12

KEEP, RELABEL, MERGE = "keep", "relabel", "merge"


class Costs(NamedTuple):
    """Of a turn that changes its role, of one whose role is unknown, of a merge and of an empty message."""

    relabel: int = 3
    unknown: int = 1
    merge: int = 1
    insert: int = 2


class Template(NamedTuple):
    """What stands before and after a message, and between merged turns."""

    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    joint: str = "\n"


#: Empty messages to insert on the way from a state to a message of a role; pairs that are missing are illegal.
WAYS = {
    (START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER],
    (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
    (USER, USER): [ASSISTANT], (USER, ASSISTANT): [],
    (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER],
}
ENDINGS = {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def moves(costs: Costs) -> tuple[np.ndarray, np.ndarray]:
    """Cheapest cost from state to role of the next turn, and whether that is a merge; of equals no merge."""
    cost = np.full((4, 4), NEVER, dtype=np.int64)
    for (state, role), inserted in WAYS.items():
        cost[state, role] = costs.insert * len(inserted)
    merged = np.zeros((4, 4), dtype=bool)
    for role in (SYSTEM, USER, ASSISTANT):
        merged[role, role] = costs.merge < cost[role, role]
    return np.where(merged, costs.merge, cost), merged


def turn_matrices(costs: Costs) -> np.ndarray:
    """For a turn of each role number (0: unknown) the cost from state to state."""
    move, _ = moves(costs)
    relabel = np.full((4, 4), costs.relabel, dtype=np.int64)
    relabel[0] = costs.unknown
    np.fill_diagonal(relabel, 0)
    return np.minimum(move[None] + relabel[:, None, :], NEVER)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), NEVER)


def best_states(matrices: list[np.ndarray], first: int, last: int) -> list[int]:
    """States after each step of the cheapest way from ``first`` to ``last``; of equals the smallest state."""
    cost, back = np.full(4, NEVER, dtype=np.int64), []
    cost[first] = 0
    for m in matrices:
        way = cost[:, None] + m
        back.append(way.argmin(axis=0))
        cost = np.minimum(way.min(axis=0), NEVER)
    states = [last]
    for came in reversed(back[1:]):
        states.append(int(came[states[-1]]))
    return states[::-1]


def last_state(matrix: np.ndarray, costs: Costs) -> int:
    ends = [matrix[START, s] + costs.insert * len(ENDINGS[s]) for s in range(4)]
    return int(np.argmin(ends))


def _headers(roles: list[int], template: Template) -> str:
    return "".join(template.before.format(role=ROLES[r]) + template.after for r in roles)


def repair_block(roles: list[int], texts: list[str], first: int, last: int, ends: bool, costs: Costs, template: Template) -> list[tuple]:
    """``(new_role, action, inserted, piece)`` per turn of a block between two states."""
    steps, (_, merged) = turn_matrices(costs), moves(costs)
    out, state = [], first
    for k, new in enumerate(best_states([steps[r] for r in roles], first, last)):
        if merged[state, new]:
            action, inserted, piece = MERGE, [], template.joint
        else:
            action = KEEP if roles[k] == new else RELABEL
            inserted = WAYS[state, new]
            piece = ("" if state == START else template.after) + _headers(inserted, template)
            piece += template.before.format(role=ROLES[new])
        piece += texts[k] or ""
        if ends and k == len(roles) - 1:
            piece += template.after + _headers(ENDINGS[new], template)
            inserted = inserted + ENDINGS[new]
        out.append((ROLES[new], action, ",".join(ROLES[r] for r in inserted), piece))
        state = new
    return out


def role_number(role: Column) -> Column:
    """Number of a role in ``ROLES``; 0 for a null or unknown one. Case and outer white space do not count."""
    name = F.lower(F.trim(role))
    for other, known in ALIASES.items():
        name = F.when(name == other, known).otherwise(name)
    return F.when(name.isin(ROLES[1:]), F.array_position(F.array(*[F.lit(r) for r in ROLES[1:]]), name)).otherwise(0).cast("int")


def _combined(level: DataFrame) -> DataFrame:
    """One matrix per (conversation, parent block), from those of its blocks."""

    def combine(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        matrices = [np.array(m, dtype=np.int64).reshape(4, 4) for m in group["matrix"]]
        total = matrices[0]
        for m in matrices[1:]:
            total = product(total, m)
        return pd.DataFrame({"conv": [key[0]], "block": [key[1]], "matrix": [total.ravel()]})

    parent = F.shiftright("block", BLOCK_BITS)
    return level.groupBy("conv", parent.alias("parent")).applyInPandas(combine, "conv string, block long, matrix array<long>")


def _borders(level: DataFrame, parents: DataFrame) -> DataFrame:
    """``conv, block, first, last, ends`` of the blocks of ``level``, from those of their parents."""

    def split(blocks: pd.DataFrame, parent: pd.DataFrame) -> pd.DataFrame:
        blocks = blocks.sort_values("block")
        matrices = [np.array(m, dtype=np.int64).reshape(4, 4) for m in blocks["matrix"]]
        states = best_states(matrices, int(parent["first"].iloc[0]), int(parent["last"].iloc[0]))
        n = len(blocks)
        return pd.DataFrame({
            "conv": blocks["conv"], "block": blocks["block"], "first": [int(parent["first"].iloc[0]), *states[:-1]],
            "last": states, "ends": [False] * (n - 1) + [bool(parent["ends"].iloc[0])],
        })

    own = level.groupBy("conv", F.shiftright("block", BLOCK_BITS).alias("parent"))
    above = parents.groupBy("conv", F.col("block").alias("parent"))
    return own.cogroup(above).applyInPandas(split, "conv string, block long, first int, last int, ends boolean")


def _runs(conversations: list[str]) -> list[tuple[int, int]]:
    """Start and end of each conversation in a sorted block."""
    cuts = [k for k in range(1, len(conversations)) if conversations[k] != conversations[k - 1]]
    return list(zip([0, *cuts], [*cuts, len(conversations)], strict=True))


def _total(roles: list[int], steps: np.ndarray) -> np.ndarray:
    total = steps[roles[0]]
    for r in roles[1:]:
        total = product(total, steps[r])
    return total


def _block_borders(placed: DataFrame, costs: Costs) -> DataFrame:
    """``conv, block, first, last, ends`` for conversations that lie in more than one block."""
    steps = turn_matrices(costs)

    def edges(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("seq")
        runs, roles, names = _runs(block["conv"].tolist()), block["role_no"].tolist(), block["conv"].tolist()
        outer = sorted({runs[0], runs[-1]})
        return pd.DataFrame({
            "conv": [names[a] for a, _ in outer], "block": [key[0]] * len(outer),
            "matrix": [_total(roles[a:b], steps).ravel() for a, b in outer],
        })

    found = placed.select("conv", "block", "seq", "role_no").groupBy("block").applyInPandas(
        edges, "conv string, block long, matrix array<long>"
    )
    found = written(found, "edges")
    spread = written(found.groupBy("conv").count().filter("count > 1").select("conv"), "spread")
    levels = [written(found.join(spread, "conv"), "level")]
    while not levels[-1].groupBy("conv").count().filter("count > 1").isEmpty():
        levels.append(written(_combined(levels[-1]), "level"))

    def best_ends(matrices: pd.Series) -> pd.Series:
        return matrices.map(lambda m: last_state(np.array(m, dtype=np.int64).reshape(4, 4), costs))

    ending = F.pandas_udf(best_ends, "int")
    borders = levels[-1].select("conv", "block", F.lit(START).alias("first"), ending("matrix").alias("last"), F.lit(True).alias("ends"))
    for level in reversed(levels[:-1]):
        borders = written(_borders(level, borders), "borders")
    return borders


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    costs: Costs = Costs(), template: Template = Template(),
) -> DataFrame:
    """One row per turn: ``conv_id, turn, seq, role, new_role, action, inserted, piece``.

    ``piece`` is what the turn adds to its rendered conversation: all pieces of a conversation in order of
    ``seq`` are its text. ``inserted`` names empty messages before the turn (and, at the end, after it).
    Turns go by number, null numbers last; turns with the same number go by role and text. A null
    conversation id is a conversation, a null or unknown role takes any, a null text is empty, repeated
    rows are turns of their own; other columns are ignored; an empty table gives no rows.
    """
    conv = F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit(""))
    rows = turns.select(
        conv.alias("conv"), F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"),
        F.col(text_col).alias("text"), role_number(F.col(role_col)).alias("role_no"),
    )
    order = [F.col("conv"), F.col("turn").asc_nulls_last(), F.col("role"), F.xxhash64("text"), F.col("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id())
    placed = written(placed.withColumn("block", F.shiftright("seq", BLOCK_BITS)), "turns")
    borders = _block_borders(placed, costs)
    steps = turn_matrices(costs)

    def trace(block: pa.Table, border: pa.Table) -> pa.Table:
        block = block.sort_by("seq")
        names, roles, texts = (block.column(c).to_pylist() for c in ("conv", "role_no", "text"))
        known = {b["conv"]: b for b in border.to_pylist()}
        found = []
        for a, b in _runs(names):
            own = known.get(names[a]) or {"first": START, "last": last_state(_total(roles[a:b], steps), costs), "ends": True}
            found += repair_block(roles[a:b], texts[a:b], own["first"], own["last"], own["ends"], costs, template)
        out = block.select(["conv_id", "turn", "seq", "role"])
        for name, column in zip(("new_role", "action", "inserted", "piece"), zip(*found, strict=True), strict=True):
            out = out.append_column(name, pa.array(column, pa.string()))
        return out

    kinds = {f.name: f.dataType.simpleString() for f in placed.schema}
    schema = f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, seq long, role {kinds['role']}, new_role string, action string, inserted string, piece string"
    return placed.groupBy("block").cogroup(borders.groupBy("block")).applyInArrow(trace, schema)
