"""Mixing sources to target weights by cube-method balanced sampling.

A source's target over its size is taken in whole repeats of every document plus a fractional
inclusion probability. The flight phase moves probabilities along the null space of the balancing
constraints (documents, tokens): each step settles at least one document at 0 or 1 and leaves both
totals where they were. Documents are dealt into buckets of bounded size, each flown in its own
task; the at most two unsettled documents of every bucket meet in the next level's buckets, until
one bucket per source is left. One bucket of every source waits for the landing: what is still
unsettled then, and the ``HELD`` smallest documents, are landed by trying all their outcomes, and
documents of that bucket change places until the words fit.

Documents of more than ``LONG`` times the mean size of their source are settled first, by the same
steps; the words they miss are spread over the probabilities of the source's other documents.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.scratch import beside, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_REPEAT = 3
BUCKET = 1000
FAN = 250
PART_BITS = 33
NEAR = 1e-9
HELD = 10
LONG = 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the 0-based position of each row by ``column`` (code points, null last), without a global window."""
    order = F.col(column).asc_nulls_last()
    placed = written(
        df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_seq", F.monotonically_increasing_id()),
        "ordered",
    )
    part = F.shiftright("_seq", PART_BITS)
    before, offsets = 0, []
    for row in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # a row per partition
        offsets += [F.lit(row["part"]), F.lit(before).cast("long")]
        before += row["count"]
    if not offsets:
        return placed.withColumn(name, F.col("_seq")).drop("_seq")
    inside = F.col("_seq").bitwiseAND(F.lit((1 << PART_BITS) - 1))
    return placed.withColumn(name, F.element_at(F.create_map(*offsets), part) + inside).drop("_seq")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """``sizes(source, size, n)`` to one row per source: ``source, source_no, source_size, n_docs, target``.

    Targets share the total size by weight; what a source cannot take, at ``max_repeat`` times its
    size, is shared again among the others by weight until nothing is above. The shares are found
    by a few scalar aggregates over the sources.
    """
    totals = sizes.groupBy("source").agg(
        F.coalesce(F.sum(F.col("size") * F.col("n")), F.lit(0)).alias("source_size"), F.sum("n").alias("n_docs")
    )
    numbered = in_order(totals, "source", "source_no")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    limit = F.col("source_size") * F.lit(float(max_repeat))
    weighed = numbered.withColumn("_weight", weight).withColumn("_limit", limit)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    share, n_full = 0.0, -1
    while True:
        full = F.col("_limit") < F.lit(share) * F.col("_weight")
        row = weighed.agg(
            F.count(F.when(full, 1)).alias("n"),
            F.sum(F.when(full, F.col("_limit"))).alias("given"),
            F.sum(F.when(~full, F.col("_weight"))).alias("weight"),
        ).first()
        if row["n"] == n_full or not row["weight"]:
            break
        n_full = row["n"]
        share = (total - (row["given"] or 0.0)) / row["weight"]
    target = F.least("_limit", F.lit(share) * F.col("_weight"))
    return written(weighed.select("source", "source_no", "source_size", "n_docs", target.alias("target")), "targets")


def _step(units: list[list], rng: random.Random) -> bool:
    """Move the probabilities of up to three units ``[prob, size, row]`` along the constraints' null space."""
    if len(units) == 3:
        a, b, c = (u[1] for u in units)
        direction = (float(c - b), float(a - c), float(b - a))
        if not any(direction):
            direction = (1.0, -1.0, 0.0)
    elif len(units) == 2 and units[0][1] == units[1][1]:
        direction = (1.0, -1.0)
    else:
        return False
    up = min(((1 - u[0]) / d if d > 0 else -u[0] / d) for u, d in zip(units, direction, strict=True) if d)
    down = min((u[0] / d if d > 0 else (u[0] - 1) / d) for u, d in zip(units, direction, strict=True) if d)
    by = up if rng.random() * (up + down) < down else -down
    for u, d in zip(units, direction, strict=True):
        u[0] += by * d
    return True


def flight(probs: list[float], sizes: list[int], seed: int) -> list[float]:
    """Inclusion probabilities after the flight phase: all 0 or 1 but at most two."""
    rng, out = random.Random(seed), list(probs)
    active: list[list] = []

    def settle() -> None:
        for u in [u for u in active if u[0] < NEAR or u[0] > 1 - NEAR]:
            out[u[2]] = float(round(u[0]))
            active.remove(u)

    for row, (prob, size) in enumerate(zip(probs, sizes, strict=True)):
        active.append([prob, size, row])
        settle()
        while len(active) == 3 and _step(active, rng):
            settle()
    while _step(active, rng):
        settle()
    for u in active:
        out[u[2]] = u[0]
    return out


def landing(probs: list[float], sizes: list[int], wanted: float) -> list[float]:
    """All 0 or 1, with a sum of sizes near ``wanted``: of all outcomes of the open units the nearest, then a taken
    and a left unit change places, or a single one changes, as long as that brings the sum nearer.

    The change that brings it nearest goes first; of equal ones a change of places, which keeps the number.
    """
    size = np.array(sizes, dtype=float)
    out = np.array(probs)
    open_rows = np.flatnonzero((out > 0) & (out < 1))
    outcomes = (np.arange(1 << len(open_rows))[:, None] >> np.arange(len(open_rows))) & 1
    moves = outcomes - out[open_rows]
    missed = np.abs(out @ size - wanted + moves @ size[open_rows]).round(6)
    out[open_rows] = outcomes[np.lexsort((np.abs(moves.sum(axis=1)).round(6), missed))[0]]
    over = float(out @ size - wanted)
    while True:
        taken, left = np.flatnonzero(out == 1), np.flatnonzero(out == 0)
        best, change = round(abs(over), 6), ()
        if len(taken) and len(left):
            left = left[np.argsort(size[left], kind="stable")]
            fit = np.searchsorted(size[left], size[taken] - over)
            for near in (fit - 1, fit):
                near = left[near.clip(0, len(left) - 1)]
                after = np.abs(over + size[near] - size[taken]).round(6)
                k = int(after.argmin())
                if after[k] < best:
                    best, change = after[k], (int(taken[k]), int(near[k]))
        single = np.abs(over + np.where(out == 1, -size, size)).round(6)
        if len(single) and single.min() < best:
            change = (int(single.argmin()),)
        if not change:
            return out.tolist()
        for k in change:
            out[k] = 1 - out[k]
        over = float(out @ size - wanted)


def settled(probs: list[float], sizes: list[int], seed: int, land: bool) -> list[float]:
    """Flight; with ``land`` the last ``HELD`` units wait for the landing, which settles all."""
    n = max(0, len(probs) - HELD) if land else len(probs)
    flown = flight(probs[:n], sizes[:n], seed) + list(probs[n:])
    return landing(flown, sizes, float(np.dot(probs, sizes))) if land else flown


def _flown(units: DataFrame, level: int, land: bool) -> DataFrame:
    def fly(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        order = ["size", "deal", "unit"]  # large documents first, so that small ones are left to land
        group = group.sort_values(order, ascending=[False, True, True], kind="stable")
        seed = (int(key[0]) * 1_000_003 + int(key[1])) * 31 + level
        return group.assign(prob=settled(group["prob"].tolist(), group["size"].tolist(), seed, land))

    return units.groupBy("source_no", "bucket").applyInPandas(fly, units.schema)


def _settled_units(units: DataFrame, bucket_rows: int) -> DataFrame:
    n_buckets = F.ceil(F.col("n_units") / F.lit(bucket_rows))
    deal = F.xxhash64("unit", "size")
    dealt = units.withColumn("deal", deal).withColumn("bucket", F.pmod(F.col("deal"), n_buckets)).drop("n_units")
    waiting = open_units = dealt.filter("bucket = 0")
    most = units.agg(F.max(n_buckets)).first()[0] or 1
    dealt, done, level = dealt.filter("bucket > 0"), [], 0
    while most > 1:
        flown = written(_flown(dealt, level, land=False), "flown")
        done.append(flown.filter("prob = 0 or prob = 1"))
        dealt = flown.filter("prob > 0 and prob < 1").withColumn("bucket", F.floor(F.col("bucket") / F.lit(FAN)))
        most, level = -(-most // FAN), level + 1
        open_units = waiting.unionByName(dealt.withColumn("bucket", F.lit(0).cast(waiting.schema["bucket"].dataType)))
    units = written(_flown(open_units, level, land=True), "landed")
    for more in done:
        units = units.unionByName(more)
    return units.drop("deal", "bucket")


def balanced_sample(units: DataFrame, bucket_rows: int = BUCKET) -> DataFrame:
    """``units(source_no, unit, size, prob, n_units)`` to the same rows with ``prob`` 0 or 1.

    Within each source the sum of ``prob`` and of ``prob * size`` stay, but for the small landing. Units with equal (source_no, unit, size) must be interchangeable.
    """
    means = units.groupBy("source_no").agg((F.avg("size") * F.lit(LONG)).alias("_long"))
    split = units.join(means, "source_no").withColumn("_is_long", F.col("size") > F.col("_long"))
    split = split.select(*units.columns, "_is_long")
    long = split.filter("_is_long").drop("_is_long")
    if long.isEmpty():
        return _settled_units(units, bucket_rows)
    numbers = long.groupBy("source_no").agg(F.count(F.lit(1)).alias("n_units"))
    long = written(long.drop("n_units").join(numbers, "source_no").select(*units.columns), "long")
    landed = written(_settled_units(long, bucket_rows), "long-landed")
    words = F.col("prob") * F.col("size")
    missed = long.select("source_no", words.alias("w")).unionByName(landed.select("source_no", (-words).alias("w")))
    missed = missed.groupBy("source_no").agg(F.sum("w").alias("_missed"))
    rest = split.filter("not _is_long").drop("_is_long")
    # room to go up or down: the share of it that is used is the same for all documents of a source
    rooms = rest.groupBy("source_no").agg(F.sum((1 - F.col("prob")) * F.col("size")).alias("_up"), F.sum(words).alias("_down"))
    spread = written(missed.join(rooms, "source_no", "left"), "spread")
    room = F.when(F.col("_missed") > 0, F.col("_up")).otherwise(F.col("_down"))
    used = F.least(F.coalesce(F.abs("_missed") / F.when(room > 0, room), F.lit(0.0)), F.lit(1.0))
    moved = F.when(F.col("_missed") > 0, F.col("prob") + used * (1 - F.col("prob"))).otherwise(F.col("prob") * (1 - used))
    rest = rest.join(spread, "source_no", "left").withColumn("prob", F.when(F.col("_missed").isNull(), F.col("prob")).otherwise(moved))
    rest = written(rest.select(*units.columns), "rest")
    return _settled_units(rest, bucket_rows).unionByName(landed)


def mix_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple = WEIGHTS,
    max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """Rows of equal (id, source, size) as one: ``doc_id, source, size, n, source_size, target, whole, extra``.

    Every one of the ``n`` rows is taken ``whole`` times, and ``extra`` of them once more.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    sizes = written(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    targets = source_targets(sizes, weights, max_repeat)
    share = F.when(F.col("size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share + F.lit(NEAR))
    owed = F.greatest(share - F.col("whole"), F.lit(0.0)) * F.col("n")
    placed = (
        sizes.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
        .drop("_source")
        .withColumn("whole", whole)
        .withColumn("_owed", owed)
        .withColumn("_sure", F.floor(F.col("_owed") + F.lit(NEAR)))
        .withColumn("_prob", F.greatest(F.col("_owed") - F.col("_sure"), F.lit(0.0)))
    )
    placed = written(placed.withColumn("_prob", F.when(F.col("_prob") < NEAR, 0.0).otherwise(F.col("_prob"))), "placed")
    units = placed.filter("_prob > 0").select(
        "source_no",
        F.col("doc_id").cast("string").alias("unit"),
        "size",
        F.col("_prob").alias("prob"),
        F.col("n_docs").alias("n_units"),
    )
    chosen = balanced_sample(units).select(
        F.col("source_no").alias("_no"), F.col("unit").alias("_id"), F.col("size").alias("_size"), F.col("prob").cast("long").alias("_chosen")
    )
    on = (
        F.col("doc_id").cast("string").eqNullSafe(F.col("_id")) & (F.col("source_no") == F.col("_no")) & (F.col("size") == F.col("_size"))
    )
    return placed.join(chosen, on, "left").select(
        "doc_id", "source", "size", "n", "source_size", "target", "whole",
        (F.col("_sure") + F.coalesce("_chosen", F.lit(0))).alias("extra"),
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """One row per input row: ``doc_id, source, size, source_size, target, taken``; options as :func:`mix_groups`.

    Size counts runs of anything but ASCII white space, 0 for a null text. ``taken`` is ``size`` times
    the repeats of the row. A null source is a source of its own, the last; a null id is an id; other
    columns are ignored; of repeated rows some may be taken once more than the others. Runs agree,
    whatever the partitioning. An empty table gives no rows.
    """
    groups = mix_groups(docs, **options)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    return groups.withColumn("_copy", copy).select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("size") * (F.col("whole") + (F.col("_copy") <= F.col("extra")).cast("long"))).alias("taken"),
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as :func:`mix` takes it, all columns kept."""
    groups = written(mix_groups(docs, id_col, source_col, text_col, **options), "mix")
    taken = groups.filter("whole > 0 or extra > 0").select(
        F.col("doc_id").alias("id"), F.col("source").alias("of"), F.col("size").alias("words"), "whole", "extra", "n"
    )
    own = beside(docs, own_id=F.col(id_col), own_source=F.col(source_col), own_size=word_count(F.col(text_col)), text=F.col(text_col))
    on = F.col("own_id").eqNullSafe(F.col("id")) & F.col("own_source").eqNullSafe(F.col("of")) & (F.col("own_size") == F.col("words"))
    joined = own.join(taken.hint("merge"), on)  # grows with the documents, so it is never broadcast
    extra = F.col("extra")
    if not groups.filter("n > 1").isEmpty():
        place = F.row_number().over(Window.partitionBy("id", "of", "words").orderBy(F.xxhash64("text")))
        extra = (place <= F.col("extra")).cast("long")
    copies = joined.withColumn("copies", (F.col("whole") + extra).cast("int")).filter("copies > 0")
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")
