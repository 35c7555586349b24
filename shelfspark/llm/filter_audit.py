"""How filters interact: what each removes in every order, and its Shapley share, from the potential of a game.

Per part of the corpus the game is v(S): documents that a coalition S of filters removes, i.e. that
fail at least one of them. All that is needed of the documents are counts by set of failed filters.

The potential of Hart and Mas-Colell is P(S) = (v(S) + sum over i in S of P(S without i)) / |S|, P of no
filter being 0; a filter's Shapley value is P(all) - P(all without it). Scaled by |all|! every P(S) is a
whole number. A step of an order removes v(before and this) - v(before).

Filters of one text are column expressions. The filter on repeated texts compares digests: the smallest
id of each text that occurs more than once meets narrow rows (digest, id) only, never texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE = " \t\n\x0b\f\r"
BETWEEN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = r"[#$%&*|]"
MIN_WORDS = 50
MIN_DISTINCT = 65
MAX_UPPER = 5
FILTERS = "ABCDE"
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS)


def text_filters(text: Column) -> dict[str, Column]:
    """Failure conditions A to D of one text that is not null."""
    trimmed = F.btrim(text, F.lit(WHITE))
    words = F.split(trimmed, BETWEEN)
    n_words = F.when(trimmed == "", 0).otherwise(F.size(words))
    n_distinct = F.when(trimmed == "", 0).otherwise(F.size(F.array_distinct(words)))
    n_upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n_words < MIN_WORDS,
        "B": n_distinct.cast("bigint") * 100 < n_words.cast("bigint") * MIN_DISTINCT,
        "C": n_upper.cast("bigint") * 100 > F.length(text).cast("bigint") * MAX_UPPER,
        "D": text.rlike(SYMBOLS),
    }


def failures(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """``(part, doc_id, mask)``: bit k of ``mask`` is set where the document fails filter k."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    plain = docs.select(
        F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{id_col}`").alias("doc_id"), text.alias("text")
    )
    bits = [F.when(fails, 1 << k).otherwise(0) for k, fails in enumerate(text_filters(F.col("text")).values())]
    mask = bits[0]
    for bit in bits[1:]:
        mask = mask + bit
    narrow = plain.select("part", "doc_id", mask.alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"))
    by_text = narrow.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    repeated = by_text.filter("n > 1 AND first_id IS NOT NULL").select("digest", "first_id")
    later = F.coalesce(F.col("doc_id") > F.col("first_id"), F.col("first_id").isNotNull() & F.col("doc_id").isNull())
    again = F.when(later, 1 << FILTERS.index("E")).otherwise(0)
    return narrow.join(repeated, "digest", "left").select("part", "doc_id", (F.col("mask") + again).alias("mask"))


def coalition_counts(failed: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per part: documents, good and toxic ones by mask, as three arrays of 2^filters counts."""
    judged = labels.groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(
        F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic")
    )
    rows = failed.join(judged, "doc_id", "left")
    sums = [F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("good", F.lit(0))).alias("good"), F.sum(F.coalesce("toxic", F.lit(0))).alias("toxic")]
    by_mask = rows.groupBy("part", "mask").agg(*sums)
    return by_mask.groupBy("part").agg(*[_by_mask(c).alias(c) for c in ("n", "good", "toxic")])


def _by_mask(count: str) -> Column:
    """Counts of all masks in order, 0 where no row has the mask."""
    known = F.map_from_entries(F.collect_list(F.struct("mask", count)))
    masks = F.sequence(F.lit(0), F.lit((1 << len(FILTERS)) - 1))
    return F.transform(masks, lambda m: F.coalesce(F.try_element_at(known, m), F.lit(0)))


def removals(by_mask: np.ndarray) -> list[int]:
    """v(S) for every coalition S, as a list by bit set: what fails at least one filter of S."""
    masks = np.arange(len(by_mask))
    return [int(by_mask[(masks & s) != 0].sum()) for s in range(len(by_mask))]


def potentials(v: list[int], n: int) -> list[int]:
    """n! P(S) for every coalition, each from those with one filter less; exact, as |S|! divides n!."""
    scaled = [0] * len(v)
    for s in range(1, len(v)):
        members = [i for i in range(n) if s >> i & 1]
        scaled[s] = (factorial(n) * v[s] + sum(scaled[s ^ (1 << i)] for i in members)) // len(members)
    return scaled


def steps_of_part(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> list[tuple]:
    """Rows (filter_order, step, counts...) of all orders of one part."""
    v, v_good, v_toxic = removals(n), removals(good), removals(toxic)
    total, whole = int(n.sum()), len(n) - 1
    scaled = potentials(v, len(FILTERS))
    shapley = [scaled[whole] - scaled[whole ^ (1 << i)] for i in range(len(FILTERS))]
    alone = [v[whole] - v[whole ^ (1 << i)] for i in range(len(FILTERS))]
    rows = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, start=1):
            after = before | 1 << i
            removed = v[after] - v[before]
            lost = v_good[after] - v_good[before], v_toxic[after] - v_toxic[before]
            rows.append((name, step, total - v[after], removed, v[1 << i] - removed, alone[i], *lost, shapley[i]))
            before = after
    return rows


def audit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source"
) -> DataFrame:
    """One row per part, order of the five filters and step, with what the filter removes there.

    A null text is empty; a null part is the empty string and joins it. Among rows of one text, all but those
    with the smallest id fail E (a null id counts as the largest; rows that share the smallest id pass). Several labels of one id count
    as good or toxic where one of them is; a null label is neither; ``shapley`` is over all orders, i.e.
    120 times the value. Other columns take no part. No documents: no rows.
    """
    counts = coalition_counts(failures(docs, id_col, text_col, part_col), labels, id_col)

    def expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, *arrays in batch[["part", "n", "good", "toxic"]].itertuples(index=False):
                rows = pd.DataFrame(steps_of_part(*map(np.asarray, arrays)), columns=["filter_order", "step", *COUNTS])
                rows.insert(0, "part", part)
                yield rows

    return counts.mapInPandas(expanded, SCHEMA)
