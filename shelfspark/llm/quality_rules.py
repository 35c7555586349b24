"""Quality rules with suffix-array repetition.

Every text becomes a sequence of words. A suffix array over the words of many texts at once (prefix
doubling, re-sorting only suffixes that are still tied) and its longest common prefixes give, for
each position, the lcp value of the deepest lcp interval that holds its suffix: the length of the
longest passage starting there that occurs again in the same text. The union of these passages is
the union of all maximal repeats; its share of the words and the longest repeat are limited.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.scratch import beside

#: Symbols that are counted, and ASCII white space.
SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
WINDOW = 3
MIN_REPEAT = 8
MAX_COVERED = 0.3
MAX_LONGEST = 0.25
BATCH_WORDS = 200_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... symbols; in the last all ranks differ.

    ``symbols`` are the sequences one after another, with different symbols in different sequences;
    ``ends`` is the end of the sequence of each position. A suffix that ends early sorts first.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    first = np.flatnonzero(np.r_[True, symbols[order][1:] != symbols[order][:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[first, n])
    rank = np.empty(n, dtype=np.int64)
    rank[order] = np.repeat(first, size)
    tied = order[np.repeat(size, size) > 1]  # in order of rank
    levels, step = [rank], 1
    while len(tied):
        after = tied + step
        inside = after < ends[tied]
        key = rank[tied] * (n + 1) + np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        by_key = np.argsort(key, kind="stable")
        tied, key = tied[by_key], key[by_key]
        old = rank[tied]
        at = np.arange(len(tied))
        new_group = np.r_[True, old[1:] != old[:-1]]
        new_part = np.r_[True, key[1:] != key[:-1]]
        group_at = np.maximum.accumulate(np.where(new_group, at, 0))
        part_at = np.maximum.accumulate(np.where(new_part, at, 0))
        rank = rank.copy()
        rank[tied] = old + part_at - group_at
        parts = np.flatnonzero(new_part)
        sizes = np.diff(np.r_[parts, len(tied)])
        tied = tied[np.repeat(sizes, sizes) > 1]
        levels.append(rank)
        step *= 2
    return levels


def longest_repeats(symbols: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per position the length of the longest passage from there that occurs elsewhere in its sequence."""
    n = len(symbols)
    levels = suffix_ranks(symbols, ends)
    suffixes = np.empty(n, dtype=np.int64)
    suffixes[levels[-1]] = np.arange(n)
    left, right = suffixes[:-1], suffixes[1:]
    pair = np.flatnonzero(levels[0][left] == levels[0][right])
    a, b = left[pair], right[pair]
    common = np.zeros(len(pair), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        at_a, at_b = a + common, b + common
        inside = (at_a < ends[a]) & (at_b < ends[b])
        rank = levels[level]
        same = inside & (rank[np.where(inside, at_a, 0)] == rank[np.where(inside, at_b, 0)])
        common += same.astype(np.int64) << level
    longest = np.zeros(n, dtype=np.int64)
    np.maximum.at(longest, a, common)
    np.maximum.at(longest, b, common)
    return longest


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a repeat of at least ``least`` symbols."""
    starts = np.flatnonzero(longest >= least)
    change = np.bincount(starts, minlength=len(longest) + 1) - np.bincount(
        starts + longest[starts], minlength=len(longest) + 1
    )
    return np.cumsum(change[:-1]) > 0


def _line_counts(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    return len(lines) - len(set(lines))


def _batches(texts: Iterator[str | None]) -> Iterator[list[tuple[str, list[bytes]]]]:
    batch, size = [], 0
    for text in texts:
        text = text or ""
        words = text.encode("utf-8", "surrogatepass").split()
        if size and size + len(words) > BATCH_WORDS:
            yield batch
            batch, size = [], 0
        batch.append((text, words))
        size += len(words)
    if batch:
        yield batch


def text_counts(texts: Iterator[str | None], min_repeat: int = MIN_REPEAT) -> Iterator[np.ndarray]:
    """A row of ``COUNTS`` per text, in batches of a bounded number of words (or one text)."""
    for batch in _batches(texts):
        out = np.zeros((len(batch), len(COUNTS)), dtype=np.int64)
        sizes = np.array([len(words) for _, words in batch])
        for k, (text, words) in enumerate(batch):
            out[k, 0] = len(words)
            out[k, 1] = len(text) - sum(map(text.count, BLANKS))
            out[k, 2] = sum(map(text.count, SYMBOLS))
            out[k, 3] = _line_counts(text)
        if n := int(sizes.sum()):
            number: dict[bytes, int] = {}
            ids = np.fromiter((number.setdefault(w, len(number)) for _, words in batch for w in words), np.int64, n)
            doc = np.repeat(np.arange(len(batch)), sizes)
            ends = np.repeat(np.cumsum(sizes), sizes)
            longest = longest_repeats(doc * len(number) + ids, ends)
            out[:, 4] = np.bincount(doc[covered(longest, WINDOW)], minlength=len(batch))
            out[:, 5] = np.bincount(doc[covered(longest, min_repeat)], minlength=len(batch))
            np.maximum.at(out[:, 6], doc, longest)
        yield out


def counts(text: Column, min_repeat: int = MIN_REPEAT) -> Column:
    """The counts of a text as a struct of longs."""

    @F.pandas_udf(", ".join(f"{c} long" for c in COUNTS))
    def counted(texts: pd.Series) -> pd.DataFrame:
        rows = [*text_counts(iter(texts), min_repeat)]
        return pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, len(COUNTS)), np.int64), columns=COUNTS)

    return counted.asNondeterministic()(text)


def _failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def _kept(c: Column, max_covered: float, max_longest: float) -> Column:
    repetitive = (c["n_covered_words"] > max_covered * c["n_words"]) | (
        (c["longest_repeat"] >= MIN_REPEAT) & (c["longest_repeat"] > max_longest * c["n_words"])
    )
    return ~_failed(c) & ~repetitive


def assess(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_covered: float = MAX_COVERED,
    max_longest: float = MAX_LONGEST,
    min_repeat: int = MIN_REPEAT,
) -> DataFrame:
    """One row per input row: ``doc_id``, the counts, ``base_failed`` and ``kept``.

    Words are runs of anything but ASCII white space. A null, empty or blank text has counts of zero
    and fails. Other columns are ignored, repeated rows stay, null ids pass through, an empty table
    gives no rows. Rejected beyond the base rules: more than ``max_covered`` of the words in repeats
    of ``min_repeat`` words or more, or one repeat longer than ``max_longest`` of the words.
    """
    c = F.col("_c")
    counted = docs.select(F.col(id_col).alias("doc_id"), counts(F.col(text_col), min_repeat).alias("_c"))
    return counted.select(
        "doc_id", *[c[k].alias(k) for k in COUNTS],
        _failed(c).alias("base_failed"), _kept(c, max_covered, max_longest).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", max_covered: float = MAX_COVERED, max_longest: float = MAX_LONGEST) -> DataFrame:
    """The rows that :func:`assess` keeps, all columns kept."""
    counted = beside(docs, counts=counts(F.col(text_col)))
    return counted.filter(_kept(F.col("counts"), max_covered, max_longest)).select("row.*")
