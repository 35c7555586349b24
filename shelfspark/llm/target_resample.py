"""Resampling of documents towards a target distribution of hashed word n-grams.

A text is lower-cased (A-Z only) and everything between words collapses to single spaces. One overlapped
pattern per n-gram length, held between spaces or the ends by lookarounds, then gives the span of every
n-gram, and the CRC-32 of its bytes gives its bucket. Each document is scanned once; its bucket counts
are written as arrays, so the corpus counts and the weights come from numbers alone.

The gain of a bucket says how much more frequent it is in the target than in the corpus; a document's
weight is the sum over its features. Adding Gumbel noise that is fixed by the document's id and taking
the highest scores draws without replacement in proportion to exp(weight).
"""

from __future__ import annotations

import math
import zlib
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.scratch import written
from shelfspark.operators.skew import globally_numbered

BUCKETS = 10_000
SCALE = 1000
SEED = 2024
MAX_REMEMBERED = 400_000
#: Fixed values of the contract: what a word is made of, once A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
BETWEEN = regex.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=8)
def span_pattern(n: int) -> regex.Pattern:
    """``n`` words one space apart that begin and end at a space or an end of the text."""
    return regex.compile(rf"(?<![^ ]){WORD}+(?: {WORD}+){{{n - 1}}}(?![^ ])")


def collapsed(text: str | None) -> str:
    return BETWEEN.sub(" ", text.translate(LOWER)).strip(" ") if text else ""


class Buckets(dict):
    """Bucket by feature; those seen first are remembered."""

    def __init__(self, n_buckets: int):
        super().__init__()
        self.n_buckets = n_buckets

    def __missing__(self, feature: str) -> int:
        bucket = zlib.crc32(feature.encode("utf-8", "surrogatepass")) % self.n_buckets
        if len(self) < MAX_REMEMBERED:
            self[feature] = bucket
        return bucket


def feature_buckets(line: str, least: int, most: int, bucket: Buckets) -> list[int]:
    """The bucket of each run of ``least`` to ``most`` words of a collapsed text, repeats included."""
    out: list[int] = []
    for n in range(least, most + 1):
        out += [bucket[line[m.start() : m.end()]] for m in span_pattern(n).finditer(line, overlapped=True)]
    return out


def _scanned(text: Column, least: int, most: int, n_buckets: int) -> Column:
    @F.pandas_udf("n_words bigint, n_features bigint, buckets array<int>, counts array<bigint>")
    def scan(texts: pd.Series) -> pd.DataFrame:
        bucket, rows = Buckets(n_buckets), []
        for text in texts:
            line = collapsed(text)
            found = np.array(feature_buckets(line, least, most, bucket), dtype=np.int32)
            buckets, counts = np.unique(found, return_counts=True)
            rows.append((line.count(" ") + 1 if line else 0, len(found), buckets, counts.astype(np.int64)))
        return pd.DataFrame(rows, columns=["n_words", "n_features", "buckets", "counts"])

    return scan.asNondeterministic()(text)


def bucket_counts(scanned: DataFrame, n_buckets: int) -> np.ndarray:
    """How often each bucket occurs in all rows; at most ``n_buckets`` sums reach the driver."""
    pairs = scanned.select(F.inline(F.arrays_zip(F.col("s.buckets").alias("bucket"), F.col("s.counts").alias("n"))))
    counts = np.zeros(n_buckets, np.int64)
    for row in pairs.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> list[int]:
    """Scaled log ratio of each bucket's smoothed shares, rounded down."""
    all_corpus, all_target, n = int(corpus.sum()), int(target.sum()), len(corpus)
    return [
        math.floor(SCALE * math.log((t + 1) * (all_corpus + n) / ((s + 1) * (all_target + n))))
        for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ]


def _weight(buckets: Column, counts: Column, gain: list[int]) -> Column:
    by_bucket = np.array(gain, dtype=np.int64)

    @F.pandas_udf("bigint")
    def weigh(all_buckets: pd.Series, all_counts: pd.Series) -> pd.Series:
        return pd.Series([int(by_bucket[b] @ c) for b, c in zip(all_buckets, all_counts, strict=True)], dtype="int64")

    return weigh(buckets, counts)


def noise(doc_id: Column, seed: int) -> Column:
    """Scaled Gumbel noise from the first 32 bits of the SHA-256 of seed and id, rounded down."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    lengths: tuple[int, int] = (1, 1),
    n_buckets: int = BUCKETS,
    percent: int = 10,
    least_words: int = 20,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (all bigint) in place of the text.

    Of the documents with ``least_words`` words or more, ``percent`` in a hundred (rounded down) with the highest
    scores are drawn; ``rank`` is their place from 1 and null for all others. Ties go to the smaller id, a
    null id last (its noise is that of an empty id), then to more features; rows that agree in all
    of these are interchangeable. A null text has no words and weight 0. Columns of ``docs`` with a name of a
    result column give way. No documents: no rows; an empty target has T = 0.
    """
    kept = [c for c in docs.columns if c not in (text_col, "n_words", "n_features", "weight", "score", "rank")]
    carried = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    scan = _scanned(F.col(f"`{text_col}`"), *lengths, n_buckets)
    scanned = written(docs.select(carried.alias("row"), F.col(f"`{id_col}`").alias("id"), scan.alias("s")), "scanned")
    of_target = target.select(_scanned(F.col(f"`{target_text_col}`"), *lengths, n_buckets).alias("s"))
    gain = gains(bucket_counts(scanned, n_buckets), bucket_counts(of_target, n_buckets))
    weighed = scanned.select("row", "id", "s.n_words", "s.n_features", _weight(F.col("s.buckets"), F.col("s.counts"), gain).alias("weight"))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    takes_part = F.col("n_words") >= least_words
    order = [F.col("out"), F.desc("score"), F.asc_nulls_last("id"), F.desc("n_features")]
    placed = globally_numbered(scored.withColumn("out", ~takes_part), order, "place")
    drawn = scanned.agg(F.count_if(F.col("s.n_words") >= least_words).alias("n")).first()["n"] * percent // 100
    rank = F.when(takes_part & (F.col("place") <= drawn), F.col("place")).alias("rank")
    return placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(kept)], "n_words", "n_features", "weight", "score", rank)
