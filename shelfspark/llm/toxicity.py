"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A document is the set of its hashed words, word pairs and pairs with one or two words between. Per
coordinate the proximal update keeps a gradient sum and a squared-gradient sum: frequent features
learn slowly, rare ones fast, and coordinates whose sum stays within the L1 bound are exactly zero,
so the model is a short list of weights.

Fitting uses a bounded labelled sample dealt over shards; each shard runs its own online passes in
its own task and the weights are averaged.
"""

from __future__ import annotations

import re
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.supervised import held_out, labelled_sample

SAMPLE = 24_000
SHARD_ROWS = 3000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
BITS = 20
ALPHA, BETA, L1, L2 = 3.0, 1.0, 8.0, 0.1
PASSES = 4
LEAST_WEIGHT = 1e-3
WORD = re.compile(r"[^\W_]+")
#: (gap between the two words, odd multipliers of their hashes)
PAIRS = [(1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9, 0x27D4EB2F165667C5), (3, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
ONE = 0xFF51AFD7ED558CCD
MAX_WORDS = 300_000


class Weights(NamedTuple):
    """Non-zero weights: at most 2^BITS, and by L1 far fewer, so they travel with the task."""

    index: np.ndarray
    value: np.ndarray
    bias: float


class Hasher:
    """Hashed features of a text; remembers the hashes of frequent words."""

    def __init__(self, bits: int = BITS):
        self.known: dict[str, int] = {}
        self.shift = np.uint64(64 - bits)

    def _hash(self, word: str) -> int:
        value = crc32(word.encode("utf-8", "surrogatepass")) + 1
        if len(self.known) < MAX_WORDS:
            self.known[word] = value
        return value

    def features(self, text: str | None) -> np.ndarray:
        """Feature numbers, with repeats."""
        words = WORD.findall(text.lower()) if text else []
        known, new = self.known.get, self._hash
        hashes = np.fromiter((known(w) or new(w) for w in words), dtype=np.uint64, count=len(words))
        parts = [hashes * np.uint64(ONE)]
        for gap, left, right in PAIRS:
            pair = hashes[:-gap] * np.uint64(left) + hashes[gap:] * np.uint64(right)
            parts.append((pair ^ (pair >> np.uint64(31))) * np.uint64(ONE))
        return (np.concatenate(parts) >> self.shift).astype(np.int64)


def fit_ftrl(documents: list[np.ndarray], labels: list[int], passes: int = PASSES, bits: int = BITS) -> Weights:
    """Online passes over documents given as arrays of distinct feature numbers."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = bias = 0.0

    def weights(at: np.ndarray | slice) -> np.ndarray:
        over = np.abs(z[at]) - L1
        return np.where(over > 0, -np.sign(z[at]) * over / ((BETA + np.sqrt(n[at])) / ALPHA + L2), 0.0)

    for _ in range(passes):
        for at, label in zip(documents, labels, strict=True):
            w = weights(at)
            slope = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -30, 30))) - label
            rate = (np.sqrt(n[at] + slope * slope) - np.sqrt(n[at])) / ALPHA
            z[at] += slope - rate * w
            n[at] += slope * slope
            rate = (np.sqrt(bias_n + slope * slope) - np.sqrt(bias_n)) / ALPHA
            bias_z += slope - rate * bias
            bias_n += slope * slope
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
    w = weights(slice(None))
    index = np.flatnonzero(w)
    return Weights(index, w[index], float(bias))


def average(models: list[Weights], shares: list[int], least: float = LEAST_WEIGHT) -> Weights:
    """Mean of models by the rows they saw; weights that average out to less than ``least`` go."""
    if not models:
        return Weights(np.zeros(0, np.int64), np.zeros(0), 0.0)
    index = np.unique(np.concatenate([m.index for m in models]))
    value = np.zeros(len(index))
    for m, share in zip(models, shares, strict=True):
        value[np.searchsorted(index, m.index)] += m.value * share / sum(shares)
    kept = np.abs(value) >= least
    return Weights(index[kept], value[kept], float(np.average([m.bias for m in models], weights=shares)))


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "toxic", folds: int = FOLDS, which: int = HELD_OUT,
    bound: int = SAMPLE, shard_rows: int = SHARD_ROWS,
) -> Weights:
    """Fit on at most ``bound`` labelled documents outside fold ``which``; without any, all weights are zero."""
    sample = labelled_sample(docs, labels, label_col, folds, which, bound, shard_rows)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], kind="stable")
        group = group.sample(frac=1, random_state=int(key[0]))  # labels may follow the order of ids
        hasher = Hasher()
        model = fit_ftrl([np.unique(hasher.features(x)) for x in group["text"]], group["label"].tolist())
        return pd.DataFrame({"shard": [key[0]], "n": [len(group)], "at": [model.index], "w": [model.value], "bias": [model.bias]})

    fitted = sample.groupBy("shard").applyInPandas(fit, "shard int, n long, at array<long>, w array<double>, bias double")
    rows = sorted(fitted.collect(), key=lambda r: r["shard"])  # one sparse model per shard; the sample bounds the shards
    models = [Weights(np.array(r["at"], np.int64), np.array(r["w"], float), r["bias"]) for r in rows]
    return average(models, [r["n"] for r in rows])


def probability(text: Column, model: Weights) -> Column:
    """Probability that a document is toxic, 0 to 1."""

    @F.pandas_udf(T.DoubleType())
    def scored(texts: pd.Series) -> pd.Series:
        dense, hasher = np.zeros(1 << BITS), Hasher()
        dense[model.index] = model.value
        out = np.empty(len(texts))
        for k, text in enumerate(texts):
            at = hasher.features(text)
            out[k] = dense[np.unique(at[dense[at] != 0])].sum() + model.bias
        return pd.Series(1 / (1 + np.exp(-np.clip(out, -700, 700))))

    return scored.asNondeterministic()(text)


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
    which: int = HELD_OUT, threshold: float = THRESHOLD, **options,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null or empty text has no feature and scores the bias alone. Labels are read from ``labels`` only, for
    documents outside fold ``which``; other columns are ignored. Repeated rows stay, a null id is never
    held out, empty tables give no rows, and without labels every score is 0.5.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    model = train(texts, labels, folds=folds, which=which, **options)
    scored = texts.select(
        "doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), probability(F.col("text"), model).alias("score")
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
