"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Line scores use the line's own shape, that of its neighbours
and whether it repeats an earlier line; transitions tie neighbouring labels. Labels exist for
documents only, so fitting alternates: all lines of a bad document start as bad, later only those
the model finds bad, and at least its worst. Forward-backward gives each line's marginal, and the
length-weighted mean over a document is calibrated to the document label.

Fitting uses a bounded labelled sample dealt over shards; every shard fits its own field in its own
task and the parameters are averaged (mixture weights).
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.scratch import beside
from shelfspark.llm.supervised import held_out, labelled_sample

SAMPLE = 6000
SHARD_ROWS = 750
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
BLANKS = " \t\n\x0b\x0c\r"
MARKS = "#*$%&<>@~^=+\\{}[]"
BLOCK = 256
MAX_CELLS = 1 << 18
LEAST_BAD = 0.02
ROUNDS, STEPS, RATE, PENALTY = 3, 60, 0.3, 1e-3

OWN = ["bias", "short", "long", "word_length", "digits", "ends", "marks", "shouts", "bars", "capitals", "repeats", "doubled", "copy"]
SHARED = OWN[6:]  # also seen from the neighbouring lines
FEATURES = [*OWN, *[f"before_{x}" for x in SHARED], *[f"after_{x}" for x in SHARED]]


class Field(NamedTuple):
    """Line weights; gains for staying bad and for staying good; gain of a good first line; calibration."""

    weights: np.ndarray
    stay: np.ndarray
    first: float
    scale: float = 1.0
    shift: float = 0.0


def lines_of(text: str | None) -> list[str]:
    return [x for x in text.split("\n") if x.strip(BLANKS)] if text else []


def line_features(lines: list[str]) -> np.ndarray:
    """A row of ``FEATURES`` per line, all within 0 and 1."""
    own = np.zeros((len(lines), len(OWN)))
    seen: set[str] = set()
    for k, line in enumerate(lines):
        words = line.split() or [line]
        n, chars = len(words), len(line)
        own[k] = (
            1.0,
            n < 3,
            min(1.0, n / 200),
            min(1.0, chars / n / 20),
            min(1.0, 4 * sum(map(line.count, "0123456789")) / chars),
            line.rstrip()[-1:] in ".!?:;",
            min(1.0, sum(map(line.count, MARKS)) / n),
            min(1.0, 2 * line.count("!!") / n),
            min(1.0, 2 * line.count("|") / n),
            sum(map(str.isupper, words)) / n,
            1 - len(set(words)) / n,
            sum(map(eq, words, words[1:])) / n,
            line in seen,
        )
        seen.add(line)
    shape = own[:, -len(SHARED) :]
    none = np.zeros((min(1, len(lines)), len(SHARED)))
    return np.hstack([own, np.vstack([none, shape[:-1]]), np.vstack([shape[1:], none])])


def _padded(scores: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in scores])
    out = np.zeros((len(scores), sizes.max()))
    for k, s in enumerate(scores):
        out[k, : len(s)] = s
    return out, sizes


def forward_backward(scores: np.ndarray, sizes: np.ndarray, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """Of padded chains: the marginal of good per line, and the expected numbers of (stays bad, stays good)."""
    n, most = scores.shape
    bad_stay, good_stay = field.stay
    ahead = np.zeros((most, 2, n))
    ahead[0, 1] = scores[:, 0] + field.first
    for t in range(1, most):
        bad, good = ahead[t - 1]
        ahead[t, 0] = np.logaddexp(bad + bad_stay, good)
        ahead[t, 1] = np.logaddexp(bad, good + good_stay) + scores[:, t]
    back = np.zeros((most, 2, n))
    for t in range(most - 2, -1, -1):
        bad, good = back[t + 1, 0], back[t + 1, 1] + scores[:, t + 1]
        inside = t + 1 < sizes
        back[t, 0] = np.where(inside, np.logaddexp(bad + bad_stay, good), 0.0)
        back[t, 1] = np.where(inside, np.logaddexp(bad, good + good_stay), 0.0)
    whole = np.logaddexp(ahead[0, 0] + back[0, 0], ahead[0, 1] + back[0, 1])
    marginal = np.exp(np.minimum(0.0, ahead[:, 1] + back[:, 1] - whole)).T
    inside = np.arange(1, most)[:, None] < sizes
    stays_bad = np.exp(np.minimum(0.0, ahead[:-1, 0] + bad_stay + back[1:, 0] - whole))
    stays_good = np.exp(np.minimum(0.0, ahead[:-1, 1] + good_stay + scores.T[1:] + back[1:, 1] - whole))
    return marginal, np.array([stays_bad[inside].sum(), stays_good[inside].sum()])


def _blocks(features: list[np.ndarray]) -> list[list[int]]:
    """Numbers of the chains with a line, those of like length together: at most ``BLOCK`` chains and, padded to the
    longest, at most ``MAX_CELLS`` lines a block (a longer chain is a block of its own)."""
    blocks: list[list[int]] = []
    for k in sorted((k for k, f in enumerate(features) if len(f)), key=lambda k: len(features[k])):
        if not blocks or len(blocks[-1]) == BLOCK or (len(blocks[-1]) + 1) * len(features[k]) > MAX_CELLS:
            blocks.append([])
        blocks[-1].append(k)
    return blocks


def marginals(features: list[np.ndarray], field: Field) -> list[np.ndarray]:
    """Per chain (with a line) the marginals of good; chains of like length share a block."""
    out: list[np.ndarray] = [np.zeros(0)] * len(features)
    for block in _blocks(features):
        scores, sizes = _padded([features[k] @ field.weights for k in block])
        found, _ = forward_backward(scores, sizes, field)
        for k, row, size in zip(block, found, sizes, strict=True):
            out[k] = row[:size]
    return out


def fit_field(features: list[np.ndarray], labels: list[int]) -> Field:
    """Maximum likelihood by Adam steps, with the lines of bad documents relabelled between rounds."""
    blocks = _blocks(features)
    field = Field(np.zeros(len(FEATURES)), np.zeros(2), 0.0)
    if not blocks:
        return field
    stacked = [np.concatenate([features[k] for k in block]) for block in blocks]
    truth = [np.full(len(features[k]), float(labels[k])) for k in range(len(features))]
    n_lines = sum(map(len, stacked))
    theta = np.zeros(len(FEATURES) + 3)
    for turn in range(ROUNDS):
        if turn:
            found = marginals(features, field)
            for k in (k for block in blocks for k in block):
                if not labels[k]:
                    truth[k] = (found[k] > 0.5).astype(float)
                    truth[k][np.argmin(found[k])] = 0.0
        mean, spread = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            field = Field(theta[:-3], theta[-3:-1], float(theta[-1]))
            slope = -PENALTY * n_lines * theta
            for block, rows in zip(blocks, stacked, strict=True):
                sizes = np.array([len(features[k]) for k in block])
                cuts = np.cumsum(sizes)[:-1]
                scores, _ = _padded(np.split(rows @ field.weights, cuts))
                wanted, _ = _padded([truth[k] for k in block])
                found, stays = forward_backward(scores, sizes, field)
                inside = np.arange(scores.shape[1]) < sizes[:, None]
                pairs = inside[:, 1:]
                slope[:-3] += (wanted - found)[inside] @ rows
                slope[-3] += ((1 - wanted[:, 1:]) * (1 - wanted[:, :-1]))[pairs].sum() - stays[0]
                slope[-2] += (wanted[:, 1:] * wanted[:, :-1])[pairs].sum() - stays[1]
                slope[-1] += (wanted[:, 0] - found[:, 0]).sum()
            slope /= n_lines
            mean, spread = 0.9 * mean + 0.1 * slope, 0.99 * spread + 0.01 * slope**2
            theta = theta + RATE * (mean / (1 - 0.9**step)) / (np.sqrt(spread / (1 - 0.99**step)) + 1e-8)
    return Field(theta[:-3], theta[-3:-1], float(theta[-1]))


def good_share(texts: Iterator[str | None], field: Field) -> np.ndarray:
    """Length-weighted mean of the marginals of a text's lines; 0 without a line."""
    lines = [lines_of(x) for x in texts]
    found = marginals([line_features(x) for x in lines], field)
    return np.array([np.average(m, weights=[len(x) for x in own]) if own else 0.0 for own, m in zip(lines, found, strict=True)])


def fit_calibration(share: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression of the label on -log(bad share), by Newton steps with a small penalty."""
    if not len(share):
        return 1.0, 0.0
    x, theta = np.column_stack([-np.log(1 - share + LEAST_BAD), np.ones(len(share))]), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (label - p) - 0.01 * theta
        curve = (x.T * (p * (1 - p))) @ x + 0.01 * np.eye(2)
        theta = theta + np.clip(np.linalg.solve(curve, slope), -2, 2)
    return float(theta[0]), float(theta[1])


def _share_column(text: Column, field: Field) -> Column:
    @F.pandas_udf(T.DoubleType())
    def shared(texts: pd.Series) -> pd.Series:
        return pd.Series(good_share(iter(texts), field), dtype=float)

    return shared.asNondeterministic()(text)


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = FOLDS, which: int = HELD_OUT,
    bound: int = SAMPLE, shard_rows: int = SHARD_ROWS,
) -> Field:
    """Fit on at most ``bound`` labelled documents outside fold ``which``; without any, everything scores 0.5."""
    sample = labelled_sample(docs, labels, label_col, folds, which, bound, shard_rows)

    def fit(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["doc_id", "text"], kind="stable")
        features = [line_features(lines_of(x)) for x in group["text"]]
        field = fit_field(features, group["label"].tolist())
        theta = [*field.weights, *field.stay, field.first]
        return pd.DataFrame({"shard": [key[0]], "n": [len(group)], "theta": [[float(x) for x in theta]]})

    fitted = sample.groupBy("shard").applyInPandas(fit, "shard int, n long, theta array<double>").collect()
    fitted.sort(key=lambda r: r["shard"])
    if not fitted:
        return Field(np.zeros(len(FEATURES)), np.zeros(2), 0.0, 0.0, 0.0)
    theta = np.average([r["theta"] for r in fitted], axis=0, weights=[r["n"] for r in fitted])
    field = Field(theta[:-3], theta[-3:-1], float(theta[-1]))
    pairs = sample.select("doc_id", "label", _share_column(F.col("text"), field).alias("share")).collect()
    pairs.sort(key=lambda r: (r["doc_id"], r["share"]))
    scale, shift = fit_calibration(np.array([r["share"] for r in pairs]), np.array([float(r["label"]) for r in pairs]))
    return field._replace(scale=scale, shift=shift)


def quality(text: Column, field: Field) -> Column:
    """Probability that a document is good, 0 to 1."""
    evidence = -F.log(1 - _share_column(text, field) + LEAST_BAD)
    return 1 / (1 + F.exp(-(evidence * field.scale + field.shift)))


def score(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS,
    which: int = HELD_OUT, threshold: float = THRESHOLD, **options,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted``.

    A null, empty or blank text has no good line and scores as such. Labels are read from ``labels`` only,
    for documents outside fold ``which``; other columns are ignored. Repeated rows stay, a null id is never
    held out, empty tables give no rows, and without labels every score is 0.5.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    field = train(texts, labels, folds=folds, which=which, **options)
    scored = texts.select("doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), quality(F.col("text"), field).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """The rows of ``docs`` with a score of ``threshold`` or more, all columns kept."""
    field = train(docs, labels, **options)
    return beside(docs, score=quality(F.col(text_col), field)).filter(F.col("score") >= threshold).select("row.*")
