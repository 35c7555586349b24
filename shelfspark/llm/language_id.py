"""Language identification: script ranges, word scores and a Viterbi path with a switching penalty.

Per language the model holds hashed character n-gram counts of words and how much of its letters
each script has. A word's script leaves only the languages that use it; among these its n-grams
give a score per language. The best path over the words of a text pays ``SWITCH`` for every change
of language, so the path labels spans of mixed text; the language with the most letters is the
text's. Counting is a distributed sum over labelled texts, scoring a narrow pass over batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.scratch import sample_share
from shelfspark.llm.supervised import HASH_STEPS, fold, held_out

#: First code point of each run of Unicode blocks, and the script of its letters.
SCRIPT_RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Syriac"), (0x0750, "Arabic"), (0x0780, "Thaana"), (0x07C0, "Nko"),
    (0x0800, "Other"), (0x08A0, "Arabic"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"),
    (0x0A80, "Gujarati"), (0x0B00, "Oriya"), (0x0B80, "Tamil"), (0x0C00, "Telugu"), (0x0C80, "Kannada"),
    (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"), (0x0F00, "Tibetan"),
    (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1780, "Khmer"), (0x1800, "Mongolian"), (0x18B0, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"),
    (0x2000, "Latin"), (0x2C80, "Greek"), (0x2D00, "Georgian"), (0x2D30, "Other"), (0x3040, "Hiragana"),
    (0x30A0, "Katakana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"), (0x31F0, "Katakana"),
    (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Latin"), (0xFF66, "Katakana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x323B0, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_RANGES})
STARTS = np.array([start for start, _ in SCRIPT_RANGES])
SCRIPT_AT = np.array([SCRIPTS.index(name) for _, name in SCRIPT_RANGES])

UNKNOWN = "und"
SAMPLE = 20_000
FOLDS, HELD_OUT = 5, 0
BITS = 16
ORDERS = 3
LEAST_SHARE = 0.005
LEAST_SCORE = -4.0
SWITCH = 12.0
SMOOTHING = 0.5
BATCH_WORDS = 100_000
MAX_WORDS = 300_000
WORD = regex.compile(r"\p{L}[\p{L}\p{M}]*")
MIX = np.uint64(0x9E3779B97F4A7C15)
BEFORE, AFTER = "\x02", "\x03"


def scripts_of(words: list[str]) -> np.ndarray:
    """Number in ``SCRIPTS`` of each word's first letter."""
    first = np.fromiter((ord(w[0]) for w in words), dtype=np.int64, count=len(words))
    return SCRIPT_AT[np.searchsorted(STARTS, first, side="right") - 1]


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams (one to ``ORDERS`` letters, word ends included) and whole words; and the word of each."""
    codes = np.frombuffer("".join(BEFORE + w + AFTER for w in words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    codes = codes.astype(np.uint64)
    word = np.repeat(np.arange(len(words)), [len(w) + 2 for w in words])
    rolled, found, owner = np.zeros(len(codes), np.uint64), [], []
    for order in range(1, ORDERS + 1):
        rolled = (rolled[: len(codes) - order + 1] * MIX) + (codes[order - 1 :] + np.uint64(order)) * MIX
        rolled ^= rolled >> np.uint64(29)
        inside = word[: len(rolled)] == word[order - 1 :]
        found.append((rolled * MIX)[inside] >> np.uint64(64 - BITS))
        owner.append(word[: len(rolled)][inside])
    whole = np.fromiter((crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))
    found.append((whole * MIX) >> np.uint64(64 - BITS))
    owner.append(np.arange(len(words)))
    return np.concatenate(found).astype(np.int64), np.concatenate(owner)


class Model(NamedTuple):
    """Languages; log share of each n-gram per language; which languages each script leaves."""

    languages: list[str]
    log_share: np.ndarray
    allowed: np.ndarray


def fit(counts: pd.DataFrame) -> Model:
    """From rows (lang, kind, at, n): n-gram counts, and letters per script (kind ``script``)."""
    languages = sorted(set(counts["lang"]))
    number = {x: k for k, x in enumerate(languages)}
    of_gram = np.zeros((1 << BITS, len(languages)))
    of_script = np.zeros((len(SCRIPTS), len(languages)))
    for kind, into in (("gram", of_gram), ("script", of_script)):
        rows = counts[counts["kind"] == kind]
        into[rows["at"].to_numpy(np.int64), rows["lang"].map(number).to_numpy(np.int64)] = rows["n"]
    log_share = np.log(of_gram + SMOOTHING) - np.log(of_gram.sum(axis=0) + SMOOTHING * len(of_gram))
    allowed = of_script >= LEAST_SHARE * of_script.sum(axis=0)
    allowed &= of_script > 0
    allowed[~allowed.any(axis=1)] = True
    return Model(languages, log_share.astype(np.float32), allowed)


def word_scores(words: list[str], model: Model) -> np.ndarray:
    """Per word and language: 0 for the best language the script leaves, down to ``LEAST_SCORE``."""
    at, owner = grams(words)
    order = np.argsort(owner, kind="stable")
    starts = np.searchsorted(owner[order], np.arange(len(words)))
    total = np.add.reduceat(model.log_share[at[order]], starts, axis=0)
    total[~model.allowed[scripts_of(words)]] = -np.inf
    return np.maximum((total - total.max(axis=1, keepdims=True)) / ORDERS, LEAST_SCORE)


def best_path(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Language of each word on the path with the highest sum of scores less ``switch`` per change.

    Keeping the language of the highest total is best where no other gains more than ``switch`` over it in any stretch,
    nor two others more than that together in a first and a last stretch: m stretches elsewhere cost at least
    m changes, and m - 1 if that language has no stretch at all. That is tried first, on whole arrays.
    """
    n, k = scores.shape
    one = int(scores.sum(axis=0).argmax())
    gain = np.vstack([np.zeros(k), np.cumsum(scores - scores[:, [one]], axis=0)])
    inside = (gain - np.minimum.accumulate(gain, axis=0)).max()
    if inside <= switch and gain.max() + (gain[-1] - gain).max() <= switch:
        return np.full(n, one)
    best, back = scores[0].tolist(), []
    for row in scores[1:].tolist():
        top = max(best)
        leader, changed = best.index(top), top - switch
        back.append([leader if changed > b else j for j, b in enumerate(best)])
        best = [max(b, changed) + s for b, s in zip(best, row, strict=True)]
    path = [best.index(max(best))]
    for came in reversed(back):
        path.append(came[path[-1]])
    return np.array(path[::-1])


class Labeller:
    """Labels texts batch by batch; remembers the scores of frequent words."""

    def __init__(self, model: Model, switch: float = SWITCH):
        self.model, self.switch = model, switch
        self.known: dict[str, int] = {}
        self.scores = np.zeros((0, len(model.languages)))

    def paths(self, texts: Iterator[str | None]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Words of each text (in lower case) and the language number of each."""
        batch: list[list[str]] = []
        size = 0
        for text in texts:
            batch.append(WORD.findall(text.lower()) if text else [])
            size += len(batch[-1])
            if size >= BATCH_WORDS:
                yield from self._label(batch)
                batch, size = [], 0
        yield from self._label(batch)

    def _label(self, batch: list[list[str]]) -> Iterator[tuple[list[str], np.ndarray]]:
        if not self.model.languages:
            yield from ((words, np.full(len(words), -1)) for words in batch)
            return
        new: dict[str, int] = {}
        known, base = self.known.get, len(self.known)
        at = []
        for words in batch:
            ids = list(map(known, words))
            at.append([base + new.setdefault(w, len(new)) if k is None else k for k, w in zip(ids, words, strict=True)])
        scores = np.vstack([self.scores, word_scores(list(new), self.model)]) if new else self.scores
        if base + len(new) <= MAX_WORDS:
            self.known.update((w, base + k) for w, k in new.items())
            self.scores = scores
        for words, ids in zip(batch, at, strict=True):
            yield words, best_path(scores[ids], self.switch) if ids else np.zeros(0, np.int64)

    def verdict(self, words: list[str], path: np.ndarray) -> tuple[str, float]:
        """Language with the most letters on the path, and its share of the letters."""
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        letters = np.bincount(path, weights=list(map(len, words)), minlength=len(self.model.languages))
        top = int(letters.argmax())
        return self.model.languages[top], float(letters[top] / letters.sum())


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS,
    which: int = HELD_OUT, bound: int = SAMPLE,
) -> Model:
    """Count over about ``bound`` documents with a text and a language outside fold ``which``, drawn by id hash."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.filter(F.col("lang").isNotNull() & (F.coalesce(fold(F.col("id"), folds), F.lit(-1)) != which))
    share = sample_share(rows.count(), bound)
    if share < 1.0:
        rows = rows.filter(F.pmod(F.xxhash64("id"), F.lit(HASH_STEPS)) < int(share * HASH_STEPS))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of_gram: dict[str, np.ndarray] = {}
        of_script: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"], strict=True):
                words = WORD.findall(text.lower()) if text else []
                for at in range(0, len(words), BATCH_WORDS):
                    part = words[at : at + BATCH_WORDS]
                    found = np.bincount(grams(part)[0], minlength=1 << BITS)
                    of_gram[lang] = of_gram.get(lang, 0) + found
                    letters = np.bincount(scripts_of(part), weights=list(map(len, part)), minlength=len(SCRIPTS))
                    of_script[lang] = of_script.get(lang, 0) + letters
        for kind, held in (("gram", of_gram), ("script", of_script)):
            for lang, n in held.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "kind": kind, "at": at, "n": n[at].astype(np.int64)})

    counts = rows.select("text", "lang").mapInPandas(counted, "lang string, kind string, at long, n long")
    return fit(counts.groupBy("lang", "kind", "at").agg(F.sum("n").alias("n")).toPandas())  # languages x 2^BITS rows


def _verdicts(text: Column, model: Model, switch: float) -> Column:
    @F.pandas_udf("lang_pred string, score double")
    def labelled(texts: pd.Series) -> pd.DataFrame:
        labeller = Labeller(model, switch)
        return pd.DataFrame([labeller.verdict(*x) for x in labeller.paths(iter(texts))], columns=["lang_pred", "score"])

    return labelled.asNondeterministic()(text)


def spans(text: Column, model: Model, switch: float = SWITCH) -> Column:
    """Stretches of one language: array of (start, end) in characters and ``lang``; empty without a letter."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))

    @F.pandas_udf(kind)
    def stretched(texts: pd.Series) -> pd.Series:
        labeller, out = Labeller(model, switch), []
        for text, (_, path) in zip(texts, labeller.paths(iter(texts)), strict=True):
            found: list[dict] = []
            for word, k in zip(WORD.finditer(text or ""), path, strict=False):
                lang = model.languages[k] if k >= 0 else UNKNOWN
                if found and found[-1]["lang"] == lang:
                    found[-1]["end"] = word.end()
                else:
                    found.append({"start": word.start(), "end": word.end(), "lang": lang})
            out.append(found)
        return pd.Series(out, dtype=object)

    return stretched.asNondeterministic()(text)


def identify(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = FOLDS,
    which: int = HELD_OUT, bound: int = SAMPLE, switch: float = SWITCH,
) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score``.

    ``lang_pred`` is a language seen in training, or ``und`` with score 0 for a null text and one without a
    letter (or without any training row); ``score`` is its share of the letters. Languages are read only
    from rows outside fold ``which``; other columns are ignored. Repeated rows stay, null ids are
    never held out, an empty table gives no rows.
    """
    model = train(docs, id_col, text_col, lang_col, folds, which, bound)
    texts = docs.select(F.col(id_col).alias("doc_id"), _verdicts(F.col(text_col), model, switch).alias("_v"))
    return texts.select("doc_id", held_out(F.col("doc_id"), folds, which).alias("held_out"), "_v.lang_pred", "_v.score")
