"""SentencePiece ids of whole texts through a table of distinct chunks, and texts back from ids.

Where no piece of the model crosses from another character into a white-space marker, merging never
joins what stands before a marker with what follows, so a text can be cut before each run of markers
(and around line feeds, which no piece holds); its ids are those of its chunks in order.

1. The distinct chunks that repeat in a sample of about ``SAMPLE`` documents at most are counted, and the most frequent
   ones, at most ``MAX_HOT`` of at most ``HOT_CHARS`` characters, are segmented once each: a table (chunk, ids).
2. Every task has that table and joins the ids to a text's chunks by position. A chunk outside the table is
   segmented once for its text and remembered by the worker, as long as it remembers fewer than
   ``MAX_REMEMBERED``. The sample decides only by which way a chunk gets its ids, never which ids.

Nothing of a document is shuffled. (Sending the rare chunks to where equal ones meet and their ids back to the
texts segments each only once in all, but moves more bytes than it saves work; figures in the README.) A model
of another kind than checked in :class:`Cutter` makes each text one chunk, so its ids stay right.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.scratch import sample_share, written

MARK, LINE = "▁", "\n"
BPE = 2
SEED = 42
SAMPLE = 65_536
MAX_HOT = 250_000
HOT_CHARS = 64
MAX_COUNTED = 150_000
CALL_CHUNKS = 50_000
CALL_CHARS = 1 << 21
LEVELS = 8
MAX_REMEMBERED = 100_000


class Cutter:
    """One model: how its texts are cut, the ids of a chunk, and the text of ids."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        self.model = SentencePieceProcessor(model_file=path)
        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(self.model.serialized_model_proto())
        form, kind = spec.normalizer_spec, spec.trainer_spec
        spaces = form.add_dummy_prefix and form.escape_whitespaces and not form.remove_extra_whitespaces
        plain = spaces and not form.precompiled_charsmap and not kind.treat_whitespace_as_suffix
        crossing = any(MARK in p.piece.lstrip(MARK) or LINE in p.piece for p in spec.pieces)
        self.cuts = plain and kind.model_type == BPE and kind.byte_fallback and not crossing
        self.end = self.model.eos_id()

    def cut(self, text: str) -> list[str]:
        """The chunks of a text in order.

        A plain word stands for one marker and the word; a chunk that begins with a line feed for itself; spaces
        alone for as many markers; spaces and a word for one marker more.
        """
        if not text:
            return []
        if not self.cuts:
            return [text]
        parts = text.replace(MARK, " ").replace(LINE, " \n").split(" ")
        if "" not in parts:
            return parts
        chunks, gap = [], 0
        for part in parts:
            if not part:
                gap += 1
            elif part[0] == LINE:
                if gap:
                    chunks.append(" " * gap)
                chunks.append(part)
                gap = 0
            else:
                chunks.append(" " * gap + part)
                gap = 0
        return [*chunks, " " * gap] if gap else chunks

    def ids(self, chunks: list[str]) -> list[list[int]]:
        """Ids of each chunk. A line feed in front keeps the model's own marker out; both ids are cut off again."""
        if not self.cuts:
            return self.model.encode(chunks, num_threads=1)
        spelled = [LINE + (x if x[0] == LINE or not x.strip(" ") else " " + x) for x in chunks]
        return [ids[2:] for ids in self.model.encode(spelled, num_threads=1)]

    def text(self, ids: list[int]) -> str:
        return self.model.decode(ids)


@lru_cache(maxsize=2)
def cutter(path: str) -> Cutter:
    """One model per worker process and file."""
    return Cutter(path)


@lru_cache(maxsize=2)
def remembered(path: str) -> dict[str, bytes]:
    """Packed ids of the rare chunks that a worker process has segmented."""
    return {}


def packed(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _segmented(chunks: list[str], model: str) -> list[bytes]:
    ids_of, out = cutter(model).ids, []
    for at in _calls(chunks):
        out += map(packed, ids_of(chunks[at]))
    return out


def _calls(chunks: list[str]) -> Iterator[slice]:
    """Slices of bounded length and bounded characters (one longer chunk is a slice of its own)."""
    start, chars = 0, 0
    for k, chunk in enumerate(chunks):
        if k > start and (k - start >= CALL_CHUNKS or chars + len(chunk) > CALL_CHARS):
            yield slice(start, k)
            start, chars = k, 0
        chars += len(chunk)
    if start < len(chunks):
        yield slice(start, len(chunks))


def frequent_chunks(texts: DataFrame, model: str, most: int, sample: int) -> dict[str, bytes]:
    """Short chunks that repeat in the sample, and their ids: all above the smallest level of frequency that
    leaves at most ``most``."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cut, counts = cutter(model).cut, Counter()
        for batch in batches:
            for text in batch["text"]:
                counts.update(cut(text))
                if len(counts) >= MAX_COUNTED:
                    yield pd.DataFrame({"chunk": list(counts.keys()), "n": list(counts.values())})
                    counts = Counter()
        if counts:
            yield pd.DataFrame({"chunk": list(counts.keys()), "n": list(counts.values())})

    def segmented(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(ids=_segmented(batch["chunk"].tolist(), model))

    share = sample_share(texts.count(), sample)
    some = texts.select("text") if share == 1.0 else texts.select("text").sample(share, seed=SEED)
    total = some.mapInPandas(counted, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n"))
    short = total.filter((F.col("n") > 1) & (F.length("chunk") <= HOT_CHARS)).withColumn("level", F.floor(F.log2("n") * LEVELS))
    table = written(short.select("level", "chunk", "n").mapInPandas(segmented, "level bigint, chunk string, n bigint, ids binary"), "chunks")
    left, least = most, None
    for level, chunks in sorted(map(tuple, table.groupBy("level").agg(F.count(F.lit(1))).collect()), reverse=True):
        left -= chunks
        if left < 0:
            break
        least = level
    if least is None:
        return {}
    rows = table.filter(F.col("level") >= least).select("chunk", "ids").collect()
    return {r["chunk"]: bytes(r["ids"]) for r in rows}


def _encoded(text: Column, model: str, table: Broadcast, ends: list[int]) -> Column:
    @F.pandas_udf("array<int>")
    def looked_up(texts: pd.Series) -> pd.Series:
        cut, known, rare, tail = cutter(model).cut, table.value.get, remembered(model), packed(ends)
        out = []
        for text in texts:
            chunks = cut(text)
            ids = list(map(known, chunks))
            if None in ids:
                others = {x for x, found in zip(chunks, ids, strict=True) if found is None}
                own = {x: rare[x] for x in others if x in rare}
                new = list(others - own.keys())
                own.update(zip(new, _segmented(new, model), strict=True))
                if len(rare) < MAX_REMEMBERED:
                    rare.update((x, own[x]) for x in new if len(x) <= HOT_CHARS)
                ids = [own[x] if found is None else found for x, found in zip(chunks, ids, strict=True)]
            out.append(np.frombuffer(b"".join(ids) + tail, "<i4"))
        return pd.Series(out, dtype=object)

    return looked_up(text)


def encode(
    docs: DataFrame, model: str, text_col: str = "text", end: bool = True, max_hot: int = MAX_HOT, sample: int = SAMPLE
) -> DataFrame:
    """``docs`` with the column ``ids`` (array<int>) in place of the text.

    The ids are those of ``SentencePieceProcessor(model).encode(text)``, with the model's end id where ``end`` is set.
    A null text counts as empty and has that id only. Repeated rows and ids stay as they are; other columns are
    carried along under any name, except that one called ``ids`` gives way. An empty table gives no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    kept = [c for c in docs.columns if c not in (text_col, "ids")]
    frequent = frequent_chunks(docs.select(text.alias("text")), model, max_hot, sample)
    table = docs.sparkSession.sparkContext.broadcast(frequent)
    ends = [cutter(model).end] if end else []
    return docs.select(*[F.col(f"`{c}`") for c in kept], _encoded(text, model, table, ends).alias("ids"))


def decode(ids: Column, model: str) -> Column:
    """The text of an array of ids, as ``SentencePieceProcessor(model).decode(ids)`` gives it; null stays null."""

    @F.pandas_udf(T.StringType())
    def decoded(arrays: pd.Series) -> pd.Series:
        text_of: Callable[[list[int]], str] = cutter(model).text
        return pd.Series([None if a is None else text_of(a.tolist()) for a in arrays], dtype=object)

    return decoded.asNondeterministic()(ids)


def digests(ids: Column, model: str) -> Column:
    """The number of ids, and the SHA-256 in hexadecimal digits of the decimal ids one space apart and of the decoded text.

    Taken on the column of :func:`encode` alone, both run in one worker and the ids never leave it.
    """

    @F.pandas_udf("n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    def digested(arrays: pd.Series) -> pd.DataFrame:
        text_of, rows = cutter(model).text, []
        for array in arrays:
            plain = array.tolist()
            decimal = " ".join(map(str, plain)).encode()
            rows.append((len(plain), sha256(decimal).hexdigest(), sha256(text_of(plain).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digested(ids)
