"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints are 64 bits; two are linked when at most ``radius`` bits differ. Candidate search
uses the covering construction: bit ``i`` gets a non-zero vector m(i) of radius + 1 bits, and for
every non-zero vector v one table hashes the bits with an odd inner product <m(i), v>. Differing
in at most ``radius`` bits leaves some v orthogonal to all of their vectors, so every linked pair
agrees on the whole key of that table: no false negatives.

Copies share a fingerprint and are folded first. Inside a bucket no pairs are formed. Two
fingerprints that agree on a table's bits and differ in at most two others meet in a value
that is at most one flipped bit away from both, so each candidate names itself and its flips of
the bits left free. A value has at most 65 neighbours, hence groups are bounded whatever the data.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfspark.llm.components import components
from shelfspark.llm.scratch import beside, written

SEED = 42
BITS = 64
RADIUS = 2
SHINGLE = 3
CHUNK = 1 << 16


def fingerprint_of(hashes: np.ndarray) -> int:
    """Unsigned 64-bit SimHash of shingle hashes, repeats included; 0 where there is none."""
    counts = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text; 0 where it has no word.

    A-Z are lowered, words are runs of anything but ASCII white space, shingles keep repeats.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    if len(words) < shingle:
        words = [b" ".join(words)]
        shingle = 1
    n = len(words) - shingle + 1
    digest, counts = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : min(at + CHUNK, n) + shingle - 1]
        rows = zip(*(part[k:] for k in range(shingle)), strict=False)
        hashes = np.array([digest(b" ".join(row), SEED) for row in rows], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(
            axis=0, dtype=np.int64
        )
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """:func:`text_fingerprint` as a column; the bits of the unsigned value in a long."""

    @F.pandas_udf(T.LongType())
    def hashed(texts: pd.Series) -> pd.Series:
        values = np.array([text_fingerprint(x, shingle) for x in texts], dtype=np.uint64)
        return pd.Series(values.view(np.int64))

    return hashed.asNondeterministic()(text)


def hex_digits(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 masks of the construction, as signed 64-bit values."""
    size = 1 << (radius + 1)
    vectors = [1 + i % (size - 1) for i in range(BITS)]
    masks = [sum(((m & v).bit_count() & 1) << i for i, m in enumerate(vectors)) for v in range(1, size)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def linked_fingerprints(classes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``classes(fp)``, distinct, to edges ``(a, b)`` that connect exactly what pairs within ``radius`` connect.

    Radius 1 or 2: the meeting points are exact for both (radius 1 meets in the fingerprints themselves).
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    tables = F.array(*[F.lit(m).cast("long") for m in covering_masks(radius)])
    hashed = classes.select("fp", F.explode(tables).alias("mask")).select(
        "fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key")
    )
    shared = written(hashed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    free = (
        hashed.join(shared.select("mask", "key"), ["mask", "key"])
        .groupBy("fp")
        .agg(F.bit_or(F.bitwise_not(F.col("mask"))).alias("free"))
    )
    flips = F.expr(f"transform(sequence(0, {BITS - 1}), i -> shiftleft(1L, i))")
    near = F.transform(F.filter(flips, lambda b: F.col("free").bitwiseAND(b) != 0), lambda b: F.col("fp").bitwiseXOR(b))
    around = free.select("fp", F.explode(F.concat(F.array("fp"), near)).alias("point"))
    if radius == 1:
        own = classes.select(F.col("fp").alias("point"))
        return around.filter("fp <> point").join(own, "point").select(F.col("fp").alias("a"), F.col("point").alias("b"))
    met = around.groupBy("point").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    return met.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """One row ``(doc_id, fp, component_id)`` per input row; ``component_id`` is the smallest id reachable.

    Other columns of ``docs`` are ignored, whatever their names. A null or blank text has fingerprint
    zero and links like any other. Repeated rows stay repeated. A null id takes part but is never a
    component id unless the whole component has none. An empty table gives no rows.
    """
    hashed = docs.select(F.col(id_col).alias("doc_id"), fingerprint(F.col(text_col), shingle).alias("fp"))
    prints = written(hashed, "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(linked_fingerprints(classes, radius)).withColumnRenamed("id", "fp")
    linked = written(roots.join(classes, "fp"), "linked")
    smallest = written(linked.groupBy("root").agg(F.min("first_id").alias("smallest_id")), "smallest")
    reached = linked.join(smallest, "root").select("fp", "smallest_id")
    labelled = written(
        classes.join(reached, "fp", "left").select("fp", F.coalesce("smallest_id", "first_id").alias("component_id")),
        "labelled",
    )
    return prints.join(labelled, "fp").select("doc_id", "fp", "component_id")


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE
) -> DataFrame:
    """The rows of ``docs`` with the smallest id of each component, all columns kept.

    Of rows that repeat the same id and fingerprint one stays. Components without any id keep one row
    per fingerprint.
    """
    found = written(near_duplicates(docs, id_col, text_col, radius, shingle), "components")
    least = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).filter("doc_id is not null")
    without = found.filter("component_id is null").select("component_id", "fp").distinct()
    kept = least.groupBy("component_id").agg(F.min("fp").alias("fp")).unionByName(without)
    kept = written(kept.select(F.col("component_id").alias("kept_id"), F.col("fp").alias("kept_fp")), "kept")
    ids_unique = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty()
    same_id = F.col("id").eqNullSafe(F.col("kept_id"))
    if ids_unique:
        return beside(docs, id=F.col(id_col)).join(kept, same_id, "left_semi").select("row.*")
    marked = beside(docs, id=F.col(id_col), fp=fingerprint(F.col(text_col), shingle))
    joined = marked.join(kept, same_id & (F.col("fp") == F.col("kept_fp")))
    return joined.dropDuplicates(["kept_id", "kept_fp"]).select("row.*")
