"""Held-out folds and bounded labelled samples for the fitted operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.llm.scratch import sample_share, written

HASH_STEPS = 1 << 30


def fold(id_col: Column, folds: int) -> Column:
    """Fold number of a row: crc32 of its id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds


def held_out(id_col: Column, folds: int, which: int) -> Column:
    return F.coalesce(fold(id_col, folds) == which, F.lit(False))


def bounded_ids(ids: DataFrame, bound: int) -> DataFrame:
    """At most ``bound`` rows of ``ids(doc_id, ...)``, those with the smallest hash of the id.

    A share by hash comes first, so that no task and not the driver sorts more than about twice the bound.
    """
    hashed = F.xxhash64(F.col("doc_id"))
    share = sample_share(ids.count(), 2 * bound)
    some = ids if share == 1.0 else ids.filter(F.pmod(hashed, F.lit(HASH_STEPS)) < int(share * HASH_STEPS))
    return some.orderBy(hashed, *ids.columns).limit(bound)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label_col: str, folds: int, which: int, bound: int, shard_rows: int,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, text, label, shard`` of at most ``bound`` labelled ids outside fold ``which``, one row each, dealt
    evenly over shards of about ``shard_rows`` rows.

    The ids are broadcast: ``bound`` is their proven size. Rows with a null label or id take no part; of
    differing labels of one id the largest counts, of differing texts the smallest.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(
        F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (fold(F.col("doc_id"), folds) != which)
    )
    chosen = bounded_ids(known.groupBy("doc_id").agg(F.max("label").alias("label")), bound)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    sample = written(found.select("doc_id", "text", "label"), "labelled")
    shards = max(1, sample.count() // shard_rows)
    place = F.row_number().over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))
    dealt = sample.select("doc_id", F.pmod(place, F.lit(shards)).cast("int").alias("shard"))
    return sample.join(F.broadcast(dealt), "doc_id").repartitionByRange(shards, "shard")
