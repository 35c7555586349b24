"""Exact top-k search by distributed histogram selection.

Vectors are whole numbers, so scores are. Each pass scores every candidate against a block of
queries as matrix products inside the tasks and sums histograms of the scores over all tasks; the
bin with a query's k-th best score becomes its range in the next pass, until bins are one score
wide. A last pass keeps what reaches the k-th score; of equal scores each task needs its k smallest
ids only. No pairs are materialised; what is shuffled is a few bins per query and task.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.session import scratch_path

BINS = 1024
BLOCK_BYTES = 4 << 20
CELLS = 1 << 22
EXACT_FLOAT, EXACT_DOUBLE = 1 << 24, 1 << 53
WIDEST = 1 << 61


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) per component, as longs."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))


def usable(id_col: Column, vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return id_col.isNotNull() & vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


class Queries(NamedTuple):
    """A block of queries, sorted by id: ids, vectors (rows), and an upper bound of any score."""

    ids: np.ndarray
    vectors: np.ndarray
    most: int


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, cut or filled with zeros to ``width``."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(column.offsets.to_numpy())
    if (sizes == width).all():
        return values.reshape(len(column), width)
    out = np.zeros((len(column), width), dtype=np.int64)
    row, at = np.repeat(np.arange(len(column)), sizes), np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[row[at < width], at[at < width]] = values[at < width]
    return out


def scored(batches: Iterator[pa.RecordBatch], block: Queries) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per piece of the candidates: ids, scores (queries x candidates), which are a query's own row."""
    kind = np.float32 if block.most < EXACT_FLOAT else np.float64 if block.most < EXACT_DOUBLE else np.int64
    left = block.vectors.astype(kind)
    step = max(1, CELLS // len(block.ids))
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        right = matrix(batch.column(1), block.vectors.shape[1]).astype(kind)
        for at in range(0, len(ids), step):
            part = ids[at : at + step]
            own = np.zeros((len(block.ids), len(part)), dtype=bool)
            for column in np.flatnonzero(np.isin(part, block.ids)):
                own[np.searchsorted(block.ids, part[column]) : np.searchsorted(block.ids, part[column], "right"), column] = True
            yield part, left @ right[at : at + step].T, own


def _histogram(items: DataFrame, block: Queries, low: np.ndarray, span: int, width: int, need: np.ndarray) -> DataFrame:
    """``q, need, bin, n``: counts over all candidates, within ``span`` from ``low``, of the bins that can
    hold a query's ``need``-th best score."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_queries = len(block.ids)
        counts = np.zeros(n_queries * BINS, dtype=np.int64)
        first = (np.arange(n_queries) * BINS)[:, None]
        for _, scores, own in scored(batches, block):
            offset = scores.astype(np.int64) - low[:, None]
            inside = (offset >= 0) & (offset < span) & ~own
            counts += np.bincount((offset // width + first)[inside], minlength=len(counts))
        counts = counts.reshape(n_queries, BINS)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts
        q, at = np.nonzero((counts > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_pydict({"q": q, "need": need[q], "bin": at, "n": counts[q, at]})

    rows = items.mapInArrow(counted, "q long, need long, bin long, n long")
    return rows.groupBy("q", "need", "bin").agg(F.sum("n").alias("n"))


def kth_scores(items: DataFrame, block: Queries, k: int) -> np.ndarray:
    """Each query's k-th best score over all candidates; where there are fewer, a value below all scores."""
    n_queries = len(block.ids)
    low, need = np.full(n_queries, -block.most, dtype=np.int64), np.full(n_queries, k, dtype=np.int64)
    enough = np.zeros(n_queries, dtype=bool)
    width, first = 2 * block.most + 1, True
    while width > 1 or first:
        span, width = width, -(-width // BINS)
        down = Window.partitionBy("q").orderBy(F.col("bin").desc())  # at most BINS rows a query
        upto = _histogram(items, block, low, span, width, need).withColumn("upto", F.sum("n").over(down))
        for row in upto.filter("upto >= need and upto - n < need").collect():  # a row a query of the block
            enough[row["q"]] = True
            low[row["q"]] += row["bin"] * width
            need[row["q"]] -= row["upto"] - row["n"]
        first = False
    return np.where(enough, low, -block.most - 1)


def _best(items: DataFrame, block: Queries, least: np.ndarray, k: int) -> DataFrame:
    """``q, query_id, vec_id, score``: of every task and query the best k candidates that reach ``least``."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3

        def cut() -> list[np.ndarray]:
            q, ids, values = held
            order = np.lexsort((ids, -values, q))
            q, ids, values = q[order], ids[order], values[order]
            start = np.searchsorted(q, q)
            first = np.arange(len(q)) - start < k
            return [q[first], ids[first], values[first]]

        for ids, scores, own in scored(batches, block):
            scores = scores.astype(np.int64)
            q, at = np.nonzero((scores >= least[:, None]) & ~own)
            held = [np.concatenate(x) for x in zip(held, (q, ids[at], scores[q, at]), strict=True)]
            held = cut()
        q, ids, values = held
        yield pa.RecordBatch.from_pydict({"q": q, "query_id": block.ids[q], "vec_id": ids, "score": values})

    return items.mapInArrow(kept, "q long, query_id long, vec_id long, score long")


def top_k(
    vectors: DataFrame, every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k best candidates by integer inner product.

    Queries are the rows with an id divisible by ``every``; candidates are all rows with another id. Ties
    go to the smaller id. Rows without an id, and vectors that are null or hold a null or non-finite
    component, take no part; vectors of other lengths than a block's longest query are cut or filled
    with zeros. A query with fewer than k candidates gets them all, a repeated query row its own result,
    and repeated candidates each their place. Other columns are ignored; no query or an empty table
    gives no rows. Scores must fit a long. Queries go in blocks of ``block_bytes``, one after another.
    """
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    items = named.filter(usable(F.col("id"), F.col("v"))).select("id", quantised(F.col("v"), scale).alias("v"))
    asked = items.filter(F.col("id") % every == 0).groupBy("id", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = asked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    longest = items.agg(F.max(squares)).first()[0] or 0.0
    width, most = sizes["width"] or 1, min(WIDEST, int(np.ceil(longest)) + 1)  # a score is at most a product of norms
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score long"
    n_blocks = -(-sizes["n"] * width * 8 // block_bytes)
    path, parts = scratch_path(spark, "top-k"), []
    for b in range(n_blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(n_blocks)) == b).collect()  # about block_bytes
        if not rows:
            continue
        rows.sort(key=lambda r: (r["id"], r["v"]))
        padded = np.array([(r["v"] + [0] * width)[:width] for r in rows], dtype=np.int64)
        block = Queries(np.array([r["id"] for r in rows], dtype=np.int64), padded, most)
        best = _best(items, block, kth_scores(items, block, k), k)
        place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
        ranked = best.withColumn("rank", place).filter(F.col("rank") <= k)
        again = {q: r["n"] for q, r in enumerate(rows) if r["n"] > 1}
        if again:
            counts = spark.createDataFrame([*again.items()], "q long, n long")
            copies = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("n", F.lit(1))))
            ranked = ranked.join(counts, "q", "left").withColumn("copy", copies)
        parts.append(f"{path}/block={b}")
        ranked.select("query_id", "rank", "vec_id", "score").write.parquet(parts[-1])
    return spark.read.schema(schema).parquet(*parts) if parts else spark.createDataFrame([], schema)
