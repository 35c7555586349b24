"""Fixed-window request limiter: a window opens at a key's first request after the last one closed.

Windows are anchored at requests, so they form a chain per key: each start is the first request
at or after the end of the window before it. Ordinary keys are walked in one sorted pass. A hot
key is never walked: its chain is found by doubling over time blocks, with equi-joins on
(key, time) whose inputs halve at every level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from shelfspark.operators.skew import top_per_key
from shelfspark.session import cut_lineage

MAX_REQUESTS = 20
WINDOW_SECONDS = 3600
HOT_ROWS = 5_000_000
SUB_BUCKETS = 64
UNKNOWN_KEY = "unknown"


def micros(ts: Column | str) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def _walk(window: int, key: str):
    """Task over rows in (key, time) order: adds window start and position; state is one window."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last_key, start, filled = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            keys = batch.column(batch.schema.get_field_index(key))
            times = batch.column(batch.schema.get_field_index("_t")).to_numpy()
            starts, positions = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
            edges = np.flatnonzero(pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)) + 1
            for a, b in zip([0, *edges], [*edges, n], strict=True):
                i = a
                this_key = keys[int(a)].as_py()
                if this_key != last_key:
                    last_key, start, filled = this_key, times[a], 0
                while i < b:
                    if times[i] >= start + window:
                        start, filled = times[i], 0
                    j = i + int(np.searchsorted(times[i:b], start + window, side="left"))
                    starts[i:j] = start
                    positions[i:j] = filled + np.arange(1, j - i + 1)
                    filled, i = filled + (j - i), j
            out = [batch.column(k) for k in range(batch.num_columns)] + [pa.array(starts), pa.array(positions)]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names, "_start", "_pos"])

    return task


def _walked(df: DataFrame, key: str, order: str, window: int) -> DataFrame:
    """Runs the walk on top of a window operator.

    The window demands that a key sits in one task in time order, so no later plan change
    (a join turned into a broadcast, a shuffle found redundant) can take that away; a plain
    repartition gives no such guarantee.
    """
    in_order = F.row_number().over(Window.partitionBy(key).orderBy("_t", order))
    ordered = df.withColumn("_row", in_order)
    schema = T.StructType([*ordered.schema.fields, T.StructField("_start", T.LongType()), T.StructField("_pos", T.LongType())])
    return ordered.mapInArrow(_walk(window, key), schema).drop("_row")


def _next_requests(events: DataFrame, window: int) -> DataFrame:
    """(k, t, jump): the first request of the key at or after t + window, null at the end."""
    width = max(window // SUB_BUCKETS, 1)

    def sub(c: str) -> Column:
        return F.floor(F.col(c) / width)

    seen = events.select("k", F.col("t").alias("at"), F.col("t").alias("event"), F.lit(None).cast("bigint").alias("asker"))
    asked = events.select("k", (F.col("t") + window).alias("at"), F.lit(None).cast("bigint").alias("event"), F.col("t").alias("asker"))
    rows = seen.unionByName(asked).withColumn("sub", sub("at"))
    inside = Window.partitionBy("k", "sub").orderBy(F.desc("at"), F.col("event").desc_nulls_last())
    found = rows.withColumn("near", F.last("event", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    later = Window.partitionBy("k").orderBy(F.desc("sub")).rowsBetween(Window.unboundedPreceding, -1)
    heads = rows.groupBy("k", "sub").agg(F.min("event").alias("head")).withColumn(
        "far", F.last("head", ignorenulls=True).over(later)
    )
    probes = found.filter(F.col("asker").isNotNull()).select("k", "sub", F.col("asker").alias("t"), "near")
    return probes.join(heads.select("k", "sub", "far"), ["k", "sub"]).select("k", "t", F.coalesce("near", "far").alias("jump"))


def _chain(events: DataFrame, window: int) -> DataFrame:
    """(k, start): all window starts of distinct requests (k, t)."""
    span = events.agg(F.min("t").alias("low"), F.max("t").alias("high")).first()
    low = span["low"]
    top = max(0, math.ceil(math.log2((span["high"] - low + 1) / window)))

    def block(c: str, level: int) -> Column:
        return F.floor((F.col(c) - low) / (window * 2**level))

    levels = [cut_lineage(_next_requests(events, window))]
    for m in range(1, top + 1):
        below = levels[-1].withColumn("b", block("t", m)).withColumn("early", F.pmod(F.col("t") - low, F.lit(window * 2**m)) < window)
        late = below.filter(~F.col("early")).groupBy("k", "b").agg(F.min("t").alias("t")).select("k", "t")
        heads = below.filter("early").select("k", "t", "jump").unionByName(
            late.join(levels[-1], ["k", "t"]).select("k", "t", "jump")
        )
        onward = levels[-1].select("k", F.col("t").alias("jump"), F.col("jump").alias("further"), F.lit(True).alias("known"))
        same = block("t", m) == block("jump", m)
        stepped = heads.join(onward, ["k", "jump"], "left")
        levels.append(
            cut_lineage(stepped.select("k", "t", F.when(same & F.col("known"), F.col("further")).otherwise(F.col("jump")).alias("jump")))
        )
    entries = events.groupBy("k").agg(F.min("t").alias("t"))
    for m in range(top, 0, -1):
        jumps = entries.join(levels[m - 1], ["k", "t"])
        within = jumps.filter(block("t", m) == block("jump", m)).select("k", F.col("jump").alias("t"))
        entries = cut_lineage(entries.unionByName(within))
    return entries.select("k", F.col("t").alias("start"))


def _doubled(df: DataFrame, key: str, order: str, window: int, max_requests: int) -> DataFrame:
    """Same result as :func:`_walked` up to position ``max_requests`` + 1, without gathering a key."""
    events = cut_lineage(df.select(F.col(key).alias("k"), F.col("_t").alias("t")).distinct())
    starts = _chain(events, window)
    near = starts.select("k", F.floor(F.col("start") / window).alias("b"), "start")
    spots = (
        near.select("k", "b", F.col("start").alias("own"), F.lit(None).cast("bigint").alias("previous"))
        .unionByName(near.select("k", F.col("b") + 1, F.lit(None).cast("bigint").alias("own"), F.col("start").alias("previous")).toDF("k", "b", "own", "previous"))
        .groupBy("k", "b").agg(F.max("own").alias("own"), F.max("previous").alias("previous"))
    )
    placed = (
        df.withColumn("b", F.floor(F.col("_t") / window))
        .join(spots.withColumnRenamed("k", key), [key, "b"])
        .withColumn("_start", F.when(F.col("own") <= F.col("_t"), F.col("own")).otherwise(F.col("previous")))
        .select(*df.columns, "_start")
    )
    admitted = top_per_key(placed, [key, "_start"], ["_t", order], max_requests, "_pos").withColumn("_pos", F.col("_pos").cast("bigint"))
    full = admitted.filter(F.col("_pos") == max_requests).select(key, "_start", F.struct("_t", order).alias("_cut"))
    refused = (
        placed.join(full, [key, "_start"])
        .filter(F.struct("_t", order) > F.col("_cut"))
        .withColumn("_pos", F.lit(max_requests + 1).cast("bigint"))
        .drop("_cut")
    )
    return admitted.unionByName(refused)


def rate_limit(
    requests: DataFrame,
    key: str,
    ts: str,
    order: str,
    max_requests: int = MAX_REQUESTS,
    window_seconds: int = WINDOW_SECONDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Decide every request: window_start, allowed, remaining, retry_after_ms.

    Requests of a key are taken by (ts, order), which must be unique. Refused requests do not
    prolong a window. Keys with more than ``hot_rows`` requests take the distributed route. Requests
    without a key share the key ``unknown``; a request without a time is refused, in no window.
    """
    window = window_seconds * 1_000_000
    by, key = key, "_key"
    keyed = requests.withColumn("_key", F.coalesce(F.col(by).cast("string"), F.lit(UNKNOWN_KEY)))
    timed = keyed.filter(F.col(ts).isNotNull()).withColumn("_t", micros(ts))
    hot = timed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).select(key)
    if hot.isEmpty():
        decided = _walked(timed, key, order, window)
    else:
        hot = cut_lineage(hot)
        cold = _walked(timed.join(hot, key, "left_anti").select(*timed.columns), key, order, window)
        dense = timed.join(hot, key, "left_semi").select(*timed.columns)
        decided = cold.unionByName(_doubled(dense, key, order, window, max_requests))
    decisions = _decisions(decided, max_requests, window).select(
        *requests.columns, "window_start", "allowed", "remaining", "retry_after_ms"
    )
    zero = F.lit(0).cast("bigint")
    refused = requests.filter(F.col(ts).isNull()).select(
        *requests.columns, F.lit(None).cast("timestamp").alias("window_start"), F.lit(False).alias("allowed"),
        zero.alias("remaining"), zero.alias("retry_after_ms"),
    )
    return decisions.unionByName(refused)


def _decisions(df: DataFrame, max_requests: int, window: int) -> DataFrame:
    allowed = F.col("_pos") <= max_requests
    return df.withColumns(
        {
            "window_start": F.timestamp_micros("_start"),
            "allowed": allowed,
            "remaining": F.when(allowed, max_requests - F.col("_pos")).otherwise(F.lit(0)).cast("bigint"),
            "retry_after_ms": F.when(allowed, F.lit(0))
            .otherwise(F.floor((F.lit(window) - (F.col("_t") - F.col("_start"))) / 1000))
            .cast("bigint"),
        }
    )


def rate_limit_state(
    decided: DataFrame,
    key: str,
    ts: str,
    as_of: str,
    max_requests: int = MAX_REQUESTS,
    window_seconds: int = WINDOW_SECONDS,
) -> DataFrame:
    """Remaining requests per key at a moment, from the decisions up to it; nothing is consumed."""
    now = F.lit(as_of).cast("timestamp")
    past = decided.filter(F.col(ts) <= now)
    windows = past.groupBy(key, "window_start").agg(F.count_if("allowed").alias("used"))
    last = windows.groupBy(key).agg(F.max(F.struct("window_start", "used")).alias("last"))
    open_ = F.unix_micros(now) - F.unix_micros(F.col("last.window_start")) < window_seconds * 1_000_000
    remaining = F.when(open_, F.greatest(F.lit(max_requests) - F.col("last.used"), F.lit(0))).otherwise(F.lit(max_requests))
    return last.select(key, remaining.cast("bigint").alias("remaining")).withColumn("limited", F.col("remaining") == 0)
