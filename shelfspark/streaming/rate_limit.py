"""The fixed-window limiter over a stream: one small state per key, and a decision for every request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from shelfspark.operators.rate import MAX_REQUESTS, WINDOW_SECONDS, micros


def limit_stream(
    requests: DataFrame,
    key: str,
    ts: str,
    order: str,
    max_requests: int = MAX_REQUESTS,
    window_seconds: int = WINDOW_SECONDS,
    expire: bool = False,
) -> DataFrame:
    """Decisions (key, order, ts, window_start, allowed, remaining, retry_after_ms) as requests arrive.

    Within a micro-batch the requests of a key are taken by (ts, order). The size of a micro-batch,
    set at the source, bounds what one key can bring at once; state is a count and a start. There is
    no watermark, so nothing is dropped: a request that comes late counts in the key's open window. With
    ``expire`` a key's state goes when nothing came for two windows by the clock; that is for streams
    that keep running, since a trigger that stops when all is read never finds such a query idle. Requests without a key are one key; a
    request without a time is refused, in no window.
    """
    window = window_seconds * 1_000_000
    stamped = requests.select(
        F.col(key), F.col(order), F.col(ts).cast("timestamp").alias(ts), micros(ts).alias("_t")
    )
    out = T.StructType(
        [
            T.StructField(key, requests.schema[key].dataType),
            T.StructField(order, requests.schema[order].dataType),
            T.StructField("t", T.LongType()),
            T.StructField("start", T.LongType()),
            T.StructField("allowed", T.BooleanType()),
            T.StructField("remaining", T.LongType()),
            T.StructField("retry_after_ms", T.LongType()),
        ]
    )
    kept = T.StructType([T.StructField("count", T.LongType()), T.StructField("start", T.LongType())])

    def decide(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        count, start = state.get if state.exists else (0, None)
        rows = pd.concat([b[[order, "_t"]] for b in batches]).sort_values(["_t", order])
        starts, allowed, remaining, retry = [], [], [], []
        times = rows["_t"].astype("Int64")
        for t in times.tolist():
            if t is pd.NA:
                starts.append(None)
                allowed.append(False)
                remaining.append(0)
                retry.append(0)
                continue
            if start is None or t >= start + window:
                count, start = 0, t
            ok = count < max_requests
            count += ok
            starts.append(start)
            allowed.append(ok)
            remaining.append(max_requests - count)
            retry.append(0 if ok else (window - (t - start)) // 1000)
        if start is not None:
            state.update((int(count), int(start)))
            if expire:
                state.setTimeoutDuration(2 * window // 1000)
        yield pd.DataFrame(
            {
                key: group[0], order: rows[order].to_numpy(), "t": times.array, "start": pd.array(starts, dtype="Int64"),
                "allowed": allowed, "remaining": remaining, "retry_after_ms": retry,
            }
        )

    decided = stamped.groupBy(key).applyInPandasWithState(
        decide, out, kept, "append", GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout
    )
    return decided.select(
        key, order, F.timestamp_micros("t").alias(ts), F.timestamp_micros("start").alias("window_start"),
        "allowed", "remaining", "retry_after_ms",
    )
