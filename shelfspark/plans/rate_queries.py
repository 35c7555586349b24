"""Request-limiter queries: events as requests, keyed by user."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import rate as R
from shelfspark.plans.registry import query, table
from shelfspark.session import scratch_path
from shelfspark.streaming.rate_limit import limit_stream

_MAX, _HOURS = 2, 12
_SQL = f"""WITH RECURSIVE ev AS (SELECT event_id, user_id, epoch_us(ts) AS t FROM events),
  starts AS (SELECT user_id, min(t) AS start FROM ev GROUP BY user_id
    UNION ALL SELECT s.user_id, min(e.t) FROM starts s JOIN ev e ON e.user_id = s.user_id AND e.t >= s.start + {_HOURS * 3600000000} GROUP BY s.user_id),
  placed AS (SELECT ev.*, s.start FROM ev ASOF JOIN starts s ON ev.user_id = s.user_id AND ev.t >= s.start),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, start ORDER BY t, event_id) AS pos FROM placed),
  decided AS (SELECT event_id, user_id, t, start, pos <= {_MAX} AS allowed, greatest({_MAX} - pos, 0) AS remaining,
    CASE WHEN pos <= {_MAX} THEN 0 ELSE ({_HOURS * 3600000000} - (t - start)) // 1000 END AS retry_after_ms FROM ranked)"""
_OUT = " SELECT event_id, user_id, start AS window_start_us, allowed, remaining, retry_after_ms FROM decided"


def _out(df):
    return df.select(
        "event_id", "user_id", F.unix_micros("window_start").alias("window_start_us"), "allowed", "remaining", "retry_after_ms"
    )


def _requests(spark, sf):
    return table(spark, sf, "events").select("event_id", "user_id", "ts")


@query("h5_rate_limit", _SQL + _OUT)
def limited(spark, sf):
    return _out(R.rate_limit(_requests(spark, sf), "user_id", "ts", "event_id", _MAX, _HOURS * 3600))


@query("h5_rate_limit_hot_keys", _SQL + _OUT)
def limited_hot(spark, sf):
    """Every key takes the distributed route; the answer is the same."""
    return _out(R.rate_limit(_requests(spark, sf), "user_id", "ts", "event_id", _MAX, _HOURS * 3600, hot_rows=0))


@query("h5_rate_limit_stream", _SQL + _OUT)
def limited_stream(spark, sf):
    """The requests arrive in four deliveries, in order of time, those without one first; the stream keeps its state between them."""
    events = _requests(spark, sf)
    cuts = events.select(F.approx_percentile(F.unix_micros(F.col("ts").cast("timestamp")), [0.25, 0.5, 0.75])).first()[0] or []
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    path = scratch_path(spark, "limited")
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = events
        part = part if low is None else part.filter(at >= low)
        part = part if high is None else part.filter((at < high) | at.isNull() if low is None else at < high)
        part.write.mode("append").parquet(f"{path}-in")
        source = spark.readStream.schema(events.schema).parquet(f"{path}-in")
        decided = limit_stream(source, "user_id", "ts", "event_id", _MAX, _HOURS * 3600)
        running = (
            decided.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-state")
            .outputMode("append").trigger(availableNow=True).start()
        )
        running.awaitTermination()
    return _out(spark.read.parquet(path))


@query(
    "h6_rate_limit_state",
    _SQL
    + f""", w AS (SELECT user_id, start, count(*) FILTER (WHERE allowed) AS used FROM decided
         WHERE t <= epoch_us(TIMESTAMP '2024-01-20 06:00:00') GROUP BY 1, 2),
       l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY start DESC) = 1)
       SELECT user_id, CASE WHEN epoch_us(TIMESTAMP '2024-01-20 06:00:00') - start < {_HOURS * 3600000000} THEN {_MAX} - used ELSE {_MAX} END AS remaining,
         CASE WHEN epoch_us(TIMESTAMP '2024-01-20 06:00:00') - start < {_HOURS * 3600000000} THEN {_MAX} - used ELSE {_MAX} END = 0 AS limited FROM l""",
)
def state(spark, sf):
    decided = R.rate_limit(_requests(spark, sf), "user_id", "ts", "event_id", _MAX, _HOURS * 3600)
    return R.rate_limit_state(decided, "user_id", "ts", "2024-01-20 06:00:00", _MAX, _HOURS * 3600)
