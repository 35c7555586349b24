from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import rate as R
from shelfspark.session import scratch_path
from shelfspark.streaming.rate_limit import limit_stream

START = dt.datetime(2024, 1, 1)
SCHEMA = "key string, id long, ts timestamp"


def brute(rows, most, window):
    state, out = {}, {}
    for key, i, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        count, start = state.get(key, (0, None))
        if start is None or (ts - start).total_seconds() >= window:
            count, start = 0, ts
        ok = count < most
        count += ok
        state[key] = (count, start)
        wait = 0 if ok else int(window * 1000 - (ts - start).total_seconds() * 1000)
        out[i] = (start, ok, most - count, wait)
    return out


def decided(df):
    return {r["id"]: (r["window_start"], r["allowed"], r["remaining"], r["retry_after_ms"]) for r in df.collect()}


def random_rows(seed, n=1500, keys=6):
    rng, rows = random.Random(seed), []
    for i in range(n):
        key = "hot" if rng.random() < 0.4 else f"k{rng.randrange(keys)}"
        rows.append((key, i, START + dt.timedelta(seconds=rng.randrange(200_000) // (1 if key == "hot" else 7) * (1 if rng.random() < 0.8 else 7))))
    return rows


def test_limit_three_per_second(spark):
    rows = [("a", i, START + dt.timedelta(milliseconds=100 * i)) for i in range(4)] + [("b", 9, START), ("a", 10, START + dt.timedelta(seconds=1))]
    got = decided(R.rate_limit(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", 3, 1))
    assert [got[i][2] for i in range(4)] == [2, 1, 0, 0]
    assert got[3][1] is False and got[3][3] == 700
    assert got[9][1] and got[10][1] and got[10][2] == 2


@pytest.mark.parametrize(
    "seed, most, window, hot_rows",
    [(1, 3, 3600, 10**9), (2, 1, 60, 10**9), (4, 2, 7, 10**9), (1, 3, 14_400, 300), (3, 20, 90_000, 0)],
)
def test_all_routes_equal_a_plain_walk(spark, seed, most, window, hot_rows):
    rows = random_rows(seed)
    got = decided(R.rate_limit(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", most, window, hot_rows))
    assert got == brute(rows, most, window)


def test_mixed_routes_over_many_files_and_batches(spark):
    """Hot keys are split off by a join that turns into a broadcast at run time; cold keys must stay whole."""
    rng, path = random.Random(9), scratch_path(spark, "many")
    rows = [("hot" if rng.random() < 0.33 else f"k{rng.randrange(300)}", i, START + dt.timedelta(seconds=rng.randrange(500_000))) for i in range(60_000)]
    spark.createDataFrame(rows, SCHEMA).repartition(8).write.parquet(path)
    got = decided(R.rate_limit(spark.read.parquet(path), "key", "ts", "id", 3, 90_000, hot_rows=5_000))
    assert got == brute(rows, 3, 90_000)


def test_walk_sits_on_an_operator_that_demands_whole_keys(spark):
    rows = spark.createDataFrame([("a", 1, START)], SCHEMA)
    text = R.rate_limit(rows, "key", "ts", "id")._jdf.queryExecution().executedPlan().toString()
    below = text[text.index("MapInArrow") :].splitlines()[1]
    assert "Window" in below


def test_allowed_never_exceeds_the_limit_and_state_follows(spark):
    rows = random_rows(5)
    df = R.rate_limit(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", 4, 1800)
    most = df.filter("allowed").groupBy("key", "window_start").count().agg(F.max("count")).first()[0]
    assert most <= 4
    as_of = START + dt.timedelta(seconds=90_000)
    state = {r["key"]: (r["remaining"], r["limited"]) for r in R.rate_limit_state(df, "key", "ts", str(as_of), 4, 1800).collect()}
    want = {}
    answers = brute([r for r in rows if r[2] <= as_of], 4, 1800)
    for key in {r[0] for r in rows if r[2] <= as_of}:
        last = max(((r[2], r[1]) for r in rows if r[0] == key and r[2] <= as_of))
        start, _, left, _ = answers[last[1]]
        want[key] = (left if (as_of - start).total_seconds() < 1800 else 4)
    assert {k: v[0] for k, v in state.items()} == want
    assert all(limited == (left == 0) for left, limited in state.values())


def test_stream_of_sorted_batches_equals_batch(spark):
    rows = sorted(random_rows(6, 600), key=lambda r: (r[2], r[1]))
    folder = scratch_path(spark, "requests")
    for n in range(4):
        part = spark.createDataFrame(rows[n * 150 : (n + 1) * 150], SCHEMA)
        part.coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out = scratch_path(spark, "decisions")
    running = (
        limit_stream(source, "key", "ts", "id", 3, 3600).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    assert decided(spark.read.parquet(out)) == brute(rows, 3, 3600)


def test_requests_without_key_or_time_get_a_decision(spark):
    rows = [("a", 1, START), (None, 2, START), (None, 3, START + dt.timedelta(seconds=1)), ("a", 4, None), (None, 5, None)]
    for hot_rows in (R.HOT_ROWS, 0):
        got = decided(R.rate_limit(spark.createDataFrame(rows, SCHEMA), "key", "ts", "id", 1, 60, hot_rows=hot_rows))
        assert got == {
            1: (START, True, 0, 0), 2: (START, True, 0, 0), 3: (START, False, 0, 59_000),
            4: (None, False, 0, 0), 5: (None, False, 0, 0),
        }


def test_stream_decides_every_request_in_any_order(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), i, START + dt.timedelta(seconds=rng.randrange(5000))) for i in range(80)]
    rows += [("a", 100, None), (None, 101, None)]
    rng.shuffle(rows)
    folder, out = scratch_path(spark, "late"), scratch_path(spark, "late-out")
    for n in range(4):
        spark.createDataFrame(rows[n * 21 : (n + 1) * 21], SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    running = (
        limit_stream(source, "key", "ts", "id", 2, 600).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    )
    running.awaitTermination()
    got = decided(spark.read.parquet(out))
    assert set(got) == {i for _, i, _ in rows}
    assert got[100] == got[101] == (None, False, 0, 0)
    assert sum(ok for _, ok, _, _ in got.values()) >= 2 * 3
