from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import guard as G
from shelfspark.operators.search import clamp_count


@pytest.mark.parametrize("n, too_long", [(4, False), (1000, False), (1001, True), (0, False)])
def test_length_gate(spark, n, too_long):
    df = spark.createDataFrame([("\x00 " + "x" * n + "\x7f\t",)], "t string")
    row = G.split_oversized(df, "t").first()
    assert row["clean_text"] == "x" * n and row["too_long"] is too_long


@pytest.mark.parametrize(
    "text, reason",
    [
        ("Knihovna je otevřená.", None), ("- a\n- **b**", None), ("Použijte `kód`.", None), ("```\ntext\n```", None),
        ("```html\n<p>", "code"), ("```JavaScript\nx", "code"), ("```python", "code"), ("<!DOCTYPE html>", "code"),
        ("<script src=x>", "code"), ("a < b scripts", None), ("volám getOpeningHours()", "leak"),
        ("getopeninghours", None), ("viz bezpečnostní PRAVIDLA", "leak"), ("zakázáno (STRICT)", "leak"), ("Tool_Calls", "leak"),
        ("a" * 5000, "truncated"), ("a" * 4000 + "getEvents", "truncated"),
    ],
)
def test_guard_output(spark, text, reason):
    row = G.guard_output(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert row["reason"] == reason
    if reason in ("leak", "code"):
        assert row["answer"] == G.FILTERED_TEXT
    elif reason == "truncated":
        assert row["answer"] == text[:4000] + G.CUT_MARKER
    else:
        assert row["answer"] == text


@pytest.mark.parametrize(
    "text, route, branch",
    [
        ("Jaká je otevírací doba?", "opening_hours", None), ("Jak se dostanu do Machnína", "opening_hours", "machnin"),
        ("Kdy je koncert ve Vesci, vesec", "opening_hours", "vesec"), ("Bude nějaký KURZ šití?", "events", None),
        ("Kde zaparkuji?", "semantic_search", None), ("Hlavní budova nebo Rochlice", "opening_hours", "rochlice"),
    ],
)
def test_routes(spark, text, route, branch):
    row = G.route_queries(spark.createDataFrame([(text,)], "t string"), "t").first()
    assert (row["route"], row["branch"]) == (route, branch)


@pytest.mark.parametrize(
    "forwarded, real, want",
    [("1.1.1.1, 2.2.2.2", "3.3.3.3", "1.1.1.1"), (None, " 3.3.3.3 ", "3.3.3.3"), ("", "", "unknown"), (None, None, "unknown")],
)
def test_client_key(spark, forwarded, real, want):
    df = spark.createDataFrame([(forwarded, real)], "f string, r string")
    assert df.select(G.client_key("f", "r")).first()[0] == want


@pytest.mark.parametrize(
    "origin, referer, operation, reason",
    [
        ("https://app.example", None, "add", None), ("https://app.example/", None, "add", None),
        (None, "https://app.example/page", "add", None), ("https://app.example.evil.tld", None, "add", "invalid origin"),
        ("", None, "add", "missing origin"), (None, None, "login", None), ("https://evil.tld", None, "heartbeat", None),
        ("https://evil.tld", "https://app.example", None, "invalid origin"),
    ],
)
def test_origins(spark, origin, referer, operation, reason):
    df = spark.createDataFrame([(origin, referer, operation)], "origin string, referer string, operation string")
    row = G.allowed_origins(df, ["https://app.example/", " "]).first()
    assert row["reject_reason"] == reason and row["allowed"] is (reason is None)


def test_retention_keeps_exactly_thirty_days(spark):
    df = spark.createDataFrame([("2024-01-01 00:00:00",), ("2023-12-31 23:59:59",)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    assert G.retain_days(df, "ts", "2024-01-31 00:00:00").count() == 1


@pytest.mark.parametrize("given, want", [(None, 5), (10, 10), (50, 20), (20, 20), (0, 1), (-5, 1)])
def test_count_clamp(given, want):
    assert clamp_count(given) == want
