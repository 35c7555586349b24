"""The keyed store: merges against a dictionary, bytes written, broken and repeated versions."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from shelfspark.operators import webindex as E
from shelfspark.sources.keyed_store import KeyedStore

SCHEMA = "id string, v int, at int"


def rows_of(store):
    return sorted(map(str, (tuple(r) for r in store.read().collect())))


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng, state = random.Random(3), {}
    store = KeyedStore(spark, str(tmp_path / "s"), "id", SCHEMA, buckets=5)
    assert store.read().count() == 0
    for n in range(4):
        ids = [None, *map(str, range(30))]
        batch = [(rng.choice(ids), rng.randrange(100), at) for at in range(12)]
        removed = [(rng.choice(ids),) for _ in range(4)]
        assert store.merge(str(n), spark.createDataFrame(batch, SCHEMA), ["at"], spark.createDataFrame(removed, "id string"))
        for (key,) in removed:
            state.pop(key, None)
        state.update({r[0]: r for r in batch})
        assert rows_of(store) == sorted(map(str, state.values()))
        assert not store.merge(str(n), spark.createDataFrame([("x", 1, 1)], SCHEMA))
    assert store.replace("anew", spark.createDataFrame([("a", 1, 1)], SCHEMA)) and rows_of(store) == ["('a', 1, 1)"]
    assert store.merge("none", spark.createDataFrame([], SCHEMA)) and rows_of(store) == ["('a', 1, 1)"]
    assert store.merge("empty", spark.createDataFrame([], SCHEMA), removed=spark.createDataFrame([("a",)], "id string")) and rows_of(store) == []


def test_a_small_batch_writes_its_own_buckets_only(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "id", SCHEMA, buckets=16)
    store.merge("load", spark.range(4000).selectExpr("cast(id as string) AS id", "1 AS v", "0 AS at"))
    store.merge("one", spark.createDataFrame([("7", 2, 1)], SCHEMA))
    size = lambda v: sum(p.stat().st_size for p in (tmp_path / "s/data" / v).rglob("*.parquet"))
    assert len(list((tmp_path / "s/data/one").glob("_bucket=*"))) == 1
    assert size("one") < size("load") / 8
    assert store.read().count() == 4000 and store.read().filter("v = 2").count() == 1


def test_a_version_without_its_manifest_does_not_count(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "s"), "id", SCHEMA, buckets=3)
    store.merge("1", spark.createDataFrame([("a", 1, 1)], SCHEMA))
    torn = spark.createDataFrame([("b", 2, 2)], SCHEMA).withColumn("_bucket", F.lit(0))
    torn.write.partitionBy("_bucket").parquet(str(tmp_path / "s/data/2"))
    assert rows_of(store) == ["('a', 1, 1)"]
    assert store.merge("2", spark.createDataFrame([("a", 5, 2)], SCHEMA)) and rows_of(store) == ["('a', 5, 2)"]


def test_refresh_of_a_store_equals_refresh_of_a_table(spark, tmp_path):
    chunk = "url string, section_heading string, chunk_index int, text string, hash string, ord bigint, last_crawled string"
    rng = random.Random(5)
    def made(day):
        return [(f"u{i}", "h", i % 2, t := f"t{rng.randrange(40)}", f"#{t}", i, day) for i in range(30) if rng.random() < 0.8]

    old, new = spark.createDataFrame(made("1"), chunk), spark.createDataFrame(made("2"), chunk)
    index = old.withColumn("id", E.chunk_id(E.chunk_key()))
    store = KeyedStore(spark, str(tmp_path / "s"), "id", index.schema, buckets=4)
    store.merge("load", index, ["ord"])
    assert E.refresh_store(store, "crawl", new)
    want = E.refresh_index(index, new).select(*store.read().columns)
    assert sorted(map(str, store.read().collect())) == sorted(map(str, want.collect()))


def test_a_merge_exchanges_its_rows_once(spark, tmp_path):
    """Bytes that all tasks send to others: old rows and the batch pass one exchange, what decides is narrow."""
    chunk = "url string, section_heading string, chunk_index int, text string, hash string, ord bigint, last_crawled string"
    body = F.expr("array_join(transform(sequence(1, 60), i -> sha2(cast(id * 100 + i as string), 256)), '')")
    rows = spark.range(0, 2000, 1, 4).select("id", body.alias("text")).selectExpr(
        "concat('u', id) AS url", "'h' AS section_heading", "0 AS chunk_index", "text", "sha2(text, 256) AS hash", "id AS ord", "'1' AS last_crawled"
    )
    rows.write.parquet(str(tmp_path / "rows"))
    made = spark.read.schema(chunk).parquet(str(tmp_path / "rows"))
    store = KeyedStore(spark, str(tmp_path / "s"), "id", made.withColumn("id", E.chunk_id(E.chunk_key())).schema, buckets=8)
    revised = made.filter("ord % 10 <> 3").withColumn("text", F.when(F.col("ord") % 2 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")))
    revised = revised.withColumns({"hash": F.sha2("text", 256), "last_crawled": F.lit("2")})
    # No automatic broadcasts: what is small here is not at size.
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        text = 2000 * 60 * 64
        sent = [shuffled(spark, lambda: store.merge("load", made.withColumn("id", E.chunk_id(E.chunk_key())), ["ord"]))]
        sent.append(shuffled(spark, lambda: E.refresh_store(store, "crawl", revised)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before[0])
        if before[1] is None:
            spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        else:
            spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", before[1])
    assert 0.3 * text < sent[0] < 1.3 * text and sent[1] < 3 * text, [s / text for s in sent]
    got = {r.ord: (r.last_crawled, r.text[-1]) for r in store.read().collect()}
    assert sorted(got) == [i for i in range(2000) if i % 10 != 3]
    assert all((day, last == "x") == (("2", True) if i % 2 == 0 else ("1", False)) for i, (day, last) in got.items())


def shuffled(spark, job):
    """Bytes written to exchanges while ``job`` runs."""
    def total():
        quantiles = spark.sparkContext._gateway.new_array(spark._jvm.double, 0)
        stages = spark._jsc.sc().statusStore().stageList(None, False, False, quantiles, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    start = total()
    job()
    return total() - start
