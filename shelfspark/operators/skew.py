"""Building blocks that keep one hot key from landing in one task.

Per-key ranking with a small limit relies on Spark's group-limit operator, which cuts every
key down to the limit before the shuffle. Full numbering and carry-forward split each key
into order buckets first, work inside (key, bucket), and pass only one row per bucket on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.session import cut_lineage

MAX_LOOKUP_ROWS = 1000
MAX_GROUP_ROWS = 1_000_000
BUCKET_ROWS = 200_000
MAX_CUTS = 256
#: A partition's rows take this many low bits of ``monotonically_increasing_id``.
PARTITION_BITS = 33


def groups_within(df: DataFrame, keys: list[str], most: int) -> bool:
    """Whether no key holds more than ``most`` rows; one pass over the keys, combined before the shuffle."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > most).isEmpty()


def first_per_key(df: DataFrame, keys: list, order: list) -> DataFrame:
    return top_per_key(df, keys, order, 1)


def top_per_key(df: DataFrame, keys: list, order: list, n: int, rank_name: str | None = None) -> DataFrame:
    name = rank_name or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(name) <= n)
    return kept if rank_name else kept.drop(name)


def with_matches(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` joined with the other columns of ``right`` on ``keys``, where null equals null."""
    named = right.withColumnsRenamed({k: f"_of_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])
    return left.join(named, on, how).drop(*[f"_of_{k}" for k in keys])


def in_order_buckets(df: DataFrame, keys: list[str], order: list[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``_bucket``, which cuts the keys above ``rows`` rows into stretches of their own order.

    The cut points are measured: the places of a sample of a key's rows that is drawn by hash, one in ``rows`` or one in a
    ``MAX_CUTS``-th of the key, whichever is more. So the stretches hold about equally many rows whether the values of
    ``order`` are small, dense, sparse or far apart, and cutting again gives the same cuts. Only rows equal in all of
    ``order`` are never parted.
    """
    place = F.struct(*order)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > rows)
    step = F.greatest(F.lit(rows), F.ceil(F.col("_rows") / MAX_CUTS))
    hot = with_matches(df.select(*dict.fromkeys([*keys, *order])), sizes, keys, "inner")
    drawn = hot.filter(F.pmod(F.xxhash64(*keys, *order), step) == 0)
    cuts = drawn.groupBy(*keys).agg(F.sort_array(F.collect_set(place)).alias("_cuts"))
    before = F.size(F.filter("_cuts", lambda c: c <= place))
    bucket = F.when(F.col("_cuts").isNull(), 0).otherwise(before)
    return with_matches(df, cuts, keys).select(*df.columns, bucket.alias("_bucket"))


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, max_group: int = MAX_GROUP_ROWS, rows: int = BUCKET_ROWS
) -> DataFrame:
    """1-based position of each row within its key; without keys, within the whole table.

    Where every key is of checked moderate size this is a plain window. Beyond, keys are cut as in
    :func:`in_order_buckets`, so one task sorts a stretch of bounded size; only (key, bucket, count) rows meet per key.
    """
    if not keys:
        return globally_numbered(df, order, name)
    if groups_within(df, keys, max_group):
        plain = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(name, plain.cast("bigint"))
    cut = in_order_buckets(df, keys, order, rows)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    joined = with_matches(cut.withColumn("_local", F.row_number().over(inside)), offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, (F.col("_local") + F.col("_offset")).cast("bigint").alias(name))


def globally_numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """1-based position of each row in the order of the whole table, in a column ``name``.

    The rows are sorted into range partitions and written once; what one partition adds to the positions of
    the next ones is the sum of the counts before it, one number per partition. Nothing is gathered.
    Rows equal in all of ``order`` get neighbouring positions in any order. ``name`` must be a new column.
    """
    spark, at = df.sparkSession, F.monotonically_increasing_id()
    placed = cut_lineage(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(name, at))
    part = F.shiftright(name, PARTITION_BITS)
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()
    ahead, rows = 0, []
    for row in sorted(counts):
        rows.append((row["part"], ahead - (row["part"] << PARTITION_BITS) + 1))
        ahead += row["n"]
    if not rows:
        return placed
    offsets = spark.createDataFrame(rows, "_part bigint, _ahead bigint")
    joined = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, (F.col(name) + F.col("_ahead")).alias(name))


def carry_forward(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    value: Column,
    name: str,
    max_group: int = MAX_GROUP_ROWS,
    rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Latest non-null ``value`` strictly before each row of the same key; large keys are cut as in :func:`numbered`."""
    if groups_within(df, keys, max_group):
        before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.last(value, ignorenulls=True).over(before))
    cut = in_order_buckets(df.withColumn("_value", value), keys, order, rows)
    carried = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    place = F.when(F.col("_value").isNotNull(), F.struct(*order))
    heads = (
        cut.groupBy(*keys, "_bucket")
        .agg(F.max_by("_value", place).alias("_last"))
        .withColumn("_head", F.last("_last", ignorenulls=True).over(carried))
        .drop("_last")
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = cut.withColumn("_local", F.last("_value", ignorenulls=True).over(inside))
    joined = with_matches(local, heads, [*keys, "_bucket"])
    return joined.select(*df.columns, F.coalesce("_local", "_head").alias(name))


def nest_in_parts(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    item: Column,
    items_name: str,
    part_size: int = 1000,
) -> DataFrame:
    """Ordered arrays per key, at most ``part_size`` items per row.

    A key of ordinary size gives one row with ``part`` = 0; a hot key gives as many rows as it
    needs, so nothing is dropped and no row grows without bound. ``order`` is ascending columns.
    """
    if groups_within(df, keys, part_size):
        place = F.struct(*order, item.alias("item"))
        whole = df.groupBy(*keys).agg(F.sort_array(F.collect_list(place)).alias("_items"))
        return whole.select(
            *keys, F.lit(0).cast("bigint").alias("part"), F.transform("_items", lambda x: x["item"]).alias(items_name)
        )
    positions = numbered(df, keys, order, "_pos").withColumn(
        "part", F.floor((F.col("_pos") - 1) / part_size).cast("bigint")
    )
    return (
        positions.groupBy(*keys, "part")
        .agg(F.sort_array(F.collect_list(F.struct(F.col("_pos"), item.alias("item")))).alias("_items"))
        .select(*keys, "part", F.transform("_items", lambda x: x["item"]).alias(items_name))
    )


def bounded_rows(df: DataFrame, max_rows: int = MAX_LOOKUP_ROWS) -> list[Row] | None:
    """The rows of a lookup table, or None when it holds more than ``max_rows``."""
    rows = df.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None
