"""Catalogue audit: how completely records are filled, per field, pair and combination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import missing_to_null

MISSING = ("", "nan")


def _present(name: str, missing: tuple[str, ...]) -> Column:
    return (missing_to_null(F.col(name), missing) if missing else F.col(name)).isNotNull()


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part * 100.0 / whole)


def field_fill_rate(
    df: DataFrame, cols: list[str] | None = None, missing_values: tuple[str, ...] = MISSING
) -> DataFrame:
    """Per column: present count, percentage of all rows, absent count. One scan, one row shuffled."""
    cols = cols or df.columns
    counts = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(_present(c, missing_values)).alias(c) for c in cols]
    )
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("non_null")) for c in cols])
    return counts.select("_total", F.inline(rows)).select(
        "field",
        F.col("non_null").alias("non_null_count"),
        _percent(F.col("non_null"), F.col("_total")).alias("percentage"),
        (F.col("_total") - F.col("non_null")).alias("null_count"),
    )


def presence_patterns(
    df: DataFrame, cols: list[str] | None = None, missing_values: tuple[str, ...] = MISSING
) -> DataFrame:
    """Row count per presence bit mask: the audit of any field combination from one small table."""
    cols = cols or df.columns
    if len(cols) > 62:
        raise ValueError("a presence mask holds at most 62 fields; audit them in groups")
    mask = F.lit(0).cast("bigint")
    for i, c in enumerate(cols):
        mask = mask.bitwiseOR(F.when(_present(c, missing_values), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return df.select(mask.alias("mask")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"))


def field_cooccurrence(
    df: DataFrame,
    cols: list[str] | None = None,
    wide: bool = False,
    missing_values: tuple[str, ...] = MISSING,
) -> DataFrame:
    """Rows where both fields are present, for every ordered pair of fields.

    Rows shrink to presence patterns first, so the pair table is built from a few patterns
    and never from the records.
    """
    cols = cols or df.columns
    patterns = presence_patterns(df, cols, missing_values)
    bits = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(1 << i).cast("bigint").alias("bit")) for i, c in enumerate(cols)])
    left = patterns.select("mask", "n", F.inline(bits).alias("field", "bit"))
    pairs = left.select(
        "mask", "n", "field", "bit", F.inline(bits).alias("other_field", "other_bit")
    )
    both = (F.col("bit").bitwiseOR(F.col("other_bit"))).alias("both")
    counted = pairs.select("field", "other_field", "n", (F.col("mask").bitwiseAND(both) == both).alias("hit"))
    long = counted.groupBy("field", "other_field").agg(
        F.sum(F.when(F.col("hit"), F.col("n")).otherwise(F.lit(0))).alias("n_rows")
    )
    return long.groupBy("field").pivot("other_field", cols).agg(F.first("n_rows")) if wide else long


def combo_coverage(df: DataFrame, combos: dict[str, Column]) -> DataFrame:
    """Rows and percentage satisfying each named condition, all in one pass."""
    counts = df.agg(
        F.count(F.lit(1)).alias("_total"), *[F.count_if(p).alias(name) for name, p in combos.items()]
    )
    rows = F.array(
        *[F.struct(F.lit(n).alias("combination"), F.col(f"`{n}`").alias("n_records")) for n in combos]
    )
    return counts.select("_total", F.inline(rows)).select(
        "combination", "n_records", _percent(F.col("n_records"), F.col("_total")).alias("percentage")
    )


def has_field(name: str, missing_values: tuple[str, ...] = MISSING) -> Column:
    """Condition for :func:`combo_coverage`: the field is present."""
    return _present(name, missing_values)


def coverage_tier(fill: DataFrame, thresholds: tuple[float, float, float] = (100.0, 60.0, 20.0)) -> DataFrame:
    """Label each field of a fill-rate table essential / high / medium / low."""
    essential, high, medium = thresholds
    pct = F.col("percentage")
    return fill.withColumn(
        "tier",
        F.when(pct >= essential, "essential")
        .when(pct > high, "high")
        .when(pct >= medium, "medium")
        .otherwise("low"),
    )
