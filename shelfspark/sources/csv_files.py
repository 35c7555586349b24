"""Quoted CSV for catalogue records: every value a string, missing values written as \"\"."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_records_csv(df: DataFrame, path: str) -> None:
    """Header, every value quoted, quotes doubled, null as the empty string; embedded newlines stay."""
    filled = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])
    filled.write.mode("overwrite").csv(
        path, header=True, quoteAll=True, escape='"', emptyValue="",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
    )


def read_records_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Reads what :func:`write_records_csv` wrote; nothing is inferred, identifiers keep their text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    raw = spark.read.schema(schema).csv(
        path, header=True, multiLine=True, escape='"', emptyValue="", lineSep="\n",
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxCharsPerColumn=-1,
    )
    return raw.na.fill("")
