"""MARC-XML records as Spark rows: a fixed schema over the built-in XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_CONTROL = "array<struct<_VALUE:string,_tag:string>>"
_DATA = "array<struct<_tag:string,_ind1:string,_ind2:string,subfield:array<struct<_VALUE:string,_code:string>>>>"
MARC_SCHEMA = f"leader string, controlfield {_CONTROL}, datafield {_DATA}"
MARC_TYPE = f"struct<leader:string,controlfield:{_CONTROL},datafield:{_DATA}>"
ENVELOPE_SCHEMA = f"header struct<identifier:string,datestamp:string>, metadata struct<record:{MARC_TYPE}>"


def read_envelopes(spark: SparkSession, path: str, row_tag: str = "record") -> DataFrame:
    """Harvested files: one row per envelope with its header and MARC record."""
    raw = spark.read.format("xml").option("rowTag", row_tag).schema(ENVELOPE_SCHEMA).load(path)
    return raw.select(
        F.col("header.identifier").alias("identifier"),
        F.col("header.datestamp").alias("datestamp"),
        F.col("metadata.record").alias("marc"),
    )


def parse_marc(xml: Column | str) -> Column:
    """A MARC record from a column that holds its XML."""
    return F.from_xml(F.col(xml) if isinstance(xml, str) else xml, MARC_SCHEMA)
