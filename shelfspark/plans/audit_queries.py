"""Catalogue-audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import audit
from shelfspark.plans import binds
from shelfspark.plans.binds import RECORD_FIELDS, with_views
from shelfspark.plans.registry import query
from shelfspark.plans.sqltext import present

_FLAGS = (
    ", flags AS (SELECT "
    + ", ".join(f'{present(chr(34) + f + chr(34))} AS "{f}"' for f in RECORD_FIELDS)
    + " FROM records)"
)
_FILL_SQL = " UNION ALL ".join(
    f"""SELECT '{f}' AS field, CAST(count(*) FILTER (WHERE "{f}") AS BIGINT) AS non_null_count,
        round(100.0 * count(*) FILTER (WHERE "{f}") / count(*), 6) AS percentage,
        CAST(count(*) FILTER (WHERE NOT "{f}") AS BIGINT) AS null_count FROM flags"""
    for f in RECORD_FIELDS
)
_PAIR_SQL = " UNION ALL ".join(
    f"""SELECT '{a}' AS field, '{b}' AS other_field,
        CAST(count(*) FILTER (WHERE "{a}" AND "{b}") AS BIGINT) AS n_rows FROM flags"""
    for a in RECORD_FIELDS
    for b in RECORD_FIELDS
)
_WIDE_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS field, "
    + ", ".join(f'CAST(count(*) FILTER (WHERE "{a}" AND "{b}") AS BIGINT) AS "{b}"' for b in RECORD_FIELDS)
    + " FROM flags"
    for a in RECORD_FIELDS
)
COMBOS = {
    "Title + Description": ("Title", "Description"),
    "Title + Author + Description": ("Title", "Author", "Description"),
    "Title + (Author OR Contributors)": ("Title", ("Author", "Contributors")),
    "Title + Description + (Author OR Contributors)": ("Title", "Description", ("Author", "Contributors")),
    "Title + Author + Publisher": ("Title", "Author", "Publisher"),
    "Title + Subjects + Description": ("Title", "Subjects", "Description"),
    "Title + Subjects + (Author OR Contributors)": ("Title", "Subjects", ("Author", "Contributors")),
}


def _combo_sql(parts: tuple) -> str:
    terms = [f'"{p}"' if isinstance(p, str) else "(" + " OR ".join(f'"{q}"' for q in p) + ")" for p in parts]
    return " AND ".join(terms)


def combo_condition(parts: tuple):
    condition = F.lit(True)
    for p in parts:
        term = F.lit(False)
        for name in (p,) if isinstance(p, str) else p:
            term = term | audit.has_field(name)
        condition = condition & term
    return condition


_COMBO_SQL = " UNION ALL ".join(
    f"""SELECT '{name}' AS combination, CAST(count(*) FILTER (WHERE {_combo_sql(parts)}) AS BIGINT) AS n_records,
        round(100.0 * count(*) FILTER (WHERE {_combo_sql(parts)}) / count(*), 6) AS percentage FROM flags"""
    for name, parts in COMBOS.items()
)


def _rounded(df):
    return df.withColumn("percentage", F.round("percentage", 6))


@query("a1_field_fill_rate", with_views("records") + _FLAGS + " " + _FILL_SQL)
def fill_rate(spark, sf):
    return _rounded(audit.field_fill_rate(binds.records(spark, sf)))


@query("a2_field_cooccurrence", with_views("records") + _FLAGS + " " + _PAIR_SQL)
def cooccurrence(spark, sf):
    return audit.field_cooccurrence(binds.records(spark, sf))


@query("a2_field_cooccurrence_wide", with_views("records") + _FLAGS + " " + _WIDE_SQL)
def cooccurrence_wide(spark, sf):
    return audit.field_cooccurrence(binds.records(spark, sf), wide=True)


@query("a3_combo_coverage", with_views("records") + _FLAGS + " " + _COMBO_SQL)
def combos(spark, sf):
    conditions = {name: combo_condition(parts) for name, parts in COMBOS.items()}
    return _rounded(audit.combo_coverage(binds.records(spark, sf), conditions))


@query(
    "a4_coverage_tier",
    with_views("records") + _FLAGS + f", fill AS ({_FILL_SQL})"
    + """ SELECT *, CASE WHEN percentage >= 100 THEN 'essential' WHEN percentage > 60 THEN 'high'
          WHEN percentage >= 20 THEN 'medium' ELSE 'low' END AS tier FROM fill""",
)
def tiers(spark, sf):
    return _rounded(audit.coverage_tier(audit.field_fill_rate(binds.records(spark, sf))))
