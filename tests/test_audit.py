from __future__ import annotations

from shelfspark.operators import audit

# Published audit of 937,364 records: present counts per field.
TOTAL = 937364
PRESENT = {
    "Identifier": 937364, "Title": 937364, "Author": 614557, "Contributors": 336574, "Publisher": 833994,
    "PublicationYear": 830356, "ISBN": 335594, "ISSN": 91152, "Subjects": 554790, "Description": 175555,
    "Language": 901168, "PhysicalDescription": 885261, "Series": 256258, "Notes": 626856, "RecordType": 937333,
    "ContentType": 183918, "MediaType": 176836, "CarrierType": 183920,
}
AUTHOR_AND_CONTRIBUTORS = 253801


def _published(spark):
    """A table with the published author/contributor overlap, one row per record."""
    only_author = PRESENT["Author"] - AUTHOR_AND_CONTRIBUTORS
    only_contributor = PRESENT["Contributors"] - AUTHOR_AND_CONTRIBUTORS
    both = AUTHOR_AND_CONTRIBUTORS
    return spark.range(TOTAL).selectExpr(
        "cast(id AS string) AS Identifier",
        "'t' AS Title",
        f"CASE WHEN id < {both + only_author} THEN 'a' ELSE ' NaN ' END AS Author",
        f"CASE WHEN id < {both} OR (id >= {both + only_author} AND id < {both + only_author + only_contributor}) THEN 'c' END AS Contributors",
    )


def test_published_fill_rates_and_inclusion_exclusion(spark):
    df = _published(spark)
    fill = {r["field"]: r for r in audit.field_fill_rate(df).collect()}
    assert fill["Author"]["non_null_count"] == 614557 and fill["Author"]["null_count"] == 322807
    assert round(fill["Author"]["percentage"], 2) == 65.56
    assert round(fill["Contributors"]["percentage"], 2) == 35.91
    either = audit.has_field("Title") & (audit.has_field("Author") | audit.has_field("Contributors"))
    combo = audit.combo_coverage(df, {"Title + (Author OR Contributors)": either}).first()
    assert combo["n_records"] == 697330 and round(combo["percentage"], 2) == 74.39
    pairs = {(r["field"], r["other_field"]): r["n_rows"] for r in audit.field_cooccurrence(df).collect()}
    assert pairs["Author", "Contributors"] == pairs["Contributors", "Author"] == AUTHOR_AND_CONTRIBUTORS
    assert {f: pairs[f, f] for f in df.columns} == {f: fill[f]["non_null_count"] for f in df.columns}


def test_wide_matrix_equals_long(spark):
    df = _published(spark).limit(1000)
    wide = {r["field"]: r.asDict() for r in audit.field_cooccurrence(df, wide=True).collect()}
    for r in audit.field_cooccurrence(df).collect():
        assert wide[r["field"]][r["other_field"]] == r["n_rows"]


def test_tiers_follow_the_thresholds(spark):
    rows = [(f, n, 100.0 * n / TOTAL, TOTAL - n) for f, n in PRESENT.items()]
    fill = spark.createDataFrame(rows, "field string, non_null_count long, percentage double, null_count long")
    tier = {r["field"]: r["tier"] for r in audit.coverage_tier(fill).collect()}
    assert [f for f, t in tier.items() if t == "essential"] == ["Identifier", "Title"]
    assert tier["Author"] == tier["Notes"] == tier["RecordType"] == "high"
    assert tier["Subjects"] == tier["ISBN"] == tier["Series"] == "medium"
    assert tier["Description"] == tier["ISSN"] == tier["MediaType"] == "low"


def test_zero_rows_give_null_percentages(spark):
    empty = spark.createDataFrame([], "a string, b string")
    assert [r["percentage"] for r in audit.field_fill_rate(empty).collect()] == [None, None]
