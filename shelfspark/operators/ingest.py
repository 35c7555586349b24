"""Catalogue ingestion: MARC fields to flat records, record filters, embedding text, upsert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.text import WS_LIST, _col, computed_once, missing_to_null, trim_ws
from shelfspark.operators.skew import first_per_key

RECORD_COLUMNS = (
    "Identifier", "Title", "Author", "Contributors", "Publisher", "PublicationYear", "ISBN", "ISSN", "Subjects",
    "Description", "Language", "PhysicalDescription", "Series", "Notes", "RecordType", "ContentType", "MediaType",
    "CarrierType",
)
KEY_MARK = "CPK:"
UNKNOWN_AUTHOR = "Neznámý autor"
UNKNOWN_TITLE = "Neznámý název"
HARVEST_DAYS = 7


def _flat(marc: Column) -> Column:
    """All subfields of a record in document order: tag, code, text."""
    per_field = F.transform(
        F.filter(marc["datafield"], lambda f: f["subfield"].isNotNull()),
        lambda f: F.transform(
            f["subfield"],
            lambda s: F.struct(f["_tag"].alias("tag"), s["_code"].alias("code"), F.nullif(s["_VALUE"], F.lit("")).alias("text")),
        ),
    )
    return F.coalesce(F.flatten(per_field), F.array().cast("array<struct<tag:string,code:string,text:string>>"))


def _first(tag: str, code: str) -> Column:
    """First subfield with that code over all repeats of the tag; null when empty or absent."""
    return F.get(F.filter("_flat", lambda s: (s["tag"] == tag) & (s["code"] == code)), F.lit(0))["text"]


def _all(tags: tuple[str, ...], code: str) -> Column:
    """Non-empty texts of one code, tag after tag, in document order within a tag."""
    def of(tag: str) -> Column:
        hits = F.filter("_flat", lambda s: (s["tag"] == tag) & (s["code"] == code) & s["text"].isNotNull())
        return F.transform(hits, lambda s: s["text"])

    return F.concat(*[of(t) for t in tags])


def _by_tag(low: str, high: str, codes: tuple[str, ...]) -> Column:
    """Non-empty texts of a range of numeric tags, ordered by tag, then code, then document order."""
    def inside(s: Column) -> Column:
        return s["tag"].between(low, high) & s["code"].isin(*codes) & s["text"].isNotNull() & s["tag"].rlike("^[0-9]{3}$")

    placed = F.transform(
        F.filter("_flat", inside), lambda s, i: F.struct(s["tag"].alias("tag"), s["code"].alias("code"), i.alias("at"), s["text"].alias("text"))
    )
    return F.transform(F.array_sort(placed), lambda s: s["text"])


def marc_records(df: DataFrame, identifier: str = "identifier", marc: str = "marc") -> DataFrame:
    """The 18 text columns of each MARC record; a missing value is the empty string."""
    m, first = F.col("_marc"), _first
    field_008 = F.get(F.filter(m["controlfield"], lambda c: c["_tag"] == "008"), F.lit(0))["_VALUE"]
    language = F.when(F.length(field_008) > 38, trim_ws(F.substring(field_008, 36, 3)))
    title = F.concat(
        F.coalesce(first("245", "a"), F.lit("")),
        F.coalesce(F.concat(F.lit(" : "), first("245", "b")), F.lit("")),
        F.coalesce(F.concat(F.lit(" "), first("245", "n")), F.lit("")),
    )
    old_publisher = F.nullif(F.concat_ws(" ", first("260", "a"), first("260", "b")), F.lit(""))
    new_publisher = F.concat_ws(" ", first("264", "a"), first("264", "b"))
    year = F.when(old_publisher.isNotNull(), first("260", "c")).otherwise(F.coalesce(first("260", "c"), first("264", "c")))
    columns = {
        "Identifier": F.col(identifier),
        "Title": title,
        "Author": F.coalesce(first("100", "a"), first("110", "a"), first("111", "a")),
        "Contributors": F.array_join(_all(("700", "710", "711"), "a"), "; "),
        "Publisher": F.coalesce(old_publisher, new_publisher),
        "PublicationYear": year,
        "ISBN": first("020", "a"),
        "ISSN": first("022", "a"),
        "Subjects": F.array_join(F.array_distinct(_by_tag("600", "699", ("a", "x"))), "; "),
        "Description": first("520", "a"),
        "Language": language,
        "PhysicalDescription": F.array_join(F.concat(*[_all(("300",), code) for code in "abc"]), " "),
        "Series": F.array_join(_all(("490", "830"), "a"), "; "),
        "Notes": F.array_join(_by_tag("500", "599", ("a",)), "; "),
        "RecordType": m["leader"],
        "ContentType": first("336", "a"),
        "MediaType": first("337", "a"),
        "CarrierType": first("338", "a"),
    }
    parsed = computed_once(df, {"_marc": F.col(marc)}).filter(m.isNotNull())
    kept = computed_once(parsed, {"_flat": _flat(m)})
    return kept.select(*[F.coalesce(columns[name], F.lit("")).alias(name) for name in RECORD_COLUMNS])


def harvest_window(df: DataFrame, ts: str, until: str, days: int = HARVEST_DAYS) -> DataFrame:
    """Rows dated from ``days`` before ``until`` to ``until``, both dates included.

    Compares the stored column with constants, so files and partitions outside are skipped.
    """
    last = F.lit(until).cast("date")
    return df.filter(
        (F.col(ts) >= F.date_sub(last, days).cast("timestamp")) & (F.col(ts) < F.date_add(last, 1).cast("timestamp"))
    )


def _clean(name: str) -> Column:
    """Trimmed, without edge quotes; empty for a missing value."""
    bare = F.regexp_replace(trim_ws(F.coalesce(F.col(name), F.lit(""))), r"^[\"']+|[\"']+$", "")
    return F.when(F.lower(bare) == "nan", "").otherwise(bare)


def normalize_records(df: DataFrame) -> DataFrame:
    """Records with title, description, type and an author or contributor, all fields cleaned."""
    def given(name: str) -> Column:
        return missing_to_null(name, ("nan",)).isNotNull() & (F.col(name) != "")

    complete = given("Title") & given("Description") & given("RecordType") & (given("Author") | given("Contributors"))
    return df.filter(complete).select("Identifier", *[_clean(c).alias(c) for c in RECORD_COLUMNS[1:]])


def record_key(c: Column | str) -> Column:
    """Text after the first 'CPK:' up to the next one, trimmed; the input when there is none."""
    col = _col(c)
    return F.when(col.contains(KEY_MARK), trim_ws(F.split_part(col, F.lit(KEY_MARK), F.lit(2)))).otherwise(col)


def embedding_text() -> Column:
    """Labelled lines of a record; absent fields leave no line."""
    def line(label: str, name: str) -> Column:
        return F.when(F.coalesce(F.col(name), F.lit("")) != "", F.concat(F.lit(f"{label}: "), F.col(name)))

    return F.concat_ws(
        "\n",
        line("Title", "Title"),
        line("Description", "Description"),
        line("Type", "RecordType"),
        F.coalesce(line("Author", "Author"), line("Contributors", "Contributors")),
        line("Subjects", "Subjects"),
        line("Notes", "Notes"),
    )


def parse_embedding_text(df: DataFrame, col: str) -> DataFrame:
    """Adds title, author, subjects, description, record_type and notes read back from labelled lines.

    The last line with a label wins. The author falls back to the contributors, then to a default.
    """
    lines = F.transform(F.split(F.coalesce(F.col(col), F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(WS_LIST)))
    split = df.withColumn("_lines", lines)

    def last(label: str) -> Column:
        hits = F.filter("_lines", lambda x: x.startswith(f"{label}:"))
        text = F.when(F.size(hits) > 0, F.element_at(hits, -1))
        return trim_ws(F.substr(text, F.lit(len(label) + 2)))

    def valid(label: str) -> Column:
        return missing_to_null(last(label), ("", "nan", "none"))

    def empty(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    return split.withColumns(
        {
            "title": F.coalesce(valid("Title"), F.lit(UNKNOWN_TITLE)),
            "author": F.coalesce(
                F.nullif(last("Author"), F.lit("")), F.nullif(last("Contributors"), F.lit("")), F.lit(UNKNOWN_AUTHOR)
            ),
            "subjects": empty(valid("Subjects")),
            "description": empty(valid("Description")),
            "record_type": empty(valid("Type")),
            "notes": empty(valid("Notes")),
        }
    ).drop("_lines")


def replace_or_upsert(target: DataFrame, batch: DataFrame, key: str, order: str, mode: str = "upsert") -> DataFrame:
    """Next version of a keyed collection: the batch over the target, or the batch alone.

    Within the batch the row with the highest ``order`` wins per key.
    """
    latest = first_per_key(batch, [key], [F.desc(order)])
    if mode == "replace":
        return latest
    if mode != "upsert":
        raise ValueError(f"unknown mode {mode}")
    return target.join(latest.select(key), key, "left_anti").unionByName(latest)
