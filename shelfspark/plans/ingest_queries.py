"""Catalogue-ingestion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import ingest as B
from shelfspark.plans import binds
from shelfspark.plans import sqltext as S
from shelfspark.plans.binds import RECORD_FIELDS, with_views
from shelfspark.plans.registry import query, table
from shelfspark.session import scratch_path
from shelfspark.sources import csv_files, marc
from shelfspark.sources.keyed_store import KeyedStore

_SUB = "struct<_VALUE:string,_code:string>"


def _marc_rows(spark, sf):
    """Every document's metadata as a MARC record in the reader's own shape."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    doc, size = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    lang, source = F.col("lang"), F.col("source")

    def sub(code, value):
        return F.struct(value.alias("_VALUE"), F.lit(code).alias("_code"))

    def field(tag, *subs, when=None):
        row = F.struct(
            F.lit(tag).alias("_tag"), F.lit("1").alias("_ind1"), F.lit(" ").alias("_ind2"),
            F.array(*subs).cast(f"array<{_SUB}>").alias("subfield"),
        )
        return row if when is None else F.when(when, row)

    good, bad, toxic = F.col("quality") == 1, F.col("quality") == 0, F.col("toxic") == 1
    unlabelled = F.col("quality").isNull()
    fields = F.array_compact(
        F.array(
            field("020", sub("a", F.concat(F.lit("978"), doc)), when=good),
            field("022", sub("a", size), when=toxic),
            field("100", sub("a", F.concat(source, F.lit(" & spol."))), when=good),
            field("110", sub("b", source), sub("a", F.concat(F.lit("Korporace "), source)), when=bad),
            field("111", sub("a", F.concat(F.lit("Akce "), lang)), when=unlabelled & (lang == "fr")),
            field("245", sub("a", F.concat(F.lit("Kniha <"), doc, F.lit(">")))),
            field("245", sub("b", lang), sub("n", F.lit("díl 2")), sub("a", F.lit("druhý titul")), when=lang != "en"),
            field("260", sub("a", F.lit("Praha :")), sub("b", source), sub("c", F.lit("1999")), when=lang == "en"),
            field("260", sub("c", F.lit("2001")), when=lang == "de"),
            field("264", sub("a", F.lit("Brno")), sub("c", F.lit("2005")), when=lang != "es"),
            field("300", sub("a", F.concat(size, F.lit(" s."))), sub("c", F.lit("23 cm"))),
            field("300", sub("b", F.lit("il."))),
            field("336", sub("a", F.lit("text")), when=lang == "fr"),
            field("337", sub("a", F.lit("bez média")), when=lang == "de"),
            field("338", sub("a", F.lit("svazek")), when=lang != "en"),
            field("490", sub("a", F.lit("Edice")), when=toxic),
            field("650", sub("x", F.lit("dějiny")), sub("a", source), sub("a", lang)),
            field("520", sub("a", F.concat(F.lit("Popis "), size)), when=~(lang == "es")),
            field("500", sub("a", F.concat(F.lit("Poznámka "), doc))),
            field("600", sub("a", lang), sub("x", F.lit("osoby")), sub("a", F.lit("dějiny"))),
            field("700", sub("a", source), sub("a", lang), when=toxic),
            field("710", sub("a", F.lit("Ústav")), when=bad),
            field("700", sub("a", F.lit("Dodatek")), when=toxic),
            field("830", sub("a", F.lit("Řada")), when=toxic | bad),
        )
    )
    text_008 = F.concat(F.lpad(F.lit(""), 35, "0"), F.rpad(lang, 3, " "), F.lit("xx"))
    record = F.struct(
        F.lit("00000nam a22").alias("leader"),
        F.array(
            F.struct(doc.alias("_VALUE"), F.lit("001").alias("_tag")),
            F.struct(text_008.alias("_VALUE"), F.lit("008").alias("_tag")),
        ).alias("controlfield"),
        fields.alias("datafield"),
    )
    return d.select(F.concat(F.lit("oai:CPK:"), doc).alias("identifier"), record.alias("marc"))


_MARC_SQL = """WITH d AS (SELECT d.*, quality, toxic, coalesce(quality = 1, false) AS good, coalesce(quality = 0, false) AS bad, coalesce(toxic = 1, false) AS tox,
      CAST(d.doc_id AS VARCHAR) AS doc, CAST(n_chars AS VARCHAR) AS size FROM documents d LEFT JOIN labels l USING (doc_id))
  SELECT 'oai:CPK:' || doc AS "Identifier", 'Kniha <' || doc || '>' || CASE WHEN lang <> 'en' THEN ' : ' || lang || ' díl 2' ELSE '' END AS "Title",
    CASE WHEN good THEN source || ' & spol.' WHEN bad THEN 'Korporace ' || source WHEN lang = 'fr' THEN 'Akce fr' ELSE '' END AS "Author",
    concat_ws('; ', CASE WHEN tox THEN source || '; ' || lang || '; Dodatek' END, CASE WHEN bad THEN 'Ústav' END) AS "Contributors",
    CASE lang WHEN 'en' THEN 'Praha : ' || source WHEN 'es' THEN '' ELSE 'Brno' END AS "Publisher",
    CASE lang WHEN 'en' THEN '1999' WHEN 'de' THEN '2001' WHEN 'es' THEN '' ELSE '2005' END AS "PublicationYear",
    CASE WHEN good THEN '978' || doc ELSE '' END AS "ISBN", CASE WHEN tox THEN size ELSE '' END AS "ISSN",
    lang || '; dějiny; osoby; ' || source AS "Subjects",
    CASE WHEN lang = 'es' THEN '' ELSE 'Popis ' || size END AS "Description", lang AS "Language", size || ' s. il. 23 cm' AS "PhysicalDescription",
    concat_ws('; ', CASE WHEN tox THEN 'Edice' END, CASE WHEN tox OR bad THEN 'Řada' END) AS "Series",
    'Poznámka ' || doc || CASE WHEN lang = 'es' THEN '' ELSE '; Popis ' || size END AS "Notes", '00000nam a22' AS "RecordType",
    CASE WHEN lang = 'fr' THEN 'text' ELSE '' END AS "ContentType", CASE WHEN lang = 'de' THEN 'bez média' ELSE '' END AS "MediaType",
    CASE WHEN lang <> 'en' THEN 'svazek' ELSE '' END AS "CarrierType" FROM d"""


@query("b1_marc_records", _MARC_SQL)
def marc_records(spark, sf):
    """Rendered to XML text and parsed back from the column."""
    xml = _marc_rows(spark, sf).select("identifier", F.to_xml("marc").alias("xml"))
    return B.marc_records(xml.select("identifier", marc.parse_marc("xml").alias("marc")))


@query("b1_marc_files", _MARC_SQL)
def marc_files(spark, sf):
    """The same records through XML files in the shared folder and the file reader."""
    path = scratch_path(spark, "marc")
    envelopes = _marc_rows(spark, sf).select(
        F.struct("identifier").alias("header"), F.struct(F.col("marc").alias("record")).alias("metadata")
    )
    envelopes.write.format("xml").option("rootTag", "envelopes").option("rowTag", "envelope").save(path)
    return B.marc_records(marc.read_envelopes(spark, path, "envelope"))


@query(
    "b2_harvest_window",
    "SELECT event_id, event_type FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-13' AND DATE '2024-01-20'",
)
def window(spark, sf):
    return B.harvest_window(table(spark, sf, "events"), "ts", "2024-01-20").select("event_id", "event_type")


@query(
    "b3_csv_round_trip",
    with_views("records") + " SELECT " + ", ".join(f"coalesce(\"{c}\", '') AS \"{c}\"" for c in RECORD_FIELDS) + " FROM records",
)
def csv(spark, sf):
    path = scratch_path(spark, "records-csv")
    csv_files.write_records_csv(binds.records(spark, sf), path)
    return csv_files.read_records_csv(spark, path, RECORD_FIELDS)


def _clean_sql(c):
    bare = S.sub(S.trim_ws(f"coalesce(\"{c}\", '')"), "^[\"']+|[\"']+$")
    return f"CASE WHEN lower({bare}) = 'nan' THEN '' ELSE {bare} END"


def _given_sql(c):
    return f"(coalesce(\"{c}\", '') <> '' AND lower({S.trim_ws(chr(34) + c + chr(34))}) <> 'nan')"


_NORMAL_SQL = (
    ", normal AS (SELECT \"Identifier\", " + ", ".join(f'{_clean_sql(c)} AS "{c}"' for c in RECORD_FIELDS[1:])
    + f" FROM records WHERE {_given_sql('Title')} AND {_given_sql('Description')} AND {_given_sql('RecordType')}"
    f" AND ({_given_sql('Author')} OR {_given_sql('Contributors')}))"
)


@query("b4_normalize_records", with_views("records") + _NORMAL_SQL + " SELECT * FROM normal")
def normalize(spark, sf):
    return B.normalize_records(binds.records(spark, sf))


@query(
    "b5_record_key",
    """WITH k AS (SELECT doc_id, CASE lang WHEN 'en' THEN 'oai:CPK: ' || doc_id || ' ' WHEN 'de' THEN 'x CPK:' || source || 'CPK:' || doc_id ELSE source END AS raw FROM documents)
       SELECT doc_id, CASE WHEN contains(raw, 'CPK:') THEN trim(split_part(raw, 'CPK:', 2)) ELSE raw END AS key FROM k""",
)
def record_key(spark, sf):
    doc = F.col("doc_id").cast("string")
    raw = (
        F.when(F.col("lang") == "en", F.concat(F.lit("oai:CPK: "), doc, F.lit(" ")))
        .when(F.col("lang") == "de", F.concat(F.lit("x CPK:"), "source", F.lit("CPK:"), doc))
        .otherwise(F.col("source"))
    )
    return table(spark, sf, "documents").select("doc_id", B.record_key(raw).alias("key"))


_EMBED_SQL = """concat_ws(chr(10), 'Title: ' || nullif("Title", ''), 'Description: ' || nullif("Description", ''), 'Type: ' || nullif("RecordType", ''),
   coalesce('Author: ' || nullif("Author", ''), 'Contributors: ' || nullif("Contributors", '')), 'Subjects: ' || nullif("Subjects", ''), 'Notes: ' || nullif("Notes", ''))"""


@query("b6_embedding_text", with_views("records") + f' SELECT "Identifier", {_EMBED_SQL} AS document FROM records')
def embedding_text(spark, sf):
    return binds.records(spark, sf).select("Identifier", B.embedding_text().alias("document"))


def _last_sql(label):
    return f"""{S.trim_ws(f"list_filter(ls, lambda x: starts_with(x, '{label}:'))[-1][{len(label) + 2}:]")}"""


def _valid_sql(label, default):
    return f"CASE WHEN {S.present(_last_sql(label), ('', 'nan', 'none'))} THEN {_last_sql(label)} ELSE '{default}' END"


@query(
    "b7_parse_embedding_text",
    with_views("records")
    + f""", e AS (SELECT "Identifier", list_transform(string_split({_EMBED_SQL}, chr(10)), lambda x: {S.trim_ws('x')}) AS ls FROM records)
      SELECT "Identifier", {_valid_sql('Title', 'Neznámý název')} AS title,
        coalesce(nullif({_last_sql('Author')}, ''), nullif({_last_sql('Contributors')}, ''), 'Neznámý autor') AS author,
        {_valid_sql('Subjects', '')} AS subjects, {_valid_sql('Description', '')} AS description, {_valid_sql('Type', '')} AS record_type,
        {_valid_sql('Notes', '')} AS notes FROM e""",
)
def parse_embedding(spark, sf):
    texts = binds.records(spark, sf).select("Identifier", B.embedding_text().alias("document"))
    return B.parse_embedding_text(texts, "document").drop("document")


@query(
    "b8_upsert",
    with_views("docs_old", "docs_new")
    + """, b AS (SELECT url AS key, text, ord FROM docs_new WHERE section_heading = 'de' OR url LIKE '%/src7/%'),
       t AS (SELECT url AS key, text, ord FROM docs_old)
       SELECT * FROM t WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT * FROM b""",
)
def upsert(spark, sf):
    batch = binds.docs_new(spark, sf).filter((F.col("section_heading") == "de") | F.col("url").contains("/src7/"))
    target = binds.docs_old(spark, sf)
    keyed = [df.select(F.col("url").alias("key"), "text", "ord") for df in (target, batch)]
    return B.replace_or_upsert(keyed[0], keyed[1], "key", "ord")


@query(
    "b_records_to_index",
    with_views("records") + _NORMAL_SQL
    + f""" SELECT trim(split_part("Identifier", 'CPK:', 2)) AS id, {_EMBED_SQL} AS document FROM normal""",
)
def to_index(spark, sf):
    """Normalise, key and render all records: what an embedding job reads."""
    normal = B.normalize_records(binds.records(spark, sf)).withColumn("document", B.embedding_text())
    rows = normal.select(B.record_key("Identifier").alias("id"), "document", F.lit(0).alias("ord"))
    return B.replace_or_upsert(rows, rows, "id", "ord", mode="replace").drop("ord")


@query(
    "b_xml_to_index",
    f"""WITH records AS (SELECT * FROM ({_MARC_SQL} WHERE doc_id % 30 BETWEEN 12 AND 19))"""
    + _NORMAL_SQL
    + f""", fresh AS (SELECT trim(split_part("Identifier", 'CPK:', 2)) AS id, {_EMBED_SQL} AS document FROM normal),
      stored AS (SELECT CAST(doc_id AS VARCHAR) AS id, 'starší záznam ' || doc_id AS document FROM documents WHERE doc_id % 3 = 0)
      SELECT * FROM fresh UNION ALL SELECT * FROM stored WHERE id NOT IN (SELECT id FROM fresh)""",
)
def xml_to_index(spark, sf):
    """A harvest from XML files to a stored index: envelopes dated within the window become records, go through the CSV
    form, are normalised and rendered, and replace or join what the index holds."""
    folder = scratch_path(spark, "harvest")
    doc = F.regexp_extract("identifier", "([0-9]+)$", 1).cast("int")
    dated = _marc_rows(spark, sf).withColumn("datestamp", F.date_add(F.lit("2024-01-01").cast("date"), doc % 30).cast("string"))
    envelopes = dated.select(F.struct("identifier", "datestamp").alias("header"), F.struct(F.col("marc").alias("record")).alias("metadata"))
    envelopes.write.format("xml").option("rootTag", "envelopes").option("rowTag", "envelope").save(f"{folder}/xml")
    harvested = marc.read_envelopes(spark, f"{folder}/xml", "envelope").withColumn("datestamp", F.col("datestamp").cast("timestamp"))
    records = B.marc_records(B.harvest_window(harvested, "datestamp", "2024-01-20"))
    csv_files.write_records_csv(records, f"{folder}/csv")
    normal = B.normalize_records(csv_files.read_records_csv(spark, f"{folder}/csv", RECORD_FIELDS))
    batch = normal.select(B.record_key("Identifier").alias("id"), B.embedding_text().alias("document"))
    store = KeyedStore(spark, f"{folder}/index", "id", "id string, document string")
    stored = table(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").cast("string").alias("id"))
    store.merge("load", stored.withColumn("document", F.concat(F.lit("starší záznam "), "id")))
    store.merge("harvest", batch)
    return store.read()
