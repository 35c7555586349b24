"""Views over the given tables in the shapes the operators work on, in Spark and in SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.operators.postings import PostingIndex
from shelfspark.operators.search import catalog_texts
from shelfspark.plans.registry import table
from shelfspark.session import path_age, shared_dir

RECORD_FIELDS = [
    "Identifier", "Title", "Author", "Contributors", "Publisher", "PublicationYear", "ISBN", "ISSN", "Subjects",
    "Description", "Language", "PhysicalDescription", "Series", "Notes", "RecordType", "ContentType", "MediaType",
    "CarrierType",
]

# One definition per column, valid in both SQL dialects; names are d = documents, l = labels.
_RECORD_SQL = {
    "Identifier": "concat('CPK:', CAST(d.doc_id AS STRING))",
    "Title": "split_part(d.text, chr(10), 1)",
    "Author": "CASE WHEN l.quality = 1 THEN concat(d.source, ', ', d.lang, ' (autor)') END",
    "Contributors": "CASE WHEN l.toxic = 1 OR (l.quality = 0 AND d.lang <> 'en') THEN d.lang END",
    "Publisher": "CASE WHEN d.lang <> 'es' THEN d.source ELSE '' END",
    "PublicationYear": "CASE WHEN l.quality = 0 THEN 'nan' ELSE CAST(1950 + d.n_chars % 75 AS STRING) END",
    "ISBN": "CASE WHEN l.doc_id IS NOT NULL THEN concat('978', CAST(d.doc_id AS STRING)) END",
    "ISSN": "CASE WHEN l.toxic = 1 THEN CAST(d.n_chars AS STRING) END",
    "Subjects": "CASE WHEN l.doc_id IS NOT NULL OR d.lang <> 'en' THEN concat(d.lang, '; ', d.source) END",
    "Description": "CASE WHEN d.n_chars > 1500 THEN d.text END",
    "Language": "d.lang",
    "PhysicalDescription": "concat(CAST(d.n_chars AS STRING), ' s.')",
    "Series": "CASE WHEN d.source IN ('src1', 'src2', 'src3') THEN concat('\"Edice ', d.source, '\"') END",
    "Notes": "CASE WHEN d.n_chars <= 3000 THEN d.text END",
    "RecordType": "CASE WHEN d.lang = 'de' AND l.quality = 0 THEN 'nan' ELSE '00000nam a22' END",
    "ContentType": "CASE WHEN d.lang = 'fr' THEN 'text' END",
    "MediaType": "CASE WHEN d.lang = 'fr' AND d.n_chars > 1000 THEN 'bez média' END",
    "CarrierType": "CASE WHEN d.lang IN ('fr', 'de') THEN ' svazek ' END",
}

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "records": (
        (),
        "SELECT "
        + ", ".join(f'{sql.replace("STRING", "VARCHAR")} AS "{name}"' for name, sql in _RECORD_SQL.items())
        + " FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    ),
    "prompts": (
        (),
        """SELECT u.conv_id * 100 + u.turn AS prompt_id, u.text AS prompt_text, coalesce(a.text, '') AS answer_text,
                  u.conv_id AS conversation_id, l.quality = 1 AS user_feedback,
                  make_timestamp((1704067200 + (u.conv_id * 100 + u.turn) * 240) * 1000000) AS created_at
           FROM conversations u
           LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
           LEFT JOIN labels l ON l.doc_id = u.conv_id * 8 + u.turn
           WHERE u.role = 'user'""",
    ),
    "conversations_dim": (
        (),
        """SELECT c.conversation_id, CAST(0 AS INTEGER) AS length, l.toxic = 0 AS user_feedback,
                  CASE WHEN l.toxic = 1 THEN '**špatná** odpověď; [viz](x)' END AS user_feedback_message
           FROM (SELECT DISTINCT conv_id AS conversation_id FROM conversations) c
           LEFT JOIN labels l ON l.doc_id = c.conversation_id""",
    ),
    "messages": ((), "SELECT conv_id AS conversation_id, turn, role, text AS content FROM conversations"),
    "books": (
        (),
        """SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ord, p_name AS title, p_brand AS author,
                  p_type AS subject, CAST(p_size AS VARCHAR) AS year, p_brand AS publisher,
                  p_type || ' ' || p_name AS description
           FROM part""",
    ),
    "holdings": (
        (),
        """SELECT CAST(l_partkey AS VARCHAR) AS book_id, 'Pobočka ' || l_linestatus AS branch,
                  CAST(l_linenumber AS VARCHAR) AS location,
                  CASE l_returnflag WHEN 'N' THEN 'Volný' WHEN 'R' THEN 'volný' ELSE 'vypůjčeno' END AS status,
                  l_orderkey * 10 + l_linenumber AS ord
           FROM lineitem""",
    ),
    "docs_old": (
        (),
        """SELECT d.doc_id AS ord, 'https://library.example/' || d.source || '/' || d.doc_id AS url,
                  d.lang AS section_heading, CAST(0 AS INTEGER) AS chunk_index, d.text AS text
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
           WHERE l.toxic IS NULL OR l.toxic = 0""",
    ),
    "docs_new": (
        (),
        """SELECT d.doc_id AS ord, 'https://library.example/' || d.source || '/' || d.doc_id AS url,
                  d.lang AS section_heading, CAST(0 AS INTEGER) AS chunk_index,
                  CASE WHEN d.lang = 'de' THEN d.text || ' (revize)' ELSE d.text END AS text
           FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
           WHERE l.quality IS NULL OR l.quality = 1""",
    ),
}


def with_views(*names: str, recursive: bool = False) -> str:
    """``WITH`` clause that defines the named views for an oracle."""
    parts = [f"{name} AS ({SQL_VIEWS[name][1]})" for name in names]
    return ("WITH RECURSIVE " if recursive else "WITH ") + ", ".join(parts)


def records(spark: SparkSession, sf: str) -> DataFrame:
    d, lab = table(spark, sf, "documents").alias("d"), table(spark, sf, "labels").alias("l")
    joined = d.join(lab, F.expr("d.doc_id = l.doc_id"), "left")
    return joined.select(*[F.expr(sql).alias(name) for name, sql in _RECORD_SQL.items()])


def prompts(spark: SparkSession, sf: str) -> DataFrame:
    conv, lab = table(spark, sf, "conversations"), table(spark, sf, "labels")
    users = conv.filter(F.col("role") == "user").select("conv_id", "turn", "text")
    answers = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    pid = F.col("conv_id") * 100 + F.col("turn")
    return (
        users.join(answers, ["conv_id", "turn"], "left")
        .join(lab, F.col("doc_id") == F.col("conv_id") * 8 + F.col("turn"), "left")
        .select(
            pid.alias("prompt_id"),
            F.col("text").alias("prompt_text"),
            F.coalesce("answer", F.lit("")).alias("answer_text"),
            F.col("conv_id").alias("conversation_id"),
            (F.col("quality") == 1).alias("user_feedback"),
            F.timestamp_seconds(F.lit(1704067200) + pid * 240).alias("created_at"),
        )
    )


def conversations_dim(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "conversations").select(F.col("conv_id").alias("conversation_id")).distinct()
    lab = table(spark, sf, "labels").select(F.col("doc_id").alias("conversation_id"), "toxic")
    return ids.join(lab, "conversation_id", "left").select(
        "conversation_id",
        F.lit(0).alias("length"),
        (F.col("toxic") == 0).alias("user_feedback"),
        F.when(F.col("toxic") == 1, "**špatná** odpověď; [viz](x)").alias("user_feedback_message"),
    )


def messages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select(
        F.col("conv_id").alias("conversation_id"), "turn", "role", F.col("text").alias("content")
    )


def books(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_partkey").alias("ord"),
        F.col("p_name").alias("title"),
        F.col("p_brand").alias("author"),
        F.col("p_type").alias("subject"),
        F.col("p_size").cast("string").alias("year"),
        F.col("p_brand").alias("publisher"),
        F.concat_ws(" ", "p_type", "p_name").alias("description"),
    )


def holdings(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    return table(spark, sf, "lineitem").select(
        F.col("l_partkey").cast("string").alias("book_id"),
        F.concat(F.lit("Pobočka "), "l_linestatus").alias("branch"),
        F.col("l_linenumber").cast("string").alias("location"),
        F.when(flag == "N", "Volný").when(flag == "R", "volný").otherwise("vypůjčeno").alias("status"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"),
    )


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return d.select(
        F.col("doc_id").alias("ord"),
        F.concat(F.lit("https://library.example/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("lang").alias("section_heading"),
        F.lit(0).alias("chunk_index"),
        "text",
        "quality",
        "toxic",
    )


def docs_old(spark: SparkSession, sf: str) -> DataFrame:
    """The index before a crawl: everything but the rows labelled toxic."""
    return _docs(spark, sf).filter(F.coalesce("toxic", F.lit(0)) == 0).drop("quality", "toxic")


def docs_new(spark: SparkSession, sf: str) -> DataFrame:
    """The next crawl: low-quality rows are gone, German ones were revised."""
    d = _docs(spark, sf).filter(F.coalesce("quality", F.lit(1)) == 1)
    revised = F.when(F.col("section_heading") == "de", F.concat("text", F.lit(" (revize)"))).otherwise(F.col("text"))
    return d.withColumn("text", revised).drop("quality", "toxic")


def book_index(spark: SparkSession, sf: str) -> PostingIndex:
    """The stored posting index of the books, kept in the shared folder; built where the table has none yet or has changed."""
    mark = f"{sf}|{path_age(spark, f'{sf}/part.parquet')}"
    index = PostingIndex(spark, f"{shared_dir(spark)}/book-postings-{hashlib.sha256(mark.encode()).hexdigest()[:16]}")
    index.apply("load", catalog_texts(books(spark, sf), ("TITLE", "AU", "SUBJECT", "G")))
    return index
