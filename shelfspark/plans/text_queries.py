"""Text-function queries, each over all documents, books or conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.plans import binds
from shelfspark.plans import sqltext as S
from shelfspark.plans.binds import with_views
from shelfspark.plans.registry import query, table


def _on_documents(name, column, sql):
    @query(name, f"SELECT doc_id, {sql} AS result FROM documents")
    def run(spark, sf):
        return table(spark, sf, "documents").select("doc_id", column().alias("result"))


_on_documents("s1_fold", lambda: T.fold("text"), S.fold("text"))
_on_documents("s2_ascii_only", lambda: T.ascii_only("text"), S.ascii_only("text"))
_on_documents("s3_comparison_key", lambda: T.comparison_key("text"), S.comparison_key("text"))
_on_documents("s6_collapse_ws", lambda: T.collapse_ws("text"), S.collapse_ws("text"))
_on_documents("s7_strip_markdown", lambda: T.strip_markdown("text"), S.strip_markdown("text"))


@query(
    "s4_clean_title",
    with_views("books") + f" SELECT ord, {S.clean_title(chr(39) + ' ' + chr(39) + ' || title || ' + chr(39) + ' / ' + chr(39))} AS result FROM books",
)
def clean(spark, sf):
    raw = F.concat(F.lit(" "), "title", F.lit(" / "))
    return binds.books(spark, sf).select("ord", T.clean_title(raw).alias("result"))


_AUTHOR_SQL = "CASE WHEN subject IN ('PROMO', 'SMALL') THEN author || ' (Autor), 1950-' WHEN subject = 'LARGE' THEN author || ', 1950-2001 ' ELSE author || ' (editor) , ' END"


@query("s5_strip_author_role", with_views("books") + f" SELECT ord, {S.strip_author_role(_AUTHOR_SQL)} AS result FROM books")
def author_role(spark, sf):
    return binds.books(spark, sf).select("ord", T.strip_author_role(F.expr(_AUTHOR_SQL)).alias("result"))


@query(
    "s8_tokens",
    """SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, '|') AS result FROM (
       SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\s,]+'), lambda x: length(x) >= 2) AS t FROM documents)""",
)
def tokens(spark, sf):
    t = T.tokens(F.lower("text"))
    return table(spark, sf, "documents").select(
        "doc_id", F.size(t).cast("bigint").alias("n_tokens"), F.array_join(t, "|").alias("result")
    )


@query("s9_capitalise_words", with_views("books") + f" SELECT ord, {S.capitalise_words('description')} AS result FROM books")
def capitalise(spark, sf):
    return binds.books(spark, sf).select("ord", T.capitalise_words("description").alias("result"))
