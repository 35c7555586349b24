"""Catalogue-search queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text
from shelfspark.operators import search as C
from shelfspark.operators.postings import PostingIndex
from shelfspark.plans import binds
from shelfspark.plans import sqltext as S
from shelfspark.plans.binds import with_views
from shelfspark.plans.registry import query, table
from shelfspark.session import scratch_path

_TITLES = [(1, "Rěd Widget"), (2, "bolt"), (3, "blue  ring"), (4, "nic takového"), (5, "GEAR hot")]
_TEXT_SQL = {
    "TITLE": "title", "AU": "author", "SUBJECT": "subject", "G": "concat_ws(' ', title, author, subject, description)",
    "DATE1": "year", "PUBL": "publisher",
}


def _match_sql(specs):
    """UNION of one containment scan per (query_id, tier, field, text)."""
    arms = []
    for qid, tier, field, text in specs:
        words = fold_text(text).split()
        if words:
            cond = " AND ".join(f"contains({S.fold(_TEXT_SQL[field])}, {S.lit(w)})" for w in words)
            if field == "DATE1":
                cond = f"{S.fold('year')} = {S.lit(fold_text(text))}"
            arms.append(f"SELECT {qid} AS query_id, {tier} AS tier, books.* FROM books WHERE {cond}")
    return "hits AS (" + " UNION ALL ".join(arms) + ")"


_KEEP_SQL = """, uniq AS (SELECT * FROM {src} QUALIFY row_number() OVER
    (PARTITION BY query_id, trim(lower(title)) || '|' || trim(lower(author)) ORDER BY ord, id) = 1),
  kept AS (SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ord, id) <= {limit})"""
_OUT = "query_id, id, title, author, subject"


def _search_sql(field, queries, limit):
    return (
        with_views("books") + ", " + _match_sql([(q, 0, field, t) for q, t in queries])
        + _KEEP_SQL.format(src="hits", limit=limit) + f" SELECT {_OUT} FROM kept"
    )


@query("c1_catalog_search", _search_sql("TITLE", _TITLES, 5))
def search(spark, sf):
    return C.catalog_search(binds.books(spark, sf), _TITLES, "TITLE").select(*_OUT.split(", "))


@query("c1_catalog_search_all", _search_sql("G", _TITLES, 1000000))
def search_all(spark, sf):
    return C.catalog_search(binds.books(spark, sf), _TITLES, "G", C.FETCH_ALL).select(*_OUT.split(", "))


@query(
    "c1_catalog_search_table",
    with_views("books")
    + f""", q AS (SELECT n_nationkey AS query_id, CASE WHEN n_regionkey < 2 THEN 'Bränd#' || n_nationkey ELSE 'ring brand#' || n_nationkey END AS query FROM nation),
       hits AS (SELECT q.query_id, books.* FROM books JOIN q ON list_bool_and(list_transform(string_split({S.fold('q.query')}, ' '),
         lambda w: contains({S.fold(_TEXT_SQL['G'])}, w))))"""
    + _KEEP_SQL.format(src="hits", limit=5) + f" SELECT {_OUT} FROM kept",
)
def search_table(spark, sf):
    key = F.col("n_nationkey").cast("string")
    wanted = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("query_id"),
        F.when(F.col("n_regionkey") < 2, F.concat(F.lit("Bränd#"), key))
        .otherwise(F.concat(F.lit("ring brand#"), key))
        .alias("query"),
    )
    return C.catalog_search(binds.books(spark, sf), wanted, "G", index=binds.book_index(spark, sf)).select(*_OUT.split(", "))


_CASCADE = [
    (1, "author", "Bränd#1"), (2, "author", "Čbrand#2"), (3, "title", "red widget"), (4, "title", "promo"),
    (5, "title", "brand#7 bolt"), (6, "general", "economy brand#3"), (7, "subject", "Standard"), (8, "general", "nikde"),
]


def _cascade_sql(limit):
    specs = [
        (qid, i, field, C._variant(text, how))
        for qid, kind, text in _CASCADE
        for i, (field, how) in enumerate(C.TIERS[kind])
    ]
    authors = " ".join(
        f"WHEN {qid} THEN " + ("(" + " OR ".join(
            f"contains({S.comparison_key(S.strip_accents('author'))}, {S.lit(p)})"
            for p in "".join(ch for ch in fold_text(text) if ch.isalnum() or ch == " ").split() if len(p) > 2
        ) + ")")
        for qid, kind, text in _CASCADE if kind == "author"
    )
    return (
        with_views("books") + ", " + _match_sql(specs)
        + ", best AS (SELECT * FROM hits QUALIFY tier = min(tier) OVER (PARTITION BY query_id))"
        + _KEEP_SQL.format(src="best", limit=limit)
        + f" SELECT tier, {_OUT} FROM kept WHERE CASE query_id {authors} ELSE true END"
    )


@query("c2_search_cascade", _cascade_sql(5))
def cascade(spark, sf):
    return C.catalog_search_cascade(binds.books(spark, sf), _CASCADE).select("tier", *_OUT.split(", "))


@query("c2_search_cascade_table", _cascade_sql(20))
def cascade_table(spark, sf):
    wanted = spark.createDataFrame(_CASCADE, "query_id int, kind string, query string")
    found = C.catalog_search_cascade(binds.books(spark, sf), wanted, 20, index=binds.book_index(spark, sf))
    return found.select("tier", *_OUT.split(", "))


_INDEXED = ("TITLE", "AU", "G")
_PIECES_SQL = " UNION ALL ".join(
    f"SELECT id, '{f}' AS field, coalesce({S.fold(_TEXT_SQL[f])}, '') AS text FROM books" for f in _INDEXED
)


@query(
    "c_posting_index",
    with_views("books")
    + f""", texts AS ({_PIECES_SQL}), held AS (SELECT DISTINCT id, field, substr(text || chr(3) || chr(3), i, 3) AS piece
        FROM texts, LATERAL (SELECT unnest(range(1, CAST(length(text) AS BIGINT) + 1)) AS i))
        SELECT field, piece, count(*) AS n FROM held GROUP BY field, piece""",
)
def posting_index(spark, sf):
    """Text counts of the pieces after a build and an update: the catalogue before lacks a fifth of the books and has
    other titles for a third; one batch brings it to the present state."""
    now = binds.books(spark, sf)
    old = now.filter("ord % 5 <> 0").withColumn("title", F.when(F.col("ord") % 3 == 0, F.concat("title", F.lit(" (starší)"))).otherwise(F.col("title")))
    index = PostingIndex(spark, scratch_path(spark, "postings"))
    index.apply("load", C.catalog_texts(old, _INDEXED))
    before = C.catalog_texts(old.filter("ord % 3 = 0"), _INDEXED)
    index.apply("changes", C.catalog_texts(now.filter("ord % 3 = 0 OR ord % 5 = 0"), _INDEXED), before)
    return index.frequencies().select("field", "piece", "n")


@query(
    "c3_filter_by_author",
    with_views("books")
    + f""" SELECT id, title, author FROM books WHERE id <> '' AND
        (contains({S.comparison_key(S.strip_accents('author'))}, 'brand1') OR contains({S.comparison_key(S.strip_accents('author'))}, 'brand25'))""",
)
def by_author(spark, sf):
    return C.filter_by_author(binds.books(spark, sf), "Bränd#1, of Brand#25").select("id", "title", "author")


@query(
    "c4_dedup_lower",
    with_views("books") + " SELECT id, title, author FROM books QUALIFY row_number() OVER (PARTITION BY trim(lower(title)), trim(lower(author)) ORDER BY ord) = 1",
)
def dedup(spark, sf):
    return C.dedup_title_author(binds.books(spark, sf)).select("id", "title", "author")


@query(
    "c4_dedup_folded",
    with_views("records") + f""" SELECT "Identifier" AS id, "Title" AS title FROM records QUALIFY row_number() OVER
       (PARTITION BY {S.fold('coalesce("Title", ' + "''" + ')')}, {S.fold('coalesce("Author", ' + "''" + ')')} ORDER BY "Identifier") = 1""",
)
def dedup_folded(spark, sf):
    titles = binds.records(spark, sf).select(
        F.col("Identifier").alias("id"), F.coalesce("Title", F.lit("")).alias("title"), F.coalesce("Author", F.lit("")).alias("author")
    )
    return C.dedup_title_author(titles, folded=True, order=["id"]).select("id", "title")


_COUNTS_SQL = """CASE p_type WHEN 'PROMO' THEN p_size || ' ex., volných ' || (p_size // 3) WHEN 'ECONOMY' THEN p_size || ' ex.'
    WHEN 'LARGE' THEN 'neuvedeno, volných 1' ELSE '' END"""
_AVAIL_SQL = f""", counts AS (SELECT CAST(p_partkey AS VARCHAR) AS book_id, {_COUNTS_SQL} AS count_text FROM part),
  parsed AS (SELECT book_id, TRY_CAST(regexp_extract(count_text, '^(\\d+)', 1) AS BIGINT) AS t,
     TRY_CAST(regexp_extract(count_text, 'volných\\s+(\\d+)', 1) AS BIGINT) AS a FROM counts),
  rows_ AS (SELECT book_id, count(*) AS n, count(*) FILTER (WHERE lower(status) = 'volný') AS free FROM holdings GROUP BY 1),
  avail AS (SELECT coalesce(p.book_id, r.book_id) AS book_id, coalesce(t, n) AS total_copies,
     CASE WHEN t IS NOT NULL OR n IS NULL THEN a ELSE free END AS available_copies
     FROM parsed p FULL JOIN rows_ r ON p.book_id = r.book_id)"""


def _availability(spark, sf):
    kind, size = F.col("p_type"), F.col("p_size")
    text = (
        F.when(kind == "PROMO", F.concat(size.cast("string"), F.lit(" ex., volných "), F.floor(size / 3).cast("string")))
        .when(kind == "ECONOMY", F.concat(size.cast("string"), F.lit(" ex.")))
        .when(kind == "LARGE", "neuvedeno, volných 1")
        .otherwise("")
    )
    counts = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("book_id"), text.alias("count_text"))
    return C.availability(binds.holdings(spark, sf), counts)


@query("c5_availability", with_views("holdings") + _AVAIL_SQL + " SELECT * FROM avail")
def availability(spark, sf):
    return _availability(spark, sf)


_PLACES_SQL = """, places AS (SELECT book_id, branch || ' – ' || location AS place, min(ord) AS ord FROM holdings
     WHERE lower(status) = 'volný' GROUP BY 1, 2),
  locs AS (SELECT book_id, string_agg(place, '; ' ORDER BY ord, place) AS locations FROM places GROUP BY 1)"""


@query("c6_available_locations", with_views("holdings") + _PLACES_SQL + " SELECT * FROM locs")
def locations(spark, sf):
    return C.available_locations(binds.holdings(spark, sf))


_LISTED = [(1, "red widget"), (2, "economy brand#3"), (3, "promo"), (4, "brand#11")]
_TITLE_SQL = S.clean_title("title")
_URL_SQL = "'https://catalogue.example/detail-' || id"


@query(
    "c7_result_listing",
    with_views("books", "holdings") + _AVAIL_SQL + _PLACES_SQL + ", " + _match_sql([(q, 0, "G", t) for q, t in _LISTED])
    + _KEEP_SQL.format(src="hits", limit=20)
    + f""", u AS (SELECT kept.*, total_copies, available_copies, locations, CASE query_id WHEN 4 THEN 'Brand#11' WHEN 2 THEN 'Někdo' END AS asked
         FROM kept LEFT JOIN avail ON avail.book_id = id LEFT JOIN locs ON locs.book_id = id),
       facts AS (SELECT query_id, count(*) > 5 AS compact, bool_and(asked IS NOT NULL AND (contains(lower(author), lower(asked))
         OR contains(lower(asked), string_split(lower(author), ',')[1]))) AS omit FROM u GROUP BY 1),
       lines AS (SELECT query_id, ord, compact, CASE WHEN compact THEN '- [' || {_TITLE_SQL} || '](' || {_URL_SQL} || ')' ||
           CASE WHEN omit THEN '' ELSE ' — ' || author END ||
           CASE WHEN total_copies IS NULL THEN '' ELSE ' [' || coalesce(available_copies, 0) || '/' || total_copies || ' volných]' END
         ELSE '### 📘 [' || {_TITLE_SQL} || '](' || {_URL_SQL} || ')' || chr(10) || '**Autor:** ' || author || ' (' || year || ')' ||
           chr(10) || '**Témata:** ' || subject || chr(10) || description ||
           CASE WHEN total_copies IS NULL THEN '' ELSE chr(10) || '**Dostupnost:** ' || coalesce(available_copies, 0) || ' volných z ' || total_copies ||
             CASE WHEN coalesce(locations, '') = '' THEN '' ELSE ' (' || locations || ')' END END END AS line
         FROM u JOIN facts USING (query_id))
       SELECT query_id, CAST(0 AS BIGINT) AS part, compact, count(*) AS n_books,
         CASE WHEN compact THEN string_agg(line, chr(10) ORDER BY ord) ELSE string_agg(line, chr(10) || chr(10) ORDER BY ord) END AS listing
       FROM lines GROUP BY query_id, compact""",
)
def listing(spark, sf):
    asked = F.when(F.col("query_id") == 4, "Brand#11").when(F.col("query_id") == 2, "Někdo")
    found = C.catalog_search(binds.books(spark, sf), _LISTED, "G", 20)
    full = (
        found.join(_availability(spark, sf), F.col("id") == F.col("book_id"), "left").drop("book_id")
        .join(C.available_locations(binds.holdings(spark, sf)), F.col("id") == F.col("book_id"), "left").drop("book_id")
        .withColumn("requested_author", asked).withColumn("url", F.lit(None).cast("string"))
    )
    return C.result_listing(full)


@query(
    "c8_book_url",
    with_views("books")
    + " SELECT id, CASE WHEN subject = 'PROMO' THEN 'https://shop.example/' || id ELSE 'https://catalogue.example/detail-' || id END AS url FROM books",
)
def url(spark, sf):
    given = F.when(F.col("subject") == "PROMO", F.concat(F.lit("https://shop.example/"), "id")).when(F.col("subject") == "SMALL", "")
    return binds.books(spark, sf).withColumn("url", given).select("id", C.book_url().alias("url"))
