"""Catalogue search: token matching, fallback tiers, dedup, copies and result listings.

Books: id, ord (catalogue order), title, author, subject, year, publisher, description.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shelfspark.functions.grams import containment_candidates
from shelfspark.functions.text import (
    ascii_only,
    clean_title,
    comparison_key,
    fold,
    fold_text,
    strip_accents,
    strip_author_role,
    trim_ws,
)
from shelfspark.operators.postings import PostingIndex
from shelfspark.operators.skew import first_per_key, nest_in_parts, top_per_key

DEFAULT_COUNT = 5
MAX_COUNT = 20
FETCH_ALL = 0
COMPACT_THRESHOLD = 5
DESCRIPTION_CHARS = 150
FREE_STATUS = "volný"
DETAIL_URL = "https://catalogue.example/detail-{id}"
FIELDS = ("TITLE", "AU", "SUBJECT", "G", "DATE1", "PUBL")

# The order in which each kind of search falls back to other indexes.
TIERS = {
    "author": (("AU", "as is"), ("AU", "ascii")),
    "title": (("TITLE", "as is"), ("TITLE", "capitalised"), ("G", "as is"), ("SUBJECT", "as is")),
    "general": (("G", "as is"), ("SUBJECT", "as is")),
    "subject": (("SUBJECT", "as is"),),
}


def clamp_count(count: int | None, default: int = DEFAULT_COUNT, most: int = MAX_COUNT) -> int:
    return default if count is None else max(1, min(count, most))


def _field_text(field: str) -> Column:
    columns = {
        "TITLE": F.col("title"),
        "AU": F.col("author"),
        "SUBJECT": F.col("subject"),
        "DATE1": F.col("year"),
        "PUBL": F.col("publisher"),
        "G": F.concat_ws(" ", "title", "author", "subject", "description"),
    }
    return F.coalesce(fold(columns[field]), F.lit(""))


def _variant(query: str, how: str) -> str:
    if how == "ascii":
        return "".join(ch for ch in query if ord(ch) < 128).strip()
    if how == "capitalised":
        return " ".join(w[:1].upper() + w[1:] for w in query.split(" "))
    return query


def _matches_literal(books: DataFrame, specs: list[tuple]) -> DataFrame:
    """Matches of a parameter list of (query_id, tier, field, text): one narrow pass over the books."""
    fields = sorted({s[2] for s in specs})
    texts = books.withColumns({f"_{f}": _field_text(f) for f in fields})
    hits = []
    for query_id, tier, field, text in specs:
        words = fold_text(text).split()
        if not words:
            continue
        if field == "DATE1":
            condition = F.col("_DATE1") == fold_text(text)
        else:
            condition = F.col(f"_{field}").contains(words[0])
            for word in words[1:]:
                condition = condition & F.col(f"_{field}").contains(word)
        hits.append(
            F.when(condition, F.struct(F.lit(query_id).alias("query_id"), F.lit(tier).alias("tier")))
        )
    if not hits:
        hits = [F.lit(None).cast("struct<query_id:bigint,tier:int>")]
    return texts.select(*books.columns, F.inline(F.array_compact(F.array(*hits))))


def catalog_texts(books: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """``(id, field, text)`` rows of the searchable texts, folded: what a posting index of the catalogue holds."""
    rows = F.array(*[F.struct(F.lit(f).alias("field"), _field_text(f).alias("text")) for f in fields])
    return books.select(F.col("id").cast("string").alias("id"), F.inline(rows))


def _matches_joined(books: DataFrame, specs: DataFrame, fields: tuple[str, ...], index: PostingIndex | None) -> DataFrame:
    """Matches of any number of queries: candidates share the rarest piece of the query, then verify.

    Only ids travel up to there; the book columns join once. Without a stored index the pieces of the
    texts are taken on the way.
    """
    words = F.filter(F.split(fold("query"), r"\s+"), lambda w: w != "")
    asked = specs.select("query_id", "tier", "field", words.alias("_words"), fold("query").alias("_whole")).filter(
        F.size("_words") > 0
    )
    keys = ["query_id", "tier", "field"]
    if index is not None:
        pairs = index.candidates(asked, "_words", keys)
    else:
        texts = catalog_texts(books, fields)
        pairs = containment_candidates(texts, "text", asked, "_words", keys, ["field"]).select(*keys, "id").distinct()
    found = asked.join(pairs.withColumnRenamed("id", "_id"), keys)
    text = F.lit(None).cast("string")
    for field in fields:
        text = F.when(F.col("field") == field, _field_text(field)).otherwise(text)
    near = books.join(found, F.col("id").cast("string").eqNullSafe(F.col("_id"))).withColumn("_text", text)
    contained = F.forall("_words", lambda w: F.col("_text").contains(w))
    verified = F.when(F.col("field") == "DATE1", F.col("_text") == F.col("_whole")).otherwise(contained)
    return near.filter(verified).select(*[books[c] for c in books.columns], "query_id", "tier")


def _limited(matches: DataFrame, limit: int) -> DataFrame:
    """First row per title and author within each query and tier, then the first ``limit`` of them."""
    title_author = F.concat_ws("|", trim_ws(F.lower("title")), trim_ws(F.lower("author")))
    within = ["query_id", "tier"]
    unique = first_per_key(matches.withColumn("_key", title_author), [*within, "_key"], ["ord", "id"]).drop("_key")
    return unique if limit == FETCH_ALL else top_per_key(unique, within, ["ord", "id"], limit)


def catalog_search(
    books: DataFrame, queries: list[tuple] | DataFrame, field: str = "G", limit: int = DEFAULT_COUNT, index: PostingIndex | None = None
) -> DataFrame:
    """Books whose folded field contains every word of the folded query, in catalogue order.

    ``queries``: a parameter list of (query_id, text), or a table (query_id, query) of any size.
    ``limit`` 0 returns all matches. ``index``, for a table of queries: a posting index of
    :func:`catalog_texts` of the same books; then only the texts of candidates are read.
    """
    if field not in FIELDS:
        raise ValueError(f"unknown field {field}; use one of {FIELDS}")
    if isinstance(queries, DataFrame):
        specs = queries.select("query_id", F.lit(0).alias("tier"), F.lit(field).alias("field"), "query")
        matches = _matches_joined(books, specs, (field,), index)
    else:
        matches = _matches_literal(books, [(qid, 0, field, text) for qid, text in queries])
    return _limited(matches, limit).drop("tier")


def catalog_search_cascade(
    books: DataFrame, queries: list[tuple] | DataFrame, limit: int = DEFAULT_COUNT, index: PostingIndex | None = None
) -> DataFrame:
    """Search by kind (author, title, general, subject) with fallback to the next index when empty.

    ``queries``: (query_id, kind, text) rows. The first tier with a match wins; which one that
    is gets decided inside the plan from one small aggregate per query. ``index`` as in :func:`catalog_search`.
    """
    if isinstance(queries, DataFrame):
        variants = {
            "as is": F.col("query"),
            "ascii": ascii_only("query"),
            "capitalised": F.array_join(
                F.transform(F.split("query", " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " "
            ),
        }
        rows = F.lit(None).cast("array<struct<tier:int,field:string,query:string>>")
        for kind, tiers in TIERS.items():
            steps = F.array(
                *[F.struct(F.lit(i).alias("tier"), F.lit(f).alias("field"), variants[v].alias("query")) for i, (f, v) in enumerate(tiers)]
            )
            rows = F.when(F.col("kind") == kind, steps).otherwise(rows)
        specs = queries.select("query_id", F.inline(rows))
        matches = _matches_joined(books, specs, ("TITLE", "AU", "SUBJECT", "G"), index)
        asked = queries.filter(F.col("kind") == "author").select("query_id", F.col("query").alias("_asked"))
        ranked = _winning_tier(matches, limit).join(asked, "query_id", "left")
        return _verified_authors(ranked, F.col("_asked")).drop("_asked")
    specs = [
        (qid, i, f, _variant(text, how))
        for qid, kind, text in queries
        for i, (f, how) in enumerate(TIERS[kind])
    ]
    asked = F.lit(None).cast("string")
    for qid, kind, text in queries:
        if kind == "author":
            asked = F.when(F.col("query_id") == qid, F.lit(text)).otherwise(asked)
    return _verified_authors(_winning_tier(_matches_literal(books, specs), limit), asked)


def _winning_tier(matches: DataFrame, limit: int) -> DataFrame:
    """Rows of the first non-empty tier; with a limit every tier is cut down before they are compared."""
    kept = _limited(matches, limit)
    if limit != FETCH_ALL:
        first = F.min("tier").over(Window.partitionBy("query_id"))
        return kept.withColumn("_first", first).filter(F.col("tier") == F.col("_first")).drop("_first")
    best = matches.groupBy("query_id").agg(F.min("tier").alias("tier"))
    return kept.join(best, ["query_id", "tier"])


def _verified_authors(found: DataFrame, asked: Column) -> DataFrame:
    return found.filter(asked.isNull() | author_matches(F.col("author"), asked))


def author_matches(author: Column, requested: Column | str) -> Column:
    """Any word of the requested name longer than two letters occurs in the author."""
    wanted = F.lit(requested) if isinstance(requested, str) else requested
    parts = F.split(comparison_key(strip_accents(wanted)), r"\s+")
    folded = comparison_key(strip_accents(author))
    return F.exists(parts, lambda p: (F.length(p) > 2) & folded.contains(p))


def filter_by_author(df: DataFrame, requested: Column | str) -> DataFrame:
    has_id = F.col("id").isNotNull() & (F.col("id") != "")
    return df.filter(has_id & author_matches(F.col("author"), requested))


def dedup_title_author(df: DataFrame, folded: bool = False, order: list | None = None, within: list[str] | None = None) -> DataFrame:
    """First row per title and author, compared lower-case and trimmed or also without diacritics."""
    norm = fold if folded else (lambda c: trim_ws(F.lower(c)))
    keyed = df.withColumn("_key", F.concat_ws("|", norm("title"), norm("author")))
    return first_per_key(keyed, [*(within or []), "_key"], order or ["ord"]).drop("_key")


def availability(holdings: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Total and free copies per book; a parsed count text wins over counting the copies.

    ``counts``: book_id, count_text such as '5 ex., volných 2'.
    """
    rows = holdings.groupBy("book_id").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.lower("status") == FREE_STATUS).alias("_free")
    )
    if counts is None:
        return rows.select("book_id", F.col("_rows").alias("total_copies"), F.col("_free").alias("available_copies"))

    def number(pattern: str) -> Column:
        found = F.regexp_extract("count_text", pattern, 1)
        return F.when(found != "", found.cast("bigint"))

    parsed = counts.select("book_id", number(r"^(\d+)").alias("_total"), number(r"volných\s+(\d+)").alias("_avail"))
    known = F.col("_total").isNotNull() | F.col("_rows").isNull()
    return parsed.join(rows, "book_id", "full_outer").select(
        "book_id",
        F.coalesce("_total", "_rows").alias("total_copies"),
        F.when(known, F.col("_avail")).otherwise(F.col("_free")).alias("available_copies"),
    )


def available_locations(holdings: DataFrame) -> DataFrame:
    """Distinct 'branch – location' of free copies per book, in first-seen order, joined with '; '."""
    free = holdings.filter(F.lower("status") == FREE_STATUS)
    places = free.groupBy("book_id", F.concat_ws(" – ", "branch", "location").alias("place")).agg(F.min("ord").alias("ord"))
    return places.groupBy("book_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("ord", "place"))), lambda s: s["place"]), "; "
        ).alias("locations")
    )


def book_url(url: Column | None = None, book_id: Column | None = None, template: str = DETAIL_URL) -> Column:
    """The given url, else one built from the id."""
    given = F.col("url") if url is None else url
    ident = F.col("id") if book_id is None else book_id
    before, after = template.split("{id}")
    return F.coalesce(F.nullif(given, F.lit("")), F.concat(F.lit(before), ident, F.lit(after)))


def _compact_line(omit_author: Column) -> Column:
    copies = F.when(
        F.col("total_copies").isNotNull(),
        F.concat(
            F.lit(" ["), F.coalesce("available_copies", F.lit(0)).cast("string"), F.lit("/"),
            F.col("total_copies").cast("string"), F.lit(" volných]"),
        ),
    ).otherwise("")
    author = F.when(omit_author, "").otherwise(F.concat(F.lit(" — "), strip_author_role("author")))
    return F.concat(F.lit("- ["), clean_title("title"), F.lit("]("), book_url(), F.lit(")"), author, copies)


def _detail_block() -> Column:
    def given(c: str) -> Column:
        return F.col(c).isNotNull() & (F.col(c) != "")

    text = F.col("description")
    short = F.when(F.length(text) > DESCRIPTION_CHARS, F.concat(F.substring(text, 1, DESCRIPTION_CHARS), F.lit("..."))).otherwise(text)
    places = F.when(given("locations"), F.concat(F.lit(" ("), F.col("locations"), F.lit(")"))).otherwise("")
    year = F.when(given("year"), F.concat(F.lit(" ("), F.col("year"), F.lit(")"))).otherwise("")
    return F.concat(
        F.lit("### 📘 ["), clean_title("title"), F.lit("]("), book_url(), F.lit(")\n**Autor:** "), F.col("author"), year,
        F.when(given("subject"), F.concat(F.lit("\n**Témata:** "), F.col("subject"))).otherwise(""),
        F.when(given("description"), F.concat(F.lit("\n"), short)).otherwise(""),
        F.when(
            F.col("total_copies").isNotNull(),
            F.concat(
                F.lit("\n**Dostupnost:** "), F.coalesce("available_copies", F.lit(0)).cast("string"), F.lit(" volných z "),
                F.col("total_copies").cast("string"), places,
            ),
        ).otherwise(""),
    )


def result_lines(df: DataFrame) -> DataFrame:
    """One formatted line or block per distinct book of each query.

    Input: query_id, ord, requested_author (null when none), id, url, title, author, year,
    subject, description, total_copies, available_copies, locations.
    """
    unique = dedup_title_author(df, folded=True, order=["ord", "id"], within=["query_id"])
    book, asked = fold("author", trim=False), fold("requested_author", trim=False)
    same = book.contains(asked) | asked.contains(F.split(book, ",")[0])
    facts = unique.groupBy("query_id").agg(
        (F.count(F.lit(1)) > COMPACT_THRESHOLD).alias("compact"),
        F.coalesce(F.bool_and(F.col("requested_author").isNotNull() & same), F.lit(False)).alias("_omit"),
        F.count(F.lit(1)).alias("n_books"),
    )
    line = F.when(F.col("compact"), _compact_line(F.col("_omit"))).otherwise(_detail_block())
    return unique.join(facts, "query_id").select("query_id", "ord", "compact", "n_books", line.alias("line"))


def result_listing(df: DataFrame, part_size: int = 1000) -> DataFrame:
    """The lines of each query joined to one text; a longer result continues in further parts.

    ``n_books`` is the size of the whole result on every part.
    """
    lines = result_lines(df)
    parts = nest_in_parts(
        lines, ["query_id", "compact", "n_books"], ["ord"], F.col("line"), "_lines", part_size
    )
    joined = F.when(F.col("compact"), F.array_join("_lines", "\n")).otherwise(F.array_join("_lines", "\n\n"))
    return parts.select("query_id", "part", "compact", "n_books", joined.alias("listing"))
