"""Web-index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions import urls as U
from shelfspark.operators import webindex as E
from shelfspark.plans import binds
from shelfspark.plans import sqltext as S
from shelfspark.plans.binds import with_views
from shelfspark.plans.registry import query, table
from shelfspark.session import scratch_path
from shelfspark.sources import html_pages
from shelfspark.sources.keyed_store import KeyedStore

_BARE = "regexp_replace(url, '[?#].*$', '')"
_ORIGIN = "lower(regexp_extract(url, '^([a-zA-Z]+://[^/?#]*)', 1))"
_PATH = f"CASE WHEN regexp_replace({_BARE}, '^[a-zA-Z]+://[^/?#]*', '') = '' THEN '/' ELSE regexp_replace({_BARE}, '^[a-zA-Z]+://[^/?#]*', '') END"
_URL = f"({_ORIGIN} || {_PATH})"


def _any(x, words):
    return "(" + " OR ".join(f"contains({x}, {S.lit(w)})" for w in words) + ")"


def _relevant_sql(x):
    return f"""(NOT {_any(f'lower({x})', U.IRRELEVANT_PARTS)} AND
        ({_any(f'lower({x})', U.IMPORTANT_PARTS)} OR len(string_split({x}, '/')) <= 4))"""


def _fetchable_sql(x):
    ends = " OR ".join(f"ends_with(lower({x}), '.{e}')" for e in U.BINARY_ENDINGS)
    return f"({_relevant_sql(x)} AND NOT {_any(f'lower({x})', U.DOWNLOAD_PARTS)} AND NOT ({ends}))"


@query("e1_normalize_url", f"SELECT page_id, {_URL} AS url FROM pages")
def normalize(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.normalize_url("url").alias("url"))


@query("e2_relevant_url", f"SELECT page_id, {_relevant_sql('url')} AS relevant FROM pages")
def relevant(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.relevant_url("url").alias("relevant"))


_HREFS_SQL = "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages"


@query("e3_fetchable_url", f"SELECT DISTINCT href, {_fetchable_sql('href')} AS fetchable FROM ({_HREFS_SQL})")
def fetchable(spark, sf):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))
    found = table(spark, sf, "pages").select(F.explode(hrefs).alias("href")).distinct()
    return found.select("href", U.fetchable_url("href").alias("fetchable"))


_TITLE_SQL = "replace(replace(trim(regexp_extract(html, '(?s)<title>(.*?)</title>', 1)), '&quot;', '\"'), '&amp;', '&')"
_FACTS_SQL = f"""{_URL} AS url, {_PATH} AS path, {_TITLE_SQL} AS title,
    regexp_extract(html, '<html lang="([^"]*)"', 1) AS language"""


@query("e4_page_facts", f"SELECT {_FACTS_SQL} FROM pages")
def facts(spark, sf):
    return html_pages.page_facts(table(spark, sf, "pages"))


def _text_sql(x):
    stripped = f"regexp_replace({x}, '<[^>]*>', ' ', 'g')"
    decoded = f"replace(replace({stripped}, '&quot;', '\"'), '&amp;', '&')"
    return f"trim(regexp_replace({decoded}, '\\s+', ' ', 'g'))"


@query(
    "e4_extract_pages",
    f"""WITH p AS (SELECT {_FACTS_SQL}, {_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
          {_text_sql("regexp_extract(html, '(?s)</h1>(.*)</article>', 1)")} AS content FROM pages)
        SELECT url, path, title, language, CASE WHEN length(content) >= 50 THEN 1 ELSE 0 END AS n_sections,
          CASE WHEN length(content) >= 50 THEN heading || '|1|' || content ELSE '' END AS sections FROM p""",
)
def pages(spark, sf):
    found = html_pages.extract_pages(table(spark, sf, "pages"))
    flat = F.array_join(F.transform("sections", lambda s: F.concat_ws("|", s["heading"], s["level"].cast("string"), s["content"])), "\n")
    return found.select("url", "path", "title", "language", F.size("sections").alias("n_sections"), flat.alias("sections"))


_ENC = """array_to_string(list_transform(string_split(d, ''), lambda ch:
    CASE WHEN ch = ' ' THEN '%20' WHEN regexp_matches(ch, '[^\\x21-\\x7E]|["<>`{}]') THEN url_encode(ch) ELSE ch END), '')"""


@query(
    "e5_extract_links",
    f"""WITH h AS (SELECT {_URL} AS src, {_ORIGIN} AS o, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM pages),
        r AS (SELECT src, o, regexp_replace(replace(replace(href, '&quot;', '"'), '&amp;', '&'), '[?#].*$', '') AS d FROM h),
        l AS (SELECT src, o || {_ENC} AS dst FROM r WHERE starts_with(d, '/'))
        SELECT DISTINCT src, dst FROM l WHERE {_fetchable_sql('dst')}""",
)
def links(spark, sf):
    return E.extract_links(table(spark, sf, "pages"))


@query(
    "e6_reachable",
    """WITH RECURSIVE edges AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst FROM lineitem
          UNION SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey FROM lineitem),
        seeds AS (SELECT DISTINCT 's' || s_suppkey AS url FROM supplier WHERE s_acctbal = (SELECT min(s_acctbal) FROM supplier)),
        walk AS (SELECT url, 0 AS depth FROM seeds UNION
          SELECT dst, depth + 1 FROM walk JOIN edges ON src = url WHERE depth < 8),
        best AS (SELECT url, min(depth) AS depth FROM walk GROUP BY url)
        SELECT url, depth FROM best""",
)
def reach(spark, sf):
    pairs = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p"), "l_partkey").alias("p"), F.concat(F.lit("s"), "l_suppkey").alias("s")
    )
    edges = pairs.select(F.col("p").alias("src"), F.col("s").alias("dst")).unionByName(
        pairs.select(F.col("s").alias("src"), F.col("p").alias("dst"))
    )
    suppliers = table(spark, sf, "supplier")
    lowest = suppliers.agg(F.min("s_acctbal")).scalar()
    seeds = suppliers.filter(F.col("s_acctbal") == lowest).select(F.concat(F.lit("s"), "s_suppkey").alias("url"))
    return E.reachable(edges, seeds)


_PAGES_SQL = """doc_pages AS (SELECT doc_id, 'https://library.example/kontakt/' || doc_id AS url, '/kontakt/' || doc_id AS path,
    source AS title, lang AS heading, text FROM documents)"""


def _doc_pages(spark, sf):
    """Every document as a contact page: an empty-heading lead, a department, and the text below it."""
    d = table(spark, sf, "documents")

    def section(order, heading, level, content):
        return F.struct(F.lit(order).alias("ord"), heading.alias("heading"), F.lit(level).alias("level"), content.alias("content"))

    doc = F.col("doc_id").cast("string")
    return d.select(
        F.concat(F.lit("https://library.example/kontakt/"), doc).alias("url"),
        F.concat(F.lit("/kontakt/"), doc).alias("path"),
        F.col("source").alias("title"),
        F.col("lang").alias("language"),
        F.array(
            section(0, F.lit("Prázdný"), 2, F.lit("  ")),
            section(1, F.concat(F.lit("Oddělení "), "lang"), 2, F.lit("úvod")),
            section(2, F.col("lang"), 3, F.col("text")),
        ).alias("sections"),
    )


def _rlike_any(x, patterns, start=""):
    return f"regexp_matches({x}, {S.lit('(?i)' + start + '(?:' + '|'.join(patterns) + ')')})"


def _valid_sql(url, text, body):
    notice = " AND ".join(f"contains(lower({text}), {S.lit(w)})" for w in E.BOILERPLATE_WORDS)
    return f"""(length({text}) >= 100 AND NOT {_any(f'lower({url})', E.RECOMMENDATION_URLS)}
       AND NOT {_rlike_any(text, E.RECOMMENDATION_TEXT)} AND NOT regexp_matches({text}, '{E.PAGE_COUNT}') AND NOT {_rlike_any(body, E.NAVIGATION_TEXT, '^')}
       AND NOT (length({text}) < 500 AND {notice}))"""


# Sections (k, url, section_ord, heading, prefix, content) -> chunks, sentence by sentence.
_FOLD_SQL = f"""full_sec AS (SELECT *, prefix || heading || chr(10) || chr(10) AS head, prefix || heading || ' (pokračování)' || chr(10) || chr(10) AS later FROM sec WHERE content <> ''),
  short AS (SELECT url, section_ord, heading, 0 AS chunk_index, head || content AS text, content AS body FROM full_sec WHERE length(content) <= 2000),
  parts AS (SELECT k, url, section_ord, heading, prefix, head, later,
      list_filter(list_transform(regexp_extract_all(content, '[^.!?]+[.!?]+|[^.!?]+$'), lambda s: {S.trim_ws('s')}), lambda s: s <> '') AS ss
    FROM full_sec WHERE length(content) > 2000),
  fold AS (SELECT k, section_ord, 0 AS at, length(head) AS filled, 0 AS chunk FROM parts
    UNION ALL SELECT f.k, f.section_ord, f.at + 1,
      CASE WHEN f.filled + length(p.ss[f.at + 1]) > 2000 AND f.filled > 800 THEN length(p.later) ELSE f.filled END + length(p.ss[f.at + 1]) + 1,
      CASE WHEN f.filled + length(p.ss[f.at + 1]) > 2000 AND f.filled > 800 THEN f.chunk + 1 ELSE f.chunk END
    FROM fold f JOIN parts p ON p.k = f.k AND p.section_ord = f.section_ord WHERE f.at < len(p.ss)),
  long AS (SELECT p.k, p.url, p.section_ord, p.heading, f.chunk AS chunk_index, p.prefix,
      string_agg(p.ss[f.at], ' ' ORDER BY f.at) AS body, any_value(p.head) AS head, any_value(p.later) AS later, max(f.chunk) OVER (PARTITION BY p.k, p.section_ord) AS last
    FROM fold f JOIN parts p ON p.k = f.k AND p.section_ord = f.section_ord WHERE f.at > 0 GROUP BY p.k, p.url, p.section_ord, p.heading, f.chunk, p.prefix),
  long_text AS (SELECT url, section_ord, heading, chunk_index, last, prefix, {S.trim_ws('CASE WHEN chunk_index = 0 THEN head ELSE later END || body')} AS text, body FROM long),
  chunks AS (SELECT * FROM short UNION ALL SELECT url, section_ord, heading, chunk_index, text, body FROM long_text
     WHERE chunk_index < last OR length(text) > length(prefix) + length(heading) + 10)"""
_CHUNK_SQL = f"""WITH RECURSIVE {_PAGES_SQL},
  sec AS (SELECT doc_id AS k, url, 1 AS section_ord, 'Oddělení ' || heading AS heading, 'Stránka: ' || title || chr(10) || 'URL: ' || path || chr(10) || chr(10) AS prefix, 'úvod' AS content FROM doc_pages
    UNION ALL SELECT doc_id, url, 2, heading, 'Stránka: ' || title || chr(10) || 'URL: ' || path || chr(10) || 'Oddělení: Oddělení ' || heading || chr(10) || chr(10),
      {S.trim_ws('text')} FROM doc_pages), {_FOLD_SQL}"""
_CHUNK_OUT = "url, section_ord, heading AS section_heading, chunk_index, text, sha256(" + S.trim_ws("text") + ") AS hash"


@query("e7_chunk_sections", _CHUNK_SQL + f" SELECT {_CHUNK_OUT} FROM chunks")
def chunks(spark, sf):
    return E.chunk_sections(_doc_pages(spark, sf), valid_only=False)


@query("e8_valid_chunk", _CHUNK_SQL + f" SELECT {_CHUNK_OUT} FROM chunks WHERE {_valid_sql('url', 'text', 'body')}")
def valid(spark, sf):
    return E.chunk_sections(_doc_pages(spark, sf))


_REFRESH_SQL = f"""WITH RECURSIVE p AS (SELECT page_id, {_FACTS_SQL}, {_text_sql("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")} AS heading,
    {_text_sql("regexp_extract(html, '(?s)</h1>(.*)</article>', 1)")} AS content FROM pages),
  sec AS (SELECT page_id AS k, url, 0 AS section_ord, heading, 'Stránka: ' || title || chr(10) || 'URL: ' || path || chr(10) || chr(10) AS prefix, content
    FROM p WHERE length(content) >= 50), {_FOLD_SQL}"""


@query("e_refresh_pages_to_chunks", _REFRESH_SQL + f" SELECT {_CHUNK_OUT} FROM chunks WHERE {_valid_sql('url', 'text', 'body')}")
def refresh(spark, sf):
    """Stored pages to valid chunks in one pass."""
    return E.chunk_sections(html_pages.extract_pages(table(spark, sf, "pages")))


_KEY_SQL = "url || '::' || section_heading || '::' || chunk_index"
_ID_SQL = f"CASE WHEN length({_KEY_SQL}) <= 100 THEN {_KEY_SQL} ELSE 'hash_' || md5({_KEY_SQL}) END"


@query(
    "e_refresh_index",
    _REFRESH_SQL
    + f""", valid AS (SELECT {_CHUNK_OUT} FROM chunks WHERE {_valid_sql('url', 'text', 'body')}),
        once AS (SELECT *, {_ID_SQL} AS id FROM valid QUALIFY row_number() OVER (PARTITION BY hash ORDER BY url, section_ord, chunk_index) = 1),
        latest AS (SELECT * FROM once QUALIFY row_number() OVER (PARTITION BY id ORDER BY url DESC, section_ord DESC, chunk_index DESC) = 1)
        SELECT id, hash, CASE WHEN length(text) % 5 <> 4 AND length(text) % 3 <> 0 THEN '2024-01-01' ELSE '2024-02-01' END AS last_crawled FROM latest""",
)
def refresh_index(spark, sf):
    """Stored pages to chunks to the next index; the index before lacks some chunks, has others in an older
    wording, and some of pages that are gone."""
    pages = html_pages.extract_pages(table(spark, sf, "pages"))
    chunks = E.chunk_sections(pages, crawled_at=F.lit("2024-02-01")).withColumn("ord", F.struct("url", "section_ord", "chunk_index"))
    size = F.length("text")
    worded = F.when(size % 3 == 0, F.concat("text", F.lit(" starší"))).otherwise(F.col("text"))
    before = chunks.filter(size % 5 != 4).withColumns({"text": worded, "last_crawled": F.lit("2024-01-01")})
    gone = before.withColumn("url", F.concat("url", F.lit("/zaniklá")))
    index = before.unionByName(gone).withColumn("hash", E.chunk_hash("text")).withColumn("id", E.chunk_id(E.chunk_key()))
    return E.refresh_index(index, chunks).select("id", "hash", "last_crawled")


@query(
    "e9_chunk_ids",
    f"""WITH c AS (SELECT doc_id, text, 'https://library.example/' || source AS url, repeat(lang, 1 + CAST(n_chars // 100 AS INTEGER)) AS section_heading, 0 AS chunk_index FROM documents)
        SELECT doc_id, sha256({S.trim_ws('text')}) AS hash, {_KEY_SQL} AS key, {_ID_SQL} AS id FROM c""",
)
def ids(spark, sf):
    heading = F.expr("repeat(lang, cast(1 + floor(n_chars / 100) as int))")
    key = E.chunk_key(F.concat(F.lit("https://library.example/"), "source"), heading, F.lit(0))
    keyed = table(spark, sf, "documents").select("doc_id", E.chunk_hash("text").alias("hash"), key.alias("key"))
    return keyed.withColumn("id", E.chunk_id(F.col("key")))


_DIFF_SQL = f""", n AS (SELECT *, {_KEY_SQL} AS key, sha256({S.trim_ws('text')}) AS hash FROM docs_new),
  o AS (SELECT *, {_KEY_SQL} AS key, sha256({S.trim_ws('text')}) AS hash FROM docs_old),
  diff AS (SELECT coalesce(n.key, o.key) AS key, CASE WHEN o.key IS NULL THEN 'added' WHEN n.key IS NULL THEN 'removed'
     WHEN n.hash <> o.hash THEN 'changed' ELSE 'unchanged' END AS status, n.hash AS new_hash, o.hash AS old_hash
     FROM n FULL JOIN o ON n.key = o.key)"""


def _hashed(df):
    return df.withColumn("hash", E.chunk_hash("text"))


def _diff(spark, sf):
    return E.diff_chunks(_hashed(binds.docs_new(spark, sf)), _hashed(binds.docs_old(spark, sf)))


@query("e10_diff_chunks", with_views("docs_old", "docs_new") + _DIFF_SQL + " SELECT * FROM diff")
def diff(spark, sf):
    return _diff(spark, sf).select("key", "status", F.col("new.hash").alias("new_hash"), F.col("old.hash").alias("old_hash"))


@query(
    "e11_dedup_by_hash",
    f"SELECT doc_id AS ord, sha256({S.trim_ws('text')}) AS hash FROM documents QUALIFY row_number() OVER (PARTITION BY sha256({S.trim_ws('text')}) ORDER BY doc_id) = 1",
)
def dedup(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "text")
    return E.dedup_by_hash(_hashed(docs)).select("ord", "hash")


@query(
    "e12_apply_diff",
    with_views("docs_old", "docs_new") + f" SELECT {_ID_SQL} AS id, url, sha256({S.trim_ws('text')}) AS hash FROM docs_new",
)
def apply(spark, sf):
    def with_id(df):
        return df.withColumn("id", E.chunk_id(E.chunk_key())).select("id", "url", "hash")

    changes = _diff(spark, sf)
    index = with_id(_hashed(binds.docs_old(spark, sf)))
    return E.apply_diff(index, with_id(E.chunks_to_add(changes)), with_id(E.chunks_to_remove(changes)))


@query(
    "e12_refresh_store",
    with_views("docs_old", "docs_new")
    + f""", n AS (SELECT *, {_ID_SQL} AS id, sha256({S.trim_ws('text')}) AS hash FROM docs_new),
      once AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY hash ORDER BY ord) = 1),
      o AS (SELECT {_ID_SQL} AS id, sha256({S.trim_ws('text')}) AS hash FROM docs_old)
      SELECT id, url, once.hash, CASE WHEN o.id IS NULL THEN '2024-02-01' ELSE '2024-01-01' END AS last_crawled
      FROM once LEFT JOIN o USING (id, hash)""",
)
def refresh_store(spark, sf):
    """A stored index takes a crawl: only buckets of rows that enter, change or go are rewritten."""
    def rows(df, crawled):
        hashed = _hashed(df).withColumn("last_crawled", F.lit(crawled))
        return hashed.withColumn("id", E.chunk_id(E.chunk_key())).withColumn("ord", F.col("ord").cast("bigint"))

    schema = "id string, url string, section_heading string, chunk_index int, text string, hash string, ord bigint, last_crawled string"
    store = KeyedStore(spark, scratch_path(spark, "index-store"), "id", schema)
    store.merge("load", rows(binds.docs_old(spark, sf), "2024-01-01"), ["ord"])
    E.refresh_store(store, "crawl", rows(binds.docs_new(spark, sf), "2024-02-01").drop("id"))
    return store.read().select("id", "url", "hash", "last_crawled")


@query(
    "e13_run_metrics",
    with_views("docs_old", "docs_new") + _DIFF_SQL
    + """, m AS (SELECT (SELECT count(*) FROM documents) AS pages, (SELECT count(*) FROM n) AS chunks, (SELECT count(*) FROM o) AS existing,
         count(*) FILTER (WHERE status IN ('added', 'changed')) AS added, count(*) FILTER (WHERE status IN ('removed', 'changed')) AS removed,
         count(*) FILTER (WHERE status = 'unchanged') AS unchanged FROM diff)
       SELECT pages, chunks, added, removed, unchanged, round(chunks / pages, 6) AS avg_chunks_per_page,
         round((added + removed) * 100.0 / (chunks + existing), 6) AS change_percent FROM m""",
)
def metrics(spark, sf):
    new, old = _hashed(binds.docs_new(spark, sf)), _hashed(binds.docs_old(spark, sf))
    out = E.run_metrics(table(spark, sf, "documents"), new, old, E.diff_chunks(new, old))
    return out.withColumn("avg_chunks_per_page", F.round("avg_chunks_per_page", 6)).withColumn(
        "change_percent", F.round("change_percent", 6)
    )


@query(
    "e14_page_lookup",
    f"""WITH req AS (SELECT l.doc_id AS request_id, '/docs/' || (l.doc_id + l.toxic * 1000000) AS slug FROM labels l),
        p AS (SELECT '/docs/' || doc_id AS slug, source AS title, {S.trim_ws(S.sub("replace(text, chr(9), '')", chr(92) + 'n{3,}', chr(10) + chr(10)))} AS t FROM documents)
        SELECT request_id, req.slug, title, CASE WHEN p.slug IS NULL THEN 'unknown page' WHEN length(t) < 20 THEN 'no content' ELSE 'ok' END AS status,
          CASE WHEN length(t) < 20 THEN NULL WHEN length(t) > 4000 THEN t[1:4000] || {S.lit(E.CUT_MARKER)} ELSE t END AS content
        FROM req LEFT JOIN p ON p.slug = req.slug""",
)
def lookup(spark, sf):
    target = F.col("doc_id") + F.col("toxic") * 1000000
    requests = table(spark, sf, "labels").select(
        F.col("doc_id").alias("request_id"), F.concat(F.lit("/docs/"), target.cast("string")).alias("slug")
    )
    docs = table(spark, sf, "documents").select(
        F.concat(F.lit("/docs/"), F.col("doc_id").cast("string")).alias("slug"), F.col("source").alias("title"), F.col("text").alias("content")
    )
    return E.page_lookup(requests, docs)
