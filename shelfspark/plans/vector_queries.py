"""Vector-retrieval queries over the embeddings table; queries are the centroids of its labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import vectors as V
from shelfspark.plans import binds
from shelfspark.plans import sqltext as S
from shelfspark.plans.registry import query, table

_BASE_SQL = """WITH pos AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
  cells AS (SELECT label, i, avg(x) AS x FROM pos GROUP BY 1, 2),
  q AS (SELECT CAST(label AS BIGINT) AS query_id, list(x ORDER BY i) AS vector FROM cells GROUP BY 1),
  e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
  pairs AS (SELECT q.query_id, e.id, round(1 - list_cosine_similarity(e.vector, q.vector), 9) AS cosine,
      round(list_sum(list_transform(list_zip(e.vector, q.vector), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 9) AS l2 FROM e, q)"""


def _centroids(spark, sf):
    cells = table(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "x")))
    return means.groupBy(F.col("label").cast("bigint").alias("query_id")).agg(
        F.transform(ordered, lambda c: c["x"]).alias("vector")
    )


def _items(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def _top_sql(metric, k):
    return f""", top AS (SELECT query_id, id, {metric} AS distance, row_number() OVER (PARTITION BY query_id ORDER BY {metric}, id) AS rank FROM pairs
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY {metric}, id) <= {k})"""


_NEAR_OUT = " SELECT query_id, id, round(distance, 6) AS distance, rank FROM top"


def _near(df):
    return df.select("query_id", "id", F.round("distance", 6).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("d1_knn_cosine", _BASE_SQL + _top_sql("cosine", 5) + _NEAR_OUT)
def cosine(spark, sf):
    return _near(V.knn(_items(spark, sf), _centroids(spark, sf), 5))


@query("d2_knn_l2", _BASE_SQL + _top_sql("l2", 10) + " SELECT query_id, id, round(distance, 6) AS distance, round(1 - distance, 6) AS score, rank FROM top")
def squared(spark, sf):
    found = V.knn(_items(spark, sf), _centroids(spark, sf), 10, "l2")
    return _near(found).join(found.select("query_id", "id", F.round("score", 6).alias("score")), ["query_id", "id"])


@query("d3_knn_approx")
def approximate(spark, sf):
    return _near(V.knn_approx(_items(spark, sf), _centroids(spark, sf), 5))


@query("d3_knn_recall", "SELECT true AS reaches_90_percent")
def recall(spark, sf):
    """The approximate search finds at least nine tenths of the exact result."""
    items, asked = _items(spark, sf), _centroids(spark, sf)
    exact = V.knn(items, asked, 5).select("query_id", "id", F.lit(1).alias("wanted"))
    found = V.knn_approx(items, asked, 5).select("query_id", "id", F.lit(1).alias("found"))
    both = exact.join(found, ["query_id", "id"], "left")
    return both.agg((F.count("found") >= 0.9 * F.count("wanted")).alias("reaches_90_percent"))


_BOOSTS = (("/en/", ("vedení", "ředitel"), 0.4), ("/fr/", (), 0.2), ("spam-farm", (), -0.5), ("/es/", (), 0.05))


@query(
    "d4_search_content",
    _BASE_SQL
    + """, top AS (SELECT query_id, id, l2 AS distance, url, html FROM pairs JOIN pages ON page_id = id
         QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY l2, id) <= 25),
       c AS (SELECT *, CASE WHEN query_id % 2 = 0 THEN 'kdo je ve Vedení' ELSE 'kniha' END AS query_text FROM top),
       u AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_id, url, html[1:100] ORDER BY distance, id) = 1),
       s AS (SELECT *, 1 - distance + CASE WHEN contains(url, '/en/') AND contains(lower(query_text), 'vedení') THEN 0.4
          WHEN contains(url, '/fr/') THEN 0.2 WHEN contains(url, 'spam-farm') THEN -0.5 WHEN contains(url, '/es/') THEN 0.05 ELSE 0 END AS score FROM u)
       SELECT query_id, id, url, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 5""",
)
def content(spark, sf):
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.col("html").alias("text"))
    asked = _centroids(spark, sf).withColumn(
        "query_text", F.when(F.col("query_id") % 2 == 0, "kdo je ve Vedení").otherwise("kniha")
    )
    found = V.search_content(_items(spark, sf).join(pages, "id"), asked, 5, _BOOSTS)
    return found.select("query_id", "id", "url", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


_PHRASED_SQL = """CASE p_type WHEN 'PROMO' THEN '  Podobné knihy jako ' || p_name WHEN 'ECONOMY' THEN 'DOPORUČENÍ mi knihu podobná jako ' || p_name || ' / '
    WHEN 'LARGE' THEN 'Něco podobného jako ' || p_name || '!' WHEN 'SMALL' THEN p_name || ' podobné knihy' WHEN 'MEDIUM' THEN 'doporučit ' ELSE p_name || ' doporučení' END"""


def _phrased():
    kind, name = F.col("p_type"), F.col("p_name")
    return (
        F.when(kind == "PROMO", F.concat(F.lit("  Podobné knihy jako "), name))
        .when(kind == "ECONOMY", F.concat(F.lit("DOPORUČENÍ mi knihu podobná jako "), name, F.lit(" / ")))
        .when(kind == "LARGE", F.concat(F.lit("Něco podobného jako "), name, F.lit("!")))
        .when(kind == "SMALL", F.concat(name, F.lit(" podobné knihy")))
        .when(kind == "MEDIUM", "doporučit ")
        .otherwise(F.concat(name, F.lit(" doporučení")))
    )


def _bare_sql(x):
    whole = S.trim_ws(x)
    out = whole
    for pattern in (*V.REQUEST_PREFIXES, *V.REQUEST_SUFFIXES):
        out = S.sub(out, "(?i)" + pattern)
    out = S.trim_ws(out)
    return f"CASE WHEN length({out}) > 0 THEN {out} ELSE {whole} END"


def _title_key_sql(x):
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({S.strip_accents(x)}), '\\s*/\\s*$', ''), '[^A-Za-z0-9_\\s]', '', 'g'), '\\s+', ' ', 'g'))"


@query(
    "d5_title_key",
    f"""WITH t AS (SELECT p_partkey, {_PHRASED_SQL} AS asked FROM part), b AS (SELECT *, {_bare_sql('asked')} AS bare FROM t)
        SELECT p_partkey, bare, {_title_key_sql('bare')} AS title_key FROM b""",
)
def keys(spark, sf):
    bare = table(spark, sf, "part").select("p_partkey", V.strip_request_phrasing(_phrased()).alias("bare"))
    return bare.select("p_partkey", "bare", V.title_key("bare").alias("title_key"))


_ASKED_SQL = """asked AS (SELECT n_nationkey AS query_id, CASE n_regionkey WHEN 0 THEN 'podobné knihy jako red widget'
    WHEN 1 THEN 'hot gear' WHEN 2 THEN 'Něco podobného jako blue bolt' WHEN 3 THEN 'jedna dvě tři čtyři pět šest sedm osm devět deset jedenáct dvanáct red widget'
    ELSE 'neznámý titul' END AS query FROM nation)"""
_BARE_TITLES = "CASE query WHEN 'podobné knihy jako red widget' THEN 'red widget' WHEN 'hot gear' THEN 'hot gear' WHEN 'Něco podobného jako blue bolt' THEN 'blue bolt' END"


@query(
    "d6_enrich_title_queries",
    binds.with_views("books") + f""", {_ASKED_SQL}, bare AS (SELECT *, {_BARE_TITLES} AS title FROM asked),
      m AS (SELECT a.query_id, min_by(b.title, b.ord) AS source_title, min_by(b.description || '. Témata: ' || b.subject, b.ord) AS enriched
        FROM bare a JOIN books b ON contains(b.title, split_part(a.title, ' ', 1)) AND contains(b.title, split_part(a.title, ' ', 2)) AND (contains(b.title, a.title) OR contains(a.title, b.title)) GROUP BY 1)
      SELECT asked.query_id, asked.query, coalesce(m.enriched, asked.query) AS enriched_query, m.source_title FROM asked LEFT JOIN m USING (query_id)""",
)
def enrich(spark, sf):
    region = F.col("n_regionkey")
    asked = table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("query_id"),
        F.when(region == 0, "podobné knihy jako red widget").when(region == 1, "hot gear")
        .when(region == 2, "Něco podobného jako blue bolt")
        .when(region == 3, "jedna dvě tři čtyři pět šest sedm osm devět deset jedenáct dvanáct red widget")
        .otherwise("neznámý titul").alias("query"),
    )
    return V.enrich_title_queries(asked, binds.books(spark, sf)).select(
        "query_id", "query", "enriched_query", "source_title"
    )


@query(
    "d6_enrich_nearest",
    _BASE_SQL + _top_sql("cosine", 3)
    + """, n AS (SELECT query_id, rank, p_name AS title, p_type || ' ' || p_name AS description, p_type AS subject FROM top JOIN part ON p_partkey = id),
      asked AS (SELECT query_id, CASE query_id % 3 WHEN 0 THEN max(title) FILTER (WHERE rank = 2) WHEN 1 THEN max(title) FILTER (WHERE rank = 1) || ' navíc'
        ELSE 'neznámý titul' END AS bare FROM n GROUP BY query_id),
      m AS (SELECT query_id, min_by(title, rank) AS source_title, min_by(description || '. Témata: ' || subject, rank) AS enriched
        FROM asked JOIN n USING (query_id) WHERE contains(title, bare) OR contains(bare, title) GROUP BY query_id)
      SELECT query_id, CASE WHEN query_id % 3 = 0 THEN 'podobné knihy jako ' ELSE '' END || bare AS query,
        coalesce(enriched, CASE WHEN query_id % 3 = 0 THEN 'podobné knihy jako ' ELSE '' END || bare) AS enriched_query, source_title
      FROM asked LEFT JOIN m USING (query_id)""",
)
def enrich_nearest(spark, sf):
    """Titles that the catalogue does not know, here an empty one, are looked for among the three nearest vectors."""
    books = table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
        F.concat_ws(" ", "p_type", "p_name").alias("description"), F.col("p_type").alias("subject"),
    )
    near = V.knn(_items(spark, sf), _centroids(spark, sf), 3).join(books, "id").select("query_id", "rank", "title", "description", "subject")
    at = lambda rank: F.max(F.when(F.col("rank") == rank, F.col("title")))
    kind = F.col("query_id") % 3
    text = (
        F.when(kind == 0, F.concat(F.lit("podobné knihy jako "), at(2))).when(kind == 1, F.concat(at(1), F.lit(" navíc"))).otherwise("neznámý titul")
    )
    asked = near.groupBy("query_id").agg(text.alias("query"))
    found = V.enrich_title_queries(asked, binds.books(spark, sf).limit(0), near)
    return found.select("query_id", "query", "enriched_query", "source_title")


def _titled(spark, sf):
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"))
    return _items(spark, sf).join(parts, "id", "left").withColumn("title", F.coalesce("title", F.lit("?")))


@query(
    "d7_recommend",
    _BASE_SQL + _top_sql("cosine", 6)
    + """, t AS (SELECT top.*, coalesce(p_name, '?') AS title, CASE WHEN query_id % 2 = 0 THEN 'Widget' END AS source_title
         FROM top LEFT JOIN part ON p_partkey = id),
       k AS (SELECT query_id, id, title, distance FROM t WHERE rank <= 5 + CASE WHEN source_title IS NULL THEN 0 ELSE 1 END
         AND (source_title IS NULL OR NOT contains(lower(title), lower(source_title))))
       SELECT query_id, id, title, row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS rank FROM k
       QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, id) <= 5""",
)
def recommend(spark, sf):
    asked = _centroids(spark, sf).withColumn("source_title", F.when(F.col("query_id") % 2 == 0, "Widget"))
    found = V.recommend(_titled(spark, sf), asked, 5)
    return found.select("query_id", "id", "title", F.col("rank").cast("bigint").alias("rank"))


@query("d8_find_by_description", _BASE_SQL + _top_sql("cosine", 3) + " SELECT query_id, id, coalesce(p_name, '?') AS title, rank FROM top LEFT JOIN part ON p_partkey = id")
def described(spark, sf):
    found = V.find_by_description(_titled(spark, sf), _centroids(spark, sf), 3)
    return found.select("query_id", "id", "title", F.col("rank").cast("bigint").alias("rank"))


@query(
    "d9_index_profile",
    "SELECT doc_id AS id, text[1:200] AS preview, (SELECT count(*) FROM documents) AS n_rows FROM documents ORDER BY doc_id LIMIT 20",
)
def profile(spark, sf):
    return V.index_profile(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("document")), 20)
