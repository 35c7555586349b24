"""Guard, routing and admission queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.operators import guard as G
from shelfspark.plans import sqltext as S
from shelfspark.plans.registry import query, table

_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


def _sanitize_sql(x):
    return S.trim_ws(S.sub(x, _CONTROL))


@query("h1_sanitize_text", f"SELECT doc_id, {_sanitize_sql('text')} AS clean_text FROM documents")
def sanitize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", G.sanitize_text("text").alias("clean_text"))


@query(
    "h2_split_oversized",
    f"""SELECT conv_id, turn, {_sanitize_sql('text')} AS clean_text, length({_sanitize_sql('text')}) > 1000 AS too_long
        FROM conversations""",
)
def oversized(spark, sf):
    return G.split_oversized(table(spark, sf, "conversations"), "text").select("conv_id", "turn", "clean_text", "too_long")


_LEAK = "(?i:" + "|".join(p.replace("(", "\\(").replace(")", "\\)") for p in G.LEAK_PHRASES) + ")|" + "|".join(G.LEAK_NAMES)
_CODE = "(?i)```(?:" + "|".join(G.CODE_LANGUAGES) + ")|" + "|".join(G.CODE_MARKUP)
_GUARD_SQL = f"""WITH cut AS (SELECT doc_id, text, CASE WHEN length(text) > 4000 THEN text[1:4000] || {S.lit(G.CUT_MARKER)} ELSE text END AS c
    FROM (SELECT doc_id, CASE WHEN lang = 'de' AND source = 'src1' THEN text || ' getEvents'
        WHEN lang = 'es' AND source IN ('src2', 'src3') THEN '```SQL' || text
        WHEN lang = 'fr' AND source = 'src4' THEN 'bezpečnostní pravidla' || text ELSE text END AS text FROM documents)),
  r AS (SELECT *, CASE WHEN regexp_matches(c, {S.lit(_LEAK)}) THEN 'leak'
      WHEN regexp_matches(c, {S.lit(_CODE)}) THEN 'code' WHEN length(text) > 4000 THEN 'truncated' END AS reason FROM cut)
  SELECT doc_id, reason, CASE WHEN reason IN ('leak', 'code') THEN {S.lit(G.FILTERED_TEXT)} ELSE c END AS answer FROM r"""


@query("h3_guard_output", _GUARD_SQL)
def guard_output(spark, sf):
    lang, source, text = F.col("lang"), F.col("source"), F.col("text")
    dirty = (
        F.when((lang == "de") & (source == "src1"), F.concat(text, F.lit(" getEvents")))
        .when((lang == "es") & source.isin("src2", "src3"), F.concat(F.lit("```SQL"), text))
        .when((lang == "fr") & (source == "src4"), F.concat(F.lit("bezpečnostní pravidla"), text))
        .otherwise(text)
    )
    docs = table(spark, sf, "documents").select("doc_id", dirty.alias("text"))
    return G.guard_output(docs, "text").select("doc_id", "reason", "answer")


def _any_sql(words):
    return "(" + " OR ".join(f"contains(f, {S.lit(w)})" for w in words) + ")"


# Words of the generated languages stand in for the Czech keyword lists, in the same three roles.
_HOURS, _BRANCH, _EVENT = ("hora", "stunde", "otevira"), ("eaument", "thereon", "vesec"), ("kurz", "akce", "est")
_ROUTE_SQL = f"""WITH t AS (SELECT conv_id, turn, lower({S.strip_accents(_sanitize_sql('text'))}) AS f FROM conversations),
  b AS (SELECT *, CASE {' '.join(f"WHEN contains(f, {S.lit(w)}) THEN {S.lit(w)}" for w in _BRANCH)} END AS branch FROM t),
  routed AS (SELECT conv_id, turn, branch, CASE WHEN {_any_sql(_HOURS)} OR branch IS NOT NULL THEN 'opening_hours'
     WHEN {_any_sql(_EVENT)} THEN 'events' ELSE 'semantic_search' END AS route FROM b)"""


def _routed(spark, sf):
    return G.route_queries(table(spark, sf, "conversations"), "text", _HOURS, _BRANCH, _EVENT)


@query("h4_route_queries", _ROUTE_SQL + " SELECT * FROM routed")
def route(spark, sf):
    return _routed(spark, sf).select("conv_id", "turn", "branch", "route")


@query("h4_route_report", _ROUTE_SQL + " SELECT route, CAST(count(*) AS BIGINT) AS n FROM routed GROUP BY 1")
def route_counts(spark, sf):
    return G.route_report(_routed(spark, sf))


@query(
    "h7_client_key",
    """SELECT event_id, CASE event_type WHEN 'click' THEN '10.0.0.' || user_id WHEN 'view' THEN '10.1.0.' || user_id
       WHEN 'purchase' THEN '10.2.0.' || user_id ELSE 'unknown' END AS client FROM events""",
)
def client(spark, sf):
    user, kind = F.col("user_id").cast("string"), F.col("event_type")
    heads = table(spark, sf, "events").select(
        "event_id",
        F.when(kind == "click", F.concat(F.lit(" 10.0.0."), user, F.lit(" , 192.168.0.1")))
        .when(kind == "view", F.concat(F.lit("10.1.0."), user))
        .when(kind == "purchase", F.lit(""))
        .alias("forwarded"),
        F.when(kind == "purchase", F.concat(F.lit("10.2.0."), user, F.lit(" "))).alias("real"),
    )
    return heads.select("event_id", G.client_key("forwarded", "real").alias("client"))


_ALLOW = ["https://www.ththen.example.com", "http://ththre.example.com/fr/", "https://ththin.example.com/"]
_ALLOW_SQL = " OR ".join(
    f"p = {S.lit(a.rstrip('/'))} OR starts_with(p, {S.lit(a.rstrip('/') + '/')})" for a in _ALLOW
)


@query(
    "h8_allowed_origins",
    f"""WITH s AS (SELECT page_id, contains(url, '?utm_source') AS exempt, regexp_replace(url, '/+$', '') AS p,
          contains(url, '#top') AS no_origin FROM pages),
        r AS (SELECT page_id, CASE WHEN exempt THEN NULL WHEN no_origin THEN 'missing origin'
          WHEN NOT ({_ALLOW_SQL}) THEN 'invalid origin' END AS reject_reason FROM s)
        SELECT *, reject_reason IS NULL AS allowed FROM r""",
)
def origins(spark, sf):
    url = F.col("url")
    rows = table(spark, sf, "pages").select(
        "page_id",
        F.when(~url.contains("#top") & ~url.contains("/en/"), url).alias("origin"),
        F.when(~url.contains("#top") & url.contains("/en/"), url).alias("referer"),
        F.when(url.contains("?utm_source"), "heartbeat").otherwise("addPrompt").alias("operation"),
    )
    return G.allowed_origins(rows, _ALLOW).select("page_id", "reject_reason", "allowed")


@query(
    "h9_retain_days",
    "SELECT event_id, user_id, event_type FROM events WHERE ts >= TIMESTAMP '2024-02-05 12:00:00' - INTERVAL 30 DAY",
)
def retain(spark, sf):
    return G.retain_days(table(spark, sf, "events"), "ts", "2024-02-05 12:00:00").select("event_id", "user_id", "event_type")
