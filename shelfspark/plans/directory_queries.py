"""Directory, opening-hours and event queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfspark.functions.text import fold_text
from shelfspark.operators import directory as D
from shelfspark.plans import sqltext as S
from shelfspark.plans.registry import query, table

_CONTACTS = [
    {"query_id": 1, "name": "Customer#000000012"},
    {"query_id": 2, "name": "customer#00000001"},
    {"query_id": 3, "role": "Machinery, building"},
    {"query_id": 4, "department": "Nátion_3"},
    {"query_id": 5, "role": "nation_21", "department": "NATION_2"},
    {"query_id": 6},
]


def _score_sql(q):
    name, role, dept = (fold_text(q.get(c) or "") for c in ("name", "role", "department"))
    n, r, d = "lower(c_name)", "lower(c_mktsegment)", "lower(n_name)"

    def near(field, wanted):
        words = [w for w in wanted.replace(",", " ").split() if len(w) >= 2]
        tests = [f"contains({field}, {S.lit(wanted)})", f"contains({S.lit(wanted)}, {field})"]
        return " OR ".join(tests + [f"contains({field}, {S.lit(w)})" for w in words])

    parts = ["0"]
    if name:
        parts.append(f"CASE WHEN {n} = {S.lit(name)} THEN 100 WHEN contains({n}, {S.lit(name)}) OR contains({S.lit(name)}, {n}) THEN 10 ELSE 0 END")
    if role:
        words = [w for w in role.replace(",", " ").split() if len(w) >= 2]
        parts.append(f"CASE WHEN {near(r, role)} THEN 5 ELSE 0 END")
        parts.append(f"CASE WHEN {' OR '.join(f'contains({d}, {S.lit(w)})' for w in words)} THEN 5 ELSE 0 END")
    if dept:
        parts.append(f"CASE WHEN {near(d, dept)} THEN 5 ELSE 0 END")
    return " + ".join(parts)


def _contacts(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(
        F.col("c_custkey").alias("ord"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("role"),
        F.col("n_name").alias("department"),
    )


@query(
    "f1_contact_search",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {q['query_id']} AS query_id, {_score_sql(q)} AS score, c_custkey AS ord, c_name AS name, c_mktsegment AS role, n_name AS department"
        " FROM customer JOIN nation ON c_nationkey = n_nationkey" for q in _CONTACTS
    ) + ") WHERE score > 0",
)
def contacts(spark, sf):
    return D.contact_search(_contacts(spark, sf), _CONTACTS)


@query(
    "f1_contact_search_table",
    """WITH asked AS (SELECT s_suppkey AS query_id, lower(replace(s_name, 'Supplier', 'Customer')) AS name,
          CASE WHEN n_regionkey = 1 THEN 'machinery, building' END AS role, CASE WHEN n_regionkey > 1 THEN lower(n_name) END AS dept
          FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        known AS (SELECT c_custkey AS ord, c_name AS name, c_mktsegment AS role, n_name AS department,
          lower(c_name) AS n, lower(c_mktsegment) AS r, lower(n_name) AS d FROM customer JOIN nation ON c_nationkey = n_nationkey)
      SELECT * FROM (SELECT query_id,
          CASE WHEN n = asked.name THEN 100 WHEN contains(n, asked.name) OR contains(asked.name, n) THEN 10 ELSE 0 END
          + CASE WHEN asked.role IS NOT NULL AND (contains(r, 'machinery') OR contains(r, 'building') OR contains(asked.role, r)) THEN 5 ELSE 0 END
          + CASE WHEN asked.role IS NOT NULL AND (contains(d, 'machinery') OR contains(d, 'building')) THEN 5 ELSE 0 END
          + CASE WHEN dept IS NOT NULL AND (contains(d, dept) OR contains(dept, d)) THEN 5 ELSE 0 END AS score,
          ord, known.name, known.role, department FROM asked, known) WHERE score > 0""",
)
def contact_table(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    asked = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("query_id"),
        F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("name"),
        F.when(F.col("n_regionkey") == 1, F.lit("Machinery, building")).alias("role"),
        F.when(F.col("n_regionkey") > 1, F.col("n_name")).alias("department"),
    )
    return D.contact_search_table(_contacts(spark, sf), asked)


@query("f2_branch_filter", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation_2') OR contains('nation_2', lower(n_name))")
def branches(spark, sf):
    return D.branch_filter(table(spark, sf, "nation"), "n_name", "Nátion_2").select("n_nationkey", "n_name")


_BRANCH_SQL = """branches AS (SELECT s_suppkey AS ord, s_acctbal, n_regionkey, n_nationkey,
    CASE WHEN n_regionkey = 0 THEN n_name WHEN n_regionkey = 1 THEN s_name ELSE n_name || ' – ' || s_name END AS branch
    FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
_HOURS_SQL = """hours AS (SELECT n_nationkey AS hours_ord, CASE WHEN n_regionkey = 2 THEN 'Nátion ' || n_nationkey
    WHEN n_regionkey = 3 THEN n_name || ' – Supplier#0000000' || n_nationkey ELSE n_name END AS hours_branch FROM nation)"""


def _branches(spark, sf):
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    region = F.col("n_regionkey")
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        F.col("s_suppkey").alias("ord"), "s_acctbal", "n_regionkey", "n_nationkey",
        F.when(region == 0, F.col("n_name")).when(region == 1, F.col("s_name"))
        .otherwise(F.concat_ws(" – ", "n_name", "s_name")).alias("branch"),
    )


def _hours(spark, sf):
    region, key = F.col("n_regionkey"), F.col("n_nationkey").cast("string")
    return table(spark, sf, "nation").select(
        F.col("n_nationkey").alias("hours_ord"),
        F.when(region == 2, F.concat(F.lit("Nátion "), key))
        .when(region == 3, F.concat("n_name", F.lit(" – Supplier#0000000"), key))
        .otherwise(F.col("n_name")).alias("hours_branch"),
    )


def _norm_sql(x):
    return S.sub(S.fold(x), "[^a-z0-9]")


_MATCH_SQL = f"""WITH {_BRANCH_SQL}, {_HOURS_SQL},
  b AS (SELECT *, {_norm_sql('branch')} AS nb, {_norm_sql("regexp_split_to_array(branch, '[ –-]')[1]")} AS w FROM branches),
  h AS (SELECT *, {_norm_sql('hours_branch')} AS nh FROM hours),
  c AS (SELECT b.*, hours_branch, hours_ord, CASE WHEN branch = hours_branch THEN 0 WHEN contains(nb, nh) OR contains(nh, nb) THEN 1
        WHEN length(w) >= 3 AND contains(nh, w) THEN 2 END AS tier FROM b, h),
  best AS (SELECT * FROM c WHERE tier IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ord ORDER BY tier, hours_ord) = 1),
  matched AS (SELECT b.*, best.hours_branch, best.hours_ord FROM branches b LEFT JOIN best USING (ord))"""


@query("f3_match_hours", _MATCH_SQL + " SELECT ord, branch, hours_branch FROM matched")
def hours(spark, sf):
    return D.match_hours(_branches(spark, sf), _hours(spark, sf)).select("ord", "branch", "hours_branch")


_SLOTS_SQL = """rows_ AS (SELECT CAST(l_orderkey AS VARCHAR) AS branch, l_returnflag AS day, l_linenumber AS ord,
    strftime(l_shipdate, '%Y-%m-%d') || ' ' || l_partkey || '/' || l_suppkey AS slot FROM lineitem)"""


def _slots(spark, sf):
    slot = F.concat(
        F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" "), F.col("l_partkey").cast("string"), F.lit("/"), F.col("l_suppkey").cast("string")
    )
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("branch"), F.col("l_returnflag").alias("day"),
        F.col("l_linenumber").alias("ord"), slot.alias("slot"),
    )


@query(
    "f4_nest_schedule",
    f"""WITH {_SLOTS_SQL}, days AS (SELECT branch, day, min(ord) AS first, string_agg(slot, ',' ORDER BY ord, slot) AS hours FROM rows_ GROUP BY 1, 2)
        SELECT branch, CAST(0 AS BIGINT) AS part, string_agg(day || '=' || hours, ';' ORDER BY first, day) AS schedule FROM days GROUP BY 1""",
)
def nest(spark, sf):
    df = D.nest_schedule(_slots(spark, sf))
    flat = F.array_join(F.transform("schedule", lambda d: F.concat_ws("=", d["day"], F.array_join(d["hours"], ","))), ";")
    return df.select("branch", "part", flat.alias("schedule"))


_UNNEST_SQL = f"""WITH {_SLOTS_SQL}, days AS (SELECT branch, day, row_number() OVER (PARTITION BY branch ORDER BY min(ord), day) - 1 AS day_ord FROM rows_ GROUP BY 1, 2)
        SELECT branch, CAST(day_ord AS INTEGER) AS day_ord, day,
          CAST(row_number() OVER (PARTITION BY branch, day ORDER BY ord, slot) - 1 AS INTEGER) AS slot_ord, slot
        FROM rows_ JOIN days USING (branch, day)"""


@query("f4_unnest_schedule", _UNNEST_SQL)
def unnest(spark, sf):
    return D.unnest_schedule(D.nest_schedule(_slots(spark, sf)))


@query("f4_schedule_in_parts", _UNNEST_SQL)
def unnest_parts(spark, sf):
    """Branches and days cut into small parts: the answer is the same."""
    return D.unnest_schedule(D.nest_schedule(_slots(spark, sf), part_size=3))


@query(
    "f5_branch_profile",
    _MATCH_SQL
    + """, details AS (SELECT branch, min(ord) AS o, count(*) AS n, count(DISTINCT n_nationkey) AS k FROM branches WHERE s_acctbal > 2000 GROUP BY branch)
      SELECT m.ord, m.branch, CASE WHEN hours_branch IS NULL THEN '' ELSE 'Po=' || hours_ord || ':00-17:00' END AS schedule,
        CASE WHEN hours_branch IS NOT NULL THEN '/hodiny/' || hours_ord END AS hours_url,
        CASE WHEN n_regionkey <> 4 THEN '+420 ' || m.ord END AS phone,
        CASE WHEN s_acctbal > 5000 THEN 'Ulice ' || m.ord ELSE 'Detail ' || d.o END AS address, 'Knihovník ' || d.o AS librarian,
        coalesce('tisk ' || d.n, '') AS services FROM matched m LEFT JOIN details d ON d.branch = m.branch""",
)
def profile(spark, sf):
    base, ord_text = _branches(spark, sf), F.col("ord").cast("string")
    own = base.select(
        "branch", "ord",
        F.when(F.col("n_regionkey") != 4, F.array(F.concat(F.lit("+420 "), ord_text)))
        .otherwise(F.array().cast("array<string>")).alias("phones"),
        F.lit(None).cast("string").alias("email"),
        F.when(F.col("s_acctbal") > 5000, F.concat(F.lit("Ulice "), ord_text)).otherwise("").alias("address"),
        F.lit(None).cast("string").alias("transport"),
        F.lit(None).cast("string").alias("detail_url"),
    )
    hour_key = F.col("hours_ord").cast("string")
    times = _hours(spark, sf).withColumn(
        "schedule",
        F.array(F.struct(F.lit("Po").alias("day"), F.array(F.concat(hour_key, F.lit(":00-17:00"))).alias("hours"))),
    ).withColumn("hours_url", F.concat(F.lit("/hodiny/"), hour_key))
    details = base.filter("s_acctbal > 2000").groupBy("branch").agg(F.min("ord").alias("o"), F.count(F.lit(1)).alias("n")).select(
        "branch",
        F.concat(F.lit("Knihovník "), F.col("o").cast("string")).alias("librarian"),
        F.concat(F.lit("Detail "), F.col("o").cast("string")).alias("address"),
        F.lit(None).cast("string").alias("transport"),
        F.array(F.concat(F.lit("tisk "), F.col("n").cast("string"))).alias("services"),
    )
    out = D.branch_profile(own, times, details)
    flat = F.array_join(F.transform("schedule", lambda d: F.concat_ws("=", d["day"], F.array_join(d["hours"], ","))), ";")
    return out.select(
        "ord", "branch", flat.alias("schedule"), "hours_url", F.col("contact.phones")[0].alias("phone"),
        F.col("contact.address").alias("address"), F.col("contact.librarian").alias("librarian"),
        F.array_join("services", ",").alias("services"),
    )


_MONTH_SQL = "CASE month(ts) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(D.MONTHS, 1)) + " END"
_DETAIL_SQL = """CASE event_type WHEN 'click' THEN day(ts) || '.  leden, ' || strftime(ts, '%H:%M') || ' - 23:59   zdarma'
    WHEN 'view' THEN day(ts) || '. leden ' || user_id || ' Kč' || ' více' WHEN 'purchase' THEN 'Dobrovolné vstupné' WHEN 'error' THEN '' ELSE strftime(ts, '%H:%M') END"""


@query(
    "f6_event_details",
    f"""WITH d AS (SELECT event_id, {_DETAIL_SQL} AS details FROM events)
        SELECT event_id, coalesce(nullif(trim(regexp_replace(regexp_replace(details, '\\s+', ' ', 'g'), '(?i)(zdarma|dobrovolné|[0-9]+\\s*Kč).*$', '')), ''), 'Dnes') AS date_text,
          nullif(regexp_extract(details, '\\b([0-9]{{1,2}}:[0-9]{{2}})\\b', 1), '') AS time,
          nullif(regexp_extract(details, '(?i)(zdarma|dobrovolné|[0-9]+\\s*Kč)', 1), '') AS price FROM d""",
)
def details(spark, sf):
    day, kind = F.dayofmonth("ts").cast("string"), F.col("event_type")
    clock = F.date_format("ts", "HH:mm")
    text = (
        F.when(kind == "click", F.concat(day, F.lit(".  leden, "), clock, F.lit(" - 23:59   zdarma")))
        .when(kind == "view", F.concat(day, F.lit(". leden "), F.col("user_id").cast("string"), F.lit(" Kč více")))
        .when(kind == "purchase", "Dobrovolné vstupné").when(kind == "error", "").otherwise(clock)
    )
    rows = table(spark, sf, "events").select("event_id", text.alias("details"), F.lit("Dnes").alias("section"))
    return D.event_details(rows, "details", "section").select("event_id", "date_text", "time", "price")


_ORDER_MONTH = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(D.MONTHS, 1)) + " END"


@query(
    "f7_parse_czech_date",
    """SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS parsed FROM orders""",
)
def czech_dates(spark, sf):
    month = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS]), F.month("o_orderdate"))
    text = F.concat(
        F.lit("v neděli "),
        F.when(F.col("o_orderpriority") == "1-URGENT", "45").otherwise(F.dayofmonth("o_orderdate").cast("string")),
        F.lit(". "), month, F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" od 17:00"),
    )
    return table(spark, sf, "orders").select("o_orderkey", D.parse_czech_date(text).cast("string").alias("parsed"))


_CATEGORIES = {"přednáška klik": "1", "view": "2", "nákup": "3", "clíck": "4"}
_PLACES = {"nation_1": "10", "nation_20": "20", "NATION_3 hlavní": "30"}
_CAL_SQL = f"""calendar AS (SELECT event_id AS ord, event_type || ' čtení ' || (user_id) AS title, event_type AS type, n_name AS location,
    CASE WHEN event_type = 'signup' THEN 'Zítra' ELSE day(ts) || '. ' || {_MONTH_SQL} || ' ' || year(ts) END AS date,
    CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END AS event_date
    FROM events JOIN nation ON n_nationkey = user_id % 25)"""


def _calendar(spark, sf):
    e, n = table(spark, sf, "events"), table(spark, sf, "nation")
    month = F.element_at(F.array(*[F.lit(m) for m in D.MONTHS]), F.month("ts"))
    day = F.concat(F.dayofmonth("ts").cast("string"), F.lit(". "), month, F.lit(" "), F.year("ts").cast("string"))
    plain = F.col("event_type") != "signup"
    return e.join(n, F.col("n_nationkey") == F.col("user_id") % 25).select(
        F.col("event_id").alias("ord"),
        F.concat("event_type", F.lit(" čtení "), F.col("user_id").cast("string")).alias("title"),
        F.col("event_type").alias("type"), F.col("n_name").alias("location"),
        F.when(plain, day).otherwise("Zítra").alias("date"),
        F.when(plain, F.to_date("ts")).alias("event_date"),
    )


def _code_sql(x, codes):
    folded = [(fold_text(k), v) for k, v in codes.items()]
    exact = " ".join(f"WHEN {S.fold(x)} = {S.lit(k)} THEN '{v}'" for k, v in folded)
    near = " ".join(f"WHEN contains({S.lit(k)}, {S.fold(x)}) OR contains({S.fold(x)}, {S.lit(k)}) THEN '{v}'" for k, v in folded)
    return f"CASE {exact} {near} END"


@query(
    "f8_filter_events",
    f"""WITH {_CAL_SQL}, f AS (SELECT * FROM calendar WHERE event_date >= DATE '2024-01-12' AND {_code_sql('type', _CATEGORIES)} = '4'
          AND {_code_sql('location', _PLACES)} = '10')
        SELECT ord, title, type, location FROM f WHERE contains({S.fold('title')}, 'cteni 1') OR NOT EXISTS (SELECT 1 FROM f WHERE contains({S.fold('title')}, 'cteni 1'))""",
)
def events(spark, sf):
    found = D.filter_events(
        _calendar(spark, sf), "2024-01-12", "Click", "nation_1", "čtení 1", None, _CATEGORIES, _PLACES
    )
    return found.select("ord", "title", "type", "location")


@query(
    "f8_filter_events_fallback",
    f"""WITH {_CAL_SQL} SELECT ord, title, type, location FROM calendar WHERE contains('signups', type) AND contains({S.fold('location')}, 'on_7')""",
)
def events_fallback(spark, sf):
    """Unknown category and place filter by containment; a title filter without hits narrows nothing."""
    found = D.filter_events(_calendar(spark, sf), None, None, "on_7", "nic takového", "signups")
    return found.select("ord", "title", "type", "location")


@query("f8_filter_events_type", f"WITH {_CAL_SQL} SELECT ord, title, type, location FROM calendar WHERE contains(type, 'err')")
def events_type(spark, sf):
    return D.filter_events(_calendar(spark, sf), type_="Err").select("ord", "title", "type", "location")


def _class_sql(rows):
    return f"""WITH {_CAL_SQL}, c AS (SELECT *, coalesce(event_date < DATE '2024-01-29', false) AS is_past FROM calendar WHERE {rows}),
  top AS (SELECT * FROM c ORDER BY is_past, CASE WHEN NOT is_past THEN event_date END ASC NULLS LAST,
    CASE WHEN is_past THEN event_date END DESC NULLS LAST, ord LIMIT 30)"""


_CLASS_OUT = " SELECT ord, title, strftime(event_date, '%Y-%m-%d') AS event_date, is_past FROM top"
_FOUND = f"event_date >= DATE '2024-01-03' AND {_code_sql('type', _CATEGORIES)} = '4' AND {_code_sql('location', _PLACES)} = '10'"


_MOST_EVENTS = 30


@query("f9_classify_events", _class_sql("true") + _CLASS_OUT)
def classify(spark, sf):
    found = D.classify_events(_calendar(spark, sf).drop("event_date"), "2024-01-29", _MOST_EVENTS)
    return found.select("ord", "title", F.col("event_date").cast("string").alias("event_date"), "is_past")


def _found_and_classified(spark, sf):
    found = D.filter_events(_calendar(spark, sf), "2024-01-03", "Click", "nation_1", None, None, _CATEGORIES, _PLACES)
    return D.classify_events(found.drop("event_date"), "2024-01-29", _MOST_EVENTS)


@query("f9_classify_found", _class_sql(_FOUND) + _CLASS_OUT)
def classify_found(spark, sf):
    found = _found_and_classified(spark, sf)
    return found.select("ord", "title", F.col("event_date").cast("string").alias("event_date"), "is_past")


@query("f9_event_counts", _class_sql(_FOUND) + " SELECT is_past, CAST(count(*) AS BIGINT) AS n FROM top GROUP BY 1")
def counts(spark, sf):
    return D.event_counts(_found_and_classified(spark, sf))


@query(
    "f10_with_fallback",
    """SELECT 'a' AS kind, doc_id FROM labels WHERE quality = 0 AND toxic = 1
       UNION ALL SELECT 'a', doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE quality = 0 AND toxic = 1)
       UNION ALL SELECT 'b', doc_id FROM labels WHERE quality = 7
       UNION ALL SELECT 'b', doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE quality = 7)""",
)
def fallback(spark, sf):
    lab, docs = table(spark, sf, "labels"), table(spark, sf, "documents").select("doc_id")
    first = D.with_fallback(lab.filter("quality = 0 AND toxic = 1").select("doc_id"), docs)
    second = D.with_fallback(lab.filter("quality = 7").select("doc_id"), docs)
    return first.select(F.lit("a").alias("kind"), "doc_id").unionByName(second.select(F.lit("b").alias("kind"), "doc_id"))


@query("f11_lookup_code", f"SELECT event_id, {_code_sql('event_type', _CATEGORIES)} AS code FROM events")
def codes(spark, sf):
    return table(spark, sf, "events").select("event_id", D.lookup_code("event_type", _CATEGORIES).alias("code"))
