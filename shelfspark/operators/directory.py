"""Contacts, branches, opening hours and events: fuzzy matching, nesting, ranking."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfspark.functions.grams import containing_pairs, containment_candidates
from shelfspark.functions.text import WS, _col, fold, fold_text, trim_ws
from shelfspark.operators.skew import first_per_key, groups_within, nest_in_parts, numbered, with_matches

# Contact scores.
EXACT_NAME, PARTIAL_NAME, ROLE_SCORE, DEPARTMENT_SCORE = 100, 10, 5, 5
CONTACT_FIELDS = ("name", "role", "department")
#: A kind is a pair of folded role and department, of a query and of a contact.
ASKED_KIND, KNOWN_KIND = ["_to_role", "_to_department"], ["_of_role", "_of_department"]
#: Queries of one kind meet contacts of one kind in cells of about this many of either.
CELL_QUERIES, CELL_CONTACTS = 1000, 10_000
CELL_TASKS = 4
#: Contacts of one name are dealt over so many tasks, a power of two, where they are told from those whose name meets no query's.
NAME_CUTS = 16
#: A branch of up to this many slots is nested in one piece before it is cut.
WHOLE_BRANCH = 2_000

# Event categories and places with their codes.
CATEGORY_CODES = {
    "pro děti": "10071", "beseda": "18855", "konference": "18858", "kurz": "18859", "kvíz": "25086",
    "literární vycházka": "35871", "projekce": "10069", "přednáška": "10066", "seminář": "19439", "soutěž": "29884",
    "společenská akce": "18860", "výstava": "10068", "workshop": "19441",
}
PLACE_CODES = {
    "hlavní budova": "10080", "králův háj": "10081", "kunratická": "10082", "machnín": "10083", "rochlice": "10084",
    "ruprechtice": "10085", "vesec": "10086",
}
# Czech month names in the genitive, January to December.
MONTHS = (
    "ledna", "února", "března", "dubna", "května", "června", "července", "srpna", "září", "října", "listopadu", "prosince",
)
PRICE = r"(?iu)(zdarma|dobrovolné|[0-9]+\s*Kč)"


def contact_search(contacts: DataFrame, queries: list[dict], strict: bool = True) -> DataFrame:
    """Contacts with a positive score per query, best first.

    ``contacts``: ord, name, role, department. ``queries``: dicts with query_id and any of name,
    role, department. The queries are parameters, so scoring is one narrow pass. With
    ``strict`` off, an empty contact field counts as contained in every query.
    """
    folded = contacts.withColumns({f"_{c}": F.coalesce(fold(c), F.lit("")) for c in ("name", "role", "department")})

    def within(wanted: str, field: Column) -> Column:
        filled = (field != "") if strict else F.lit(True)
        return filled & F.lit(wanted).contains(field)

    def any_word(wanted: str, field: Column) -> Column:
        words = [w for w in wanted.replace(",", " ").split() if len(w) >= 2]
        hit = F.lit(False)
        for w in words:
            hit = hit | field.contains(w)
        return hit

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    scored = []
    for q in queries:
        name, role, dept = (fold_text(q.get(c) or "") for c in ("name", "role", "department"))
        score = F.lit(0)
        if name:
            partial = F.col("_name").contains(name) | within(name, F.col("_name"))
            score = score + F.when(F.col("_name") == name, EXACT_NAME).when(partial, PARTIAL_NAME).otherwise(0)
        if role:
            own = F.col("_role").contains(role) | within(role, F.col("_role")) | any_word(role, F.col("_role"))
            score = score + points(own, ROLE_SCORE) + points(any_word(role, F.col("_department")), DEPARTMENT_SCORE)
        if dept:
            field = F.col("_department")
            score = score + points(field.contains(dept) | within(dept, field) | any_word(dept, field), DEPARTMENT_SCORE)
        scored.append(F.struct(F.lit(q["query_id"]).alias("query_id"), score.alias("score")))
    positive = F.filter(F.array(*scored), lambda s: s["score"] > 0)
    found = folded.select(F.inline(positive), *contacts.columns)
    return found.orderBy("query_id", F.desc("score"), "ord")


def _words(wanted: Column) -> Column:
    """Distinct words of two letters or more."""
    return F.array_distinct(F.filter(F.split(F.replace(wanted, F.lit(","), F.lit(" ")), f"{WS}+"), lambda w: F.length(w) >= 2))


def contact_search_table(contacts: DataFrame, queries: DataFrame) -> DataFrame:
    """:func:`contact_search` (strict) for a table of queries: query_id, name, role, department, null where not asked.

    Rows come in no order. Points for role and department depend on these two texts only, so they are counted for the distinct
    pairs of them on either side, the kinds; a contact's kind scores only where one of its fields holds the query's text or a word
    of it, or lies in the query's text, and both are equi-joins on the rarest piece. Queries and contacts of scoring kinds meet
    in cells of bounded size (:func:`_meeting`), once for each result; the contacts whose name meets no query's name do so by themselves,
    without a look at the names. Other results come from names alone, which meet by equal stretches.
    """
    known = contacts.select(*contacts.columns, *[F.coalesce(fold(c), F.lit("")).alias(f"_of_{c}") for c in CONTACT_FIELDS])
    asked = queries.select("query_id", *[F.coalesce(fold(c), F.lit("")).alias(f"_to_{c}") for c in CONTACT_FIELDS])
    kinds = _kind_points(known, asked)

    wanted, name = F.col("_to_name"), F.col("_of_name")
    near = name.contains(wanted) | ((name != "") & wanted.contains(name))
    by_name = F.when(wanted == "", 0).when(name == wanted, EXACT_NAME).when(near, PARTIAL_NAME).otherwise(0)
    names = containing_pairs(known, "_of_name", asked, "_to_name")
    names = names.unionByName(containing_pairs(asked, "_to_name", known, "_of_name")).distinct()
    points, cut = F.col("_points"), F.xxhash64("ord").bitwiseAND(F.lit(NAME_CUTS - 1))
    near_names = names.select(F.col("_of_name").alias("_near"), F.explode(F.sequence(F.lit(0), F.lit(NAME_CUTS - 1))).alias("_cut"))
    meets = (name == F.col("_near")) & (cut == F.col("_cut"))
    met = [
        _meeting(asked, known.join(near_names, meets, how), kinds).select("query_id", score.alias("score"), *contacts.columns)
        for how, score in (("left_anti", points), ("left_semi", points + by_name))
    ]

    named = asked.join(names, "_to_name").join(known, "_of_name").join(kinds, [*ASKED_KIND, *KNOWN_KIND], "left_anti")
    return reduce(DataFrame.unionByName, [*met, named.select("query_id", by_name.alias("score"), *contacts.columns)])


def _kind_points(known: DataFrame, asked: DataFrame) -> DataFrame:
    """The kinds of queries and contacts that score together, with their ``_points``."""
    of, to = known.select(*KNOWN_KIND).distinct(), asked.select(*ASKED_KIND).distinct()

    def long(df: DataFrame, keys: list[str], name: str) -> DataFrame:
        rows = F.array(*[F.struct(F.lit(c).alias("field"), F.col(k).alias(name)) for c, k in zip(CONTACT_FIELDS[1:], keys, strict=True)])
        return df.select(*keys, F.inline(rows)).filter(F.col(name) != "")

    held, texts = long(of, KNOWN_KIND, "value"), long(to, ASKED_KIND, "wanted")
    single = texts.select(*ASKED_KIND, "field", F.explode(_words(F.col("wanted"))).alias("wanted"))
    elsewhere = single.filter("field = 'role'").withColumn("field", F.lit("department"))
    needles = texts.unionByName(single).unionByName(elsewhere).distinct().withColumn("_parts", F.array("wanted"))
    holding = containment_candidates(held, "value", needles, "_parts", [*ASKED_KIND, "field", "wanted"], ["field"])
    within = containment_candidates(texts, "wanted", held.withColumn("_parts", F.array("value")), "_parts", [*KNOWN_KIND, "field"], ["field"])
    both = [*ASKED_KIND, *KNOWN_KIND]
    pairs = holding.filter(F.col("value").contains(F.col("wanted"))).select(*both).unionByName(
        within.filter(F.col("wanted").contains(F.col("value"))).select(*both)
    ).distinct()

    def holds_word(field: Column, wanted: Column) -> Column:
        return F.exists(_words(wanted), lambda w: field.contains(w))

    def near(c: str) -> Column:
        f, w = F.col(f"_of_{c}"), F.col(f"_to_{c}")
        return ((w != "") & (f.contains(w) | ((f != "") & w.contains(f)))) | holds_word(f, w)

    role = F.when(near("role"), ROLE_SCORE).otherwise(0)
    department = F.when(near("department"), DEPARTMENT_SCORE).otherwise(0)
    role_elsewhere = F.when(holds_word(F.col("_of_department"), F.col("_to_role")), DEPARTMENT_SCORE).otherwise(0)
    return pairs.withColumn("_points", role + role_elsewhere + department).filter("_points > 0")


def _meeting(asked: DataFrame, known: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every query beside every contact of the kinds that score together.

    The queries of a kind are cut into blocks and its contacts into parts by hash; a block and a part meet in a cell of their own,
    so a frequent kind is spread over many cells, none of which grows with the tables.
    """
    cuts = int(asked.sparkSession.conf.get("spark.sql.shuffle.partitions")) * CELL_TASKS
    blocks = asked.groupBy(*ASKED_KIND).agg(F.ceil(F.count(F.lit(1)) / CELL_QUERIES).alias("_blocks"))
    parts = known.groupBy(*KNOWN_KIND).agg(F.ceil(F.count(F.lit(1)) / CELL_CONTACTS).alias("_parts"))
    counted = kinds.join(blocks, ASKED_KIND).join(parts, KNOWN_KIND)

    def upto(n: str, name: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(name)

    cell = [*ASKED_KIND, *KNOWN_KIND, "_block", "_part"]
    block, part = F.pmod(F.xxhash64("query_id"), F.col("_blocks")), F.pmod(F.xxhash64("ord"), F.col("_parts"))
    queries = asked.join(counted, ASKED_KIND).withColumn("_block", block).select(*asked.columns, *KNOWN_KIND, "_block", "_points", upto("_parts", "_part"))
    rows = known.join(counted.drop("_points"), KNOWN_KIND).withColumn("_part", part).select(*known.columns, *ASKED_KIND, "_part", upto("_blocks", "_block"))
    return rows.repartition(cuts, *cell).join(queries.repartition(cuts, *cell), cell)


def branch_filter(df: DataFrame, col: str, query: str) -> DataFrame:
    """Rows whose folded name contains the query or is contained in it."""
    wanted, name = fold_text(query), fold(col, trim=False)
    return df.filter(name.contains(wanted) | F.lit(wanted).contains(name))


def _letters(c: Column) -> Column:
    return F.regexp_replace(fold(c), r"[^a-z0-9]", "")


def match_hours(branches: DataFrame, hours: DataFrame) -> DataFrame:
    """Best hours row per branch: same name, else either name contains the other, else first word.

    ``branches``: branch, ord. ``hours``: hours_branch, hours_ord. Adds hours_branch (null when
    nothing matches). Candidates come from equi-joins on name pieces, so neither side has to fit
    anywhere.
    """
    word = F.split(F.col("branch"), r"[\s\-–]")[0]
    left = branches.select("branch", "ord", _letters(F.col("branch")).alias("_b"), _letters(word).alias("_w"))
    right = hours.select("hours_branch", "hours_ord", _letters(F.col("hours_branch")).alias("_h"))
    picked = ["branch", "ord", "hours_branch", "hours_ord", "tier"]

    def needle(df: DataFrame, c: str, shortest: int = 1) -> DataFrame:
        return df.filter(F.length(c) >= shortest).withColumn("_words", F.array(c))

    hours_keys, branch_keys = ["hours_branch", "hours_ord"], ["branch", "ord"]
    inner = containment_candidates(left, "_b", needle(right, "_h"), "_words", hours_keys)
    outer = containment_candidates(right, "_h", needle(left, "_b"), "_words", branch_keys)
    first = containment_candidates(right, "_h", needle(left, "_w", 3), "_words", branch_keys)

    same = left.join(right, F.col("branch") == F.col("hours_branch")).withColumn("tier", F.lit(0))
    contained = inner.filter(F.col("_b").contains(F.col("_h"))).withColumn("tier", F.lit(1))
    containing = outer.filter(F.col("_h").contains(F.col("_b"))).withColumn("tier", F.lit(1))
    by_word = first.filter(F.col("_h").contains(F.col("_w"))).withColumn("tier", F.lit(2))

    found = same.select(*picked)
    for part in (contained, containing, by_word):
        found = found.unionByName(part.select(*picked))
    best = first_per_key(found, ["branch", "ord"], ["tier", "hours_ord"]).select("branch", "ord", "hours_branch")
    return branches.join(best, ["branch", "ord"], "left")


def nest_schedule(rows: DataFrame, part_size: int = 1000) -> DataFrame:
    """(branch, day, slot, ord) rows -> branch with an ordered array of (day, hours, day_ord, first_slot).

    Days keep first-seen order and slots theirs; rows without a slot add nothing. A branch with more
    than ``part_size`` slots continues in further rows (``part``), and a day with more in further
    elements: ``day_ord`` is the day's place in the branch and ``first_slot`` that of the element's
    first slot in the day, so :func:`unnest_schedule` gives the same rows at every size. A null branch is a
    branch, and a null day a day. Branches of up to ``WHOLE_BRANCH`` slots are grouped in one pass and cut into parts where
    they lie.
    """
    filled = rows.filter(F.col("slot").isNotNull() & (F.col("slot") != ""))
    if groups_within(filled, ["branch"], max(part_size, WHOLE_BRANCH)):
        seen = filled.groupBy("branch").agg(F.sort_array(F.collect_list(F.struct("ord", "day", "slot"))).alias("_seen"))
        days = F.array_distinct(F.transform("_seen", lambda s: s["day"]))

        def hours_of(day: Column) -> Column:
            return F.transform(F.filter("_seen", lambda s: s["day"].eqNullSafe(day)), lambda s: s["slot"])

        def pieces(day: Column, place: Column) -> Column:
            hours = hours_of(day)
            firsts = F.transform(F.sequence(F.lit(0), F.ceil(F.size(hours) / part_size).cast("int") - 1), lambda k: k * part_size)
            return F.transform(firsts, lambda at: _day(day, F.slice(hours, at + 1, part_size), place, at))

        placed = seen.select("branch", F.flatten(F.transform(days, pieces)).alias("_placed"))
        parts = F.sequence(F.lit(0), F.ceil(F.size("_placed") / part_size).cast("int") - 1)
        numbered_parts = placed.select("branch", "_placed", F.explode(parts).alias("_n"))
        schedule = F.slice("_placed", F.col("_n") * part_size + 1, part_size)
        return numbered_parts.select("branch", F.col("_n").cast("bigint").alias("part"), schedule.alias("schedule"))
    slots = nest_in_parts(filled, ["branch", "day"], ["ord", "slot"], F.struct("slot", "ord"), "_slots", part_size)
    opened = slots.filter("part = 0").select("branch", "day", F.col("_slots")[0]["ord"].alias("ord"))
    days = numbered(opened, ["branch"], ["ord", "day"], "_n").select("branch", "day", (F.col("_n") - 1).alias("_day"))
    hours = F.transform("_slots", lambda s: s["slot"])
    elements = with_matches(slots, days, ["branch", "day"], "inner").select(
        "branch", "_day", F.col("part").alias("_piece"), _day(F.col("day"), hours, F.col("_day"), F.col("part") * part_size).alias("_item")
    )
    return nest_in_parts(elements, ["branch"], ["_day", "_piece"], F.col("_item"), "schedule", part_size)


def _day(day: Column, hours: Column, place: Column, first_slot: Column) -> Column:
    return F.struct(
        day.alias("day"), hours.alias("hours"), place.cast("int").alias("day_ord"), first_slot.cast("int").alias("first_slot")
    )


def unnest_schedule(df: DataFrame) -> DataFrame:
    """Back to one row per (branch, day, slot) with both positions."""
    days = df.select("branch", F.explode("schedule").alias("_d"))
    slots = days.select("branch", F.col("_d.day_ord").alias("day_ord"), F.col("_d.day").alias("day"), "_d", F.posexplode("_d.hours").alias("_p", "slot"))
    return slots.select("branch", "day_ord", "day", (F.col("_d.first_slot") + F.col("_p")).alias("slot_ord"), "slot")


def branch_profile(branches: DataFrame, hours: DataFrame, details: DataFrame) -> DataFrame:
    """Branches with their schedule, a contact struct and services.

    ``branches``: branch, ord, phones, email, address, transport, detail_url. ``hours``:
    hours_branch, hours_ord, schedule, hours_url. ``details``: branch, librarian, address,
    transport, services; its address and transport only fill gaps. Hours that come in parts (``part``, see
    :func:`nest_schedule`) stay in parts: a branch then has one row for each, with the same facts.
    """
    parts = ["part"] if "part" in hours.columns else []
    matched = match_hours(branches, hours.select("hours_branch", "hours_ord").distinct())
    timed = matched.join(hours.select("hours_branch", *parts, "schedule", "hours_url"), "hours_branch", "left")
    extra = details.select(
        "branch", "librarian", "services",
        F.col("address").alias("_address"), F.col("transport").alias("_transport"),
    )
    full = timed.join(extra, "branch", "left")

    def gap(c: str) -> Column:
        return F.coalesce(F.nullif(F.col(c), F.lit("")), F.col(f"_{c}")).alias(c)

    empty = F.array().cast(hours.schema["schedule"].dataType)
    phones = F.when(F.size("phones") > 0, F.col("phones")).alias("phones")
    return full.select(
        "branch", "ord", *[F.coalesce(p, F.lit(0).cast("bigint")).alias(p) for p in parts],
        F.coalesce("schedule", empty).alias("schedule"),
        "hours_url",
        F.struct(phones, "email", gap("address"), gap("transport"), "librarian").alias("contact"),
        F.coalesce("services", F.array().cast("array<string>")).alias("services"),
        "detail_url",
    )


def event_details(df: DataFrame, details: str, section: str) -> DataFrame:
    """Date text (or the section heading), first HH:MM, and price of an event's detail line."""
    text = F.col(details)
    left = trim_ws(F.regexp_replace(F.regexp_replace(text, f"{WS}+", " "), PRICE + ".*$", ""))
    time = F.regexp_extract(text, r"\b([0-9]{1,2}:[0-9]{2})\b", 1)
    price = F.regexp_extract(text, PRICE, 1)
    return df.withColumns(
        {
            "date_text": F.coalesce(F.nullif(left, F.lit("")), F.col(section)),
            "time": F.nullif(time, F.lit("")),
            "price": F.nullif(price, F.lit("")),
        }
    )


def parse_czech_date(c: Column | str) -> Column:
    """'d. month yyyy' with the month in the genitive -> date; null when it is no valid date."""
    pattern = r"([0-9]{1,2})\.\s*(\p{L}+)\s+([0-9]{4})"
    day, name, year = (F.regexp_extract(_col(c), pattern, i) for i in (1, 2, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(name))
    return F.when(month > 0, F.try_to_date(F.concat_ws("-", year, month.cast("string"), day), "y-M-d"))


def lookup_code(c: Column | str, codes: dict[str, str]) -> Column:
    """Code by folded key: an equal key first, else the first key containing or contained."""
    value = fold(c)
    code = F.lit(None).cast("string")
    for key, found in reversed(codes.items()):
        k = fold_text(key)
        near = (value != "") & (F.lit(k).contains(value) | value.contains(k))
        code = F.when(near, found).otherwise(code)
    for key, found in reversed(codes.items()):
        code = F.when(value == fold_text(key), found).otherwise(code)
    return code


def _code_of(text: str, codes: dict[str, str]) -> str | None:
    wanted, folded = fold_text(text), {fold_text(k): v for k, v in codes.items()}
    if wanted in folded:
        return folded[wanted]
    return next((v for k, v in folded.items() if k in wanted or wanted in k), None)


def filter_events(
    events: DataFrame,
    date: str | None = None,
    category: str | None = None,
    place: str | None = None,
    fulltext: str | None = None,
    type_: str | None = None,
    category_codes: dict[str, str] | None = None,
    place_codes: dict[str, str] | None = None,
) -> DataFrame:
    """Events (title, type, location, event_date) from a date, of a category, at a place, by title words.

    A known name filters by code, an unknown one by containment. The title filter only narrows
    when something remains; that test is a subquery of the same plan.
    """
    categories, places = category_codes or CATEGORY_CODES, place_codes or PLACE_CODES
    if type_ and not (date or category or place or fulltext):
        kind, wanted = fold("type", trim=False), fold_text(type_)
        return events.filter((kind != "") & (kind.contains(wanted) | F.lit(wanted).contains(kind)))
    category = category or type_
    if date:
        events = events.filter(F.col("event_date") >= F.lit(date).cast("date"))
    if category:
        code = _code_of(category, categories)
        kind, wanted = fold("type"), fold_text(category)
        near = (kind != "") & (kind.contains(wanted) | F.lit(wanted).contains(kind))
        events = events.filter((lookup_code("type", categories) == code) if code else near)
    if place:
        code = _code_of(place, places)
        near = fold("location").contains(fold_text(place))
        events = events.filter((lookup_code("location", places) == code) if code else near)
    if fulltext:
        hit = fold("title", trim=False).contains(fold_text(fulltext))
        events = events.filter(hit | ~events.filter(hit).exists())
    return events


def classify_events(
    events: DataFrame, today: str, max_results: int | None = None, date_text: str = "date"
) -> DataFrame:
    """Upcoming events soonest first, then past ones most recent first; all, or the first ``max_results``.

    Unparsed dates count as upcoming and come after the dated ones. Adds event_date and is_past.
    """
    parsed = events.withColumn("event_date", parse_czech_date(date_text))
    day = F.col("event_date")
    classified = parsed.withColumn("is_past", F.coalesce(day < F.lit(today).cast("date"), F.lit(False)))
    order = [
        F.col("is_past"),
        F.when(~F.col("is_past"), day).asc_nulls_last(),
        F.when(F.col("is_past"), day).desc_nulls_last(),
        F.col("ord"),
    ]
    ordered = classified.orderBy(*order)
    return ordered if max_results is None else ordered.limit(max_results)


def event_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("is_past").agg(F.count(F.lit(1)).alias("n"))


def with_fallback(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """The primary rows, or all fallback rows when there are none; decided inside the plan."""
    return primary.unionByName(fallback.filter(~primary.exists()))
