from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from shelfspark.functions.grams import containing_pairs
from shelfspark.operators import directory as D
from shelfspark.operators import skew


def contacts(spark):
    rows = [
        (0, "Jana Nováková", "ředitelka", "vedení"),
        (1, "Petr Novák", "IT správce", "oddělení IT"),
        (2, "Eva Malá", None, "dětské oddělení"),
    ]
    return spark.createDataFrame(rows, "ord long, name string, role string, department string")


@pytest.mark.parametrize(
    "asked, want",
    [
        ({"name": "jana novakova"}, [(0, 100)]),
        ({"name": "Novák"}, [(0, 10), (1, 10)]),
        ({"role": "Ředitelka vedení"}, [(0, 10)]),
        ({"department": "detske oddeleni"}, [(2, 5), (1, 5)]),
        ({"name": "Petr Novák", "role": "spravce"}, [(1, 105)]),
        ({}, []),
    ],
)
def test_contact_scores(spark, asked, want):
    got = D.contact_search(contacts(spark), [{"query_id": 7, **asked}]).collect()
    assert sorted((r["ord"], r["score"]) for r in got) == sorted(want)
    assert [r["score"] for r in got] == sorted((r["score"] for r in got), reverse=True)


def test_empty_role_only_matches_when_not_strict(spark):
    loose = D.contact_search(contacts(spark), [{"query_id": 1, "role": "kuchař"}], strict=False).collect()
    assert [r["name"] for r in loose] == ["Eva Malá"]
    assert D.contact_search(contacts(spark), [{"query_id": 1, "role": "kuchař"}]).count() == 0


@pytest.mark.parametrize("query, n", [("Rochlice", 1), ("rochlice", 1), ("Machnín", 1), ("Machnin", 1), ("Praha", 0)])
def test_branch_filter(spark, query, n):
    df = spark.createDataFrame([("Pobočka Rochlice",), ("Machnín",)], "branch string")
    assert D.branch_filter(df, "branch", query).count() == n


def test_match_hours_tiers_and_profile(spark):
    branches = spark.createDataFrame(
        [("Rochlice", 0), ("Machnín – dočasně", 1), ("Vesec u lesa", 2), ("Jinde", 3)], "branch string, ord long"
    ).withColumns(
        {"phones": F.array(F.lit("1")), "email": F.lit("e"), "address": F.lit(""), "transport": F.lit("bus"), "detail_url": F.lit("u")}
    )
    slot = F.array(F.struct(F.lit("Po").alias("day"), F.array(F.lit("9:30-11:30"), F.lit("12:00-16:00")).alias("hours")))
    hours = spark.createDataFrame(
        [("Machnin", 0), ("Rochlice 2", 1), ("Rochlice", 2), ("Knihovna Vesec", 3)], "hours_branch string, hours_ord long"
    ).withColumns({"schedule": slot, "hours_url": F.col("hours_branch")})
    details = spark.createDataFrame(
        [("Rochlice", "Jana", "Ulice 1", "tram", ["tisk"])], "branch string, librarian string, address string, transport string, services array<string>"
    )
    got = {r["branch"]: r for r in D.branch_profile(branches, hours, details).collect()}
    assert {b: r["hours_url"] for b, r in got.items()} == {
        "Rochlice": "Rochlice", "Machnín – dočasně": "Machnin", "Vesec u lesa": "Knihovna Vesec", "Jinde": None,
    }
    assert got["Jinde"]["schedule"] == [] and got["Jinde"]["services"] == []
    assert got["Rochlice"]["schedule"][0]["hours"] == ["9:30-11:30", "12:00-16:00"]
    contact = got["Rochlice"]["contact"]
    assert (contact["address"], contact["transport"], contact["librarian"]) == ("Ulice 1", "bus", "Jana")


@pytest.mark.parametrize("part_size", [1000, 2])
def test_nest_schedule_and_back(spark, part_size):
    rows = [("A", "Po", "8-9", 0), ("A", "Po", "10-12", 1), ("A", "St", "9-10", 2), ("A", "Út", None, 3), ("B", "Po", "7-8", 4), ("A", "Čt", "1-2", 5)]
    df = spark.createDataFrame(rows, "branch string, day string, slot string, ord long")
    nested = D.nest_schedule(df, part_size)
    if part_size == 1000:
        a = nested.filter("branch = 'A'").first()
        assert [(d["day"], d["hours"]) for d in a["schedule"]] == [("Po", ["8-9", "10-12"]), ("St", ["9-10"]), ("Čt", ["1-2"])]
    back = sorted(tuple(r) for r in D.unnest_schedule(nested).collect())
    assert back == sorted(
        [("A", 0, "Po", 0, "8-9"), ("A", 0, "Po", 1, "10-12"), ("A", 1, "St", 0, "9-10"), ("A", 2, "Čt", 0, "1-2"), ("B", 0, "Po", 0, "7-8")]
    )


@pytest.mark.parametrize("part_size", [1000, 2])
def test_long_day_keeps_its_positions(spark, part_size):
    rows = [("A", "Po", f"s{i}", i) for i in range(5)] + [("A", "Út", "t", 9)]
    df = spark.createDataFrame(rows, "branch string, day string, slot string, ord long")
    nested = D.nest_schedule(df, part_size)
    got = sorted(tuple(r)[1:] for r in D.unnest_schedule(nested).collect())
    assert got == [(0, "Po", i, f"s{i}") for i in range(5)] + [(1, "Út", 0, "t")]
    hours = nested.withColumnRenamed("branch", "hours_branch").withColumns({"hours_ord": F.lit(0), "hours_url": F.lit("/h")})
    branches = spark.createDataFrame(
        [("A", 0, [], None, "", "", "")],
        "branch string, ord int, phones array<string>, email string, address string, transport string, detail_url string",
    )
    details = spark.createDataFrame([], "branch string, librarian string, address string, transport string, services array<string>")
    profile = D.branch_profile(branches, hours, details).orderBy("part").collect()
    assert [r["part"] for r in profile] == list(range(len(profile))) and {r["hours_url"] for r in profile} == {"/h"}
    slots = [(d["day"], h) for r in profile for d in r["schedule"] for h in d["hours"]]
    assert slots == [("Po", f"s{i}") for i in range(5)] + [("Út", "t")]
    assert all(len(r["schedule"]) <= part_size for r in profile)


def test_schedules_with_null_branches_and_days_are_the_same_at_every_size(spark):
    rng = random.Random(12)
    rows = [(rng.choice(["A", "B", None]), rng.choice(["Po", "Út", None]), rng.choice([f"s{i}", "", None, "x"]), i) for i in range(90)]
    df = spark.createDataFrame(rows, "branch string, day string, slot string, ord long")
    want = sorted(map(str, D.unnest_schedule(D.nest_schedule(df)).collect()))
    assert len(want) == sum(bool(r[2]) for r in rows)
    for part_size in (1, 3, 40):
        assert sorted(map(str, D.unnest_schedule(D.nest_schedule(df, part_size)).collect())) == want


@pytest.mark.parametrize("part_size", [1, 3, 40])
def test_schedules_are_cut_alike_whether_branches_are_nested_whole_or_not(spark, monkeypatch, part_size):
    rng = random.Random(13)
    rows = [(rng.choice(["A", "B", "B", "C", None]), rng.choice(["Po", "Út", "St", None]), f"s{rng.randrange(30)}", i) for i in range(120)]
    df = spark.createDataFrame(rows, "branch string, day string, slot string, ord long")
    jobs, plain = [], D.groups_within
    monkeypatch.setattr(D, "groups_within", lambda *a: jobs.append(a) or plain(*a))
    monkeypatch.setattr(skew, "groups_within", lambda *a: jobs.append(a) or plain(*a))
    whole = sorted(map(str, D.nest_schedule(df, part_size).collect()))
    assert len(jobs) == 1
    monkeypatch.setattr(D, "WHOLE_BRANCH", 0)
    assert sorted(map(str, D.nest_schedule(df, part_size).collect())) == whole


@pytest.mark.parametrize(
    "text, want",
    [
        ("18. dubna 2024", dt.date(2024, 4, 18)), ("v pátek 3.května 2024 od 17:00", dt.date(2024, 5, 3)),
        ("31. PROSINCE 2023", dt.date(2023, 12, 31)), ("31. dubna 2024", None), ("18. duben, 13:00", None), ("Dnes", None),
    ],
)
def test_czech_dates(spark, text, want):
    assert spark.createDataFrame([(text,)], "d string").select(D.parse_czech_date("d")).first()[0] == want


def events(spark):
    rows = [
        (0, "Čtení pro děti", "Kurz", "Vesec", "3. ledna 2024", dt.date(2024, 1, 3)),
        (1, "Šachy", "Soutěž", "Hlavní budova", "9. ledna 2024", dt.date(2024, 1, 9)),
        (2, "Koncert", "Hudba", "Klub", "Zítra", None),
        (3, "Čtení", "Beseda", "Vesec", "7. ledna 2024", dt.date(2024, 1, 7)),
        (4, "Výlet", "Hudba", "Klub", "1. ledna 2024", dt.date(2024, 1, 1)),
    ]
    return spark.createDataFrame(rows, "ord long, title string, type string, location string, date string, event_date date")


@pytest.mark.parametrize(
    "filters, want",
    [
        ({"date": "2024-01-07"}, {1, 3}), ({"category": "soutez"}, {1}), ({"category": "hudba"}, {2, 4}),
        ({"place": "vesec"}, {0, 3}), ({"place": "klub"}, {2, 4}), ({"fulltext": "cteni"}, {0, 3}),
        ({"place": "vesec", "fulltext": "nic"}, {0, 3}), ({"type_": "hud"}, {2, 4}), ({}, {0, 1, 2, 3, 4}),
    ],
)
def test_filter_events(spark, filters, want):
    assert {r["ord"] for r in D.filter_events(events(spark), **filters).collect()} == want


def test_classify_events_order_and_limit(spark):
    got = D.classify_events(events(spark).drop("event_date"), "2024-01-07")
    assert [r["ord"] for r in got.collect()] == [3, 1, 2, 0, 4]
    assert {r["is_past"]: r["n"] for r in D.event_counts(got).collect()} == {False: 3, True: 2}
    assert [r["ord"] for r in D.classify_events(events(spark).drop("event_date"), "2024-01-07", 2).collect()] == [3, 1]


def test_contact_table_equals_parameters(spark):
    asked = [
        (1, "Jana Nováková", None, None), (2, "nova", None, None), (3, None, "ředitelka knihovny", None), (4, None, "vedení", None),
        (5, None, None, "oddělení, vedení"), (6, None, None, None), (7, "pan Jana Nováková ml.", "it", "x"),
    ]
    queries = spark.createDataFrame(asked, "query_id int, name string, role string, department string")
    rows = contacts(spark)
    names = ("query_id", "name", "role", "department")
    want = D.contact_search(rows, [dict(zip(names, q)) for q in asked])
    pick = lambda df: sorted((r["query_id"], r["ord"], r["score"]) for r in df.collect())
    assert pick(D.contact_search_table(rows, queries)) == pick(want)


def test_contact_table_meets_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(D, "CELL_QUERIES", 2)
    monkeypatch.setattr(D, "CELL_CONTACTS", 3)
    rng = random.Random(3)
    names, texts = ["Jana Nová", "Nová", "pan Jana Nová ml.", "jan", "", None], ["vedení", "vedení, IT", "it", "oddělení it", "", None]
    rows = [(i // 2, rng.choice(names), rng.choice(texts), rng.choice(texts)) for i in range(60)]
    asked = [(i, rng.choice(names), rng.choice(texts), rng.choice(texts)) for i in range(30)]
    known = spark.createDataFrame(rows, "ord long, name string, role string, department string")
    queries = spark.createDataFrame(asked, "query_id int, name string, role string, department string")
    want = D.contact_search(known, [dict(zip(("query_id", "name", "role", "department"), q)) for q in asked])
    pick = lambda df: sorted(map(str, df.select("query_id", "score", "ord", "name", "role", "department").collect()))
    table = D.contact_search_table(known, queries)
    assert pick(table) == pick(want)
    assert "rangepartitioning" not in table._jdf.queryExecution().executedPlan().toString()


def test_contact_names_are_compared_only_where_they_meet_a_query(spark, monkeypatch):
    meeting, parts = D._meeting, []
    monkeypatch.setattr(D, "_meeting", lambda asked, known, kinds: parts.append(known) or meeting(asked, known, kinds))
    names = ["Jana Nová", "Nová", "Cizí", "pan Jana Nová ml.", "", None]
    rows = [(i // 3 if i % 7 else None, names[i % 6], ("it", "vedení", None)[i % 3], ("oddělení it", "")[i % 2]) for i in range(48)]
    asked = [(1, "Jana Nová", "it", None), (2, None, "vedení", "it"), (3, "nikdo", None, "oddělení"), (4, "", "it", ""), (4, "Nová", "it", "it")]
    known = spark.createDataFrame(rows, "ord long, name string, role string, department string")
    queries = spark.createDataFrame(asked, "query_id int, name string, role string, department string")
    want = D.contact_search(known, [dict(zip(("query_id", "name", "role", "department"), q)) for q in asked])
    pick = lambda df: sorted(map(str, df.select("query_id", "score", "ord", "name", "role", "department").collect()))
    assert pick(D.contact_search_table(known, queries)) == pick(want)
    of = [{r["name"] for r in part.collect()} for part in parts]
    assert of == [{"Cizí", "", None}, {"Jana Nová", "Nová", "pan Jana Nová ml."}]
    assert sum(part.count() for part in parts) == len(rows)


def test_containing_pairs_of_short_and_long_names(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 9))) for _ in range(40)] + ["x" * 50 + "y", "x" * 40 + "y", None]
    needles = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 5))) for _ in range(20)] + ["x" * 39 + "y", "x" * 45, None]
    frames = [spark.createDataFrame([(v,) for v in values], f"{c} string") for c, values in (("t", texts), ("n", needles))]
    got = [tuple(r) for r in containing_pairs(frames[0], "t", frames[1], "n").collect()]
    assert sorted(got) == sorted({(t, n) for t in texts if t for n in needles if n and n in t})


def test_classify_events_has_no_limit_of_its_own(spark):
    many = spark.range(45).selectExpr("id AS ord", "'t' AS title", "'3. ledna 2024' AS date")
    assert D.classify_events(many, "2024-01-07").count() == 45
    assert D.classify_events(many, "2024-01-07", 40).count() == 40


def test_event_details(spark):
    rows = [("18. duben,  13:00 - 17:00   zdarma", "Dnes"), ("100 Kč", "Zítra"), ("Dobrovolné", None)]
    got = D.event_details(spark.createDataFrame(rows, "d string, s string"), "d", "s").collect()
    assert (got[0]["date_text"], got[0]["time"], got[0]["price"]) == ("18. duben, 13:00 - 17:00", "13:00", "zdarma")
    assert (got[1]["date_text"], got[1]["time"], got[1]["price"]) == ("Zítra", None, "100 Kč")
    assert (got[2]["date_text"], got[2]["price"]) == (None, "Dobrovolné")


def test_fallback_and_codes(spark):
    some, other, none = spark.range(2), spark.range(5, 8), spark.range(0)
    assert D.with_fallback(some, other).count() == 2
    assert D.with_fallback(none, other).count() == 3
    names = spark.createDataFrame([("PŘEDNÁŠKA",), ("deti",), ("Seminář a workshop",), ("nic",), ("",)], "n string")
    assert [r[0] for r in names.select(D.lookup_code("n", D.CATEGORY_CODES)).collect()] == ["10066", "10071", "19439", None, None]
