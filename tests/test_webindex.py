from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from shelfspark.operators import webindex as E
from shelfspark.session import write_bucketed
from shelfspark.sources import html_pages

CHUNK = "url string, section_heading string, chunk_index int, text string, hash string, ord long"


def chunk(url, text, h, o=0, heading="Úvod", index=0):
    return (url, heading, index, text, h, o)


def statuses(spark, new, old):
    diff = E.diff_chunks(spark.createDataFrame(new, CHUNK), spark.createDataFrame(old, CHUNK))
    return diff, {r["key"].split("::")[0]: r["status"] for r in diff.collect()}


@pytest.mark.parametrize(
    "new, old, want",
    [
        ([chunk("a", "x", "1")], [], {"a": "added"}),
        ([chunk("a", "x", "1")], [chunk("a", "x", "1")], {"a": "unchanged"}),
        ([chunk("a", "y", "2")], [chunk("a", "x", "1")], {"a": "changed"}),
        ([], [chunk("a", "x", "1")], {"a": "removed"}),
        (
            [chunk("a", "x", "1"), chunk("b", "y", "2"), chunk("c", "z", "3")],
            [chunk("a", "x", "1"), chunk("b", "x", "1"), chunk("d", "z", "3")],
            {"a": "unchanged", "b": "changed", "c": "added", "d": "removed"},
        ),
        ([chunk("a", "x", "1", 0), chunk("a", "y", "2", 1)], [chunk("a", "y", "2")], {"a": "unchanged"}),
    ],
)
def test_diff_cases(spark, new, old, want):
    assert statuses(spark, new, old)[1] == want


def test_diff_partitions_keys_and_applies(spark):
    new = [chunk(f"u{i}", "t" * (i % 5), str(i % 5), i) for i in range(40)]
    old = [chunk(f"u{i}", "t" * (i % 3), str(i % 3), i) for i in range(20, 70)]
    diff, status = statuses(spark, new, old)
    counts = {s: list(status.values()).count(s) for s in set(status.values())}
    assert counts["added"] + counts["changed"] + counts["unchanged"] == 40
    assert counts["removed"] + counts["changed"] + counts["unchanged"] == 50

    def keyed(df):
        return df.withColumn("id", E.chunk_id(E.chunk_key())).select("id", "hash")

    index = keyed(spark.createDataFrame(old, CHUNK))
    after = E.apply_diff(index, keyed(E.chunks_to_add(diff)), keyed(E.chunks_to_remove(diff)))
    assert sorted(after.collect()) == sorted(keyed(spark.createDataFrame(new, CHUNK)).collect())
    metrics = E.run_metrics(spark.range(8), spark.createDataFrame(new, CHUNK), spark.createDataFrame(old, CHUNK), diff).first()
    assert metrics["avg_chunks_per_page"] == 5.0
    assert metrics["added"] == counts["added"] + counts["changed"]


def test_hash_key_and_id(spark):
    row = spark.createDataFrame([("  test  ", "test")], "a string, b string").select(
        E.chunk_hash("a").alias("a"), E.chunk_hash("b").alias("b"),
        E.chunk_key(F.lit("https://example.com/page1"), F.lit("Introduction"), F.lit(0)).alias("key"),
        E.chunk_id(F.lit("k" * 100)).alias("short"), E.chunk_id(F.lit("k" * 101)).alias("long"),
    ).first()
    assert row["a"] == row["b"] and re.fullmatch("[0-9a-f]{64}", row["a"])
    assert row["key"] == "https://example.com/page1::Introduction::0"
    assert row["short"] == "k" * 100 and re.fullmatch("hash_[0-9a-f]{32}", row["long"])


def pages(spark, *rows):
    schema = f"url string, path string, title string, language string, sections {html_pages.SECTION_TYPE}"
    return spark.createDataFrame([(u, "/" + u.rsplit("/", 1)[-1], "Titul", "cs", s) for u, s in rows], schema)


def section(i, heading, content, level=2):
    return (i, heading, level, content)


def reference_chunks(title, path, heading, content, low=800, high=2000):
    """Plain walk over the sentences, the definition the fold has to match."""
    prefix = f"Stránka: {title}\nURL: {path}\n\n"
    if len(content) <= high:
        return [f"{prefix}{heading}\n\n{content}"]
    current, out = f"{prefix}{heading}\n\n", []
    for sentence in (s.strip() for s in re.findall(r"[^.!?]+[.!?]+|[^.!?]+$", content)):
        if not sentence:
            continue
        if len(current) + len(sentence) > high and len(current) > low:
            out.append(current.strip())
            current = f"{prefix}{heading} (pokračování)\n\n{sentence} "
        else:
            current += sentence + " "
    if len(current.strip()) > len(prefix) + len(heading) + 10:
        out.append(current.strip())
    return out


def test_no_pages_and_no_sections_give_no_chunks(spark):
    assert E.chunk_sections(pages(spark, ("https://l.example/a", []))).count() == 0


def test_short_sections_in_order_blank_ones_skipped(spark):
    text = "Obsah první části je dost dlouhý na to, aby prošel kontrolou nejmenší délky textu. " * 2
    got = E.chunk_sections(pages(spark, ("https://l.example/a", [section(0, "A", text), section(1, "B", "  "), section(2, "C", text)])))
    rows = got.orderBy("section_ord").collect()
    assert [(r["section_heading"], r["chunk_index"]) for r in rows] == [("A", 0), ("C", 0)]
    assert rows[0]["text"] == f"Stránka: Titul\nURL: /a\n\nA\n\n{text.strip()}"


@pytest.mark.parametrize(
    "content",
    [
        " ".join(f"Toto je věta číslo {i}, která něco říká o knihovně." for i in range(50)),
        "Slovo " * 900,
        "A. " + "B" * 2500 + ". Konec bez tečky",
        "... " + "Věta! " * 600 + "zbytek",
        "Krátká? " * 240 + "x" * 1900 + ".",
    ],
)
def test_long_sections_split_like_a_plain_walk(spark, content):
    got = E.chunk_sections(pages(spark, ("https://l.example/a", [section(0, "Nadpis", content)])), valid_only=False)
    rows = got.orderBy("chunk_index").collect()
    assert [r["text"] for r in rows] == reference_chunks("Titul", "/a", "Nadpis", content.strip())
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert all("(pokračování)" in r["text"] for r in rows[1:])


def test_departments_only_on_contact_pages(spark):
    text = "Telefon a adresa oddělení, kde vám rádi poradíme s výběrem knih a časopisů. " * 2
    parts = [section(0, "Prázdné", " "), section(1, "Oddělení A", text), section(2, "Jana", text, 3), section(3, "Bez úrovně", text, 4)]
    got = E.chunk_sections(pages(spark, ("https://l.example/kontakt", parts), ("https://l.example/jine", parts)))
    marked = [(r["url"], r["section_heading"]) for r in got.collect() if "Oddělení: Oddělení A" in r["text"]]
    assert marked == [("https://l.example/kontakt", "Jana")]


@pytest.mark.parametrize(
    "url, text, body, want",
    [
        ("https://l.example/a", "x" * 99, "x", False),
        ("https://l.example/a", "x" * 100, "x", True),
        ("https://l.example/Tipy-ke-cteni/1", "x" * 200, "x", False),
        ("https://l.example/a", "KNIHOVNÍCI DOPORUČUJÍ " + "x" * 200, "x", False),
        ("https://l.example/a", "kniha má 123 stran " + "x" * 200, "x", False),
        ("https://l.example/a", "x" * 200, "Přejít na obsah", False),
        ("https://l.example/a", "Cookies, GDPR a ochrana osobních údajů " + "x" * 100, "x", False),
        ("https://l.example/a", "Cookies, GDPR a ochrana osobních údajů " + "x" * 500, "x", True),
        ("https://l.example/a", "Cookies a ochrana osobních údajů " + "x" * 100, "x", True),
    ],
)
def test_valid_chunk(spark, url, text, body, want):
    row = spark.createDataFrame([(url, text, body)], "u string, t string, b string")
    assert row.select(E.valid_chunk(F.col("u"), F.col("t"), F.col("b"))).first()[0] is want


HTML = """<html lang="cs"><head><title> Knihovna &amp; svět </title><style>p{}</style></head><body>
<header>Menu hlavní</header><nav><a href="/x">X</a></nav>
<main><p>Úvodní odstavec před nadpisem, který je dostatečně dlouhý pro zachování.</p>
<h1>První <b>nadpis</b></h1><div>Text <i>prvního</i> oddílu &mdash; vnořený &lt;obsah&gt;, celkem přes padesát znaků.<script>bad()</script></div>
<div class="box ad">Reklama, která se musí vynechat i s celým svým dlouhým textem a odkazy.</div>
<h2></h2><h2>Krátký</h2><p>málo</p>
<h3>Navigace</h3><p>Menu stránky, které začíná slovem z navigace, a proto se celé vynechá.</p>
<section><h2>Poslední</h2><ul><li>první položka seznamu služeb</li><li>druhá položka seznamu služeb</li></ul></section>
</main><footer>Patička</footer></body></html>"""


def test_extract_pages_sections(spark):
    df = spark.createDataFrame([("https://L.example/Cesta?x=1#y", HTML), ("https://l.example", None)], "url string, html string")
    full, empty = html_pages.extract_pages(df).orderBy(F.desc("url")).collect()[::-1]
    full, empty = (full, empty) if full["sections"] else (empty, full)
    assert (full["url"], full["path"], full["title"], full["language"]) == ("https://l.example/Cesta", "/Cesta", "Knihovna & svět", "cs")
    got = [(s["heading"], s["level"], s["content"]) for s in full["sections"]]
    assert got == [
        ("Introduction", 1, "Úvodní odstavec před nadpisem, který je dostatečně dlouhý pro zachování."),
        ("První nadpis", 1, "Text prvního oddílu — vnořený <obsah>, celkem přes padesát znaků."),
        ("Poslední", 2, "první položka seznamu služeb druhá položka seznamu služeb"),
    ]
    assert empty["title"] is None or empty["title"] == "Untitled"
    assert empty["sections"] == []


def test_unclosed_tags_and_missing_containers():
    long = "dlouhý text oddílu, který má určitě více než padesát znaků celkem"
    assert html_pages.page_sections(f"<article><h2>A<p>{long}</article>") == []
    got = html_pages.page_sections(f"<body><article><h2>A</h2><p><b>{long}<br><p>{long}</article><p>{long} mimo")
    assert [s["content"] for s in got] == [f"{long} {long}"]
    assert html_pages.page_sections(f"<p>{long}</p>") == []


def test_extract_links(spark):
    html = """<a href="/kontakt">k</a><a class=x href='/akce/detail/1?x=1'>e</a><a href=/a.pdf>p</a><a>no</a>
      <a href="https://l.example.evil.tld/kontakt">z</a><a href="https://other.example/">o</a><a href="#top">t</a>
      <a href="/a/b/c/d">deep</a><a href="/sluzby/x&amp;y">s</a><a href="mailto:x@y">m</a><a href="/kontakt#2">k2</a>"""
    df = spark.createDataFrame([("https://l.example/sluzby/start", html)], "url string, html string")
    got = {r["dst"] for r in E.extract_links(df).collect()}
    assert got == {
        "https://l.example/kontakt", "https://l.example/akce/detail/1", "https://l.example/sluzby/start",
        "https://l.example/sluzby/x&y",
    }


def test_reachable_orders_by_depth_and_caps(spark):
    edges = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "a"), ("x", "y"), ("a", "a")]
    df = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("a",)], "url string")
    got = [(r["url"], r["depth"]) for r in E.reachable(df, seeds).collect()]
    assert got == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("e", 3)]
    assert [r["url"] for r in E.reachable(df, seeds, max_pages=2).collect()] == ["a", "b"]
    assert [r["url"] for r in E.reachable(df, seeds, max_depth=1).collect()] == ["a", "b", "c"]


def test_reachable_from_random_edges_and_a_hub(spark):
    rng = random.Random(21)
    edges = [(f"p{rng.randrange(120)}", f"p{rng.randrange(120)}") for _ in range(150)]
    edges += [("p3", f"h{i}") for i in range(300)] + [(None, "p1"), ("p1", None)]
    df, near = spark.createDataFrame(edges, "src string, dst string"), {"p0": 0, "p3": 0}
    level = ["p0", "p3"]
    while level:
        level = sorted({b for a, b in edges if a in level and b is not None and b not in near})
        near.update(dict.fromkeys(level, max(near.values()) + 1))
    seeds = spark.createDataFrame([("p0",), ("p3",), ("p3",)], "url string")
    assert {r["url"]: r["depth"] for r in E.reachable(df, seeds).collect()} == near
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("reach_")]


def test_a_level_exchanges_neither_edges_nor_found_pages(spark, tmp_path):
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = spark.range(2000).selectExpr("concat('p', id % 97) AS src", "cast(id % 4 AS int) AS salt", "concat('p', id % 89) AS dst")
    found = spark.range(500).selectExpr("concat('p', id) AS url", "cast(id % 3 AS int) AS depth")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        write_bucketed(edges, "plan_links", f"{tmp_path}/l", n, "src", "salt")
        write_bucketed(found, "plan_found", f"{tmp_path}/f", n, "url")
        text = E.next_level(spark.table("plan_links"), spark.table("plan_found"), 2)._jdf.queryExecution().executedPlan().toString()
        links, pages = [line for line in text.splitlines() if "Scan parquet" in line and "plan_links" in line], text.count("Exchange hashpartitioning")
        assert len(links) == 1 and pages == 2  # the salted frontier, and what it leads to
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for table in ("plan_links", "plan_found"):
            spark.sql(f"DROP TABLE IF EXISTS {table}")


def test_page_lookup(spark):
    known = spark.createDataFrame([("/a", "A", "x" * 4001), ("/b", "B", "\tmálo"), ("/c", "C", "řádek\n\n\n\n\tdalší dlouhý řádek ")], "slug string, title string, content string")
    asked = spark.createDataFrame([(1, "/a"), (2, "/b"), (3, "/c"), (4, "/d")], "request_id int, slug string")
    rows = {r["request_id"]: r for r in E.page_lookup(asked, known).collect()}
    assert rows[1]["content"] == "x" * 4000 + "\n\n[…obsah zkrácen]"
    assert (rows[2]["status"], rows[2]["content"]) == ("no content", None)
    assert rows[3]["content"] == "řádek\n\ndalší dlouhý řádek"
    assert (rows[4]["status"], rows[4]["title"]) == ("unknown page", None)


def test_links_are_real_attributes_of_visible_anchors(spark):
    html = """<!-- <a href="/comment">x</a> --><script>var s = '<a href="/script">';</script>
    <a data-href="/zz" href="/real">r</a> <a title="a > b" class=x href='/quoted'>q</a> <a hreflang="cs" href=/bare>b</a>
    <a href="/a&#38;b">amp</a> <a name="none">n</a> <area href="/area"> <a href="">e</a>"""
    pages = spark.createDataFrame([("https://a.example/x", html)], "url string, html string")
    got = {r["dst"] for r in E.extract_links(pages).collect()}
    assert got == {f"https://a.example/{p}" for p in ("real", "quoted", "bare", "a&b")}


def test_titles_decode_all_references(spark):
    rows = [("a", "<title>Otev&iacute;rac&iacute; doba &#225; &amp; v&#xED;ce</title>"), ("b", None), ("c", "<title> </title>")]
    pages = spark.createDataFrame(rows, "url string, html string")
    assert [r["title"] for r in html_pages.page_facts(pages).orderBy("url").collect()] == ["Otevírací doba á & více", "Untitled", "Untitled"]
    assert [r["title"] for r in html_pages.extract_pages(pages).orderBy("url").collect()] == ["Otevírací doba á & více", "Untitled", "Untitled"]


def test_references_cut_before_their_end_stay(spark):
    long = "Otev&iacute;rací doba &amp; kontakty &amp pobočky &copy &nesmysl; &#225; &#22 R&D, vše přes padesát znaků."
    want = "Otevírací doba & kontakty &amp pobočky &copy &nesmysl; á &#22 R&D, vše přes padesát znaků."
    html = f"<title>Ženy &amp; muži &amp</title><article><h1>Ženy &amp; muži &amp</h1><p>{long}</p></article>"
    pages = spark.createDataFrame([("https://l.example/a", html)], "url string, html string")
    got = html_pages.extract_pages(pages).first()
    assert got["title"] == html_pages.page_facts(pages).first()["title"] == "Ženy & muži &amp"
    assert [(s["heading"], s["content"]) for s in got["sections"]] == [("Ženy & muži &amp", want)]


def test_page_counts_only_in_lower_case(spark):
    text = "Nová budova má 300 STRAN popisu a mnoho dalších slov, která jsou tu jen pro délku, a ještě pár navíc. " * 2
    rows = spark.createDataFrame([(text,), (text.replace("STRAN", "stran"),)], "t string")
    assert [r[0] for r in rows.select(E.valid_chunk(F.lit("/x"), F.col("t"))).collect()] == [True, False]


def test_long_chain_is_walked_to_its_end(spark):
    edges = spark.createDataFrame([(f"p{i:02d}", f"p{i + 1:02d}") for i in range(60)], "src string, dst string")
    seeds = spark.createDataFrame([("p00",)], "url string")
    assert E.reachable(edges, seeds).count() == 61


def test_buckets_of_the_edges_grow_with_them(spark, monkeypatch):
    made, write = [], E.write_bucketed
    monkeypatch.setattr(E, "EDGES_PER_BUCKET", 50, raising=False)
    monkeypatch.setattr(E, "write_bucketed", lambda df, table, path, buckets, *c: (made.append(buckets), write(df, table, path, buckets, *c)))
    edges = spark.range(1000).selectExpr("cast(id div 40 AS string) AS src", "cast(id + 1 AS string) AS dst")
    seeds = spark.createDataFrame([("0",)], "url string")
    assert E.reachable(edges, seeds).count() == 1001
    assert made[0] == 20 and set(made[1:]) == {8} and spark.conf.get("spark.sql.shuffle.partitions") == "8"
