from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from shelfspark.functions import text as T
from shelfspark.functions import urls as U


def one(spark, make, value):
    return spark.createDataFrame([(value,)], "c string").select(make(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    "make, value, want",
    [
        (T.fold, "  Šťastný Ødegård ŁÓDŹ ", "stastny odegard lodz"),
        (T.fold, "Straße Æther æon", "strasse aether aeon"),
        (T.fold, "été", "ete"),
        (T.ascii_only, " Čapek ", "apek"),
        (T.comparison_key, " Karel (Čapek), 1890! ", "karel apek 1890"),
        (T.clean_title, "R.U.R. / ", "R.U.R."),
        (T.strip_author_role, "Čapek, Karel, 1890-1938 (Autor)", "Čapek, Karel"),
        (T.strip_author_role, "Němcová, Božena, 1820-", "Němcová, Božena"),
        (T.collapse_ws, " a\t\n b c ", "a b c"),
        (T.strip_markdown, "# T\n\n\n\n**[x](u)** *i* **b**\n• z", "T\n\nx (u) i b\n- z"),
        (T.capitalise_words, "božena mcDonald", "Božena McDonald"),
        (T.trim_ws, " ﻿ x \t", "x"),
    ],
)
def test_text_functions(spark, make, value, want):
    assert one(spark, make, value) == want


def test_fold_is_idempotent_and_matches_the_literal_form(spark):
    for value in ("Příliš žluťoučký kůň", "  ÀÉÎÕÜ ß ", "plain ascii", "Œuvre ǅ"):
        folded = one(spark, T.fold, value)
        assert folded == T.fold_text(value) == one(spark, T.fold, folded)


def test_missing_markers(spark):
    for value in (None, "", "  ", " NaN", "none "):
        assert one(spark, T.missing_to_null, value) is None
    assert one(spark, T.missing_to_null, "nantes") == "nantes"


def test_tokens(spark):
    assert one(spark, T.tokens, "a bc,  def ,g") == ["bc", "def"]


@pytest.mark.parametrize(
    "value, want",
    [
        ("https://Example.com", "https://example.com/"),
        ("https://example.com/page#x", "https://example.com/page"),
        ("https://example.com/A?focus=1#x", "https://example.com/A"),
        ("http://example.com:80/a", "http://example.com/a"),
    ],
)
def test_normalize_url(spark, value, want):
    assert one(spark, U.normalize_url, value) == want


@pytest.mark.parametrize(
    "value, relevant, fetchable",
    [
        ("https://l.example/kontakt", True, True),
        ("https://l.example/a/b/c", False, False),
        ("https://l.example/sluzby/a/b", True, True),
        ("https://l.example/sluzby/a/b.PDF", True, False),
        ("https://l.example/getfile/1", False, False),
        ("https://l.example/akce/getfile/1", True, False),
        ("https://l.example/Login", False, False),
        ("https://l.example/sluzby/tipy-ke-cteni", False, False),
    ],
)
def test_url_judgement(spark, value, relevant, fetchable):
    assert one(spark, U.relevant_url, value) is relevant
    assert one(spark, U.fetchable_url, value) is fetchable


@pytest.mark.parametrize(
    "href, want",
    [
        ("/x", "https://l.example/x"),
        ("b", "https://l.example/a/b"),
        ("../c", "https://l.example/c"),
        ("./d/./e", "https://l.example/a/d/e"),
        ("//other.example/z", "https://other.example/z"),
        ("HTTP://Other.example", "http://other.example/"),
        ("?q=1", "https://l.example/a/page"),
        ("#top", "https://l.example/a/page"),
        ("/ž lutý", "https://l.example/%C5%BE%20lut%C3%BD"),
        ("mailto:a@l.example", None),
        ("javascript:void(0)", None),
    ],
)
def test_resolve_links(spark, href, want):
    df = spark.createDataFrame([(href, "https://l.example/a/page")], "href string, base string")
    assert U.resolve_links(df, "href", "base", "dst").first()["dst"] == want


def test_comparison_key_equals_its_pattern_and_spares_it(spark):
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), 0x1F600]]
    rows = [(f"a{c}Z 9",) for c in chars] + [("",), (None,), ("\u00a0x\u2003 \u0416\u4e2d!",)]
    df = spark.createDataFrame(rows, "c string").repartition(8)
    plain = T.trim_ws(F.regexp_replace(F.lower("c"), rf"[^a-z0-9{T.WS_CHARS}]", ""))
    assert df.filter(~T.comparison_key("c").eqNullSafe(plain)).isEmpty()
    assert "translate(" in df.select(T.comparison_key("c"))._jdf.queryExecution().analyzed().toString()
