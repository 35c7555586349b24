"""The stored posting index: look-ups against plain containment, updates against rebuilds."""

from __future__ import annotations

import random

import pytest

from shelfspark.operators import postings, search
from shelfspark.operators.postings import PostingIndex

BOOKS = "id string, ord long, title string, author string, subject string, year string, publisher string, description string"
LETTERS = "aabcdeéž 1\U0001f600"


def made_books(n, seed):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(LETTERS) for _ in range(rng.randrange(0, 14)))
    return [(str(i), i, text(), rng.choice([text(), None]), text(), "1990", None, text()) for i in range(n)]


@pytest.fixture(scope="module")
def books(spark):
    return spark.createDataFrame(made_books(120, 4), BOOKS)


def asked(spark, seed=7):
    rng = random.Random(seed)
    words = ["".join(rng.choice(LETTERS.replace(" ", "")) for _ in range(rng.choice([1, 2, 3, 4]))) for _ in range(60)]
    words += [f"{a} {b}" for a, b in zip(words[:20], words[20:40], strict=True)] + ["", "  ", "zzzz", "a zzzz"]
    return spark.createDataFrame(list(enumerate(words)), "query_id int, query string")


def rows(df):
    return sorted(map(str, df.collect()))


def test_search_by_index_equals_search_by_scan(spark, books, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"), buckets=5)
    index.apply("load", search.catalog_texts(books))
    queries = asked(spark)
    for field in ("TITLE", "G", "DATE1"):
        want = []
        for r in queries.collect():
            want += [str(x) for x in search.catalog_search(books, [(r.query_id, r.query)], field, 0).collect()]
        by_index = search.catalog_search(books, queries, field, 0, index)
        assert rows(by_index) == sorted(want) == rows(search.catalog_search(books, queries, field, 0))
    kinds = queries.selectExpr("query_id", "element_at(array('author', 'title', 'general', 'subject'), query_id % 4 + 1) AS kind", "query")
    by_index = search.catalog_search_cascade(books, kinds, 3, index)
    assert rows(by_index) == rows(search.catalog_search_cascade(books, kinds, 3)) != []


def test_update_equals_rebuild(spark, books, tmp_path):
    new = spark.createDataFrame([b for b in made_books(150, 5) if b[1] % 4], BOOKS)
    texts, later = search.catalog_texts(books), search.catalog_texts(new)
    index = PostingIndex(spark, str(tmp_path / "i"), buckets=3)
    assert index.apply("1", texts) and not index.apply("1", later)
    kept = texts.intersect(later)
    assert index.apply("2", later.exceptAll(kept), texts.exceptAll(kept))
    rebuilt = PostingIndex(spark, str(tmp_path / "r"), buckets=3)
    rebuilt.apply("all", later)
    packed = index.compact(str(tmp_path / "c"))
    for other in (rebuilt, packed):
        assert rows(index.frequencies()) == rows(other.frequencies())
        assert rows(index.postings()) == rows(other.postings())
    queries = asked(spark, 9)
    assert rows(search.catalog_search(new, queries, "G", 0, index)) == rows(search.catalog_search(new, queries, "G", 0))


def test_empty_index_and_unfinished_batch(spark, books, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"))
    assert search.catalog_search(books, asked(spark), "G", 0, index).count() == 0
    assert index.apply("none", search.catalog_texts(books.limit(0)))
    assert index.postings().count() == index.frequencies().count() == 0
    # Postings without frequencies are those of a batch that did not end; it counts only when it is applied again.
    index._write(spark.createDataFrame([("G", "abc", "1", 1, 0)], "field string, piece string, id string, sign int, bucket int"), "postings", "torn")
    assert index.batches() == ["none"]
    assert index.apply("torn", search.catalog_texts(books)) and index.batches() == ["none", "torn"]
    assert index.postings().filter("piece = 'abc' AND id = '1' AND field = 'G'").count() <= 1


def test_look_up_reads_only_the_folders_of_the_pieces(spark, books, tmp_path):
    index = PostingIndex(spark, str(tmp_path / "i"), buckets=16)
    index.apply("load", search.catalog_texts(books))
    needle = spark.createDataFrame([(1, "TITLE", ["abc"])], "query_id int, field string, words array<string>")
    found = index.candidates(needle, "words", ["query_id", "field"])
    assert "dynamicpruning" in found._jdf.queryExecution().executedPlan().toString()


def test_the_pieces_of_a_small_file_are_taken_by_many_tasks(spark, tmp_path, monkeypatch):
    texts = spark.range(600).selectExpr("cast(id AS string) AS id", "'G' AS field", "concat('text ', id) AS text").coalesce(1)
    index, tasks = PostingIndex(spark, str(tmp_path / "p")), []
    monkeypatch.setattr(postings, "TEXTS_PER_TASK", 50, raising=False)
    put = index._put
    monkeypatch.setattr(index, "_put", lambda batch, rows: (tasks.append(rows.rdd.getNumPartitions()), put(batch, rows)))
    assert index.apply("load", texts) and tasks == [12]
    assert index.frequencies().filter("piece = 'tex'").first()["n"] == 600
