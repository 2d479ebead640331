"""Terms counted by tables of bytes, vectors and numbers made where the texts are: against the plain ways."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkseam.functions.text import alnum_tokens, term_counts, terms
from sparkseam.operators import chunking, keyword_index, ranges, store
from sparkseam.operators.keyword_index import KeywordIndex
from sparkseam.session import folder

TEXTS = [None, "", " ", "a", "ab", "ab\x00cd a.b/c", "AB ab Ab.", "été ÉTÉ naïve straße İstanbul Σσς", "x" * 5000, "tail", "head tail", ".. // ..", "\U0001f600ab\U0001f600", "…", "cd"]


def plan(rows):
    return rows._jdf.queryExecution().executedPlan().toString()


def test_terms_are_counted_as_terms_splits_them(spark, monkeypatch):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").coalesce(1)
    for way in (terms, alnum_tokens):
        counts = term_counts(F.col("text"), way)
        for r in rows.select("id", way(F.col("text")).alias("all"), counts.alias("c")).collect():
            assert dict(zip(r["c"]["terms"], r["c"]["tf"], strict=True)) == Counter(r["all"]), TEXTS[r["id"]]


def test_embedding_and_chunking_of_plain_texts_move_nothing(spark):
    """The vector of a text is made in its row, and a file without blocks isn't dealt to Python."""
    files = spark.createDataFrame([(f"f{i}", "text" if i % 3 else None, t) for i, t in enumerate(TEXTS)], "file_path string, file_type string, content string")
    assert "Exchange" not in plan(store.embed(files, text="content"))
    chunks = chunking.structured_chunks(files, 10, 2)
    assert "MapInPandas" not in plan(chunks)
    assert {(r["file_path"], r["text"]) for r in chunks.collect()} == {(f"f{i}", t) for i, t in enumerate(TEXTS) if t}


def test_numbers_by_the_bits_of_a_hash(spark):
    rows = spark.range(5000).select("id", F.xxhash64("id").alias("ord"))
    got = [r["id"] for r in ranges.hash_numbers(rows, "ord", "n").orderBy("n").collect()]
    assert got == [r["id"] for r in rows.orderBy("ord").collect()]
    assert {r["n"] for r in ranges.hash_numbers(rows, "ord", "n").collect()} == set(range(1, 5001))


def test_sync_by_hash_reads_only_texts_that_are_new(spark):
    index = KeywordIndex(spark, folder(spark, "kw"))
    state = lambda *rows: spark.createDataFrame(rows, "id long, hash string")
    texts = lambda *rows: spark.createDataFrame(rows, "id long, text string")
    assert index.sync(state((1, "o"), (2, "e")), "id", "text", "hash", texts((1, "oak oak"), (2, "elm"), (9, "another's")))
    assert not index.sync(state((2, "e"), (1, "o")), "id", "text", "hash", texts())
    assert index.sync(state((1, "o"), (3, "f")), "id", "text", "hash", texts((3, "fir")))
    assert {(r["term"], r["df"]) for r in index.df().collect()} == {("oak", 1), ("fir", 1)} and index.totals() == (2, 3)


@pytest.mark.parametrize("most", [0, 100])
def test_terms_of_replaced_documents_are_taken_off(spark, monkeypatch, most):
    """Few ids find their lists by a broadcast, many by their blocks."""
    monkeypatch.setattr(keyword_index, "BROADCAST_IDS", most)
    index = KeywordIndex(spark, folder(spark, "kw"))
    texts = lambda *rows: spark.createDataFrame(rows, "id long, text string")
    index.add(texts((1, "oak elm"), (2, "oak oak"), (3, "fir")), "id", "text")
    index.add(texts((1, "elm ash"), (3, None)), "id", "text")
    index.add(texts((1, "yew")), "id", "text")
    assert {(r["term"], r["df"]) for r in index.df().collect()} == {("oak", 1), ("yew", 1)} and index.totals() == (3, 3)
