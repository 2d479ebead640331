"""The stored keyword index: searches with block bounds, and statistics that follow changes, against scans of the texts."""

import random

import pytest
from pyspark.sql import functions as F

from sparkseam.operators import keyword_index, search
from sparkseam.operators.keyword_index import KeywordIndex
from sparkseam.session import folder

ASKED = ["oak", "elm", "fir", "oak", "nowhere"]


def made(seed, n, first=0):
    """Most texts are long with few query terms; a few short ones are full of them."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = rng.choices(["ash", "box", "yew", "oak", "elm", "fir"], weights=[20, 20, 20, 0.2, 0.15, 0.1], k=rng.randint(1, 60))
        if rng.random() < 0.05:
            words = rng.choices(["oak", "elm", "fir"], k=rng.randint(1, 8))
        out.append((first + i, " ".join(words)))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def top(rows, k):
    best = sorted(((-round(r["score"], 6), r["id"]) for r in rows.collect()))[:k]
    return [b for b in best if b[0] < 0]


def same(rows, digits=9):
    return {r["id"]: round(r["score"], digits) for r in rows.collect()}


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(keyword_index, "BLOCK", 8)


def test_bounded_search_equals_a_scan_and_scores_few_blocks(spark, small_blocks):
    rows = frame(spark, made(1, 600))
    index = KeywordIndex(spark, folder(spark, "kw"))
    index.add(rows, "id", "text")
    for k in (1, 10, 1000):
        assert top(index.bm25_topk(ASKED, k, first=2), k) == top(search.bm25(rows, ASKED, "id", "text"), k)
        if k == 10:
            scored, all_ = index.scored_blocks
            assert all_ > 50 and scored < 0.5 * all_, (scored, all_)
    assert index.bm25_topk(["nowhere"], 5).count() == 0


def test_scores_where_every_document_holds_a_term(spark, small_blocks):
    """The least score is then no longer 0, and the scale begins at it."""
    rows = frame(spark, [(i, "oak " * (i % 5 + 1) + "ash " * (i % 7)) for i in range(60)])
    index = KeywordIndex(spark, folder(spark, "kw"))
    index.add(rows, "id", "text")
    assert top(index.bm25_topk(["oak"], 7), 7) == top(search.bm25(rows, ["oak"], "id", "text"), 7)
    index.add(frame(spark, [(99, "ash")]), "id", "text")
    more = rows.unionByName(frame(spark, [(99, "ash")]))
    assert top(index.bm25_topk(["oak"], 7), 7) == top(search.bm25(more, ["oak"], "id", "text"), 7)


def test_one_document_without_a_term_among_many_with_two(spark):
    """Sums of document frequencies prove nothing here, so documents are counted."""
    rows = frame(spark, [(i, "oak elm " * (i % 4 + 1)) for i in range(40)] + [(50, "ash ash ash")])
    index = KeywordIndex(spark, folder(spark, "kw"))
    index.add(rows, "id", "text")
    assert top(index.bm25_topk(["oak", "elm"], 7), 7) == top(search.bm25(rows, ["oak", "elm"], "id", "text"), 7)


@pytest.mark.parametrize("norms", [False, True])
def test_changes_equal_a_rebuild(spark, small_blocks, norms):
    before, after = dict(made(2, 120)), dict(made(3, 120, first=80))
    index = KeywordIndex(spark, folder(spark, "kw"), norms=norms)
    index.add(frame(spark, list(before.items())), "id", "text")
    index.add(frame(spark, list(after.items())), "id", "text")  # 80 to 119 anew
    index.remove(frame(spark, [(i, "") for i in [*range(0, 30), *range(150, 170), 7777]]), "id")
    index.add(frame(spark, [(5, "fir fir rare"), (6, None), (160, "")]), "id", "text")
    live = {i: t for i, t in {**before, **after}.items() if not (i < 30 or 150 <= i < 170)} | {5: "fir fir rare", 6: None, 160: ""}
    rows = frame(spark, list(live.items()))
    fresh = KeywordIndex(spark, folder(spark, "kw"), norms=norms)
    fresh.add(rows, "id", "text")
    assert index.totals() == fresh.totals() == (len(live), sum(len((t or "").split()) for t in live.values()))
    assert sorted(index.df().collect()) == sorted(fresh.df().collect())
    if norms:
        asked = "oak fir fir rare nowhere"
        want = same(search.tfidf(rows, asked, "id", "text"), 8)
        assert same(index.tfidf(asked), 8) == want == same(fresh.tfidf(asked), 8)
    else:
        assert same(index.bm25(ASKED)) == same(search.bm25(rows, ASKED, "id", "text"))
        assert top(index.bm25_topk(ASKED, 9), 9) == top(search.bm25(rows, ASKED, "id", "text"), 9)


def test_sync_sees_a_changed_text_and_touches_no_other(spark):
    index = KeywordIndex(spark, folder(spark, "kw"))
    one, two = [(1, "oak"), (2, "elm"), (3, None)], [(1, "oak"), (2, "fir"), (4, "ash")]
    assert index.sync(frame(spark, one), "id", "text") and not index.sync(frame(spark, one), "id", "text")
    assert index.sync(frame(spark, two), "id", "text") and not index.sync(frame(spark, two), "id", "text")
    assert index.bm25(["elm"]).count() == 0 and index.bm25(["fir"]).count() == 1
    assert {(r["id"], r["segment"]) for r in index.docs().collect()} == {(1, 0), (2, 1), (4, 1)}
    assert index.sync(frame(spark, []), "id", "text") and index.docs().count() == 0


def test_refusals_and_changes_that_broke_off(spark):
    index = KeywordIndex(spark, folder(spark, "kw"))
    with pytest.raises(ValueError):
        index.add(frame(spark, [(1, "a b"), (1, "c d")]), "id", "text")
    with pytest.raises(ValueError):
        index.tfidf("oak")
    index.add(frame(spark, [(1, "oak elm"), (None, "oak")]), "id", "text")
    broken = KeywordIndex(spark, index.folder)
    real = broken._write

    def stops(rows, name, segment):
        real(rows, name, segment)
        if name == "docs":
            raise RuntimeError("lost")

    broken._write = stops
    with pytest.raises(RuntimeError):
        broken.add(frame(spark, [(2, "oak")]), "id", "text")
    again = KeywordIndex(spark, index.folder)
    assert same(again.bm25(["oak"])).keys() == {1}
    again.add(frame(spark, [(3, "oak")]), "id", "text")
    assert same(again.bm25(["oak"])).keys() == {1, 3} and again.totals() == (2, 3)


def test_a_block_is_listed_where_its_documents_are(spark, small_blocks):
    """No list is put together from several tasks: all of a block's lie in one file, sorted by term."""
    index = KeywordIndex(spark, folder(spark, "kw"))
    index.add(frame(spark, made(5, 200)), "id", "text")
    rows = index.blocks().withColumn("file", F.input_file_name()).collect()
    where = {}
    for r in rows:
        where.setdefault(r["block"], set()).add(r["file"])
    assert len(where) == 25 and all(len(files) == 1 for files in where.values())
    assert sum(r["df"] for r in rows) == sum(len(set(t.split())) for _, t in made(5, 200))
