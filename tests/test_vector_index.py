"""The pruned vector index against a scan of all vectors."""

import numpy as np
import pytest

from sparkseam.operators.vector_index import VectorIndex, bounds, centres, units
from sparkseam.session import folder


def made(seed, n, groups, spread, dim=16):
    rng = np.random.default_rng(seed)
    heads = rng.normal(size=(groups, dim))
    return heads[rng.integers(groups, size=n)] + spread * rng.normal(size=(n, dim))


def frame(spark, vectors, first=0):
    return spark.createDataFrame([(i + first, [float(x) for x in v], i % 3) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, label int")


def scanned(vectors, query, k, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    scores = np.round(units(np.array(vectors, dtype=float)) @ units(np.array([query], dtype=float))[0], 6)
    return sorted(((-s, i) for s, i in zip(scores, ids)))[:k]


def got(rows):
    return [(-r["score"], r["vec_id"]) for r in sorted(rows, key=lambda r: r["rank"])]


@pytest.mark.parametrize("spread", [0.05, 0.5, 5.0])
def test_bounds_hold_for_every_member(spread):
    unit = units(made(1, 400, 12, spread))
    pivots = centres(unit, 20)
    own = (unit @ pivots.T).argmax(axis=1)
    dots = np.einsum("ij,ij->i", unit, pivots[own])
    cells = np.unique(own)
    least, largest = (np.array([f(dots[own == c]) for c in cells]) for f in (np.min, np.max))
    bound = bounds(unit[:50], pivots[cells], least, largest)
    for at, c in enumerate(cells):
        assert ((unit[:50] @ unit[own == c].T).max(axis=1) <= bound[:, at]).all()


def test_single_queries_equal_a_scan_and_read_few_cells(spark):
    vectors = made(2, 1500, 30, 0.1)
    index = VectorIndex(spark, folder(spark, "vectors"))
    index.build(frame(spark, vectors))
    cells = len(index.cells()[0])
    shares = []
    for at in (0, 7, 700):
        assert got(index.topk(vectors[at].tolist(), 8).collect()) == scanned(vectors, vectors[at], 8)
        shares.append(len(index.reached(vectors[at].tolist(), 8)) / cells)
    assert max(shares) < 0.25, shares
    # without groups the bounds help little, and the rows are right all the same
    loose = made(3, 300, 1, 50.0)
    index.build(frame(spark, loose))
    assert got(index.topk(loose[5].tolist(), 8).collect()) == scanned(loose, loose[5], 8)


def test_a_filter_that_few_rows_pass(spark):
    vectors = made(4, 400, 10, 0.1)
    index = VectorIndex(spark, folder(spark, "vectors"))
    index.build(frame(spark, vectors))
    own = [i for i in range(400) if i % 3 == 2]
    assert got(index.topk(vectors[0].tolist(), 150, {"label": 2}).collect()) == scanned([vectors[i] for i in own], vectors[0], 150, own)
    assert index.topk(vectors[0].tolist(), 5, {"label": 9}).count() == 0


def test_batches_equal_a_scan(spark):
    vectors = made(5, 900, 20, 0.1)
    vectors[100:400] = vectors[100]  # one cell with a third of all rows, all tied
    index, rows = VectorIndex(spark, folder(spark, "vectors")), frame(spark, vectors)
    index.build(rows)
    found = index.batch_topk(rows.filter("vec_id % 9 = 0"), 4).collect()
    for q in range(0, 900, 9):
        assert got([r for r in found if r["query_id"] == q]) == scanned(vectors, vectors[q], 4)


def test_changes_equal_a_rebuild(spark):
    vectors, later = made(6, 300, 6, 0.2), made(7, 200, 6, 0.4)
    index = VectorIndex(spark, folder(spark, "vectors"))
    index.build(frame(spark, vectors))
    index.add(frame(spark, later, first=200))  # 200 to 299 anew, 300 to 399 new
    index.remove(frame(spark, later, first=350))
    index.add(frame(spark, vectors[:10], first=390))
    ids = [*range(350), *range(390, 400)]
    live = [*vectors[:200], *later[:150], *vectors[:10]]
    for q in (vectors[3], later[120], later[170], vectors[250]):
        assert got(index.topk(q.tolist(), 6).collect()) == scanned(live, q, 6, ids)
    found = index.batch_topk(frame(spark, live[:60]), 300).collect()
    assert got([r for r in found if r["query_id"] == 7]) == scanned(live, live[7], 300, ids)


def test_nulls_zero_vectors_and_no_rows(spark):
    index = VectorIndex(spark, folder(spark, "vectors"))
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (None, [1.0, 1.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    index.build(rows.limit(0))
    assert index.reached([1.0, 0.0], 3) == [] and index.batch_topk(rows, 2).count() == 0
    index.add(rows)
    assert got(index.topk([2.0, 0.0], 5).collect()) == [(-1.0, 1), (-1.0, 4), (0.0, 3)]
    assert {r["query_id"] for r in index.batch_topk(rows, 2).collect()} == {1, 3, 4}


def test_a_segment_without_its_cells_counts_for_nothing(spark):
    """An add that broke off before its last step is as if it hadn't begun."""
    index = VectorIndex(spark, folder(spark, "vectors"))
    vectors = made(8, 60, 4, 0.2)
    index.build(frame(spark, vectors))
    index._cells = lambda *_: None
    index.add(frame(spark, vectors, first=100))
    again = VectorIndex(spark, index.folder)
    assert got(again.topk(vectors[0].tolist(), 60).collect()) == scanned(vectors, vectors[0], 60)
