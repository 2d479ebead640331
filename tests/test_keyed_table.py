"""The bucketed keyed table: what a change rewrites, versions, replayed batches and conflicts."""

import random

import pytest

from sparkseam.operators.keyed_table import Conflict, KeyedTable
from sparkseam.session import folder


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, v string")


def table_of(spark, rows, **args):
    table = KeyedTable(spark, folder(spark, "keyed"), "k", frame(spark, []).schema, **args)
    table.upsert(frame(spark, rows))
    return table


def held(table, *args, **named):
    return sorted(map(tuple, table.read(*args, **named).collect()))


def paths(table, version=None):
    return {r["path"] for r in table.manifest(version).filter("path is not null").collect()}


def test_an_upsert_rewrites_only_the_files_it_touches(spark):
    table = table_of(spark, [(i, f"a{i}") for i in range(-500, 1500)], buckets=4, file_rows=100)
    first = paths(table)
    assert len(first) >= 20
    assert table.upsert(frame(spark, [(7, "new"), (7, "newer"), (99_999, "far")])) == 2
    second = paths(table)
    assert len(first - second) == 1 and len(second - first) <= 3  # key 7's file again, and the new key's
    assert held(table) == sorted([(i, f"a{i}") for i in range(-500, 1500) if i != 7] + [(7, "newer"), (99_999, "far")])
    assert held(table, 1) == [(i, f"a{i}") for i in range(-500, 1500)]
    assert held(table, keys=[7, -3, 123_456]) == [(-3, "a-3"), (7, "newer")]


def test_random_changes_equal_a_dictionary(spark):
    rng, want = random.Random(3), {}
    table = KeyedTable(spark, folder(spark, "keyed"), "k", frame(spark, []).schema, buckets=3, file_rows=20)
    for turn in range(5):
        batch = [(rng.randrange(-60, 60), f"{turn}-{n}") for n in range(40)]
        table.upsert(spark.createDataFrame([(*r, n) for n, r in enumerate(batch)], "k long, v string, n int").repartition(3), order="n")
        want.update(batch)
        gone = [(rng.randrange(-60, 60), "") for _ in range(10)]
        table.delete(frame(spark, gone))
        for k, _ in gone:
            want.pop(k, None)
        assert held(table) == sorted(want.items())
    before = table.version()
    assert table.delete(frame(spark, [(1000, "")])) == before  # nothing to do, no version


def test_a_replayed_batch_counts_once(spark):
    table = table_of(spark, [(1, "a")])
    assert table.upsert(frame(spark, [(1, "b")]), name="7") == 2
    assert table.upsert(frame(spark, [(1, "c")]), name="7") == 2 and held(table) == [(1, "b")]
    assert table.upsert(frame(spark, []), name="8") == 3 and table.batches() and set(table.batches()) == {"7", "8"}


def test_of_two_changes_from_one_version_the_later_is_refused(spark):
    table = table_of(spark, [(1, "a"), (2, "b")])
    other = KeyedTable(spark, table.folder, "k", table.schema)
    real = other._write

    def late(rows, version):
        out = real(rows, version)
        table.upsert(frame(spark, [(2, "first")]))
        return out

    other._write = late
    with pytest.raises(Conflict):
        other.upsert(frame(spark, [(2, "second")]))
    assert held(table) == [(1, "a"), (2, "first")]


def test_files_without_a_manifest_count_for_nothing_and_are_removed(spark):
    table = table_of(spark, [(1, "a"), (2, "b")])
    broken = KeyedTable(spark, table.folder, "k", table.schema)
    broken._publish = lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        broken.upsert(frame(spark, [(1, "z")]))
    assert held(table) == [(1, "a"), (2, "b")]
    table.upsert(frame(spark, [(3, "c")]))
    assert table.remove_old() >= 1 and held(table) == [(1, "a"), (2, "b"), (3, "c")] and table.versions() == [2]
    assert table.remove_old() == 0
    table.upsert(frame(spark, [(4, "d")]))
    assert table.version() == 3 and len(held(table)) == 4


def test_string_keys_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([("é", 1), ("", 2), ("b", None)], "k string, n int")
    table = KeyedTable(spark, folder(spark, "keyed"), "k", rows.schema, buckets=2)
    assert held(table) == [] and table.version() == 0
    table.upsert(rows)
    table.upsert(spark.createDataFrame([("b", 5)], "k string, n int"))
    assert held(table) == [("", 2), ("b", 5), ("é", 1)]
    with pytest.raises(ValueError):
        table.upsert(spark.createDataFrame([(None, 5)], "k string, n int"))
