"""Streams with keyed state and exactly-once batches against plain walks over the same rows."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkseam.operators.keyed_table import KeyedTable
from sparkseam.session import folder
from sparkseam.streaming import ingest, stateful, streams

T0 = datetime(2024, 1, 1)
EVENTS = "event_id long, ts timestamp, who string, act string, low boolean"


def events(seed, n):
    rng, at, out = random.Random(seed), T0, []
    for i in range(n):
        at += timedelta(minutes=rng.choice([0, 5, 40, 300]))
        out.append((i, at, rng.choice(["a", "b", None]), rng.choice(["submit", "submit", "approve", "reject", None]), rng.choice([True, False, False, None])))
    return out


def source(spark, rows, files):
    return streams.source(spark, streams.in_order(spark.createDataFrame(rows, EVENTS), "ts", files, "events"), files=1)


def requests_by_hand(rows, life, late):
    out, pending = [], {}
    acts = [r for r in rows if r[3]]
    mark = max(r[1] for r in acts) - late
    for i, at, who, act, low in sorted(acts, key=lambda r: (r[1], r[0])):
        if who in pending and at > pending[who][1] + life:
            first = pending.pop(who)
            out.append((who, first[0], "expired", first[1] + life))
        if act == "submit" and low:
            out.append((who, i, "auto_approved", at))
        elif act == "submit":
            if who in pending:
                out.append((who, pending.pop(who)[0], "superseded", at))
            pending[who] = (i, at)
        elif who in pending:
            out.append((who, pending.pop(who)[0], {"approve": "approved", "reject": "rejected"}[act], at))
    out += [(who, i, "expired", at + life) for who, (i, at) in pending.items() if at + life < mark]
    return sorted(out, key=str)


@pytest.mark.parametrize("files", [1, 4])
def test_approvals_follow_a_walk(spark, files):
    rows = events(4, 300)
    quiet = [(900, T0, "quiet", "submit", False), (901, T0 + timedelta(days=1), "quiet", "approve", False)]  # a timer alone ends the first
    stream = stateful.approvals(source(spark, rows + quiet, files), "who", F.col("act"), F.col("low"), "4 hours", "1 hour")
    got = [(r["who"], r["request"], r["status"], r["decided"]) for r in streams.drain(stream, "approvals").collect()]
    assert sorted(got, key=str) == requests_by_hand(rows + quiet, timedelta(hours=4), timedelta(hours=1))
    assert {g[2] for g in got} == {"expired", "auto_approved", "superseded", "approved", "rejected"}


def lookups_by_hand(rows, life):
    stored, out = {}, {}
    for i, at, who, act, _ in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (who, act)
        if key in stored and at - stored[key] < life:
            out[i] = "hit"
        else:
            out[i], stored[key] = "expired" if key in stored else "miss", at
    return out


@pytest.mark.parametrize("files", [1, 5])
def test_lookups_follow_a_walk(spark, files):
    rows = events(9, 150)
    stream = stateful.lookups(source(spark, rows, files), ["who", "act"], "5 hours", "1 hour")
    got = {r["event_id"]: r["outcome"] for r in streams.drain(stream, "lookups").collect()}
    assert got == lookups_by_hand(rows, timedelta(hours=5)) and Counter(got.values()).keys() == {"hit", "miss", "expired"}


def test_rows_behind_the_watermark_do_nothing(spark):
    early = [(1, T0 + timedelta(days=9), "a", "submit", False), (2, T0 + timedelta(days=10), "b", "submit", False)]
    path = folder(spark, "late")
    for rows in (early, [(3, T0, "a", "approve", False), (4, T0 + timedelta(days=9, hours=1), "a", "approve", False)]):
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(path)
    stream = stateful.approvals(streams.source(spark, path, files=1), "who", F.col("act"), F.col("low"), "9 days", "2 days")
    assert [(r["request"], r["decided"]) for r in streams.drain(stream, "late").collect()] == [(1, T0 + timedelta(days=9, hours=1))]


@pytest.mark.parametrize("lost_at", ["/0", "/2"])
def test_a_batch_that_comes_again_counts_once(spark, lost_at):
    texts = [random.Random(1).choice(["x", "y", "z", None]) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = streams.source(spark, streams.in_order(docs, "doc_id", 3, "texts"), files=1)
    schema = spark.createDataFrame([], "content_hash string, n long").schema
    table, state, lost = KeyedTable(spark, folder(spark, "t"), "content_hash", schema, buckets=2), folder(spark, "state"), []

    def once(batch, name):
        table.accumulate(batch, name)
        if name.endswith(lost_at) and not lost:
            lost.append(name)
            raise ConnectionError("lost")

    hashes = rows.select(F.coalesce("text", F.lit("")).alias("content_hash"), F.lit(1).cast("long").alias("n"))
    with pytest.raises(Exception, match="lost"):
        ingest.merge(hashes, "s", state, once)
    ingest.merge(hashes, "s", state, once)
    assert {r["content_hash"]: r["n"] for r in table.read().collect()} == Counter(t or "" for t in texts)
    assert sorted(table.batches()) == ["s/0", "s/1", "s/2"]


def test_complete_mode_keeps_the_last_table(spark):
    rows = events(2, 40)
    stream = source(spark, rows, 3).groupBy("who").agg(F.count(F.lit(1)).alias("n"))
    assert {r["who"]: r["n"] for r in streams.drain(stream, "complete", "complete").collect()} == Counter(r[2] for r in rows)


def test_a_file_in_order_is_read_by_many_tasks(spark):
    rows = spark.range(0, 1000, 1, 4).withColumn("task", F.spark_partition_id())
    back = spark.read.parquet(streams.in_order(rows, "id", 2, "tasks"))
    assert len(back.inputFiles()) == 2 and back.count() == 1000 and back.select("task").distinct().count() == 4


def test_keys_share_calls_and_nulls_keep_numbers_whole(spark):
    """A bucket is one call for many keys; beside a null, large whole numbers stay as they are."""
    big = 2**60 + 1
    rows = [(big + i, T0 + timedelta(hours=i), None if i % 3 == 0 else big + i % 2, "x") for i in range(12)]
    path = streams.in_order(spark.createDataFrame(rows, "event_id long, ts timestamp, user long, kind string"), "ts", 2, "nulls")
    out = streams.drain(stateful.lookups(streams.source(spark, path, files=1), ["user", "kind"], "4 hours", "1 day", buckets=1), "nulls")
    assert {(r["user"], r["event_id"]) for r in out.collect()} == {(r[2], r[0]) for r in rows}
    assert Counter(r["outcome"] for r in out.collect())["miss"] == 3


def test_batches_in_order_are_written_by_several_tasks(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 20)
    rows = spark.range(200).selectExpr("id % 7 as who", "if(id < 190, 0, id) as at", "id")  # ranges without rows
    seen = []
    stream = streams.ordered(rows, "at", 4, "several")
    query = stream.writeStream.foreachBatch(lambda b, n: seen.append([r["at"] for r in b.select("at").collect()])).trigger(availableNow=True)
    query.option("checkpointLocation", streams.folder(spark, "several")).start().awaitTermination()
    assert sorted(x for b in seen for x in b) == [0] * 190 + list(range(190, 200))
    full = [b for b in seen if b]
    assert all(max(a) <= min(b) for a, b in zip(full, full[1:])) and len(seen) <= 4
    path = streams.in_order(spark.range(200).toDF("id"), "id", 4, "files", 2)
    assert spark.read.parquet(path).selectExpr("input_file_name() as f").distinct().count() == 8 and spark.read.parquet(path).count() == 200
