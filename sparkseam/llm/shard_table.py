"""Sharding by a permutation-filled lookup table.

Every shard walks the slots of a prime-sized table in an order of its own (offset + k * skip, both from a hash of its
name). Shards take turns; on its turn a shard claims the first slot of its order that is still free, until none is.
The table is filled inside the JVM by one fold over the possible probes, bounded by shards x slots and independent of
the data. Rows then meet it by slot = hash(key) mod slots in a broadcast join: slots rows, whatever the input.

Adding or removing a shard moves few slots, and shard shares differ by one slot at most.

Defined results: a null key hashes as the empty string. Repeated rows and ties go to the same shard. An empty table
gives an empty result. Very long keys are hashed whole. All columns of the rows stay; where one has a result column's
name already, the result column gets underscores before its name until that is free. One to 255 shards with distinct
names; more slots than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots, a prime; about a hundred for each shard keep a change of shards cheap.
SLOTS, SHARDS = 2039, 16


def hash60(text: Column) -> Column:
    """60 bits of MD5 as a long: the same number in any SQL engine."""
    return F.conv(F.left(F.md5(text), F.lit(15)), 16, 10).cast("long")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(spark: SparkSession, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """slot, shard for every slot. The state of the fold: owner (one byte a slot, FF is free), next (each shard's probes so far), turn, left."""
    if not is_prime(slots) or not 0 < len(shards) < 256 or len(set(shards)) < len(shards) or slots <= len(shards):
        raise ValueError("a prime number of slots above the number of distinct shards (1 to 255) is needed")
    n = len(shards)
    names = F.array(*[F.lit(s) for s in shards])
    start = spark.range(1).select(
        names.alias("names"), F.transform(names, lambda s: F.pmod(hash60(F.concat(s, F.lit("/offset"))), F.lit(slots)).cast("int")).alias("offset"),
        F.transform(names, lambda s: (F.pmod(hash60(F.concat(s, F.lit("/skip"))), F.lit(slots - 1)) + 1).cast("int")).alias("skip"),
    )
    free = F.unhex(F.lit("FF" * slots))
    state = F.struct(free.alias("owner"), F.array_repeat(F.lit(0), n).alias("next"), F.lit(0).alias("turn"), F.lit(slots).alias("left"))

    def probe(a: Column, _: Column) -> Column:
        k = F.get(a["next"], a["turn"])
        slot = F.pmod(F.get("offset", a["turn"]) + k.cast("long") * F.get("skip", a["turn"]), F.lit(slots)).cast("int")
        open_ = F.substr(a["owner"], slot + 1, F.lit(1)) == F.unhex(F.lit("FF"))
        byte = F.unhex(F.lpad(F.hex(a["turn"]), 2, "0"))
        moved = F.struct(
            F.when(open_, F.overlay(a["owner"], byte, slot + 1, F.lit(1))).otherwise(a["owner"]).alias("owner"),
            F.transform(a["next"], lambda x, i: F.when(i == a["turn"], x + 1).otherwise(x)).alias("next"),
            F.when(open_, F.pmod(a["turn"] + 1, F.lit(n))).otherwise(a["turn"]).alias("turn"),
            F.when(open_, a["left"] - 1).otherwise(a["left"]).alias("left"),
        )
        return F.when(a["left"] > 0, moved).otherwise(a)

    filled = start.select("names", F.aggregate(F.sequence(F.lit(1), F.lit(n * slots)), state, probe, lambda a: F.hex(a["owner"])).alias("owner"))
    return filled.select("names", "owner", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))).alias("slot")).select(
        "slot", F.get("names", F.conv(F.substr("owner", 2 * F.col("slot") + 1, F.lit(2)), 16, 10).cast("int")).alias("shard"))


def free_name(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def place(rows: DataFrame, key: str, shards: list[str], slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """rows with slot_col and shard_col."""
    slot_col = free_name(slot_col, rows.columns)
    shard_col = free_name(shard_col, [*rows.columns, slot_col])
    mine, theirs = free_name("_slot_of_row", rows.columns), free_name("_slot_of_table", rows.columns)
    table = lookup_table(rows.sparkSession, shards, slots).select(F.col("slot").alias(theirs), F.col("shard").alias(shard_col))
    at = F.pmod(hash60(F.coalesce(F.col(key).cast("string"), F.lit(""))), F.lit(slots)).cast("int")
    met = rows.withColumn(mine, at).join(F.broadcast(table), F.col(mine) == F.col(theirs), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.col(mine).alias(slot_col), F.col(shard_col))


def op7_shard_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", [f"shard-{i:03d}" for i in range(SHARDS)])


ORACLE = """
with recursive h as (select i, 'shard-' || lpad(i::varchar, 3, '0') as s from range(16) t(i)),
o as (select i, s, (('0x' || substr(md5(s || '/offset'), 1, 15))::bigint % 2039) as o, (('0x' || substr(md5(s || '/skip'), 1, 15))::bigint % 2038) + 1 as k from h),
c as (select list(o order by i) as o, list(k order by i) as k, list(s order by i) as s from o),
f(turn, nxt, owner, left_) as (select 0, list_transform(range(16), lambda x: 0::bigint), list_transform(range(2039), lambda x: -1), 2039
  union all
  select case when free then (turn + 1) % 16 else turn end, nxt[1 : turn] || [nxt[turn + 1] + 1] || nxt[turn + 2 : ], case when free then owner[1 : slot] || [turn] || owner[slot + 2 : ] else owner end, case when free then left_ - 1 else left_ end
  from (select *, owner[slot + 1] < 0 as free from (select f.*, ((c.o[turn + 1] + nxt[turn + 1] * c.k[turn + 1]) % 2039)::int as slot from f, c where left_ > 0)))
select doc_id, slot, c.s[owner[slot + 1] + 1] as shard from (select doc_id, (('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint % 2039)::int as slot from documents), (select owner from f where left_ = 0), c
"""
