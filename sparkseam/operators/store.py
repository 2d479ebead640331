"""A chunk store on Parquet: incremental ingest, hash dedup, keyed upsert, delete, lookups, persistence."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType

from sparkseam.functions.text import term_counts
from sparkseam.operators.ranges import hash_numbers, row_numbers

# Columns that a metadata filter may name.
FILTER_KEYS = ("file_path", "file_type", "resource_type", "cloud_provider", "repo")


def content_hash(text: str):
    return F.sha2(F.coalesce(F.col(text), F.lit("")), 256)


def changed(files: DataFrame, registry: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    """Files whose (path, hash) the registry lacks."""
    rows = files.withColumn("content_hash", content_hash(text))
    return rows.join(registry.select(path, "content_hash"), [path, "content_hash"], "left_anti")


def registry_of(files: DataFrame, path: str = "file_path", text: str = "content") -> DataFrame:
    return files.select(path, content_hash(text).alias("content_hash"))


def first_of_each(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row for each value of keys: the first (or last) in an order; of equals the one that is read first.

    Rows are reduced before the shuffle, so a hot key is no hot task.
    """
    read = F.monotonically_increasing_id()
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("at"), (-read if last else read).alias("read"))
    pick = F.max_by if last else F.min_by
    best = rows.select("*", place.alias("_place")).groupBy(*keys).agg(pick(F.struct(*rows.columns), "_place").alias("_best"))
    return best.select(*[F.col("_best")[c].alias(c) for c in rows.columns])


def insert_new(store: DataFrame, batch: DataFrame, order: str, text: str = "text", dedup: bool = True) -> DataFrame:
    """Rows of batch whose text hash is new to the store and first in the batch, with ids from the store's largest on."""
    rows = batch.withColumn("content_hash", content_hash(text))
    if dedup:
        rows = rows.join(store.select("content_hash").distinct(), "content_hash", "left_anti")
        rows = first_of_each(rows, ["content_hash"], order)
    return numbered(rows, order, next_id(store))


def numbered(rows: DataFrame, order: str, first: DataFrame, name: str = "index_id") -> DataFrame:
    """rows with dense ids in the order of a column, beginning at first (one row, next_id)."""
    out = row_numbers(rows, [F.col(order)], "_number").crossJoin(F.broadcast(first))
    return out.withColumn(name, (F.col("next_id") + F.col("_number") - 1).cast("long")).drop("_number", "next_id")


def numbered_by_hash(rows: DataFrame, order: str, first: DataFrame, name: str = "index_id") -> DataFrame:
    """The same where the column is a 64-bit hash: its leading bits are the ranges, so rows are moved once and written by nobody."""
    out = hash_numbers(rows, order, "_number").crossJoin(F.broadcast(first))
    return out.withColumn(name, (F.col("next_id") + F.col("_number") - 1).cast("long")).drop("_number", "next_id")


def upsert(store: DataFrame, batch: DataFrame, key: str, order: str) -> DataFrame:
    """store with the last batch row of each key in place of its own."""
    last = first_of_each(batch, [key], order, last=True).drop(order)
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def delete(store: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return store.join(keys.select(key).distinct(), key, "left_anti")


def deleted(store: DataFrame, keys: DataFrame, key: str, id_col: str = "index_id") -> DataFrame:
    """The ids that delete() frees; their count is how many rows it removes."""
    return store.join(keys.select(key).distinct(), key, "left_semi").select(id_col)


def replace(store: DataFrame, batch: DataFrame, key: str, order: str, text: str = "text") -> DataFrame:
    """Delete by key, then insert what is new by hash."""
    rest = delete(store, batch, key)
    new = insert_new(rest, batch, order, text)
    return rest.unionByName(new.select(*rest.columns))


def next_id(store: DataFrame, name: str = "index_id") -> DataFrame:
    return store.agg(F.coalesce(F.max(name) + 1, F.lit(0)).cast("long").alias("next_id"))


def metadata_filter(rows: DataFrame, where: dict, ids: list | None = None, id_col: str = "index_id", keys: tuple[str, ...] = FILTER_KEYS) -> DataFrame:
    """Equalities on known keys, all at once; unknown keys are ignored."""
    for name, value in where.items():
        if name in keys:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows if ids is None else rows.filter(F.col(id_col).isin(ids))


def exists_by_hash(rows: DataFrame, store: DataFrame, text: str = "text") -> DataFrame:
    """rows with `present`: whether the store holds their text."""
    known = store.select("content_hash").distinct().withColumn("_p", F.lit(True))
    return rows.withColumn("content_hash", content_hash(text)).join(known, "content_hash", "left").withColumn("present", F.coalesce("_p",
        F.lit(False))).drop("_p")


def chunk_view(store: DataFrame) -> DataFrame:
    """Metadata JSON as columns; text that isn't JSON counts as empty."""
    meta = F.from_json("metadata_json", "map<string,string>")
    return store.withColumn("metadata", F.coalesce(meta, F.expr("map()").cast("map<string,string>"))).drop("metadata_json")


def legacy_rows(texts: DataFrame, schema: str, text: str = "value", name: str = "index_id") -> DataFrame:
    """Rows of stores that were kept as one JSON array: their place in it, from 0, is their id. texts: one array for each row.

    Pickled stores aren't read: loading one runs whatever code it holds.
    """
    rest = [c for c in texts.columns if c != text]
    each = texts.select(*rest, F.posexplode(F.from_json(text, f"array<struct<{schema}>>")).alias(name, "_row"))
    return each.select(*rest, F.col(name).cast("long").alias(name), "_row.*")


def save(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str, dimension: int | None = None, vector: str = "embedding") -> DataFrame:
    """The store at path; refused if its vectors have another dimension."""
    store = spark.read.parquet(path)
    if dimension is not None and vector in store.columns:
        other = store.filter(F.size(vector) != dimension).limit(1).count()
        if other:
            raise ValueError(f"the stored vectors don't have {dimension} dimensions")
    return store


def reconcile(spark: SparkSession, store_path: str, registry_path: str) -> bool:
    """Whether both parts of the state exist. If only one does, both are removed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = []
    for p in (store_path, registry_path):
        path = jvm.org.apache.hadoop.fs.Path(p)
        there.append((path.getFileSystem(conf), path))
    found = [fs.exists(p) for fs, p in there]
    if any(found) and not all(found):
        for fs, p in there:
            fs.delete(p, True)
    return all(found)


def hashed(counts: Column, dimension: int) -> Column:
    """The vector of a text by its term_counts: terms hashed into signed buckets, at length one; zeros for a text without terms."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hashes, tf in batches:
            h, n = hashes.flatten().to_numpy(), len(hashes)
            at = pc.list_parent_indices(hashes).to_numpy() * dimension + h % dimension
            sums = np.bincount(at, np.where(h < 0, -1.0, 1.0) * tf.flatten().to_numpy(), n * dimension).reshape(n, dimension)
            unit = (sums / np.maximum(np.sqrt((sums * sums).sum(1, keepdims=True)), 1e-10)).astype(np.float32)
            yield pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * dimension, pa.array(unit.ravel()))

    return F.arrow_udf(run, "array<float>", ArrowUDFType.SCALAR_ITER)(F.transform(counts["terms"], lambda t: F.xxhash64(t)), counts["tf"])


def embed(rows: DataFrame, dimension: int = 64, text: str = "text", encoder: Callable | None = None, known: DataFrame | None = None) -> DataFrame:
    """rows with `embedding`.

    The default encoder works in each row, so no text is moved for it. encoder: Arrow batches of (content_hash, text) to batches of
    (content_hash, embedding); each distinct text is encoded once, and not at all if `known` (content_hash, embedding) has it.
    """
    keyed = rows.withColumn("content_hash", content_hash(text))
    if not encoder:
        return keyed.withColumn("_counts", term_counts(F.col(text))).withColumn("embedding", hashed(F.col("_counts"), dimension)).drop("_counts")
    distinct = keyed.select("content_hash", text).dropDuplicates(["content_hash"])
    if known is not None:
        distinct = distinct.join(known.select("content_hash"), "content_hash", "left_anti")
    coded = distinct.mapInArrow(encoder, "content_hash string, embedding array<float>")
    if known is not None:
        coded = coded.unionByName(known.select("content_hash", "embedding").dropDuplicates(["content_hash"]))
    return keyed.join(coded, "content_hash")
