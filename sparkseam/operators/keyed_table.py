"""A keyed table in buckets with versions: an upsert rewrites only the files whose rows it changes.

Rows are dealt by the hash of their key into `buckets` (fixed when the table is made), and each bucket's rows lie in
files of at most FILE_ROWS rows, sorted by key. A version is a manifest, one row for each file: bucket, path, least and
largest key, rows, and the version that wrote it. A change meets the manifest before it meets any data: a file is
touched only if one of the batch's keys of its bucket lies in its range; untouched files are named again as they are.
What is touched is read, merged with the batch (one join on bucket and key, so no bucket is one task's work) and
written as new files of the next version.

A manifest is written aside and renamed to its number, so a version is there as a whole or not at all, and of two
changes that began from one version the later to publish is refused. Each manifest carries the batch that made it: a
batch whose name is in the history already does nothing, so a replayed batch counts once. Old versions can be read
until remove_old().

In a batch the last row of a key in the given order counts; of rows that are equal in it, the one read first (without
an order: the one read last). Null keys are refused. Deleting a key that isn't there does nothing, and a change that
touches nothing makes no version unless its batch is named.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sparkseam.operators.store import first_of_each
from sparkseam.session import exists, materialise, remove

#: Rows in a file, about.
FILE_ROWS = 100_000
_MANIFEST = "bucket int, path string, least string, largest string, rows long, written int, batch string"


class Conflict(RuntimeError):
    """Another change was published since this one began."""


class KeyedTable:
    """A table with one row for each key in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str, key: str, schema: StructType, buckets: int = 16, file_rows: int = FILE_ROWS):
        self.spark, self.folder, self.key, self.schema, self.buckets, self.file_rows = spark, folder.rstrip("/"), key, schema, buckets, file_rows

    # ---- versions

    def versions(self) -> list[int]:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(p) if x.getPath().getName().isdigit()) if fs.exists(p) else []

    def version(self) -> int:
        return (self.versions() or [0])[-1]

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row for each file of a version, and one without a path that names the version's batch."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], _MANIFEST)
        return self.spark.read.schema(_MANIFEST).parquet(f"{self.folder}/manifest/{version}")

    def batches(self) -> list[str]:
        """Names of the batches of all versions there are; one row for each version."""
        paths = [f"{self.folder}/manifest/{v}" for v in self.versions()]
        rows = self.spark.read.schema(_MANIFEST).parquet(*paths).filter("path is null and batch is not null") if paths else None
        return [] if rows is None else [r[0] for r in rows.select("batch").distinct().collect()]

    def _publish(self, files: DataFrame, version: int, batch: str | None) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        aside, final = f"{self.folder}/aside-{uuid.uuid4().hex}", f"{self.folder}/manifest/{version}"
        named = self.spark.range(1).select(*[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in _MANIFEST.split(", "))][:-2],
            F.lit(version).alias("written"), F.lit(batch).cast("string").alias("batch"))
        files.select(*named.columns).unionByName(named).coalesce(1).write.parquet(aside)
        fs = p(final).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(p(f"{self.folder}/manifest"))
        if fs.exists(p(final)) or not fs.rename(p(aside), p(final)):
            remove(self.spark, aside)
            raise Conflict(f"version {version} was published meanwhile")

    # ---- reading

    def read(self, version: int | None = None, keys: list | None = None) -> DataFrame:
        """The rows of a version (the newest), or of some keys only: files whose bucket and range hold none of them aren't read."""
        files = self.manifest(version).filter("path is not null")
        if keys is not None:
            asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.key]]))
            files = self._touched(files, asked)
        paths = [r[0] for r in files.select("path").distinct().collect()]  # names of files, not rows
        rows = self._files(paths)
        return rows if keys is None else rows.filter(F.col(self.key).isin(keys))

    def _files(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.folder}/data/{p}" for p in paths])

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _order(self, key: Column) -> Column:
        """Keys as strings whose order is the keys': least and largest of any type lie in one column."""
        kind = self.schema[self.key].dataType.simpleString()
        if kind in ("tinyint", "smallint", "int", "bigint"):
            # the sign bit flipped, in 16 hex digits
            return F.lpad(F.hex(key.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
        return key.cast("string") if kind == "string" else F.date_format(key, "yyyy-MM-dd HH:mm:ss.SSSSSS")

    def _touched(self, files: DataFrame, keys: DataFrame) -> DataFrame:
        """The files in whose bucket and range a key lies."""
        own = keys.select(self._bucket().alias("bucket"), self._order(F.col(self.key)).alias("_k"))
        return files.join(own, (files["bucket"] == own["bucket"]) & F.col("_k").between(F.col("least"), F.col("largest")), "left_semi")

    # ---- changes

    def upsert(self, batch: DataFrame, order: str | None = None, name: str | None = None) -> int:
        """Puts the batch's rows in place of those of their keys; returns the version. order: a column of batch that tells its last rows."""
        return self._change(batch, order, name, keep=True)

    def delete(self, keys: DataFrame, name: str | None = None) -> int:
        return self._change(keys.select(self.key), None, name, keep=False)

    def accumulate(self, batch: DataFrame, name: str | None = None) -> int:
        """Adds the batch's numbers to those of their keys: all columns but the key are summed, nulls counting as 0."""
        version = self.version()
        if name is not None and name in self.batches():
            return version
        sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in self.schema.names if c != self.key]
        total = lambda rows: rows.groupBy(self.key).agg(*sums)
        new = materialise(total(batch.select(*self.schema.names)), "sums")
        paths = [r[0] for r in self._touched(self.manifest(version).filter("path is not null"), new).select("path").collect()]
        old = self._files(paths).join(new.select(self.key), self.key, "left_semi")
        return self._change(total(old.unionByName(new)), None, name, keep=True, began=version)

    def _change(self, batch: DataFrame, order: str | None, name: str | None, keep: bool, began: int | None = None) -> int:
        version = self.version() if began is None else began
        if name is not None and name in self.batches():
            return version
        place = order or "_read"
        rows = batch if order else batch.withColumn(place, F.monotonically_increasing_id())
        columns = self.schema.names if keep else [self.key]
        rows = first_of_each(rows.select(*dict.fromkeys([*columns, place])), [self.key], place, last=True).select(*columns)
        rows = materialise(rows.select(*[F.col(c).cast(self.schema[c].dataType).alias(c) for c in columns]), "batch")
        if not rows.filter(F.col(self.key).isNull()).isEmpty():
            raise ValueError(f"{self.key} is null in the batch")
        files = self.manifest(version).filter("path is not null")
        touched = materialise(self._touched(files, rows), "touched")
        paths = [r[0] for r in touched.select("path").collect()]
        rest = self._files(paths).join(rows.select(self.key), self.key, "left_anti")
        new = self._write(rest.unionByName(rows) if keep else rest, version + 1)
        if not paths and new is None and name is None:
            return version
        stay = files.join(touched.select("path"), "path", "left_anti")
        self._publish(stay if new is None else stay.unionByName(new), version + 1, name)
        return version + 1

    def _write(self, rows: DataFrame, version: int) -> DataFrame | None:
        """Writes rows as files of one bucket each, sorted by key; returns their rows of the manifest."""
        rows = materialise(rows.withColumn("_bucket", self._bucket()), "merged")
        sizes = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
        parts = sizes.select("_bucket", F.ceil(F.col("_n") / self.file_rows).cast("int").alias("_parts"))
        total = parts.agg(F.sum("_parts")).first()[0]
        if not total:
            return None
        # ranges of (bucket, key), about as many as there will be files; a range that meets two buckets writes to both
        folder = uuid.uuid4().hex
        rows.repartitionByRange(total, "_bucket", self.key).sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(
            f"{self.folder}/data/{folder}")
        back = self.spark.read.schema(StructType([*self.schema.fields])).option("basePath", f"{self.folder}/data/{folder}").parquet(f"{self.folder}/data/{folder}")
        path = F.regexp_extract(F.input_file_name(), f"({folder}/.*)$", 1)
        found = back.select(path.alias("path"), F.col(self.key).alias("_k"), self._bucket().alias("bucket")).groupBy("path").agg(F.first("bucket").alias("bucket"),
            F.min("_k").alias("a"), F.max("_k").alias("b"), F.count(F.lit(1)).alias("rows"))
        return found.select("bucket", "path", self._order(F.col("a")).alias("least"), self._order(F.col("b")).alias("largest"), "rows",
            F.lit(version).alias("written"), F.lit(None).cast("string").alias("batch"))

    def remove_old(self, keep: int = 1) -> int:
        """Forgets all but the newest `keep` versions and deletes files that none of those names; returns how many folders went.

        Names of batches go with their versions, so keep as many as may be replayed. No change may run meanwhile.
        """
        versions = self.versions()
        for v in versions[:-keep]:
            remove(self.spark, f"{self.folder}/manifest/{v}")
        used = set()
        for v in versions[-keep:]:
            named = self.manifest(v).filter("path is not null").select(F.split("path", "/")[0].alias("f")).distinct()
            used |= {r[0] for r in named.collect()}
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/data")
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [x.getPath() for x in fs.listStatus(p) if x.getPath().getName() not in used] if exists(self.spark, f"{self.folder}/data") else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)
