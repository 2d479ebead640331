"""Structured Streaming forms of ingest and audit; each ends when all present input is read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.session import folder, remove

#: Rows of one file of a batch, about, in ordered().
FILE_ROWS = 250_000


def in_order(rows: DataFrame, column: str, files: int, name: str, each: int = 1) -> str:
    """Writes a table as files that follow each other in a column (equal counts, about), one written after the other; returns their folder.

    A stream of it with one file for each batch sees the rows in batches of that order. With `each`, so many files, written at once, stand for one.
    """
    spark = rows.sparkSession
    path = folder(spark, f"input-{name}")
    cuts = rows.select(F.expr(f"percentile_approx(`{column}`, array({', '.join(str(i / files) for i in range(1, files))}))")).first()[0] if files > 1 else []
    edges, done = [None, *(cuts or []), None], 0
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows if low is None else rows.filter(F.col(column) > F.lit(low))
        part = part if high is None else part.filter((F.col(column) <= F.lit(high)) | (F.col(column).isNull() if low is None else F.lit(False)))
        # the table is read by many tasks; only the rows of a file meet in one
        part.repartition(each).write.mode("append").parquet(path)
        done += each
        for _ in range(done - _files(spark, path) if each > 1 else 0):  # a task without rows writes none, and batches are counted in files
            rows.limit(0).repartition(1).write.mode("append").parquet(path)
    return path


def _files(spark: SparkSession, path: str) -> int:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sum(x.getPath().getName().startswith("part-") for x in at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at))


def ordered(rows: DataFrame, column: str, batches: int, name: str) -> DataFrame:
    """A stream of a table in so many batches that follow each other in a column; the files of a batch grow in number, not in size, with the table."""
    each = max(1, rows.count() // batches // FILE_ROWS)
    return source(rows.sparkSession, in_order(rows, column, batches, name, each), files=each)


def source(spark: SparkSession, path: str, times: tuple[str, ...] = (), files: int | None = None) -> DataFrame:
    """A stream of the Parquet files at path (a folder, or one file: the stream then watches its folder for that name). times: columns cast to timestamps; files: of one batch at most."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        reader, path = reader.option("pathGlobFilter", name), folder
    rows = reader.parquet(path)
    return rows.withColumns({t: F.col(t).cast("timestamp") for t in times}) if times else rows


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all present input into the shared folder and reads the result. In complete mode each batch has a folder of its own, and the last one's is read."""
    spark = stream.sparkSession
    base = folder(spark, f"stream-{name}")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/out")
    last = [-1]

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch-{number}")  # a batch that comes again writes the same
        if last[0] >= 0 and last[0] != number:
            remove(spark, f"{base}/batch-{last[0]}")
        last[0] = number

    writer.foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/batch-{last[0]}") if last[0] >= 0 else spark.createDataFrame([], stream.schema)


def ingest_dedup(stream: DataFrame, text: str = "text") -> DataFrame:
    """The distinct content hashes of a stream of texts."""
    return stream.select(F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("content_hash")).dropDuplicates(["content_hash"])


def audit_windows(stream: DataFrame, width: str = "1 day", late: str = "2 days", time: str = "ts") -> DataFrame:
    """Events for each window and type; rows later than `late` are dropped by the watermark."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"),
        F.round(F.sum("value"), 2).alias("total"))
