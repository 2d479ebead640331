"""Ingest of a stream into keyed tables, each batch exactly once.

A batch is merged by foreachBatch under the name `<stream>/<batch id>`, and the table's manifest carries that name. If
the stream fails after a batch was published but before its checkpoint says so, the batch comes again under the same
name and does nothing. The name of a stream must stay the same as long as its checkpoint does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.operators.keyed_table import KeyedTable
from sparkseam.operators.store import content_hash


def merge(stream: DataFrame, name: str, checkpoint: str, change: Callable[[DataFrame, str], object]) -> None:
    """Runs a stream over all present input; change(batch, name of the batch) puts a batch into a table."""
    query = stream.writeStream.foreachBatch(lambda batch, number: change(batch, f"{name}/{number}") and None)
    query.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_texts(stream: DataFrame, table: KeyedTable, name: str, checkpoint: str, text: str = "text") -> None:
    """Counts how often each text came: a table of content_hash and n that a repeated batch would falsify."""
    rows = stream.select(content_hash(text).alias("content_hash"), F.lit(1).cast("long").alias("n"))
    merge(rows, name, checkpoint, table.accumulate)
