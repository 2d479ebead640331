"""Arrow batches cut so that a worker holds little text at once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

#: Rows, and bytes of the batch, that are worked on at once.
ROWS, BYTES = 1000, 4_000_000
#: A session's bound of bytes for a batch that goes to Python, and Spark's own value of it.
BOUND, UNBOUND = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends about BYTES bytes at once to Python, unless it has a bound of its own: an executor holds a batch several times outside its heap."""
    if spark.conf.get(BOUND) == UNBOUND:
        spark.conf.set(BOUND, str(BYTES))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ROWS rows and about BYTES bytes (a larger row is a slice of its own); what was freed goes back to the system at the end."""
    for batch in batches:
        step = max(1, min(ROWS, BYTES * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
    give_back()


def give_back() -> None:
    """Workers are used again by later tasks; memory that allocators keep for this one would add to theirs."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
