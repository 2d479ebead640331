"""Dense numbers in a global order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.session import materialise

#: Rows that one task numbers; with more than MOST_RANGES ranges the ranges grow.
RANGE_ROWS, MOST_RANGES = 20_000, 2_000


def row_numbers(rows: DataFrame, order: list[Column], name: str, per_range: int = RANGE_ROWS) -> DataFrame:
    """rows with `name`, 1 to n in an order that should be total.

    Rows are dealt into ranges of the order, whose number follows their count; each range numbers its own rows, and the
    ranges' sizes (one row for each) are added up before it.
    """
    n = rows.count()
    per_range = max(per_range, -(-n // MOST_RANGES))
    if n <= per_range:
        return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))
    dealt = materialise(rows.repartitionByRange(-(-n // per_range), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return dealt.join(F.broadcast(sizes), "_range").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_range", "_before")


#: Leading bits of a hash that make a range.
HASH_BITS = 11


def hash_numbers(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with `name`, 1 to n in the order of a column of 64-bit hashes. rows is read twice: only that column the first time, to count its ranges."""
    at = F.shiftright(F.col(order), 64 - HASH_BITS).cast("int")
    sizes = rows.groupBy(at.alias("_range")).agg(F.count(F.lit(1)).alias("_size"))  # 2,048 rows at most
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(order))
    out = rows.withColumn("_range", at).withColumn("_inside", inside).join(F.broadcast(sizes), "_range")
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_range", "_before", "_inside")
