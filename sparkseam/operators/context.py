"""Context assembly: ranked entries packed into a token budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions.text import token_estimate, words


def truncated(text: Column, most: Column) -> Column:
    """text, or its first words up to `most` estimated tokens with an ellipsis."""
    w, keep = words(text), F.floor(most / 0.75).cast("int")
    cut = F.concat(F.array_join(F.slice(w, F.lit(1), keep), " "), F.when(F.size(w) > keep, F.lit("…")).otherwise(""))
    return F.when(token_estimate(text) <= most, text).otherwise(cut)


def header(rank: Column, chunk_id: Column, provider: Column, resource: Column, path: Column, kind: Column) -> Column:
    part = lambda name, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{name}="), c))
    return F.concat_ws(" | ", F.concat(F.lit("["), rank.cast("string"), F.lit("]")), part("id", chunk_id), part("cloud", provider), part("resource",
        resource), part("file", path), part("type", kind))


def pack_code(rows: DataFrame, budget: int, group: list[str], rank: str = "rank", head: str = "header", text: str = "text") -> DataFrame:
    """group, rank, entry, whole: entries in rank order while they fit; the first that doesn't is cut if 50 tokens are left, and ends the list."""
    rows = rows.filter(F.coalesce(text, F.lit("")) != "")
    entry = lambda body: F.concat(F.col(head), F.lit("\n```\n"), body, F.lit("\n```"))
    w = Window.partitionBy(*group).orderBy(rank)
    rows = rows.withColumn("_cost", token_estimate(entry(F.col(text))))
    rows = rows.withColumn("_used", F.coalesce(F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("_over", F.sum(F.when(F.col("_used") + F.col("_cost") > budget, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = (F.col("_over") == 1) & (F.col("_used") + F.col("_cost") > budget)
    left = F.lit(budget) - F.col("_used")
    rows = rows.filter((F.col("_over") == 0) | (last & (left >= 50)))
    return rows.select(*group, rank, F.when(last, entry(truncated(F.col(text), left - 20))).otherwise(entry(F.col(text))).alias("entry"),
        (~last).alias("whole"))


def pack_rules(rows: DataFrame, budget: int, group: list[str], rank: str = "rank", head: str = "header", text: str = "text") -> DataFrame:
    """group, rank, entry: each text cut to its share of the budget (200 tokens at least), up to the first that doesn't fit."""
    w = Window.partitionBy(*group).orderBy(rank)
    rows = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*group)))
    share = F.greatest(F.lit(200), F.floor(F.lit(budget) / F.greatest("_n", F.lit(1)))).cast("int")
    rows = rows.withColumn("entry", F.concat(F.col(head), F.lit("\n"), truncated(F.coalesce(text, F.lit("")), share))).withColumn("_cost",
        token_estimate(F.col("entry")))
    rows = rows.withColumn("_sum", F.sum("_cost").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_over", F.max(F.when(F.col("_sum") > budget, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.filter("_over = 0").select(*group, rank, "entry")


def prompt(sections: DataFrame, group: list[str], rank: str = "rank") -> DataFrame:
    """group, text: packed entries joined in order; the budget bounds what is gathered."""
    return sections.groupBy(*group).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(rank, "entry"))), lambda x: x["entry"]),
        "\n\n").alias("text"))
