"""Recursive queries: depths in a forest of replies, values at any depth of free JSON.

Both are one recursive common table expression, in which every row is reached once: a row of a forest has one parent,
and a value lies in one object or array. What is reached a second time on another way (a graph) is expand()'s work
(`chunking`), as a recursion can't leave out what it met before.

Spark stops a recursion after `spark.sql.cteRecursionRowLimit` rows; that limit is lifted while a result is written, so
no row is lost or fails for the number of rows. A recursion deeper than `most` levels fails, it isn't cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.session import materialise

ROW_LIMIT = "spark.sql.cteRecursionRowLimit"


@contextmanager
def _any_number_of_rows(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(ROW_LIMIT)
    spark.conf.set(ROW_LIMIT, "-1")
    try:
        yield
    finally:
        spark.conf.set(ROW_LIMIT, before)


def forest(rows: DataFrame, key: str, parent: str, most: int = 1000) -> DataFrame:
    """key, root, depth (0: a root) of every row that a root reaches. A root has a null parent.

    Rows on a cycle, below one, or below a parent that isn't there have no root and are left out; a null key is reached
    but has no children. A key that repeats is reached once for each of its rows, and so is everything below it. A level
    is one join by parent, so a parent with many children costs what its children cost.
    """
    spark = rows.sparkSession
    given = materialise(rows.select(F.col(key).alias("k"), F.col(parent).alias("p")), "forest-rows")
    found = spark.sql(
        f"""WITH RECURSIVE reached(k, root, depth) MAX RECURSION LEVEL {most} AS (
              SELECT k, k, 0 FROM {{given}} WHERE p IS NULL
              UNION ALL
              SELECT g.k, r.root, r.depth + 1 FROM reached r JOIN {{given}} g ON g.p = r.k)
            SELECT k, root, depth FROM reached""", given=given)
    with _any_number_of_rows(spark):
        return materialise(found.select(F.col("k").alias(key), "root", "depth"), "forest")


def json_values(rows: DataFrame, key: str, column: str, most: int = 1000) -> DataFrame:
    """key, at, kind, value: every value of a JSON text that is neither object nor array, with its place (`$.a[0].b`).

    kind is a variant's type name, value its text (null for null). A null text or one that isn't JSON has no rows.
    """
    spark = rows.sparkSession
    given = rows.select(F.col(key).alias("k"), F.try_parse_json(F.col(column)).alias("v")).filter("v is not null")
    found = spark.sql(
        f"""WITH RECURSIVE parts(k, at, v) MAX RECURSION LEVEL {most} AS (
              SELECT k, '$', v FROM {{given}}
              UNION ALL
              SELECT p.k, p.at || CASE WHEN e.key IS NULL THEN '[' || e.pos || ']' ELSE '.' || e.key END, e.value
              FROM (SELECT * FROM parts WHERE schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%') p,
                LATERAL variant_explode(p.v) AS e)
            SELECT k, at, schema_of_variant(v) AS kind, variant_get(v, '$', 'string') AS value FROM parts
            WHERE NOT (schema_of_variant(v) LIKE 'OBJECT%' OR schema_of_variant(v) LIKE 'ARRAY%')""", given=given)
    with _any_number_of_rows(spark):
        return materialise(found.select(F.col("k").alias(key), "at", "kind", "value"), "json-values")
