"""Small tables that Spark and SQL share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def frame(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """Rows as a table built by the JVM; whole numbers are longs."""

    def lit(v):
        if isinstance(v, bool) or not isinstance(v, int):
            return F.array(*[F.lit(x) for x in v]).cast("array<string>") if isinstance(v, (list, tuple)) else F.lit(v)
        return F.lit(v).cast("long")

    return spark.range(1).select(F.inline(F.array(*[F.struct(*[lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rows])))


def values(names: list[str], rows: list[tuple]) -> str:
    """The same rows as SQL: (select * from (values ...) t(...))."""

    def lit(v) -> str:
        if v is None:
            return "null"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, (list, tuple)):
            return "[" + ", ".join(map(lit, v)) + "]::varchar[]"
        if isinstance(v, str):
            parts = v.split("\n")
            return " || chr(10) || ".join("'" + p.replace("'", "''") + "'" for p in parts)
        return f"{v}::bigint" if isinstance(v, int) else f"{v}::double"

    body = ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)
    return f"(select * from (values {body}) t({', '.join(names)}))"


def beside(names: list[str], rows: list[tuple], sql: str) -> str:
    """The fixed rows and those that a select over the given tables yields, as one table."""
    return f"(select * from {values(names, rows)} union all {sql})"


def pick(items: list[str], number: Column) -> Column:
    """The item at a remainder."""
    return F.get(F.array(*map(F.lit, items)), (number % len(items)).cast("int"))


def pick_sql(items: list[str], number: str) -> str:
    return "([" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + f"])[({number}) % {len(items)} + 1]"


def printf_sql(template: str, *values: str) -> str:
    """A text as F.format_string writes it."""
    return f"printf('{template.replace(chr(39), chr(39) * 2)}', {', '.join(values)})"
