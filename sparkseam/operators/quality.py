"""Answer quality: failure signals, routing to a repair skill, query rewriting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions.text import alnum_tokens, words
from sparkseam.session import materialise

# Filler words and stop words.
FILLER = [
    "please", "kindly", "just", "actually", "basically", "i", "think", "maybe", "possibly", "can", "could", "you",
    "help", "me",
]
STOPWORDS = [
    "the", "is", "a", "an", "to", "of", "for", "in", "on", "with", "and", "or",
    "this", "that", "it", "as", "by", "be", "are", "at", "from", "check", "issue",
]


def signals(rows: DataFrame) -> DataFrame:
    """rows (query, answer, docs: array<string>) with the three scores, is_failure and reason. Thresholds use unrounded scores."""
    tokens, known = alnum_tokens(F.col("answer")), F.array_distinct(alnum_tokens(F.array_join("docs", " ")))
    rows = rows.withColumn("_t", tokens).withColumn("_d", known)
    n = F.size("_t")
    shared = F.size(F.filter("_t", lambda x: F.array_contains(F.col("_d"), x)))
    miss = F.when(n == 0, F.lit(1.0)).otherwise((n - shared) / F.nullif(n, F.lit(0)))
    ground = F.when(n == 0, F.lit(0.0)).otherwise(shared / F.nullif(n, F.lit(0)))
    low = F.lower(F.coalesce("answer", F.lit("")))
    off = lambda phrase, w: F.when(F.contains(low, F.lit(phrase)), F.lit(w)).otherwise(0.0)
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(1.0 - off("i think", 0.3) - off("maybe", 0.2) - off("possibly",
        0.2) - F.when(F.size(words(F.col("answer"))) < 5, F.lit(0.4)).otherwise(0.0), 6)))
    rows = rows.withColumns({"_m": miss, "_g": ground, "_s": sure})
    why = F.array_compact(F.array(F.when(F.col("_m") > 0.5, "hallucination_score > 0.5"), F.when(F.col("_g") < 0.3, "grounding_score < 0.3"),
        F.when(F.col("_s") < 0.5, "confidence_score < 0.5")))
    out = rows.withColumns({"hallucination_score": F.round("_m", 3), "grounding_score": F.round("_g", 3), "confidence_score": F.round("_s", 3),
        "is_failure": F.size(why) > 0, "reason": F.when(F.size(why) > 0, F.array_join(why, "; ")).otherwise("quality acceptable")})
    return out.withColumn("skill", route(F.col("query"), F.col("_m"), F.col("_g"))).drop("_t", "_d", "_m", "_g", "_s")


def doc_texts(docs: Column) -> Column:
    """array<string>: the texts and the descriptions of an array<struct<text, description>>, empty ones left out."""
    both = F.flatten(F.transform(docs, lambda d: F.array(d["text"], d["description"])))
    return F.coalesce(F.filter(both, lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), F.array().cast("array<string>"))


def route(query: Column, missing: Column, grounding: Column) -> Column:
    low = F.concat(F.lit(" "), F.lower(F.coalesce(query, F.lit(""))), F.lit(" "))
    many = F.contains(low, F.lit(" and ")) | F.contains(low, F.lit(" or ")) | F.contains(low, F.lit(",")) | F.contains(low, F.lit(";"))
    return F.when(missing > 0.5, "rewrite").when(grounding < 0.3, "focus").when(many, "decompose").otherwise("exit")


def rewrite(query: Column) -> Column:
    kept = F.filter(alnum_tokens(query), lambda x: ~x.isin(FILLER))
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(query)


def decompose(query: Column) -> Column:
    parts = F.filter(F.transform(F.split(query, r"(?i)\b(?:and|or)\b"), lambda x: F.regexp_replace(x, r"^[ ,;:.\t\n]+|[ ,;:.\t\n]+$", "")), lambda x: x != "")
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(query))


def focus(rows: DataFrame, key: str, k: int = 5) -> DataFrame:
    """key, focused: the query with the k most frequent context words. rows: key, query, context (array<string>)."""
    each = rows.select(key, F.explode(alnum_tokens(F.array_join("context", " "))).alias("t")).filter(~F.col("t").isin(STOPWORDS) & (F.length("t") > 2))
    n = each.groupBy(key, "t").agg(F.count(F.lit(1)).alias("c"))
    top = n.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("c"), "t"))).filter(F.col("r") <= k)
    said = top.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]), " ").alias("_w"))
    return rows.select(key, "query").join(said, key, "left").select(key, F.when(F.col("_w").isNull(), F.col("query")).otherwise(F.concat("query",
        F.lit(" focus:"), F.col("_w"))).alias("focused"))


def improve(rows: DataFrame, answer: Callable[[DataFrame], DataFrame], key: str, rounds: int = 3) -> DataFrame:
    """key, query, answer, docs, round of the last try. answer adds answer and docs to (key, query); failing rows are asked again, rewritten or focused."""
    todo, out = rows.select(key, "query"), None
    for i in range(1, rounds + 1):
        # each round is written, so the plan doesn't grow and the answers are asked for once
        tried = materialise(signals(answer(todo)).withColumn("round", F.lit(i)), f"round{i}")
        done = tried.filter(~F.col("is_failure")) if i < rounds else tried
        part = done.select(key, "query", "answer", "docs", "round")
        out = part if out is None else out.unionByName(part)
        if i < rounds:
            again = tried.filter("is_failure")
            focused = focus(again.select(key, "query", F.col("docs").alias("context")), key)
            todo = again.join(focused, key).select(key, F.when(F.col("skill") == "rewrite", rewrite(F.col("query"))).when(F.col("skill") == "focus",
                F.col("focused")).when(F.col("skill") == "decompose", F.get(decompose(F.col("query")), F.lit(0))).otherwise(F.col("query")).alias("query"))
    return out
