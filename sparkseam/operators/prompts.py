"""Prompts for a language model, and its answers.

A prompt is one row. What goes into it is cut before it is gathered: packed entries keep to a token budget, lists to a
number of entries, and texts to a number of characters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseam.operators.context import prompt as joined

# Headings of the sections in their order, and the limits of each part.
QUERY, RESOURCES, CODE, RULES, TASK = "## Analysis Query", "## Matched Resource Tags", "## Code Context (IaC Snippets)", "## Security Rules & Best Practices", "## Task"
ASSIGNMENTS, RETRIEVED, INSTRUCTIONS = "## Role Assignments to Analyse", "## Retrieved Code Context", "## Instructions"
FILE, SNIPPET, FOUND = "## File", "## Pipeline Snippet", "## Rule-Based Findings"
MOST_ASSIGNMENTS, MOST_CHUNKS, MOST_RULES, MOST_FINDINGS = 15, 5, 5, 10
CLIP_SOURCE, CLIP_RULE, CLIP_REFERENCE, CLIP_SNIPPET = 500, 600, 500, 1200

ROLE = "You review infrastructure code for security faults. Use only what is given below."
ANSWER = 'Answer with one JSON object: {"issues": [{"title": "", "severity": "", "description": "", "affected_resource": "", "recommendation": "", "cwe": "", "owasp": "", "rule_id": ""}], "summary": ""}'
NO_ANSWER = '{"issues": [], "summary": ""}'


def section(heading: str, body: Column) -> Column:
    """Heading and body with an empty line after them; null, which joins leave out, where the body is empty."""
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(heading + "\n"), body, F.lit("\n")))


def with_text(rows: DataFrame, entries: DataFrame, key: str, name: str) -> DataFrame:
    """rows with the entries (key, rank, entry) of each joined in order."""
    return rows.join(joined(entries, [key]).withColumnRenamed("text", name), key, "left")


def review(questions: DataFrame, code: DataFrame, rules: DataFrame, resources: DataFrame, key: str = "qid") -> DataFrame:
    """key, prompt. questions: key, query, hint; code, rules: key, rank, entry, packed; resources: key, rank, resource_type, cloud_provider, category."""
    part = lambda c: F.concat(F.lit(f"{c}="), F.coalesce(c, F.lit("")))
    tags = resources.select(key, "rank", F.concat(F.lit("- "), F.concat_ws(", ", part("resource_type"), part("cloud_provider"),
        part("category"))).alias("entry"))
    lines = tags.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "entry"))), lambda x: x["entry"]), "\n").alias("_tags"))
    rows = with_text(with_text(questions, code, key, "_code"), rules, key, "_rules").join(lines, key, "left")
    hint = F.when(F.coalesce("hint", F.lit("")) != "", F.concat(F.lit("Focus your analysis on: "), F.col("hint"), F.lit(" security issues.\n")))
    return rows.select(key, F.concat_ws("\n", F.lit(ROLE + "\n"), hint, section(QUERY, F.col("query")), section(RESOURCES, F.col("_tags")),
        section(CODE, F.col("_code")), section(RULES, F.col("_rules")), F.lit(TASK), F.lit(ANSWER)).alias("prompt"))


def listed(rows: DataFrame, key: str, entry: Column, most: int) -> DataFrame:
    """key, rank, entry of the first `most` rows of each key (rank: 1 to n)."""
    return rows.filter(F.col("rank") <= most).select(key, "rank", entry.alias("entry"))


def clipped(text: str, most: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, most)


def access_review(questions: DataFrame, assignments: DataFrame, code: DataFrame, rules: DataFrame, key: str = "qid") -> DataFrame:
    """key, prompt. questions: key, query; assignments: key, rank and the columns of role assignments; code: key, rank, file_path, text; rules: key, rank, title, severity, text."""
    said = F.concat(F.lit("identity: `"), F.col("identity_name"), F.lit("`, role: `"), F.col("role"), F.lit("`, scope: `"), F.col("scope_type"),
        F.lit("` (`"), F.coalesce(F.nullif("scope_value", F.lit("")), F.lit("reference")), F.lit("`)"))
    head = F.concat(F.lit("### ["), F.col("rank"), F.lit("] "), F.col("block_name"), F.lit(" ("), F.col("file_path"), F.lit(")\n```\n"),
        clipped("source_text", CLIP_SOURCE), F.lit("\n```\n"), said)
    chunk = F.concat(F.lit("### [Code "), F.col("rank"), F.lit("] "), F.coalesce(F.nullif("file_path", F.lit("")), F.lit("retrieved chunk")),
        F.lit("\n```\n"), clipped("text", CLIP_SOURCE), F.lit("\n```"))
    rule = F.concat(F.lit("### [Rule "), F.col("rank"), F.lit("] "), F.col("title"), F.when(F.coalesce("severity", F.lit("")) != "",
        F.concat(F.lit(" ("), F.col("severity"), F.lit(")"))).otherwise(""), F.lit("\n"), clipped("text", CLIP_RULE))
    more = assignments.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    rows = with_text(questions, listed(assignments, key, head, MOST_ASSIGNMENTS), key, "_own").join(more, key, "left")
    rows = with_text(rows, listed(code.filter(F.coalesce("text", F.lit("")) != ""), key, chunk, MOST_CHUNKS), key, "_code")
    rows = with_text(rows, listed(rules, key, rule, MOST_RULES), key, "_rules")
    rest = F.when(F.col("_n") > MOST_ASSIGNMENTS, F.concat(F.lit("("), (F.col("_n") - MOST_ASSIGNMENTS).cast("string"),
        F.lit(" more assignments not shown)\n")))
    return rows.select(key, F.concat_ws("\n", F.lit(ROLE + "\n"), section(ASSIGNMENTS, F.col("_own")), rest, section(RETRIEVED, F.col("_code")),
        section(RULES, F.col("_rules")), section(QUERY, F.col("query")), F.lit(INSTRUCTIONS), F.lit(ANSWER)).alias("prompt"))


def snippet_review(snippets: DataFrame, found: DataFrame, rules: DataFrame, key: str = "qid") -> DataFrame:
    """key, prompt. snippets: key, file_path, snippet, query; found: key, rank, finding (JSON); rules: key, rank, title, text."""
    rule = F.concat(F.lit("### [Rule "), F.col("rank"), F.lit("] "), F.col("title"), F.lit("\n"), clipped("text", CLIP_REFERENCE))
    first = found.filter(F.col("rank") <= MOST_FINDINGS).groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank",
        "finding"))), lambda x: x["finding"]), ",\n").alias("_found"))
    rows = with_text(snippets.join(first, key, "left"), listed(rules, key, rule, MOST_RULES), key, "_rules")
    body = F.concat(F.lit("```\n"), clipped("snippet", CLIP_SNIPPET), F.lit("\n```"))
    listing = F.concat(F.lit("["), F.coalesce("_found", F.lit("")), F.lit("]"))
    return rows.select(key, F.concat_ws("\n", F.lit(ROLE + "\n"), section(FILE, F.col("file_path")), section(SNIPPET, body), section(FOUND, listing),
        section(RULES, F.col("_rules")), section(QUERY, F.col("query")), F.lit(INSTRUCTIONS), F.lit(ANSWER)).alias("prompt"))


# ---- the model

Answer = Callable[[str], str]


def silent(prompt: str) -> str:
    """The client where there is no model."""
    return NO_ANSWER


def recorded(answers: dict[str, str]) -> Answer:
    """A client that gives the answer of the first key that the prompt holds, and else none."""
    return lambda prompt: next((a for k, a in answers.items() if k in prompt), NO_ANSWER)


def answered(prompts: DataFrame, answer: Answer = silent, key: str = "qid") -> DataFrame:
    """key, raw: the client's answer to each prompt; a client that fails gives no issues, and its error as the summary."""
    import json

    def ask(prompt: str) -> str:
        try:
            return answer(prompt)
        except Exception as e:  # whatever a client raises is an answer without issues
            return json.dumps({"issues": [], "summary": f"no answer: {e}"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({key: b[key], "raw": [ask(p) for p in b["prompt"]]})

    return prompts.select(key, "prompt").mapInPandas(run, f"`{key}` {prompts.schema[key].dataType.simpleString()}, raw string")
