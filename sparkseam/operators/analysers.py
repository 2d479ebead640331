"""Analyses of one kind over files or chunks: findings by rule, a model's beside them, what was read, and a summary.

Files are rows (file_path, file_type, content). Chunks of a store become such rows by of_chunks(), each read on its own.
Findings have the columns FINDING, whatever the kind. A model's findings, where given, are rows with some of them and `ord`.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkseam.functions.classify import filled
from sparkseam.operators import detectors, federation, iam
from sparkseam.session import materialise
from sparkseam.sources import parsers

FINDING = {"rule_id": "string", "severity": "string", "issue": "string", "file_path": "string", "line_number": "int", "type": "string",
    "identity": "string", "role": "string", "scope": "string"}


@dataclass(frozen=True)
class Analysis:
    """findings: FINDING; files: file_path, each once; summary: one row units, total, high, medium, low, files."""

    findings: DataFrame
    files: DataFrame
    summary: DataFrame


@dataclass(frozen=True)
class Kind:
    """How files of some types are read into units, how units are judged, and which of a model's findings count as new."""

    types: tuple[str, ...]
    read: Callable[[DataFrame], DataFrame]
    judge: Callable[[DataFrame], DataFrame]
    keys: tuple[str, ...]
    folded: bool
    model_rule: str


def finding(rows: DataFrame, *kept: str) -> DataFrame:
    """rows with the columns FINDING, those kept beside them and no others; what they lack is empty, line 0."""
    empty = lambda kind: F.lit("") if kind == "string" else F.lit(0).cast(kind)
    have = lambda c, kind: F.coalesce(F.col(c).cast(kind), empty(kind)) if c in rows.columns else empty(kind)
    return rows.select(*kept, *[have(c, kind).alias(c) for c, kind in FINDING.items()])


def of_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks (file_path, file_type, text) as files; those without a text have nothing to read."""
    return chunks.filter(F.coalesce("text", F.lit("")) != "").select(F.coalesce("file_path", F.lit("")).alias("file_path"), "file_type",
        F.col("text").alias("content"))


def with_model(found: DataFrame, said: DataFrame, keys: tuple[str, ...], rule: str, folded: bool) -> DataFrame:
    """Findings, then a model's whose keys no finding has, each once: its first by ord. Without a severity they are LOW, without a rule `rule`.

    folded: keys are compared without regard to case; then the model's own rule ids don't count, and its severity is put in upper case.
    """
    form = lambda c: F.lower(F.col(c)) if folded and FINDING[c] == "string" else F.col(c)
    key = F.struct(*[form(c).alias(c) for c in keys])
    rows = finding(said, "ord").withColumn("_key", key)
    first = rows.groupBy("_key").agg(F.min(F.struct("ord", *FINDING)).alias("_f"))
    new = first.join(found.select(key.alias("_key")).distinct(), "_key", "left_anti").select("_f.*").drop("ord")
    severity = filled(F.col("severity"), F.lit("LOW"))
    new = new.withColumns({"severity": F.upper(severity) if folded else severity, "rule_id": F.lit(rule) if folded else filled(F.col("rule_id"),
        F.lit(rule))})
    return found.unionByName(new)


def summary(findings: DataFrame, files: DataFrame, units: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = findings.agg(F.count(F.lit(1)).alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"))
    one = lambda rows, name: F.broadcast(rows.agg(F.count(F.lit(1)).alias(name)))
    return one(units, "units").crossJoin(F.broadcast(counts)).crossJoin(one(files, "files"))


def _access(units: DataFrame) -> DataFrame:
    return iam.analyse(units).withColumn("type", F.lit("iam"))


def _trust(units: DataFrame) -> DataFrame:
    return federation.findings(units).withColumn("type", F.lit("workload_identity"))


def _secrets(units: DataFrame) -> DataFrame:
    return detectors.secret_findings(units.withColumnRenamed("content", "text")).withColumn("type", F.lit("secret"))


CONFIG = ("terraform", "yaml", "json")
KINDS = {
    "iam": Kind(CONFIG, parsers.role_assignments, _access, ("identity", "role", "scope"), True, "IAM-LLM"),
    "workload_identity": Kind(CONFIG, parsers.federation_configs, _trust, ("identity", "issue"), True, "WID-LLM"),
    "prompt_injection": Kind(("yaml",), parsers.pipeline_snippets, detectors.pipeline_findings, ("type", "file_path", "line_number", "issue"), False, "PIPE-LLM"),
    "secrets": Kind((), lambda files: files, _secrets, ("type", "file_path", "line_number", "issue"), False, "SEC-LLM"),
}


def analyse(kind: str, files: DataFrame, said: DataFrame | None = None, all_files: bool = False) -> Analysis:
    """The analysis of a kind over files; types that it can't read are passed over.

    The files it names are those with something to judge, or, with all_files, all with a path, as for chunks.
    Files are parsed once: what they hold is written and read for findings, files and summary.
    """
    k = KINDS[kind]
    units = k.read(files.filter(F.col("file_type").isin(*k.types)) if k.types else files)
    units = materialise(units, "units")
    found = finding(k.judge(units))
    if said is not None:
        found = with_model(found, said, k.keys, k.model_rule, k.folded)
    found = materialise(found, "findings")
    named = (files if all_files else units).filter(F.coalesce("file_path", F.lit("")) != "").select("file_path").distinct()
    return Analysis(found, named, summary(found, named, units))


def is_access_chunk(file_type: Column, resource_type: Column, text: Column) -> Column:
    """Whether a chunk holds role assignments or definitions."""
    low = F.lower(F.coalesce(text, F.lit("")))
    written = F.contains(low, F.lit("roleassignment")) | F.contains(low, F.lit("roledefinition"))
    return F.coalesce(F.when(file_type == "terraform", resource_type == "azurerm_role_assignment").when(file_type.isin("yaml", "json"), written), F.lit(False))


def access_chunks(found: DataFrame, store: DataFrame) -> DataFrame:
    """All chunks with role assignments of the files that were found; if there are none, the chunks found. Both have the store's columns."""
    near = store.join(found.select("file_path").filter("file_path <> ''").distinct(), "file_path", "left_semi").filter(is_access_chunk(
        F.col("file_type"), F.col("resource_type"), F.col("text")))
    near = materialise(near, "near")
    return found.select(*near.columns) if near.isEmpty() else near
