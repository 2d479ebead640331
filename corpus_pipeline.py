"""The corpus pipeline: quality rules, toxicity, near duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of docs. run() writes each stage's rows as Parquet into the shared folder and reads them again for the next;
what a stage wrote on its way is deleted once its rows are written.

Defined results: nulls in any column, empty and very long texts, ties, repeated rows and extra columns go as the
operators' docstrings say. A null or empty text has no words and is rejected by the first stage, and so an empty
documents table gives an empty result. Repeated rows are copies: one of them stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseam.llm import jaccard_join, line_quality, packing, pii, toxicity
from sparkseam.session import materialise, read_table, release, written

TOKENIZER = "byte_bpe_50k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; frequent lines of a source leave the others."""
    return line_quality.keep_good(docs)


def toxic_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents called toxic by the grammar, fitted on the labelled documents still here, go."""
    return toxicity.keep_clean(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; repeated ids are told apart by their texts."""
    return jaccard_join.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data become the name of their kind in brackets."""
    return pii.masked(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxic_documents),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", personal_data),
    ("packing", packed),
]

#: SQL can't express the tagger, the fitted grammar and the packing; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    mark = written()
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        release(spark, mark, keep=docs)  # what the stage wrote on its way, and its input
    return STAGES[-1][1](spark, docs, sf_dir)
