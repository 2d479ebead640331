"""Registered queries of the engine's own operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkseam.plans import analysis_queries, chunk_queries, detector_queries, engine_queries, report_queries, review_queries, search_queries

_MODULES = [search_queries, chunk_queries, detector_queries, analysis_queries, report_queries, engine_queries, review_queries]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid retrieval: BM25 and cosine branches, fused and ranked."""
    return search_queries.hybrid_topk(spark, sf_dir)


def queries() -> dict:
    return {k: f for m in _MODULES for k, f in m.Q.items()}


def oracle_sql() -> dict:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
