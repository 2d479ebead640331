"""Findings of workload identity federation settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkseam.functions import classify as C

# Rule, severity, finding.
RULES = [("WID-AZ-001", "HIGH", "Invalid or missing federation issuer"), ("WID-AZ-002", "HIGH", "Missing or overly broad audience restriction"),
    ("WID-AZ-003", "MEDIUM", "Overly broad subject claim"), ("WID-AZ-004", "HIGH", "External or cross-tenant trust without restriction")]


def findings(configs: DataFrame) -> DataFrame:
    """One row for every rule that a setting breaks; several may hold at once."""
    k8s = F.col("federation_type") == "kubernetes_service_account"
    strict = ~(k8s & ~(F.col("explicit_issuer") | F.col("explicit_subject") | F.col("explicit_audiences")))
    subject = F.coalesce("subject", F.lit(""))
    host = C.host_of(F.col("issuer"))
    loose = F.contains(subject, F.lit("*")) | F.endswith(subject, F.lit(":"))
    holds = [
        strict & F.col("explicit_issuer") & ~C.valid_https(F.col("issuer")),
        strict & F.col("explicit_audiences") & ((F.coalesce(F.size("audiences"), F.lit(0)) == 0) | F.exists("audiences", lambda a: F.trim(a).isin("", "*"))),
        F.col("explicit_subject") & C.broad_subject(subject),
        ~(k8s & ~F.col("explicit_issuer")) & (host != "") & ~C.trusted_host(host) & (loose | (F.coalesce("tenant_id", F.lit("")) == "")),
    ]
    each = F.array_compact(F.array(*[F.when(h, F.struct(F.lit(r).alias("rule_id"), F.lit(s).alias("severity"), F.lit(i).alias("issue"))) for h,
        (r, s, i) in zip(holds, RULES, strict=True)]))
    return configs.select("identity", "issuer", "subject", F.array_join("audiences", ",").alias("audiences"), "file_path", "block_name", F.inline(each))
