"""The rule catalogue: normalisation, joins with resources, rule-aware retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseam.functions.classify import filled
from sparkseam.functions.text import contains_any, first_match, severity_rank
from sparkseam.operators import search, store
from sparkseam.session import exists, materialise

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
# Id, source category, severity, resource type, provider, category of the built-in rules; titles are our own.
BUILT_IN = [
    ("owasp-iac-01", "owasp", "CRITICAL", "secrets", "aws", "secrets", "Credentials written into configuration"),
    ("owasp-llm-01", "owasp", "HIGH", "secrets", "generic", "secrets", "Secrets reachable from a model prompt"),
    ("owasp-iac-02", "owasp", "HIGH", "azurerm_storage_account", "azure", "storage", "Storage open to anonymous readers"),
    ("owasp-iac-03", "owasp", "HIGH", "general", "aws", "general", "Data kept without encryption"),
    ("owasp-iac-04", "owasp", "CRITICAL", "identity", "aws", "identity", "Wildcard grants in access policies"),
    ("owasp-iac-05", "owasp", "CRITICAL", "azurerm_storage_account", "azure", "storage", "Public containers with sensitive data"),
    ("owasp-iac-06", "owasp", "HIGH", "general", "azure", "general", "Logging and monitoring switched off"),
    ("cis-aws-01", "cis_aws", "HIGH", "aws_security_group", "aws", "networking", "Administration ports open to the world"),
    ("cis-aws-02", "cis_aws", "HIGH", "general", "aws", "general", "Trail of API calls not kept"),
    ("cis-aws-03", "cis_aws", "MEDIUM", "aws_s3_bucket", "aws", "storage", "Bucket without access logging"),
    ("cis-aws-04", "cis_aws", "HIGH", "general", "aws", "general", "Keys that are never rotated"),
    ("cis-aws-05", "cis_aws", "HIGH", "aws_security_group", "aws", "networking", "Default group lets traffic in"),
    ("cis-aws-06", "cis_aws", "MEDIUM", "general", "aws", "general", "Flow logs not enabled"),
    ("cis-k8s-01", "cis_k8s", "CRITICAL", "kubernetes_pod", "kubernetes", "compute", "Privileged containers"),
    ("cis-k8s-02", "cis_k8s", "CRITICAL", "kubernetes_pod", "kubernetes", "compute", "Containers that run as root"),
    ("cis-k8s-03", "cis_k8s", "HIGH", "kubernetes_pod", "kubernetes", "compute", "Host namespaces shared with pods"),
    ("cis-k8s-04", "cis_k8s", "HIGH", "kubernetes_pod", "kubernetes", "compute", "Capabilities not dropped"),
    ("cis-k8s-05", "cis_k8s", "MEDIUM", "kubernetes_pod", "kubernetes", "compute", "Containers without limits"),
    ("azure-01", "azure", "HIGH", "azurerm_storage_account", "azure", "storage", "Storage account accepts plain HTTP"),
    ("azure-02", "azure", "HIGH", "aws_security_group", "azure", "networking", "Network security rule allows any source"),
    ("gcp-01", "gcp", "CRITICAL", "google_storage_bucket", "gcp", "storage", "Bucket open to all users"),
    ("gcp-02", "gcp", "HIGH", "google_compute_instance", "gcp", "compute", "Instance with the default service account"),
    ("general-01", "general", "HIGH", "secrets", "generic", "secrets", "Passwords in plain text"),
    ("general-02", "general", "MEDIUM", "networking", "generic", "networking", "Endpoints without transport encryption"),
    ("general-03", "general", "HIGH", "compute", "aws", "compute", "Instances with public addresses"),
    ("general-04", "general", "MEDIUM", "general", "aws", "general", "Resources without owner tags"),
    ("general-05", "general", "MEDIUM", "aws_security_group", "aws", "networking", "Egress without limits"),
    ("general-06", "general", "HIGH", "secrets", "aws", "secrets", "Secrets outside a vault"),
    ("general-07", "general", "HIGH", "aws_security_group", "aws", "networking", "Database ports open to the world"),
    ("cis-az-iam-01", "cis_azure", "CRITICAL", "azurerm_user_assigned_identity", "azure", "identity", "Managed identity owns a subscription"),
    ("cis-az-iam-02", "cis_azure", "HIGH", "azurerm_storage_account", "azure", "storage", "Contributor over a whole storage account"),
    ("cis-az-iam-03", "cis_azure", "HIGH", "azurerm_user_assigned_identity", "azure", "identity", "Identity may grant access to others"),
    ("cis-az-iam-04", "cis_azure", "HIGH", "azurerm_user_assigned_identity", "azure", "identity", "Identity with several broad roles"),
    ("cis-az-iam-05", "cis_azure", "MEDIUM", "azurerm_user_assigned_identity", "azure", "identity", "Role wider than its workload"),
    ("cis-az-wi-01", "cis_azure", "HIGH", "secrets", "azure", "secrets", "Federated credential trusts any issuer"),
    ("cis-az-wi-02", "cis_azure", "MEDIUM", "kubernetes_pod", "azure", "compute", "Service account shared by workloads"),
    ("cis-az-wi-03", "cis_azure", "HIGH", "secrets", "azure", "secrets", "Token audience not restricted"),
]
FIELDS = ["rule_id", "source_category", "severity", "resource_type", "cloud_provider", "category", "title"]
# Resource type by the first needle group in a rule's text.
RULE_TYPES = [
    ("azurerm_user_assigned_identity", ["managed identity"]),
    ("*storage", ["storage account", "blob"]),
    ("aws_s3_bucket", ["s3 bucket"]),
    ("aws_security_group", ["security group"]),
    ("azurerm_network_security_group", ["network security group", "nsg"]),
    ("google_storage_bucket", ["gcp storage bucket", "uniform bucket-level access"]),
    ("google_compute_instance", ["compute engine", "vm instance"]),
    ("kubernetes_pod", ["kubernetes", "container", "pod"]),
    ("storage", ["publicly accessible cloud storage", "storage resources"]),
    ("networking", ["network segmentation", "http endpoint"]),
    ("secrets", ["password", "secret", "token", "key vault"]),
    ("identity", ["identity", "iam", "oidc", "rbac"]),
    ("compute", ["compute", "cluster", "lambda"]),
]
# Category of a resource type, then by needle.
TYPE_CATEGORIES = {
    "azurerm_storage_account": "storage", "aws_s3_bucket": "storage", "google_storage_bucket": "storage", "aws_security_group": "networking",
        "azurerm_network_security_group": "networking", "google_compute_firewall": "networking",
    "kubernetes_pod": "compute", "google_compute_instance": "compute", "aws_instance": "compute", "azurerm_linux_virtual_machine": "compute",
        "azurerm_user_assigned_identity": "identity", "service_account": "identity",
    "storage": "storage", "networking": "networking", "compute": "compute", "identity": "identity", "secrets": "secrets", "general": "general",
}


def built_in_rows() -> list[tuple]:
    return list(BUILT_IN)


def catalogue(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """The built-in rules, then extra ones (columns FIELDS); a later rule replaces an earlier one of its id."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(FIELDS, r, strict=True)]) for r in built_in_rows()])
    base = spark.range(1).select(F.inline(rows))
    if extra is None:
        return base
    return base.join(extra.select("rule_id"), "rule_id", "left_anti").select(*FIELDS).unionByName(extra.select(*FIELDS))


def normalise(rules: DataFrame) -> DataFrame:
    """FIELDS of raw rules (id, category, severity, title, description, indicators, references, resource_type, cloud_provider)."""
    raw = [F.coalesce(c, F.lit("")) for c in ("title", "description", "indicators", "references", "category")]
    probe, source = F.lower(F.concat_ws(" ", *raw)), F.lower(F.coalesce("category", F.lit("")))
    found = first_match(probe, RULE_TYPES, "general")
    kind = filled(F.col("resource_type"), F.when(found == "*storage", F.when(F.contains(probe, F.lit("azure")), "azurerm_storage_account").otherwise(
        "storage")).otherwise(found))
    both = F.concat(source, F.lit("\n"), probe)
    cloud = (
        F.when(F.contains(both, F.lit("azure")), "azure").when(contains_any(both, ["aws"]) | F.contains(probe, F.lit("s3")), "aws")
        .when(F.contains(source, F.lit("gcp")) | F.contains(probe, F.lit("google")), "gcp").when(F.contains(source, F.lit("k8s")) | F.contains(probe,
            F.lit("kubernetes")), "kubernetes").otherwise("generic")
    )
    by_type = F.try_element_at(F.create_map(*[F.lit(x) for kv in TYPE_CATEGORIES.items() for x in kv]), kind)
    by_text = first_match(probe, [("storage", ["storage", "bucket", "blob"]), ("secrets", ["secret", "password", "token"]), ("networking",
        ["network", "firewall", "security group"]), ("identity", ["identity", "iam", "role"]), ("compute", ["compute", "vm", "pod", "container"])], "general")
    group = F.when(source.isin("identity", "networking", "secrets", "compute", "storage"), source).otherwise(F.coalesce(by_type, by_text))
    return rules.select(
        F.col("id").alias("rule_id"), F.coalesce("category", F.lit("general")).alias("source_category"), F.upper(F.coalesce("severity",
            F.lit("INFO"))).alias("severity"),
        kind.alias("resource_type"), filled(F.col("cloud_provider"), cloud).alias("cloud_provider"), group.alias("category"), F.coalesce("title",
            F.lit("")).alias("title"),
    )


def rank_of(severity: Column) -> Column:
    return severity_rank(severity, SEVERITIES, 9)


def applicable(resources: DataFrame, rules: DataFrame) -> DataFrame:
    """resource columns and rule columns for every rule that holds for a resource (resource_type, cloud_provider, category).

    A resource looks up at most four pairs (kind, cloud): its type, or `general` if it has none, and its category, each for
    its cloud and for any. A rule has one pair, so it is met once, and both sides may be of any size.
    """
    r = rules.select(*[F.col(c).alias(f"_r_{c}") for c in FIELDS])
    cloud = F.lower(F.coalesce("_r_cloud_provider", F.lit("generic")))
    r = r.withColumns({"_kind": F.lower(F.coalesce("_r_resource_type", F.lit("general"))), "_cloud": F.when(cloud.isin("generic", "all", "unknown"),
        "*").otherwise(cloud)})
    own, cat = F.lower(F.coalesce("resource_type", F.lit(""))), F.lower(F.coalesce(F.nullif("category", F.lit("")), F.lit("general")))
    kinds = F.array_distinct(F.array(F.when(own != "", own).otherwise("general"), cat))
    clouds = F.array_distinct(F.array(F.lit("*"), F.lower(filled(F.col("cloud_provider"), F.lit("generic")))))
    asked = resources.withColumn("_kind", F.explode(kinds)).withColumn("_cloud", F.explode(clouds))
    return asked.join(r, ["_kind", "_cloud"]).drop("_kind", "_cloud")


def rule_score(rule_type: Column, resource_type: Column, rule_id: Column) -> Column:
    return F.when(F.lower(rule_type) == F.lower(resource_type), F.lit(0.95)).otherwise(F.lit(0.85)) + F.when(F.startswith(rule_id, F.lit("custom-")),
        F.lit(0.2)).otherwise(F.lit(0.0))


def rule_aware(resources: DataFrame, rules: DataFrame, k: int) -> DataFrame:
    """The k best rules for ranked resources (a `rank` column): the best score of each rule, ties to the earlier resource."""
    rows = applicable(resources, rules).withColumn("score", F.round(rule_score(F.col("_r_resource_type"), F.col("resource_type"), F.col("_r_rule_id")), 6))
    best = rows.groupBy("_r_rule_id").agg(F.max(F.struct("score", (-F.col("rank")).alias("_early"))).alias("_b"), F.first("_r_severity").alias("severity"))
    best = best.select(F.col("_r_rule_id").alias("rule_id"), "severity", F.col("_b.score").alias("score"))
    order = [F.desc("score"), rank_of(F.col("severity")), F.col("rule_id")]
    return best.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


DETAILS = ["description", "indicators", "remediation", "references"]


def documents(rules: DataFrame) -> DataFrame:
    """rules with DETAILS filled: what a rule lacks is said from its title, resource and provider."""
    have = [c if c in rules.columns else None for c in DETAILS]
    about = F.concat(F.col("title"), F.lit(" ("), F.col("resource_type"), F.lit(", "), F.col("cloud_provider"), F.lit(")."))
    stand_in = [about, F.concat(F.lit("Settings of "), F.col("resource_type"), F.lit(" that show: "), F.lower("title")),
        F.concat(F.lit("Change the "), F.col("category"), F.lit(" settings so that this no longer holds.")), F.lit("")]
    full = [(filled(F.col(c), d) if c else d).alias(name) for name, c, d in zip(DETAILS, have, stand_in, strict=True)]
    return rules.select(*FIELDS, *full)


def rule_text(rules: DataFrame) -> DataFrame:
    """rule_id, text: the document that rule search embeds, of the rule's eight fields."""
    upper = F.concat(F.lit("["), F.concat_ws(" | ", F.upper("category"), "severity", "cloud_provider", "resource_type"), F.lit("] "), F.col("title"))
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.col(c))
    return documents(rules).select("rule_id", F.concat_ws("\n\n", upper, "description", part("Indicators", "indicators"), part("Remediation",
        "remediation"), part("References", "references")).alias("text"))


class KnowledgeBase:
    """The rules with their texts and embeddings, kept in a folder."""

    def __init__(self, spark: SparkSession, folder: str, dimension: int = 64):
        self.spark, self.folder, self.dimension = spark, folder.rstrip("/"), dimension

    def _embedded(self, rules: DataFrame) -> DataFrame:
        return store.embed(documents(rules).join(rule_text(rules), "rule_id"), self.dimension)

    def rules(self) -> DataFrame:
        """The latest of each rule id."""
        rows = self.spark.read.parquet(self.folder)
        return rows.groupBy("rule_id").agg(F.max_by(F.struct(*rows.columns), "segment").alias("r")).select("r.*")

    def load_or_build(self, extra: DataFrame | None = None) -> int:
        """How many rules there are, after building the folder if it isn't there."""
        if not exists(self.spark, self.folder):
            self._embedded(catalogue(self.spark, extra)).withColumn("segment", F.lit(0)).write.parquet(self.folder)
        return self.rules().count()

    def add_rules(self, raw: DataFrame) -> int:
        """Adds raw rules (as normalise() takes them); returns how many. One with a known id replaces it."""
        rules = normalise(raw).join(raw.select(F.col("id").alias("rule_id"), *[c for c in DETAILS if c in raw.columns]), "rule_id")
        last = self.spark.read.parquet(self.folder).agg(F.max("segment")).first()[0]
        new = materialise(self._embedded(rules).withColumn("segment", F.lit(last + 1)), "rules")
        new.write.mode("append").parquet(self.folder)
        return new.count()

    def search(self, query: str, k: int = 7, where: dict | None = None) -> DataFrame:
        """The k nearest rules of a question."""
        asked = store.embed(self.spark.range(1).select(F.lit(query).alias("text")), self.dimension).select("embedding").first()[0]
        return search.vector_topk(self.rules(), list(asked), k, "rule_id", where)


def enrich(issues: DataFrame, top_rule: DataFrame) -> DataFrame:
    """Issues whose empty rule_id and rule_description are filled from the best rule (rule_id, title; one row or none)."""
    one = top_rule.select(F.col("rule_id").alias("_id"), F.col("title").alias("_title")).limit(1)
    rows = issues.join(F.broadcast(one), F.lit(True), "left")
    return rows.withColumn("rule_id", filled(F.col("rule_id"), F.coalesce("_id", F.lit("")))).withColumn("rule_description",
        filled(F.col("rule_description"), F.coalesce("_title", F.lit("")))).drop("_id", "_title")
