"""Over-permission findings of role assignments.

Columns in: ord, identity_name, identity_type, role, scope_type, scope_value, file_path, block_name. The pair rules
match classes of equal assignments of one identity on the pieces that make a pair possible (the same scope, or one scope
as an ancestor path of the other), not every pair of an identity's assignments.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions.text import severity_rank

# Role sets, privilege and scope orders, alternatives.
HIGH_ROLES = ["Owner", "User Access Administrator", "Co-Administrator"]
SERVICE_WIDE = ["Storage Account Contributor", "Storage Blob Data Contributor", "Storage Queue Data Contributor", "Virtual Machine Contributor",
    "Network Contributor", "Key Vault Secrets Officer", "Monitoring Contributor", "SQL DB Contributor"]
PRIVILEGE = {
    "Owner": 4, "User Access Administrator": 4, "Co-Administrator": 4, "Contributor": 3, "Storage Account Contributor": 3,
        "Virtual Machine Contributor": 3, "Network Contributor": 3, "Security Admin": 3,
    "Key Vault Secrets Officer": 3, "Storage Blob Data Contributor": 2, "Storage Queue Data Contributor": 2, "Reader": 1,
        "Storage Blob Data Reader": 1, "Key Vault Reader": 1,
}
SCOPES = {"subscription": 0, "resource_group": 1, "resource": 2, "unknown": 3}
NARROWER = {"subscription": "resource_group", "resource_group": "resource", "resource": "resource", "unknown": "resource_group"}
ALTERNATIVES = {
    "Owner": ["Contributor", "Reader", "User Access Administrator"],
    "User Access Administrator": ["Reader", "Contributor"],
    "Co-Administrator": ["Contributor", "Reader"],
    "Contributor": ["Reader", "Storage Blob Data Contributor", "Virtual Machine Contributor", "Key Vault Secrets User", "Network Contributor",
        "SQL DB Contributor"],
    "Network Contributor": ["Reader", "Network Watcher Contributor"],
    "Storage Account Contributor": ["Storage Blob Data Contributor", "Storage Blob Data Reader", "Storage Queue Data Contributor"],
    "Virtual Machine Administrator Login": ["Virtual Machine User Login", "Virtual Machine Contributor"],
    "Security Admin": ["Security Reader"],
}
FINDING = ["rule_id", "identity", "role", "scope", "scope_value", "severity", "issue", "recommendations", "file_path", "block_name", "ord"]


def number(key: Column, table: dict, default: int) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def narrower(scope: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in NARROWER.items() for x in kv]), scope), F.lit("resource_group"))


def suggested_roles(role: Column, hint: Column) -> Column:
    """Up to four alternatives, those that share a word with the hint first, each part in its order."""
    pairs = [x for k, v in ALTERNATIVES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]
    options = F.coalesce(F.try_element_at(F.create_map(*pairs), role), F.array(F.lit("Reader")))
    words = F.filter(F.split(F.lower(F.coalesce(hint, F.lit(""))), r"\s+"), lambda w: w != "")
    fits = lambda x: F.exists(words, lambda w: F.contains(F.lower(x), w))
    return F.slice(F.concat(F.filter(options, fits), F.filter(options, lambda x: ~fits(x))), 1, 4)


def finding(rows: DataFrame, rule, severity, issue, recommendations, role="role", scope="scope_type", value="scope_value") -> DataFrame:
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return rows.select(c(rule).alias("rule_id"), F.col("identity_name").alias("identity"), c(role).alias("role"), c(scope).alias("scope"),
        c(value).alias("scope_value"), c(severity).alias("severity"), c(issue).alias("issue"), c(recommendations).alias("recommendations"),
        "file_path", "block_name", F.col("ord").cast("long").alias("ord"))


def rule_chain(rows: DataFrame) -> DataFrame:
    """At most one finding for each assignment: the first rule that holds."""
    high, wide = F.col("role").isin(HIGH_ROLES), F.col("scope_type").isin("subscription", "unknown")
    rule = F.when(high & wide, "IAM-AZ-001").when((F.col("role") == "Contributor") & wide, "IAM-AZ-002").when((F.col("role") == "Contributor") & (
        F.col("scope_type") == "resource_group"), "IAM-AZ-003").when(high, "IAM-AZ-004")
    rows = rows.withColumn("_rule", rule).filter("_rule is not null")
    issue = F.concat(F.lit("'"), F.col("role"), F.lit("' at "), F.col("scope_type"), F.lit(" scope"))
    return finding(rows, "_rule", F.when(F.col("_rule") == "IAM-AZ-003", "MEDIUM").otherwise("HIGH"), issue, suggested_roles(F.col("role"),
        F.col("identity_name")))


def multi_role(rows: DataFrame, most: int = 3) -> DataFrame:
    """Identities with more than `most` assignments; roles in assignment order.

    The finding names all roles of an identity, so these are gathered in one row; counting comes first, and only
    identities above the limit are gathered.
    """
    many = rows.groupBy("identity_name").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("ord", "scope_type", "file_path")).alias("_f")).filter(F.col("_n") > most)
    # only what is gathered is moved with each assignment; the first one's scope and file come with the count
    g = rows.select("identity_name", "ord", "role").join(many.select("identity_name"), "identity_name", "left_semi")
    g = g.groupBy("identity_name").agg(F.sort_array(F.collect_list(F.struct("ord", "role"))).alias("_r")).join(many, "identity_name")
    g = g.select("identity_name", F.array_join(F.transform("_r", lambda x: x["role"]), ", ").alias("role"),
        F.col("_f.scope_type").alias("scope_type"), F.col("_f.file_path").alias("file_path"), F.lit("").alias("block_name"), F.col("_f.ord").alias("ord"), "_n")
    issue = F.concat(F.lit("Identity '"), F.col("identity_name"), F.lit("' has "), F.col("_n").cast("string"), F.lit(" role assignments"))
    return finding(g, F.lit("IAM-AZ-005"), F.lit("MEDIUM"), issue, F.array(F.lit("Audit and consolidate role assignments")), value=F.lit(""))


def path_of(scope: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(scope, F.lit(""))), "/+$", "")


def ancestors(path: Column) -> Column:
    """The path and every path above it."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")), lambda x: x != "")


def scope_order(scope: Column) -> Column:
    return number(scope, SCOPES, 99)


def overlap(rows: DataFrame) -> DataFrame:
    """Pairs of one identity on the same or nested scopes where one role covers the other; the first pair of each (identity, roles, scope).

    Assignments that agree on identity, role and scope are one class with its first and last assignment. Pairs are formed
    between classes, not assignments, so their number doesn't grow with how often a role is assigned. Of a pair of roles
    of different privilege the first assignments of both classes are the first pair; of one role the first assignment of
    a class, if one of its partner's comes later, covers the partner's. Where the covering assignment has no file or
    block, the partner's stand in.
    """
    one = F.struct("ord", "file_path", "block_name")
    classes = rows.groupBy("identity_name", "role", "scope_type", "scope_value").agg(F.min(one).alias("lo"), F.max(one).alias("hi"))
    # a scope of slashes alone has no path and meets only its equals
    path = path_of(F.col("scope_value"))
    classes = classes.select("identity_name", F.when(path != "", path).otherwise(F.col("scope_value")).alias("_at"), (path != "").alias("_deep"),
        F.struct("role", "scope_type", "scope_value", "lo", "hi").alias("_class")).filter("identity_name is not null and _at <> ''")
    # an identity's classes, few against its rows, are moved once: what they hold for the paths above them and their pairs is never moved
    paths = F.when(F.col("_deep"), ancestors(F.col("_at"))).otherwise(F.array("_at"))
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes that become many pairs aren't put together
    deep = classes.repartition(tasks, "identity_name").select("identity_name", "_at", "_class", F.explode(paths).alias("_path"))
    met = deep.groupBy("identity_name", "_path").agg(F.collect_list(F.when(F.col("_path") == F.col("_at"), F.col("_class"))).alias("_x"), F.collect_list("_class").alias("_y"))
    # equal scopes meet where nested ones do
    pairs = met.select("identity_name", "_y", F.explode("_x").alias("x")).select("identity_name", "x", F.explode("_y").alias("y"))
    order = lambda c: F.struct(F.col(f"{c}.role"), F.col(f"{c}.scope_type"))
    same = (F.col("x.scope_value") == F.col("y.scope_value")) & (order("x") <= order("y"))
    pairs = pairs.filter(same | (scope_order(F.col("x.scope_type")) < scope_order(F.col("y.scope_type"))))
    level = lambda c: number(F.col(f"{c}.role"), PRIVILEGE, 0)
    gap, alike = level("x") - level("y"), F.col("x.role") == F.col("y.role")

    def covers(holds: Column, d: str, e: str) -> Column:
        """The place of the pair, its covering class, the class it covers and that class's assignment in the pair; null if d doesn't cover e."""
        first, second = F.col(f"{d}.lo"), F.col(f"{e}.lo")
        met = F.when(alike & (second["ord"] <= first["ord"]), F.col(f"{e}.hi")).otherwise(second)
        at = F.struct(F.least(first["ord"], met["ord"]).alias("a"), F.greatest(first["ord"], met["ord"]).alias("b"))
        return F.when(holds, F.struct(at.alias("_at"), F.col(d).alias("d"), F.col(e).alias("e"), met.alias("_met")))

    later = lambda d, e: F.col(f"{d}.lo.ord") < F.col(f"{e}.hi.ord")
    both = F.array(covers(F.when(alike, later("x", "y")).otherwise(gap > 0), "x", "y"), covers(F.when(alike, later("y", "x")).otherwise(gap < 0), "y", "x"))
    # one pass over the pairs: each gives up to two coverings
    out = pairs.select("identity_name", F.inline(F.array_compact(both)))
    value = F.coalesce(F.nullif("d.scope_value", F.lit("")), F.col("e.scope_value"))
    fill = lambda c: F.coalesce(F.nullif(f"d.lo.{c}", F.lit("")), F.col(f"_met.{c}"))
    out = out.select("identity_name", F.col("d.role").alias("_d"), F.col("e.role").alias("_e"), value.alias("scope_value"), F.struct("_at",
        F.col("d.scope_type").alias("scope_type"), fill("file_path").alias("file_path"), fill("block_name").alias("block_name")).alias("_f"))
    out = out.groupBy("identity_name", "_d", "_e", "scope_value").agg(F.min("_f").alias("_f"))
    out = out.select("identity_name", F.concat("_d", F.lit(" + "), "_e").alias("role"), F.col("_f.scope_type").alias("scope_type"), "scope_value",
        F.col("_f.file_path").alias("file_path"), F.col("_f.block_name").alias("block_name"), F.col("_f._at.a").alias("ord"))
    return finding(out, F.lit("IAM-AZ-007"), F.lit("MEDIUM"), F.lit("Overlapping role assignments for one identity"),
        F.array(F.lit("Audit and remove overlapping role assignments")))


def broad_redundant(rows: DataFrame) -> DataFrame:
    """Assignments that a narrower one of the same identity and role makes needless.

    What matters of all scopes at or below a path is only how narrow the narrowest type there is, so one row for each
    (identity, role, path) is joined.
    """
    path = path_of(F.col("scope_value"))
    rows = rows.select("ord", "identity_name", "role", "scope_type", "file_path", "block_name", path.alias("_path"),
        F.when(F.col("scope_value") != path, F.col("scope_value")).alias("_written"))  # the path stands for a scope that equals it
    # classes first: only one row for each (identity, role, path) walks up its path
    deep = rows.groupBy("identity_name", "role", "_path").agg(F.max(scope_order(F.col("scope_type"))).alias("_o"))
    deep = deep.select("identity_name", "role", F.explode(ancestors(F.col("_path"))).alias("_path"), "_o")
    deep = deep.groupBy("identity_name", "role", "_path").agg(F.max("_o").alias("_narrowest"))
    # no scope of the narrowest type there is lies above a narrower one, so its rows needn't be shuffled
    top = F.broadcast(rows.agg(F.max(scope_order(F.col("scope_type"))).alias("_top")))
    out = rows.filter("_path <> ''").join(top, scope_order(F.col("scope_type")) < F.col("_top")).drop("_top")
    out = out.join(deep, ["identity_name", "role", "_path"]).filter(scope_order(F.col("scope_type")) < F.col("_narrowest")).withColumn("scope_value",
        F.coalesce("_written", "_path"))
    severity = F.when(F.col("scope_type") == "subscription", "MEDIUM").otherwise("LOW")
    advice = F.array(F.concat(F.lit("Reduce scope from "), F.col("scope_type"), F.lit(" to "), narrower(F.col("scope_type"))))
    return finding(out, F.lit("IAM-AZ-008"), severity, F.lit("Role assigned at broader scope than necessary"), advice)


def service_wide(rows: DataFrame) -> DataFrame:
    out = rows.filter(F.col("role").isin(SERVICE_WIDE) & F.col("scope_type").isin("subscription", "resource_group"))
    severity = F.when(F.col("scope_type") == "subscription", "MEDIUM").otherwise("LOW")
    return finding(out, F.lit("IAM-AZ-009"), severity, F.lit("Broad service-wide access role assignment"), suggested_roles(F.col("role"), F.lit("")))


def analyse(rows: DataFrame, most: int = 3) -> DataFrame:
    """All findings with seq, the order of the report: severity, then rule group, then assignment order."""
    parts = [rule_chain(rows), multi_role(rows, most), overlap(rows), broad_redundant(rows), service_wide(rows)]
    out = parts[0].withColumn("part", F.lit(0))
    for i, p in enumerate(parts[1:], 1):
        out = out.unionByName(p.withColumn("part", F.lit(i)))
    return out.withColumn("severity_rank", severity_rank(F.col("severity"), ("HIGH", "MEDIUM", "LOW"), 3))


def merge_model(found: DataFrame, extra: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Findings, then a model's findings whose lower-case keys are new, each once; severity LOW and the rule id by default."""
    low = lambda rows, p: rows.withColumns({f"{p}{k}": F.lower(F.coalesce(k, F.lit(""))) for k in keys})
    marks = [f"_k{k}" for k in keys]
    known = low(found, "_k").select(*marks).distinct()
    first = Window.partitionBy(*marks).orderBy("ord")
    new = low(extra, "_k").join(known, marks, "left_anti").withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", *marks)
    new = new.withColumn("rule_id", F.lit(rule)).withColumn("severity", F.coalesce(F.nullif(F.upper("severity"), F.lit("")), F.lit("LOW")))
    return found.unionByName(new.select(*[c for c in found.columns if c in new.columns]), allowMissingColumns=True)


def summary(found: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(F.count(F.lit(1)).alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"),
        F.array_join(F.sort_array(F.collect_set("file_path")), ",").alias("files"))
