"""URL filters by hashed host-suffix and path-prefix expressions.

Each URL is expanded into every (host suffix, path prefix) expression that some rule could equal: suffixes on label
boundaries, limited to label counts that rules have, and prefixes limited to path lengths that rules have. Both sets
are small whatever the number of rules, and no possible match is left out. Expressions meet the rules in an equi-join
on the first PREFIX_HEX hex digits of their SHA-256; the full digest then confirms, and the longest rule wins.

Defined results: a null URL or one without "://" has an empty host and path, no rule and the default verdict. Repeated
rows keep one result row each. An empty rule table gives every row the default verdict; an empty URL table no rows.
Rules of equal length: the longer host, then block before allow, then the smaller string. Columns besides the id and the URL are not
carried, so their names can't clash. Very long URLs are expanded like others: at most as many expressions as rules have
label counts times path lengths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PREFIX_HEX = 8
#: Rules are broadcast up to this count (about 200 bytes each); beyond it the join shuffles and AQE splits hot keys.
BROADCAST_RULES = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """(action, rule) pairs as a table built by the JVM."""
    if not rules:
        return spark.range(0).select(F.lit("").alias("action"), F.lit("").alias("rule"))
    rows = [F.struct(F.lit(a).alias("action"), F.lit(r).alias("rule")) for a, r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ://, up to / ? # or end; A-Z lower-cased) and path (then up to ? # or end)."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow",
    broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """id_col, host, path, rule, verdict for every row of urls. rules: (action, rule), a rule as host/path-prefix."""
    host, path = host_path(F.col("_url"))
    rows = urls.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url")).select("_id", "_url", host.alias("_host"), path.alias("_path"))
    cut = F.instr("rule", "/")
    known = (
        rules.select("action", "rule")
        .filter(F.col("rule").isNotNull() & (cut > 0))
        .select("action", "rule", F.translate(F.substr("rule", F.lit(1), cut - 1), UPPER, LOWER).alias("rule_host"), F.substr("rule", cut).alias("rule_path"))
        .withColumn("digest", F.sha2(F.concat("rule_host", "rule_path"), 256))
        .withColumn("short", F.left("digest", F.lit(PREFIX_HEX)))
    )
    seen = known.agg(
        F.count(F.lit(1)).alias("n"),
        F.collect_set(F.length("rule_path")).alias("lengths"),
        F.collect_set(F.size(F.split("rule_host", r"\."))).alias("labels"),
    ).first()
    if not seen["n"]:
        return rows.select(F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
            F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    known = F.broadcast(known) if seen["n"] <= broadcast_rules else known

    parts = F.split("_host", r"\.")
    labels = F.filter(F.array(*map(F.lit, sorted(seen["labels"]))), lambda n: n <= F.size(parts))
    suffixes = F.transform(labels, lambda n: F.call_function("substring_index", F.col("_host"), F.lit("."), -n))
    lengths = F.filter(F.array(*map(F.lit, sorted(seen["lengths"]))), lambda n: n <= F.length("_path"))
    each = rows.select("_id", "_url", F.explode(suffixes).alias("_suffix"), "_path").select("_id", "_url", F.col("_suffix"), "_path",
        F.explode(lengths).alias("_n"))
    each = each.select("_id", "_url", F.sha2(F.concat("_suffix", F.left("_path", F.col("_n"))), 256).alias("_digest"))
    each = each.withColumn("_short", F.left("_digest", F.lit(PREFIX_HEX)))
    # the digest is confirmed after the join; as an equality it would become part of the join's key
    hits = each.join(known, each["_short"] == known["short"]).filter(F.nullif("_digest", "digest").isNull())
    order = F.struct(F.length("rule"), F.length("rule_host"), (F.col("action") == "block").cast("int"))
    # a smaller string must win the last tie, so the maximum is taken without it and ties go to the smallest rule
    best = hits.groupBy("_id", "_url").agg(F.max(order).alias("_top"), F.collect_set(F.struct(order.alias("o"), F.col("rule"), F.col("action"))).alias("_all"))
    best = best.select(F.col("_id").alias("_bid"), F.col("_url").alias("_burl"), F.array_min(F.transform(F.filter("_all",
        lambda x: x["o"] == F.col("_top")), lambda x: F.struct(x["rule"], x["action"]))).alias("_best"))
    return rows.join(best, rows["_id"].eqNullSafe(best["_bid"]) & (rows["_url"] == best["_burl"]), "left").select(
        F.col("_id").alias(id_col), F.col("_host").alias("host"), F.col("_path").alias("path"),
        F.col("_best")["rule"].alias("rule"), F.coalesce(F.col("_best")["action"], F.lit(default)).alias("verdict"),
    )


RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


ORACLE = """
with u as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path, row_number() over () as r from u),
k(action, rule, rh, rp) as (values ('allow','org/','org','/'), ('block','example.org/es/','example.org','/es/'), ('block','example.org/en/1','example.org','/en/1'), ('allow','com/fr/','com','/fr/'), ('block','com/de/','com','/de/')),
m as (select r, action, rule, row_number() over (partition by r order by length(rule) desc, length(rh) desc, (action = 'block')::int desc, rule) as p
  from h join k on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from h left join (select * from m where p = 1) using (r)
"""
