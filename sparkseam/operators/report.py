"""Issues to reports: normalise, deduplicate, order, count, judge by a policy, write."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkseam.functions.classify import filled
from sparkseam.functions.text import severity_rank
from sparkseam.operators.ranges import row_numbers
from sparkseam.operators.store import first_of_each
from sparkseam.session import spread
from sparkseam.sources.files import deep_merge, load_config

ISSUE = ["file_path", "rule_id", "issue", "line_number", "severity", "detector"]
REPORT_ORDER = ("CRITICAL", "HIGH", "MEDIUM", "LOW")
SARIF_LEVEL = {"CRITICAL": "error", "HIGH": "error", "MEDIUM": "warning", "LOW": "note"}
# The policy where none is given.
DEFAULT_POLICY = {"fail_on": {"high": True, "medium": False, "low": False}, "max_allowed": {"high": 0, "medium": 5, "low": 10}}


def normalise(issues: DataFrame) -> DataFrame:
    """Missing severity is LOW, a missing rule the detector's name, a missing line 0."""
    return issues.withColumns({
        "file_path": F.coalesce("file_path", F.lit("")), "severity": F.upper(filled(F.col("severity"), F.lit("LOW"))),
        "rule_id": filled(F.col("rule_id"), F.upper(F.coalesce("detector", F.lit("")))), "line_number": F.coalesce(F.col("line_number").cast("int"),
            F.lit(0)), "issue": F.coalesce("issue", F.lit("")),
    })


def dedup(issues: DataFrame, order: str) -> DataFrame:
    """The first issue of each (file, rule, issue, line, severity)."""
    return first_of_each(issues, ["file_path", "rule_id", "issue", "line_number", "severity"], order)


def rank_of(severity: Column) -> Column:
    return severity_rank(severity, REPORT_ORDER, 9)


def ordered(issues: DataFrame, tie: str) -> DataFrame:
    """issues with position in the report: severity, file, line, then tie. Ranges are numbered apart, so no task sees all rows."""
    rows = issues.withColumn("_severity", rank_of(F.col("severity")))
    return row_numbers(rows, [F.col(c) for c in ("_severity", "file_path", "line_number", tie)], "position").drop("_severity")


def severity_summary(issues: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("severity") == s)
    return issues.agg(F.count(F.lit(1)).alias("total"), n("CRITICAL").alias("critical"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"),
        n("LOW").alias("low"), F.countDistinct("file_path").alias("files"))


def five_buckets(issues: DataFrame) -> DataFrame:
    low = F.lower(F.coalesce("severity", F.lit("")))
    return issues.agg(*[F.count_if(low == s).alias(s) for s in ("critical", "high", "medium", "low", "info")])


def run(found: list[DataFrame], errors: DataFrame, order: str) -> tuple[DataFrame, DataFrame]:
    """Issues of all detectors and a one-row summary with the number of detector errors (file_path, detector)."""
    rows = found[0]
    for f in found[1:]:
        rows = rows.unionByName(f, allowMissingColumns=True)
    issues = dedup(normalise(rows), order)
    return issues, severity_summary(issues).crossJoin(F.broadcast(errors.agg(F.count(F.lit(1)).alias("errors"))))


# ---- policy


def policy_of(text: str | None, environment: str = "", overrides: dict | None = None, default: dict | None = None) -> dict:
    """Default, then the file, then its environment, then overrides. An unknown environment raises."""
    loaded = load_config(text)
    chosen = {}
    if environment:
        if environment not in (loaded.get("environments") or {}):
            raise ValueError(f"no environment named {environment}")
        chosen = loaded["environments"][environment]
    out = deep_merge(deep_merge(deep_merge(default or DEFAULT_POLICY, loaded), chosen), overrides or {})
    out.pop("environments", None)
    return out


def policy_frame(spark: SparkSession, policy: dict) -> DataFrame:
    """severity, fail_on, max_allowed for the four severities; without a limit critical and high allow none."""
    rows = []
    for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"):
        most = policy.get("max_allowed", {}).get(s.lower(), 0 if s in ("CRITICAL", "HIGH") else 999999)
        rows.append(F.struct(F.lit(s).alias("severity"), F.lit(bool(policy.get("fail_on", {}).get(s.lower(), False))).alias("fail_on"),
            F.lit(int(most or 0)).cast("long").alias("max_allowed")))
    return spark.range(1).select(F.inline(F.array(*rows)))


def settings(text: Column, environment: Column, over: Column) -> Column:
    """struct<policy: string, error: string> of policy_of() on each row: the merged policy as JSON, or why there is none.

    text: YAML or JSON, environment: a name or empty, over: overrides as JSON. Nulls count as empty. YAML has no expression in Spark, so this
    one step runs in Python, over Arrow batches.
    """

    @F.pandas_udf("policy string, error string")
    def merged(texts: pd.Series, names: pd.Series, overs: pd.Series) -> pd.DataFrame:
        def one(text, name, more):
            try:
                return json.dumps(policy_of(text, name or "", load_config(more)), default=str), None
            except (ValueError, TypeError, AttributeError, RecursionError) as e:  # no such environment, a part that isn't a mapping, too deep
                return None, str(e)[:200]

        return pd.DataFrame([one(*row) for row in zip(texts, names, overs, strict=True)], columns=["policy", "error"])

    return merged(*[F.coalesce(c, F.lit("")) for c in (text, environment, over)])


def policies(rows: DataFrame, key: str) -> DataFrame:
    """key, severity, fail_on, max_allowed, error: the four limits of each row's policy (key, text, environment, overrides); a policy that
    can't be merged is one row with its error."""
    kind = "fail_on map<string,string>, max_allowed map<string,string>"
    each = spread(rows.select(key, "text", "environment", "overrides")).select(key, settings(F.col("text"), F.col("environment"), F.col("overrides")).alias("_s"))
    each = each.select(key, F.col("_s.error").alias("error"), F.from_json("_s.policy", kind).alias("_p"))
    limits = []
    for s in ("CRITICAL", "HIGH", "MEDIUM", "LOW"):
        most, fails = F.try_element_at("_p.max_allowed", F.lit(s.lower())), F.try_element_at("_p.fail_on", F.lit(s.lower()))
        named = F.coalesce(F.map_contains_key("_p.max_allowed", s.lower()), F.lit(False))
        limits.append(F.struct(F.lit(s).alias("severity"), (~F.coalesce(fails, F.lit("")).isin("", "false", "0", "null", "{}", "[]")).alias("fail_on"),
            F.when(named, F.coalesce(most.try_cast("double").try_cast("bigint"), F.lit(0))).otherwise(0 if s in ("CRITICAL", "HIGH") else 999999).cast("long").alias("max_allowed")))
    none = F.struct(F.lit(None).cast("string").alias("severity"), F.lit(None).cast("boolean").alias("fail_on"), F.lit(None).cast("long").alias("max_allowed"))
    return each.select(key, F.inline(F.when(F.col("error").isNull(), F.array(*limits)).otherwise(F.array(none))), "error")


def overrides_json(fails: Column, limits: Column) -> Column:
    """overrides() on each row as JSON: fails array<string>, limits map<string,bigint>; nulls count as empty."""
    low = F.array_distinct(F.transform(F.coalesce(fails, F.array().cast("array<string>")), lambda x: F.lower(x)))
    on = F.map_from_arrays(low, F.transform(low, lambda x: F.lit(True)))
    most = F.transform_keys(F.coalesce(limits, F.create_map().cast("map<string,bigint>")), lambda k, v: F.lower(k))
    return F.when((F.size(on) > 0) | (F.size(most) > 0), F.to_json(F.struct(on.alias("fail_on"), most.alias("max_allowed")))).otherwise("{}")


def evaluate_each(issues: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """evaluate() for each key by its own limits (policies()): key, severity, count, max_allowed, violated, reason. A policy with an error isn't judged."""
    counts = issues.groupBy(key, "severity").agg(F.count(F.lit(1)).alias("_c"))
    rows = limits.filter("severity is not null").join(counts, [key, "severity"], "left").withColumn("count", F.coalesce("_c", F.lit(0)))
    reason = violation(F.col("count"), F.col("fail_on"), F.col("max_allowed"))
    return rows.withColumn("reason", reason).select(key, "severity", "count", "max_allowed", (F.col("reason") != "").alias("violated"), "reason")


def violation(count: Column, fail_on: Column, most: Column) -> Column:
    return F.when(count <= 0, "").when(fail_on, "zero tolerance").when(count > most, "over the limit").otherwise("")


def evaluate(issues: DataFrame, policy: DataFrame) -> DataFrame:
    """severity, count, max_allowed, violated, reason for every severity of the policy."""
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("_c"))
    rows = policy.join(counts, "severity", "left").withColumn("count", F.coalesce("_c", F.lit(0))).drop("_c")
    reason = violation(F.col("count"), F.col("fail_on"), F.col("max_allowed"))
    return rows.withColumn("reason", reason).select("severity", "count", "max_allowed", (F.col("reason") != "").alias("violated"), "reason")


def violation_files(issues: DataFrame, verdict: DataFrame) -> DataFrame:
    """severity, file_path of violated severities, each once."""
    return issues.filter(F.col("file_path") != "").select("severity", "file_path").distinct().join(F.broadcast(verdict.filter("violated").select(
        "severity")), "severity", "left_semi")


def exit_code(errors: Column, failed: Column, high: Column, fail_on_high: bool = False) -> Column:
    return F.when(errors > 0, 2).when(failed, 1).when(F.lit(fail_on_high) & (high > 0), 1).otherwise(0)


# ---- sinks


def sarif_results(issues: DataFrame, critical_as_note: bool = False) -> DataFrame:
    """rule, level, uri, start_line, message of every issue."""
    levels = SARIF_LEVEL | ({"CRITICAL": "note"} if critical_as_note else {})
    level = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv]), F.upper("severity")), F.lit("note"))
    rule = filled(F.col("rule_id"), filled(F.col("detector"), F.lit("SPARKSEAM")))
    return issues.select(rule.alias("rule"), level.alias("level"), F.replace("file_path", F.lit("\\"), F.lit("/")).alias("uri"),
        F.greatest(F.coalesce(F.col("line_number").cast("int"), F.lit(1)), F.lit(1)).alias("start_line"), F.col("issue").alias("message"))


def sarif_rules(issues: DataFrame, order: str) -> DataFrame:
    """rule, name, detector: the first issue of each rule."""
    rule = filled(F.col("rule_id"), filled(F.col("detector"), F.lit("SPARKSEAM")))
    return issues.groupBy(rule.alias("rule")).agg(F.min(F.struct(order, "issue", "detector")).alias("f")).select("rule",
        F.col("f.issue").alias("name"), F.col("f.detector").alias("detector"))


def sarif_document(issues: DataFrame, order: str) -> DataFrame:
    """One row, document: a whole SARIF 2.1.0 report, for a report that fits a row; write_sarif writes one of any size."""
    rules = sarif_rules(issues, order).agg(F.sort_array(F.collect_list(F.struct(F.col("rule").alias("id"), F.col("name"),
        F.struct(F.col("detector")).alias("properties")))).alias("rules"))
    place = F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias(
        "physicalLocation"))
    found = sarif_results(issues).select(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations")).alias("r"), "rule", "uri", "start_line", "message")
    found = found.agg(F.sort_array(F.collect_list(F.struct("rule", "uri", "start_line", "message", "r"))).alias("all")).select(F.transform("all",
        lambda x: x["r"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit("sparkseam").alias("name"), F.col("rules")).alias("driver")).alias("tool"), F.col("results"))
    return found.crossJoin(rules).select(F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


def write_sarif(issues: DataFrame, order: str, path: str) -> None:
    """One JSON line for each result and rule, in parts: a report of any size is written where its rows are."""
    sarif_results(issues).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/results")
    sarif_rules(issues, order).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(f"{path}/rules")
    head = json.dumps({"version": "2.1.0", "runs": [{"tool": {"driver": {"name": "sparkseam"}}}]})
    issues.sparkSession.range(1).select(F.lit(head).alias("value")).write.mode("overwrite").text(f"{path}/head")


#: Places of the pieces of a document written in parts.
HEAD, RULES, MIDDLE, RESULTS, TAIL = range(5)


def sarif_parts(issues: DataFrame, order: str) -> DataFrame:
    """section, position, line: a whole SARIF document as rows, one for each rule and result, in the order they are written in.

    A line after the first of its section begins with its comma, so any cut between rows gives pieces that only need
    joining. Numbers come from ranges, so no task holds the issues; equal issues are different results.
    """
    rules = row_numbers(sarif_rules(issues, order), [F.col("rule")], "position")
    rule = F.to_json(F.struct(F.col("rule").alias("id"), "name", F.struct("detector").alias("properties")))
    place = F.struct(F.struct(F.struct("uri").alias("artifactLocation"), F.struct(F.col("start_line").alias("startLine")).alias("region")).alias(
        "physicalLocation"))
    keys = ["rule", "uri", "start_line", "message", "level"]
    results = row_numbers(sarif_results(issues), [F.col(k) for k in keys], "position")
    result = F.to_json(F.struct(F.col("rule").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"),
        F.array(place).alias("locations")))
    comma = F.when(F.col("position") > 1, ",").otherwise("")
    fixed = [(HEAD, '{"version":"2.1.0","runs":[{"tool":{"driver":{"name":"sparkseam","rules":['), (MIDDLE, ']}},"results":['), (TAIL, "]}]}")]
    ends = issues.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(n).alias("section"), F.lit(0).cast("long").alias("position"),
        F.lit(text).alias("line")) for n, text in fixed])))
    return ends.unionByName(rules.select(F.lit(RULES).alias("section"), "position", F.concat(comma, rule).alias("line"))).unionByName(
        results.select(F.lit(RESULTS).alias("section"), "position", F.concat(comma, result).alias("line")))


def write_sarif_parts(issues: DataFrame, order: str, path: str) -> None:
    """One SARIF document of any size: the part files of the folder, joined in the order of their names."""
    sarif_parts(issues, order).orderBy("section", "position").select("line").write.mode("overwrite").text(path)


def write_sarif_document(issues: DataFrame, order: str, path: str) -> None:
    sarif_document(issues, order).coalesce(1).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def console(issues: DataFrame, summary: DataFrame, tie: str, most: int = 5) -> DataFrame:
    """line_number, line: the head of the report and the first issues (a top-k)."""
    top = issues.orderBy(rank_of(F.col("severity")), "file_path", "line_number", tie).limit(most)
    w = Window.orderBy(rank_of(F.col("severity")), "file_path", "line_number", tie)
    listed = top.select((F.row_number().over(w) + 2).alias("line_number"), F.format_string("- [%s] %s (%s)", "severity", "issue",
        filled(F.col("file_path"), F.lit("unknown file"))).alias("line"))
    head = summary.select(F.lit(1).alias("line_number"), F.format_string("Total issues: %d", "total").alias("line")).unionByName(
        summary.select(F.lit(2).alias("line_number"), F.format_string("CRITICAL: %d  HIGH: %d  MEDIUM: %d  LOW: %d", "critical", "high", "medium",
            "low").alias("line")))
    return head.unionByName(listed)


def console_policy(issues: DataFrame, summary: DataFrame, verdict: DataFrame, most_files: int = 5) -> DataFrame:
    """line_number, line: what the report says about the policy. verdict: evaluate()'s rows; with detector errors it isn't judged."""
    failed = verdict.agg(F.coalesce(F.bool_or("violated"), F.lit(False)).alias("failed")).crossJoin(F.broadcast(summary.select("errors")))
    judged = F.when(F.col("errors") > 0, "NOT EVALUATED").when(F.col("failed"), "FAIL").otherwise("PASS")
    head = failed.select(F.lit(1).alias("line_number"), F.concat(F.lit("Build policy: "), judged).alias("line"))
    place = (rank_of(F.col("severity")) * 2).cast("int")
    files = violation_files(issues, verdict).withColumn("_n", F.row_number().over(Window.partitionBy("severity").orderBy("file_path"))).filter(
        F.col("_n") <= most_files)
    files = files.groupBy("severity").agg(F.array_join(F.sort_array(F.collect_list("file_path")), ", ").alias("files"))
    bad = verdict.filter("violated").join(files, "severity", "left").crossJoin(F.broadcast(failed.filter("errors = 0").select("errors")))
    said = bad.select((place + 2).alias("line_number"), F.format_string("- %s: %d found, %d allowed (%s)", "severity", "count", "max_allowed",
        "reason").alias("line"))
    where = bad.select((place + 3).alias("line_number"), F.format_string("  in %s", F.coalesce("files", F.lit("no files recorded"))).alias("line"))
    return head.unionByName(said).unionByName(where)


def overrides(fail_on: list[str] = (), max_allowed: dict[str, int] | None = None) -> dict:
    """What a command line sets over a policy: severities that fail at once, and limits; empty where it sets nothing."""
    out = {"fail_on": {s.lower(): True for s in fail_on}, "max_allowed": {s.lower(): int(n) for s, n in (max_allowed or {}).items()}}
    return out if out["fail_on"] or out["max_allowed"] else {}


def listing(issues: DataFrame, tie: str, most_chars: int = 200) -> DataFrame:
    """position, line: every issue as a printed line in the report's order, its text clipped."""
    place = F.concat(filled(F.col("file_path"), F.lit("unknown file")), F.when(F.col("line_number") > 0, F.concat(F.lit(":"), F.col("line_number").cast("string"))).otherwise(""))
    clip = F.when(F.length("issue") > most_chars, F.concat(F.substring("issue", 1, most_chars), F.lit("..."))).otherwise(F.col("issue"))
    return ordered(issues, tie).select("position", F.concat_ws(" ", F.concat(F.lit("["), F.col("severity"), F.lit("]")), F.col("rule_id"), place, F.lit("-"), clip).alias("line"))


def sources(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct files of retrieved chunks and findings."""
    return chunks.select("file_path").unionByName(found.select("file_path")).filter("file_path <> ''").distinct()


def retrieval_confidence(code: DataFrame, n_rules: DataFrame, k_code: int, k_rules: int) -> DataFrame:
    """One row: half chunk coverage, 0.3 mean of the three best scores, 0.2 rule coverage. code: rank, final_score; n_rules: n."""
    a = code.agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.avg(F.when(F.col("rank") <= 3, F.col("final_score"))), F.lit(0.0)).alias("t"))
    score = 0.5 * F.least(F.col("c") / max(k_code, 1), F.lit(1.0)) + 0.3 * F.col("t") + 0.2 * F.least(F.col("n") / max(k_rules, 1), F.lit(1.0))
    return a.crossJoin(F.broadcast(n_rules.select("n"))).select(F.round(F.least(score, F.lit(1.0)), 3).alias("confidence"))


def cache_stats(entries: DataFrame, now: Column) -> DataFrame:
    """total, live (now before expiry) and expired entries."""
    live = F.count_if(now < F.col("expiry"))
    return entries.agg(F.count(F.lit(1)).alias("total"), live.alias("live"), (F.count(F.lit(1)) - live).alias("expired"))
