"""Whole analyses of one kind over files of the given tables, a model's findings beside those by rule, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkseam.operators import analysers, federation
from sparkseam.plans import detector_queries as dq
from sparkseam.plans.fixtures import pick, pick_sql
from sparkseam.session import read_table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


_COUNTS = "count(*) as total, count(*) filter (where severity = 'HIGH') as high, count(*) filter (where severity = 'MEDIUM') as medium, count(*) filter (where severity = 'LOW') as low"

# ---- federation: a model names findings of the suppliers' settings again in other letters, and others of its own, twice each

_SAID_ISSUES = [federation.RULES[2][2].upper(), "Issuer unknown to us", "issuer UNKNOWN to us"]
_BY_RULE = " ".join(f"when '{r}' then '{i}'" for r, _, i in federation.RULES)
_FED = f"""r as (select identity, rule_id, severity, case rule_id {_BY_RULE} end as issue from ({dq.SQL['federation_findings']})),
m0 as (select c_custkey as ord, 'APP' || c_custkey as identity, {pick_sql(_SAID_ISSUES, 'c_custkey')} as issue, case when c_custkey % 2 = 0 then '' else 'medium' end as severity from customer),
m as (select * from m0 union all select 1000000 + ord, lower(identity), issue, 'high' from m0),
n as (select *, row_number() over (partition by lower(identity), lower(issue) order by ord) as p from m
 where not exists (select 1 from r where lower(r.identity) = lower(m.identity) and lower(r.issue) = lower(m.issue))),
f as (select identity, rule_id, severity, issue from r union all select identity, 'WID-LLM', upper(coalesce(nullif(severity, ''), 'LOW')), issue from n where p = 1)"""


def said_of_trust(spark, sf):
    k = F.col("c_custkey")
    once = read_table(spark, sf, "customer").select(k.alias("ord"), F.concat(F.lit("APP"), k).alias("identity"), pick(_SAID_ISSUES, k).alias("issue"),
        F.when(k % 2 == 0, "").otherwise("medium").alias("severity"))
    return once.unionByName(once.select((F.col("ord") + 1000000).alias("ord"), F.lower("identity").alias("identity"), "issue", F.lit("high").alias("severity")))


def trust(spark, sf):
    return analysers.analyse("workload_identity", dq.fed_files(spark, sf), said_of_trust(spark, sf))


@query("federation_analysis", f"with {_FED} select identity, rule_id, severity, issue from f")
def federation_analysis(spark, sf):
    return trust(spark, sf).findings.select("identity", "rule_id", "severity", "issue")


@query("federation_summary", f"with {_FED}, c as ({dq.SQL['federation_configs']}) select (select count(*) from c) as units, (select count(distinct file_path) from c) as files, {_COUNTS} from f")
def federation_summary(spark, sf):
    return trust(spark, sf).summary


# ---- pipelines: a model names findings of the customers' files again, in other letters (which counts as new), and others

_SAID_STEPS = ["A downloaded script is piped to a shell", "a downloaded script is piped to a shell", "The step trusts its input"]
_PIPE_ISSUE = {"PIPE-SCRIPT-001": "A downloaded script is piped to a shell", "PIPE-SCRIPT-002": "eval runs a command that is put together at run time",
    "PIPE-SCRIPT-003": "exec runs inside a step", "PIPE-PROMPT-001": "A line tries to override the instructions of a model",
    "PIPE-INPUT-001": "Input from outside the repository reaches a command"}
_PIPE_TYPE = {"PIPE-SCRIPT": "script_injection", "PIPE-PROMPT": "prompt_injection", "PIPE-INPUT-": "external_input"}
_case = lambda of, c: f"case {c} " + " ".join(f"when '{k}' then '{v}'" for k, v in of.items()) + " end"
_PIPE = f"""r as (select file_path, line_number, {_case(_PIPE_TYPE, 'substr(rule_id, 1, 11)')} as type, {_case(_PIPE_ISSUE, 'rule_id')} as issue, rule_id, severity from ({dq.SQL['pipeline_findings']})),
m as (select c_custkey as ord, '.github/workflows/c' || c_custkey || '.yml' as file_path, 7 as line_number, 'script_injection' as type, {pick_sql(_SAID_STEPS, 'c_nationkey')} as issue,
 case when c_custkey % 2 = 0 then 'OWN-1' end as rule_id, case when c_custkey % 5 = 0 then null else 'MEDIUM' end as severity from customer),
f as (select * from r union all select file_path, line_number, type, issue, coalesce(rule_id, 'PIPE-LLM'), coalesce(severity, 'LOW') from m
 where not exists (select 1 from r where r.file_path = m.file_path and r.line_number = m.line_number and r.type = m.type and r.issue = m.issue))"""


def said_of_steps(spark, sf):
    k = F.col("c_custkey")
    return read_table(spark, sf, "customer").select(k.alias("ord"), F.format_string(".github/workflows/c%d.yml", k).alias("file_path"), F.lit(7).alias(
        "line_number"), F.lit("script_injection").alias("type"), pick(_SAID_STEPS, F.col("c_nationkey")).alias("issue"), F.when(k % 2 == 0,
        "OWN-1").alias("rule_id"), F.when(k % 5 != 0, "MEDIUM").alias("severity"))


def steps(spark, sf):
    files = dq.ci_files(spark, sf).withColumn("file_type", F.lit("yaml"))
    said = said_of_steps(spark, sf)
    return analysers.analyse("prompt_injection", files, said.unionByName(said.withColumn("ord", F.col("ord") + 1000000)))


@query("pipeline_analysis", f"with {_PIPE} select file_path, line_number, type, issue, rule_id, severity from f")
def pipeline_analysis(spark, sf):
    return steps(spark, sf).findings.select("file_path", "line_number", "type", "issue", "rule_id", "severity")


@query("pipeline_summary", f"with {_PIPE}, s as ({dq.SQL['pipeline_snippets']}) select (select count(*) from s) as units, (select count(distinct file_path) from s) as files, {_COUNTS} from f")
def pipeline_summary(spark, sf):
    return steps(spark, sf).summary
