"""Prompts, model answers, roles, nested texts and reports around a scan, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkseam.operators import detectors, prompts, quality, report, search, store
from sparkseam.operators import governance as G
from sparkseam.operators import rules as rules_
from sparkseam.operators.recursion import forest, json_values
from sparkseam.plans import chunk_queries as cq
from sparkseam.plans import detector_queries as dq
from sparkseam.plans import report_queries as rq
from sparkseam.plans.engine import Engine, scan_errors, scan_issues
from sparkseam.plans.fixtures import beside, frame, pick, pick_sql, values
from sparkseam.session import folder, read_table
from sparkseam.sources import parsers

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


NL = "chr(10)"


def text(value: str) -> str:
    """A string literal of several lines in SQL."""
    return f" || {NL} || ".join("'" + part.replace("'", "''") + "'" for part in value.split("\n"))


def heading(name: str, body: str) -> str:
    return f"{text(name)} || {NL} || {body} || {NL}"


# ---- prompts: a question for every conversation, its turns as code

ASK = ["qid", "query", "hint"]
ASKED = [(1, "Which storage is public?", "storage"), (2, "Who may write?", ""), (3, "Is anything open?", None)]
_ASK = "(select distinct conv_id as qid, 'What of ' || conv_id || '?' as query, case conv_id % 3 when 0 then 'storage' when 1 then '' end as hint from conversations)"
_HEADS = f"""h as (select conv_id as qid, turn as doc_id, row_number() over (partition by conv_id order by turn, role, text) as rank, role as source,
 string_split(text, {NL})[1] as line from conversations)"""
_ENTRY = f"""e as (select qid, string_agg('[' || rank || '] ' || line, {NL} || {NL} order by rank) as body from h where rank <= 4 group by qid),
s as (select qid, string_agg('[r' || rank || '] ' || source, {NL} || {NL} order by rank) as body from h where rank <= 2 group by qid)"""
_TAGS = f"""g as (select qid, string_agg('- resource_type=' || source || ', cloud_provider=, category=general', {NL} order by rank) as body
 from h where rank <= 3 group by qid)"""


def questions(spark, sf):
    hint = F.when(F.col("qid") % 3 == 0, "storage").when(F.col("qid") % 3 == 1, "")
    rows = read_table(spark, sf, "conversations").select(F.col("conv_id").alias("qid")).distinct()
    return rows.select("qid", F.concat(F.lit("What of "), "qid", F.lit("?")).alias("query"), hint.alias("hint"))


def heads(spark, sf):
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    line = F.substring_index("text", "\n", 1).alias("line")
    return read_table(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("doc_id"), rank.alias("rank"),
        F.col("role").alias("source"), line)


@query("prompt_review",
    f"""with {_HEADS}, {_ENTRY}, {_TAGS} select qid, {text(prompts.ROLE)} || {NL} || {NL} || case when hint <> '' then 'Focus your analysis on: ' || hint || ' security issues.' || {NL} || {NL} else '' end
 || {heading(prompts.QUERY, 'query')} || {NL} || coalesce({heading(prompts.RESOURCES, 'g.body')} || {NL}, '') || coalesce({heading(prompts.CODE, 'e.body')} || {NL}, '') || coalesce({heading(prompts.RULES, 's.body')} || {NL}, '')
 || {text(prompts.TASK)} || {NL} || {text(prompts.ANSWER)} as prompt from {_ASK} left join e using (qid) left join s using (qid) left join g using (qid)""")
def prompt_review(spark, sf):
    h = heads(spark, sf)
    code = h.filter("rank <= 4").select("qid", "rank", F.format_string("[%d] %s", "rank", "line").alias("entry"))
    rules = h.filter("rank <= 2").select("qid", "rank", F.format_string("[r%d] %s", "rank", "source").alias("entry"))
    tags = h.filter("rank <= 3").select("qid", "rank", F.col("source").alias("resource_type"), F.lit(None).cast("string").alias("cloud_provider"),
        F.lit("general").alias("category"))
    return prompts.review(questions(spark, sf), code, rules, tags)


_ACCESS = f"""a as (select qid, doc_id, rank, '### [' || rank || '] b' || doc_id || ' (' || source || ')' || {NL} || '```' || {NL} || substr(line, 1, 500) || {NL} || '```' || {NL} || 'identity: `i' || doc_id || '`, role: `Reader`, scope: `unknown` (`reference`)' as entry from h),
own as (select qid, string_agg(entry, {NL} || {NL} order by rank) as body from a where rank <= 15 group by qid), n as (select qid, count(*) as n from h group by qid),
c as (select qid, string_agg('### [Code ' || rank || '] ' || source || {NL} || '```' || {NL} || substr(line, 1, 500) || {NL} || '```', {NL} || {NL} order by rank) as body from h where rank <= 5 and line <> '' group by qid),
r as (select qid, string_agg('### [Rule ' || rank || '] ' || source || ' (HIGH)' || {NL} || substr(line, 1, 600), {NL} || {NL} order by rank) as body from h where rank <= 5 group by qid)"""


@query("prompt_access",
    f"""with {_HEADS}, {_ACCESS} select qid, {text(prompts.ROLE)} || {NL} || {NL} || coalesce({heading(prompts.ASSIGNMENTS, 'own.body')} || {NL}, '')
 || case when n > 15 then '(' || (n - 15) || ' more assignments not shown)' || {NL} || {NL} else '' end || coalesce({heading(prompts.RETRIEVED, 'c.body')} || {NL}, '') || coalesce({heading(prompts.RULES, 'r.body')} || {NL}, '')
 || {heading(prompts.QUERY, 'query')} || {NL} || {text(prompts.INSTRUCTIONS)} || {NL} || {text(prompts.ANSWER)} as prompt from {_ASK} left join own using (qid) left join n using (qid) left join c using (qid) left join r using (qid)""")
def prompt_access(spark, sf):
    h = heads(spark, sf)
    name = lambda p: F.concat(F.lit(p), F.col("doc_id"))
    own = h.select("qid", "rank", name("b").alias("block_name"), F.col("source").alias("file_path"), F.col("line").alias("source_text"),
        name("i").alias("identity_name"), F.lit("Reader").alias("role"), F.lit("unknown").alias("scope_type"), F.lit("").alias("scope_value"))
    code = h.select("qid", "rank", F.col("source").alias("file_path"), F.col("line").alias("text"))
    rules = h.select("qid", "rank", F.col("source").alias("title"), F.lit("HIGH").alias("severity"), F.col("line").alias("text"))
    return prompts.access_review(questions(spark, sf).drop("hint"), own, code, rules)


@query("prompt_snippet",
    f"""with {_HEADS}, f as (select qid, string_agg('{{"rank":' || rank || '}}', ',' || {NL} order by rank) as body from h where rank <= 10 group by qid),
r as (select qid, string_agg('### [Rule ' || rank || '] ' || source || {NL} || substr(line, 1, 500), {NL} || {NL} order by rank) as body from h where rank <= 5 group by qid)
select qid, {text(prompts.ROLE)} || {NL} || {NL} || {heading(prompts.FILE, "'ci.yml'")} || {NL} || {heading(prompts.SNIPPET, f"'```' || {NL} || substr(repeat('ab', 1000), 1, 1200) || {NL} || '```'")} || {NL}
 || {heading(prompts.FOUND, "'[' || coalesce(f.body, '') || ']'")} || {NL} || coalesce({heading(prompts.RULES, 'r.body')} || {NL}, '') || {heading(prompts.QUERY, 'query')} || {NL} || {text(prompts.INSTRUCTIONS)} || {NL} || {text(prompts.ANSWER)} as prompt
 from {_ASK} left join f using (qid) left join r using (qid)""")
def prompt_snippet(spark, sf):
    h = heads(spark, sf)
    asked = questions(spark, sf).select("qid", F.lit("ci.yml").alias("file_path"), F.repeat(F.lit("ab"), F.lit(1000)).alias("snippet"), "query")
    found = h.select("qid", "rank", F.to_json(F.struct("rank")).alias("finding"))
    return prompts.snippet_review(asked, found, h.select("qid", "rank", F.col("source").alias("title"), F.col("line").alias("text")))


def _client(prompt: str) -> str:
    if prompt.endswith("? late"):
        raise TimeoutError("too slow")
    return prompts.recorded({"storage": '{"issues": [{"title": "Open bucket", "severity": "high"}], "summary": "one"}'})(prompt)


@query("model_answers", f"select qid, case when hint = 'storage' then 'Open bucket' else '' end as titles, case hint when 'storage' then 'one' when '' then 'no answer: too slow' else '' end as "
    f"summary from {_ASK}")
def model_answers(spark, sf):
    """A recorded client asked for every conversation: an answer, an error, or no answer."""
    asked = questions(spark, sf).select("qid", F.concat_ws(" ", "query", F.when(F.col("hint") == "", "late").otherwise(F.col("hint"))).alias("prompt"))
    said = parsers.model_output(prompts.answered(asked, _client))
    return said.select("qid", F.array_join(F.transform("issues", lambda x: x["title"]), ",").alias("titles"), "summary")


# ---- scans

BROKEN = [("deep/a.json", "json", "[" * 100_000), ("deep/b.yaml", "yaml", "steps: " + "[" * 5_000 + "]" * 5_000), ("fine/c.tf", "terraform",
    'resource "x" "y" {}\n'), ("none/d.tf", "terraform", None)]
FILE = ["file_path", "file_type", "content"]
ERRORS = [("deep/a.json", "iam"), ("deep/a.json", "workload_identity"), ("deep/b.yaml", "iam"), ("deep/b.yaml", "pipeline"), ("deep/b.yaml",
    "workload_identity"), ("none/d.tf", "iam"), ("none/d.tf", "workload_identity")]


_NATION_ERRORS = "select 'deep/n' || n_nationkey || '.json', unnest(['iam', 'workload_identity']) from nation where n_nationkey % 2 = 0"


def broken(spark, sf):
    """Files that can't be read, and one for each nation, every other too deep."""
    n = F.col("n_nationkey")
    own = read_table(spark, sf, "nation").select(F.format_string("deep/n%d.json", n).alias("file_path"), F.lit("json").alias("file_type"), F.when(n % 2 == 0,
        F.repeat(F.lit("["), F.lit(100_000))).otherwise("[]").alias("content"))
    return frame(spark, FILE, BROKEN).unionByName(own)


@query("scan_errors", f"select * from {beside(['file_path', 'detector'], ERRORS, _NATION_ERRORS)}")
def scan_errors_query(spark, sf):
    """Files that a reader can't read are rows, and don't end the scan."""
    return scan_errors(broken(spark, sf)).select("file_path", "detector")


_SECRET_OUT = beside(["file_path", "line_number", "secret_type"], dq.SEC_OUT, dq.CUSTOMER_FOUND)


@query("scan_exit", f"select (select count(*) from {beside(['file_path', 'detector'], ERRORS, _NATION_ERRORS)}) as errors, (select count(*) from {_SECRET_OUT}) as total, 2 as code")
def scan_exit(spark, sf):
    """A scan with detector errors ends with 2, whatever it found."""
    files = broken(spark, sf).unionByName(dq.secret_files(spark, sf).select("file_path",
        F.lit("other").alias("file_type"), F.col("text").alias("content")))
    issues, summary = report.run([scan_issues(files)], scan_errors(files), "ord")
    return summary.select("errors", "total", report.exit_code(F.col("errors"), F.lit(False), F.col("high"), True).alias("code"))


@query("secret_summary",
    f"""with p as (select unnest({[k for k, _, _ in detectors.SECRETS]}) as secret_type, unnest({[s for _, _, s in detectors.SECRETS]}) as severity union all select 'high_entropy', 'MEDIUM'),
f as (select file_path, severity from {_SECRET_OUT} join p using (secret_type))
select count(*) as total, count(*) filter (where severity = 'HIGH') as high, count(*) filter (where severity = 'MEDIUM') as medium, count(*) filter (where severity = 'LOW') as low, count(distinct file_path) as files_with_findings,
{len(dq.SEC_ROWS)} + (select count(*) from customer) as files_analysed, case when count(*) filter (where severity = 'HIGH') > 0 then 'HIGH' else 'other' end as worst from f""")
def secret_summary(spark, sf):
    return detectors.secret_report(dq.secret_files(spark, sf))


_FILES = "(select severity, string_agg(file_path, ', ' order by file_path) as files from (select distinct severity, file_path, dense_rank() over (partition by severity order by file_path) as n from d where file_path <> '') where n <= 5 group by severity)"


def _policy_sql(errors: int) -> str:
    return f"""with {rq._ISS}, {rq._EV}, v as (select e.*, case severity when 'CRITICAL' then 0 when 'HIGH' then 2 when 'MEDIUM' then 4 else 6 end as place from e where reason <> '' and {errors} = 0)
select 1 as line_number, 'Build policy: ' || {"'NOT EVALUATED'" if errors else "case when exists (select 1 from v) then 'FAIL' else 'PASS' end"} as line
union all select place + 2, '- ' || severity || ': ' || count || ' found, ' || max_allowed || ' allowed (' || reason || ')' from v
union all select place + 3, '  in ' || coalesce(files, 'no files recorded') from v left join {_FILES} using (severity)"""


def _policy_lines(spark, sf, errors: int):
    issues, summary = rq.issues_of(spark, sf)
    summary = summary.withColumn("errors", F.lit(errors).cast("long"))
    return report.console_policy(issues, summary, report.evaluate(issues, rq._policy(spark)))


@query("console_policy", _policy_sql(0))
def console_policy(spark, sf):
    return _policy_lines(spark, sf, 0)


@query("console_policy_unjudged", _policy_sql(1))
def console_policy_unjudged(spark, sf):
    return _policy_lines(spark, sf, 1)


@query("issue_listing", f"""with {rq._ISS}, o as (select *, row_number() over (order by {rq._RANK}, file_path, line_number, ord) as position from d)
select position, '[' || severity || '] ' || rule_id || ' ' || case when file_path = '' then 'unknown file' else file_path end || case when line_number > 0 then ':' || line_number else '' end || ' - '
 || case when length(issue) > 10 then substr(issue, 1, 10) || '...' else issue end as line from o""")
def issue_listing(spark, sf):
    return report.listing(rq.issues_of(spark, sf)[0], "ord", 10)


@query("legacy_ids", "select conv_id, row_number() over (partition by conv_id order by turn, role) - 1 as index_id, turn as chunk_id, role as file_type from conversations")
def legacy_ids(spark, sf):
    """A JSON array for each conversation: places in it become ids."""
    ordered = F.sort_array(F.collect_list(F.struct(F.col("turn").alias("chunk_id"), F.col("role").alias("file_type"))))
    kept = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.to_json(ordered).alias("value"))
    return store.legacy_rows(kept, "chunk_id: long, file_type: string")


@query("sarif_document", f"with {rq._ISS}, r as (select distinct rule_id from d) select '2.1.0' as version, (select count(*) from d) as results, "
    f"(select count(*) from r) as rules, (select rule_id from d order by rule_id limit 1) as first_rule")
def sarif_document(spark, sf):
    """What a reader finds in the document."""
    doc = report.sarif_document(rq.issues_of(spark, sf)[0], "ord")
    schema = "version string, runs array<struct<tool: struct<driver: struct<rules: array<struct<id: string>>>>, results: array<struct<ruleId: string>>>>"
    d = doc.select(F.from_json("document", schema).alias("d")).select("d.version", F.get("d.runs", F.lit(0)).alias("run"))
    return d.select("version", F.size("run.results").cast("long").alias("results"), F.size("run.tool.driver.rules").cast("long").alias("rules"),
        F.get("run.results", F.lit(0))["ruleId"].alias("first_rule"))


_FAILS = [[], ["HIGH"], ["low", "LOW"]]


@query("policy_overrides", """select o_orderkey, case when o_orderkey % 3 = 0 and o_custkey % 2 = 0 then '{}' else '{"fail_on":{' || case o_orderkey % 3 when 1 then '"high":true'
 when 2 then '"low":true' else '' end || '},"max_allowed":{' || case when o_custkey % 2 = 1 then '"low":' || o_custkey else '' end || '}}' end as text from orders""")
def policy_overrides(spark, sf):
    """What each order sets over a policy, as JSON."""
    fails = F.get(F.array(*[F.array(*map(F.lit, x)).cast("array<string>") for x in _FAILS]), (F.col("o_orderkey") % 3).cast("int"))
    limits = F.when(F.col("o_custkey") % 2 == 1, F.create_map(F.lit("LOW"), F.col("o_custkey")))
    return read_table(spark, sf, "orders").select("o_orderkey", report.overrides_json(fails, limits).alias("text"))


# ---- roles

NEW_ROLES, NEW_TOOLS = [("Auditor", "view_audit"), ("VIEWER", "run_scan")], [("Ledger", "view_audit"), ("llm_client", "view_audit")]
RQ_ROWS = [(r, t) for r in ("auditor", "AUDITOR", "viewer", "admin", "nobody") for t in ("ledger", "LEDGER", "llm_client", "iam_analyzer",
    "unheard_of", "user_management")]
PERMISSIONS = sorted({p for ps in G.GRANTS.values() for p in ps})
_OWN_R = f"select distinct lower(c_mktsegment), {pick_sql(PERMISSIONS, 'c_nationkey')} from customer where c_custkey % 10 = 0"
_OWN_T = f"select lower(n_name), {pick_sql(PERMISSIONS, 'n_nationkey')} from nation"
_NEW_R = beside(["role", "permission"], [(r.lower(), p) for r, p in NEW_ROLES], _OWN_R)
_NEW_T = beside(["tool", "permission"], [(t.lower(), p) for t, p in NEW_TOOLS], _OWN_T)
_G2 = f"g as (select * from {rq._GR} where role not in (select role from {_NEW_R}) union all select * from {_NEW_R}), tl as (select * from {rq._TO} where tool not in (select tool from {_NEW_T}) union all select * from {_NEW_T})"


_ASKERS, _ASKED_TOOLS = ["auditor", "Viewer", "analyst", "nobody"], ["LEDGER", "llm_client", "iam_analyzer", "unheard_of", "user_management"]
_EVENT_ASKS = f"select {pick_sql(_ASKERS, 'user_id')}, {pick_sql(_ASKED_TOOLS, 'event_id')} from events"


def _new(spark, sf):
    """Roles of the customers' segments and tools of the nations, registered beside fixed ones."""
    roles = read_table(spark, sf, "customer").filter("c_custkey % 10 = 0").select(F.col("c_mktsegment").alias("role"), pick(PERMISSIONS, F.col("c_nationkey")).alias(
        "permission")).distinct()
    tools = read_table(spark, sf, "nation").select(F.col("n_name").alias("tool"), pick(PERMISSIONS, F.col("n_nationkey")).alias("permission"))
    return frame(spark, ["role", "permission"], NEW_ROLES).unionByName(roles), frame(spark, ["tool", "permission"], NEW_TOOLS).unionByName(tools)


@query("rbac_registered", f"with {_G2}, n as (select q.role, q.tool, coalesce(tl.permission, 'run_scan') as permission "
    f"from {beside(['role', 'tool'], RQ_ROWS, _EVENT_ASKS)} q left join tl on tl.tool = lower(q.tool)) select *, exists (select 1 from g where g.role = "
    f"lower(n.role) and g.permission = n.permission) as allowed from n")
def rbac_registered(spark, sf):
    roles, tools = _new(spark, sf)
    own = read_table(spark, sf, "events").select(pick(_ASKERS, F.col("user_id")).alias("role"), pick(_ASKED_TOOLS, F.col("event_id")).alias("tool"))
    return G.access(frame(spark, ["role", "tool"], RQ_ROWS).unionByName(own), roles, tools).select("role", "tool", "permission", "allowed")


@query("rbac_tools", f"with {_G2} select distinct role, tool from g join tl using (permission)")
def rbac_tools(spark, sf):
    roles, tools = _new(spark, sf)
    return G.accessible_tools(spark, roles, tools)


@query("rbac_permissions", f"with {_G2} select * from g")
def rbac_permissions(spark, sf):
    return G.grants(spark, _new(spark, sf)[0])


# ---- nested texts, flat texts, freed ids, appended events

_BAD = f"case when length(text) > 32768 then 'length' when regexp_matches(text, '{G.HTML_TAG}') then 'html' when regexp_matches(text, '{G.TRAVERSAL}') then 'path_traversal' when regexp_matches(text, '{G.PROMPT_INJECTION}') then 'prompt_injection' end"


@query("sanitize_nested", f"with {rq._SAN}, b as (select sid, text, {_BAD} as bad from cl) select sid, text, text as inner_text, 'ok' as tag, text as "
    f"entry, case when bad is null then '' else 'payload.text:' || bad || ',payload.deep[].text:' || bad || ',payload.named.k:' || bad end as rejected from b")
def sanitize_nested(spark, sf):
    rows = rq.to_sanitise(spark, sf)
    inner = F.struct(F.col("text"), F.lit(1).alias("n"))
    rows = rows.select("sid", F.struct(F.col("text"), F.array(inner).alias("deep"), F.array(F.lit("ok")).alias("tags"), F.create_map(F.lit("k"),
        F.col("text")).alias("named"), F.lit(True).alias("flag")).alias("payload"))
    out = G.sanitised_nested(rows, "payload")
    said = F.array_join(F.transform("rejected", lambda x: F.concat(x["at"], F.lit(":"), x["reason"])), ",")
    return out.select("sid", "payload.text", F.get("payload.deep", F.lit(0))["text"].alias("inner_text"), F.get("payload.tags",
        F.lit(0)).alias("tag"), F.try_element_at("payload.named", F.lit("k")).alias("entry"), said.alias("rejected"))


@query("doc_texts", "with t as (select conv_id, unnest([text, role]) as x, unnest([0, 1]) as p, turn, role, text from conversations) select conv_id, "
    "string_agg(x, '|' order by turn, role, text, p) filter (where x is not null and trim(x) <> '') as texts from t group by conv_id")
def doc_texts(spark, sf):
    docs = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    rows = read_table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(docs, lambda x: F.struct(x["text"].alias("text"),
        x["role"].alias("description"))).alias("docs"))
    return rows.select("conv_id", F.array_join(quality.doc_texts(F.col("docs")), "|").alias("texts"))


@query("deleted_ids", "select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
def deleted_ids(spark, sf):
    gone = read_table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return store.deleted(read_table(spark, sf, "orders"), gone, "o_custkey", "o_orderkey")


@query("audit_append", "select event_type, 2 * count(*) as n from events group by event_type")
def audit_append(spark, sf):
    """Events written twice to one folder: the second time adds to the first."""
    path, events = folder(spark, "audit"), read_table(spark, sf, "events").select("event_id", "event_type")
    for _ in range(2):
        G.append_audit(events, path)
    return spark.read.schema("event_id long, event_type string").json(path).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---- state: what is kept in folders and sessions


@query("json_sink", "select doc_id, lang, n_chars from documents")
def json_sink(spark, sf):
    """Rows written as JSON and read again; written twice, the second time replaces the first."""
    path, rows = folder(spark, "json"), read_table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    report.write_json(rows.limit(3), path)
    report.write_json(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("store_documents", """with v as (select case when doc_id % 5 = 0 then reverse(text) else text end as t from documents)
select sha256(t) as content_hash, count(*) as files, 1::bigint as shown from v where length(t) > 0 group by t""")
def store_documents(spark, sf):
    """documents as files of the store: an earlier version, the tables' own, compacted, old segments gone, then changed texts. How many files hold
    a text, and how often it is shown."""
    docs = read_table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id"), F.lit(".txt")).alias("file_path"), F.lit("text").alias("file_type"),
        F.col("text").alias("content"), "doc_id", "lang")
    put = lambda rows: engine.ingest(rows.select("file_path", "file_type", "content"), size=10_000_000)
    engine = Engine(spark, folder(spark, "engine"))
    put(docs.filter("lang <> 'de'").withColumn("content", F.when(F.col("doc_id") % 7 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content"))))
    put(docs)
    engine.compact()
    engine.remove_old()
    put(docs.filter("doc_id % 5 = 0").withColumn("content", F.reverse("content")))
    shown = engine.chunks().groupBy("content_hash").agg(F.count(F.lit(1)).alias("shown"))
    return engine.registry().groupBy("content_hash").agg(F.count(F.lit(1)).alias("files")).join(shown, "content_hash").select("content_hash", "files", "shown")


@query("session_isolated", "select case when user_id % 2 = 0 then 'even' else 'odd' end as session, count(*) as seen, case when user_id % 2 = 0 then '11111' else '22222' end as "
    "threshold, false as outside from events group by all")
def session_isolated(spark, sf):
    """Two sessions with a view and a setting of one name each: both see their own events, and the session outside sees neither."""
    parts = []
    for odd, (name, threshold) in enumerate((("even", "11111"), ("odd", "22222"))):
        own = G.isolated(spark)
        own.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        read_table(own, sf, "events").filter(f"user_id % 2 = {odd}").createOrReplaceTempView("own_events")
        parts.append((name, own))
    outside = spark.catalog.tableExists("own_events")
    seen = [s.table("own_events").agg(F.count(F.lit(1)).alias("seen")).select(F.lit(name).alias("session"), "seen", F.lit(s.conf.get(
        "spark.sql.autoBroadcastJoinThreshold")).alias("threshold"), F.lit(outside).alias("outside")) for name, s in parts]
    paths = [folder(spark, "session") for _ in seen]
    for rows, path in zip(seen, paths, strict=True):
        rows.write.parquet(path)
    return spark.read.parquet(*paths)


CONF_TEXTS = ["", "max_allowed: {low: %d}", "- a list", "{bad", '{"max_allowed": {"high": %d}, "other": {"kept": 4}}', "environments: {dev: {max_allowed: {low: %d}}}"]


@query("config_merge", "select s_suppkey, case when s_suppkey % 6 = 4 then s_nationkey else 0 end as high, case when s_suppkey % 6 in (1, 5) then s_nationkey else 10 end as low, "
    "case when s_suppkey % 6 = 4 then 4 else 0 end::bigint as kept from supplier")
def config_merge(spark, sf):
    """Settings of each supplier over the defaults: none, YAML, what isn't a mapping, broken text, JSON, an environment's."""
    k = F.col("s_suppkey")
    text = F.get(F.array(*[F.format_string(t, "s_nationkey") if "%d" in t else F.lit(t) for t in CONF_TEXTS]), (k % 6).cast("int"))
    made = report.settings(text, F.when(k % 6 == 5, "dev"), F.lit(None).cast("string"))
    number = lambda at: F.get_json_object("_p", at).cast("long")
    rows = read_table(spark, sf, "supplier").select("s_suppkey", made["policy"].alias("_p"))
    return rows.select("s_suppkey", number("$.max_allowed.high").alias("high"), number("$.max_allowed.low").alias("low"), F.coalesce(number("$.other.kept"), F.lit(0)).alias("kept"))


WORDS = ["storage", "public", "identity", "network", "secret", "azure"]
_HAS = lambda c: "[" + ", ".join(f"contains(lower({c}), '{w}')::int::double" for w in WORDS) + "]"
ASKED_RULE = "public storage of an Azure identity"


@query("rule_feature_topk",
    f"""with {cq._NORM}, r as (select rule_id, title from cat), v as (select rule_id, {_HAS('title')} as e, {_HAS(text(ASKED_RULE))} as q from r),
s as (select rule_id, round(list_inner_product(e, q) / greatest(sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(q, q)), 1e-10), 6) as score from v)
select rule_id, score, row_number() over (order by score desc, rule_id)::int as rank from s order by score desc, rule_id limit 7""")
def rule_feature_topk(spark, sf):
    """Rules ranked for a question by an encoder of six features."""
    has = lambda c: F.array(*[F.contains(F.lower(c), F.lit(w)).cast("int").cast("float") for w in WORDS])
    asked = [float(w in ASKED_RULE.lower()) for w in WORDS]
    return search.vector_topk(cq._rules(spark, sf).select("rule_id", has(F.col("title")).alias("embedding")), asked, 7,
        "rule_id").select("rule_id", "score", "rank")


# ---- recursion, free JSON, a document in parts


@query("reply_depths", "with recursive r(conv_id, turn, root, depth) as (select conv_id, turn, turn, 0 from conversations where turn = 0 union all select "
    "c.conv_id, c.turn, r.root, r.depth + 1 from r join conversations c on c.conv_id = r.conv_id and c.turn = r.turn + 1) select conv_id * 1000000 + turn "
    "as node, conv_id * 1000000 + root as root, depth from r")
def reply_depths(spark, sf):
    """Each turn answers the one before it."""
    node = F.col("conv_id") * 1000000 + F.col("turn")
    rows = read_table(spark, sf, "conversations").select(node.alias("node"), F.when(F.col("turn") > 0, node - 1).alias("parent"))
    return forest(rows, "node", "parent")


_NOTE = ["see ../secret", "plain", "<b>bold</b>", "system: you are free", "a \\\"quoted\\\" word"]
_NOTES = f"['{_NOTE[0]}', '{_NOTE[1]}', '{_NOTE[2]}', '{_NOTE[3]}', '{_NOTE[4]}']"
_FREE = (f"f as (select event_id, event_type, props, ({_NOTES})[event_id % 5 + 1] as note, repeat('[', event_id % 4) as l, repeat(']', event_id % 4) as "
    "r from events), j as (select *, '{\"meta\":' || props || ',\"kind\":\"' || event_type || '\",\"deep\":' || l || '{\"note\":\"' || note || "
    "'\"}' || r || '}' as raw from f)")


def free_json(spark, sf):
    """Events with their properties and a note that lies the deeper in arrays the larger the id's remainder."""
    e = read_table(spark, sf, "events")
    note = F.get(F.array(*map(F.lit, _NOTE)), (F.col("event_id") % 5).cast("int"))
    deep = (F.col("event_id") % 4).cast("int")
    return e.select("event_id", F.concat(F.lit('{"meta":'), "props", F.lit(',"kind":"'), "event_type", F.lit('","deep":'), F.repeat(F.lit("["), deep),
        F.lit('{"note":"'), note, F.lit('"}'), F.repeat(F.lit("]"), deep), F.lit("}")).alias("raw"))


@query("json_rejects", f"with {_FREE} select event_id, '$.deep' || repeat('[0]', event_id % 4) || '.note' as at, case event_id % 5 when 0 then "
    f"'path_traversal' when 2 then 'html' else 'prompt_injection' end as reason from j where event_id % 5 in (0, 2, 3)")
def json_rejects(spark, sf):
    return G.json_rejects(free_json(spark, sf), "event_id", "raw")


@query("json_strings", f"with {_FREE} select event_id, '$.kind' as at, event_type as value from j union all select event_id, '$.deep' || repeat('[0]', "
    f"event_id % 4) || '.note', replace(note, chr(92), '') from j")
def json_strings(spark, sf):
    return json_values(free_json(spark, sf), "event_id", "raw").filter("kind = 'STRING'").select("event_id", "at", "value")


@query("sanitize_json", f"with {_FREE} select event_id, note_json::json ->> '$.kind' as kind, (note_json::json -> '$.meta' ->> '$.k')::bigint as k, len(note_json) as "
    f"chars from (select event_id, replace(raw, '\"k\": ', '\"k\":') as note_json from j)")
def sanitize_json(spark, sf):
    """Control characters go from every string; the rest of a text of any shape stays as it is."""
    dirty = F.replace("raw", F.lit('"note":"'), F.lit('"note":"\\u0001'))
    clean = free_json(spark, sf).select("event_id", G.sanitised_json(dirty).alias("c"))
    return clean.select("event_id", F.get_json_object("c", "$.kind").alias("kind"), F.get_json_object("c", "$.meta.k").cast("long").alias("k"),
        F.length("c").cast("long").alias("chars"))


@query("sarif_parts", f"with {rq._ISS} select rule_id as rule, case severity when 'CRITICAL' then 'error' when 'HIGH' then 'error' when 'MEDIUM' then "
    f"'warning' else 'note' end as level, replace(file_path, chr(92), '/') as uri, greatest(line_number, 1) as start_line, issue as message from d")
def sarif_parts(spark, sf):
    """A document written in parts and its results read again from the files."""
    path = folder(spark, "sarif")
    report.write_sarif_parts(rq.issues_of(spark, sf)[0], "ord", path)
    kind = "ruleId string, level string, message struct<text string>, locations array<struct<physicalLocation struct<artifactLocation struct<uri " \
        "string>, region struct<startLine int>>>>"
    rows = spark.read.text(path).select(F.from_json(F.regexp_replace("value", "^,", ""), kind).alias("r")).filter("r.ruleId is not null")
    place = F.get("r.locations", F.lit(0))["physicalLocation"]
    return rows.select(F.col("r.ruleId").alias("rule"), "r.level", place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias(
        "start_line"), F.col("r.message.text").alias("message"))
