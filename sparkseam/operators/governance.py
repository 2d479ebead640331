"""Governance: poisoning checks and trust, sanitising, output guardrails, roles, audit, approvals."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import ArrowUDFType
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

from sparkseam.functions.text import contains_any, entropy_is_above, repetition, severity_rank
from sparkseam.operators.detectors import redact
from sparkseam.operators.recursion import json_values

# Patterns and tiers.
INJECTION = [
    r"(?i)(?:ignore|forget|disregard|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|rules?|context)",
    r"(?i)system\s*:\s*you\s+are", r"(?i)<\s*/?system\s*>", r"(?i)\|\s*im_(?:start|end)\s*\|", r"(?i)<<\s*(?:INST|SYS)\s*>>",
        r"(?i)\[INST\]|\[/INST\]", r"(?i)\bdo\s+anything\s+now\b", r"(?i)\bjailbreak\b",
]
EXFILTRATION = [r"(?i)(?:curl|wget|fetch|http\.get)\s+['\"]?https?://[^\s'\"]{10,}", r"(?i)base64\s*\(", r"(?i)eval\s*\("]
TRUST = {"git": 0.95, "internal": 0.90, "file": 0.80, "external": 0.50, "unknown": 0.40}
HTML_TAG = r"(?s)<[a-zA-Z/!?][^>]{0,200}>"
TRAVERSAL = r"\.\.[/\\]"
PROMPT_INJECTION = r"(?i)(?:ignore|forget|disregard|override|bypass)\s+(?:all\s+)?(?:previous|prior|above|earlier)\s+(?:instructions?|prompts?|context|rules?)|system\s*:\s*you\s+are|<\s*/?system\s*>|\[\s*system\s*\]|(INST|SYS)\s*>>|<<\s*(INST|SYS)|\|\s*im_start\s*\||\|\s*im_end\s*\|"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
MAX_INPUT, MAX_FIELD = 32_768, 8_000
OUTPUT_INJECTION = r"(?i)(?:ignore|forget|override)\s+(?:previous|prior|all)\s+(?:instructions?|rules?|context)"
KNOWN_HOSTS = ["nvd.nist.gov", "owasp.org", "cve.mitre.org", "docs.microsoft.com", "cloud.google.com", "docs.aws.amazon.com"]
SEVERITY_HINTS = [("CRITICAL", ["CRIT"]), ("HIGH", ["ERROR"]), ("MEDIUM", ["WARN"]), ("LOW", ["NOTE", "NOTICE"]), ("INFO", ["DEBUG"])]
SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO", "UNKNOWN")
ROLE_LEAST = {"viewer": "HIGH", "analyst": "MEDIUM", "engineer": "LOW", "admin": "INFO"}
GRANTS = {
    "viewer": [
        "read_report",
    ],
    "analyst": [
        "read_report", "export_report", "run_scan", "read_policy", "invoke_llm",
    ],
    "engineer": [
        "read_report", "export_report", "run_scan", "schedule_scan", "manage_index", "read_policy", "write_policy", "invoke_llm", "approve_finding",
    ],
    "admin": [
        "read_report", "export_report", "run_scan", "schedule_scan", "manage_index", "delete_index", "read_policy", "write_policy", "manage_users",
            "manage_roles", "view_audit", "approve_finding", "reject_finding", "invoke_llm",
    ],
}
TOOLS = {
    "iam_analyzer": "run_scan", "workload_identity_analyzer": "run_scan", "prompt_injection_analyzer": "run_scan", "secrets_analyzer": "run_scan",
        "permission_analyzer": "run_scan",
    "vector_store_manager": "manage_index", "rag_pipeline_ingest": "manage_index", "delete_index": "delete_index",
        "policy_engine_write": "write_policy", "policy_engine_read": "read_policy",
    "llm_client": "invoke_llm", "rag_orchestrator": "invoke_llm", "audit_log_export": "view_audit", "user_management": "manage_users",
        "approve_finding": "approve_finding", "reject_finding": "reject_finding",
}
EVENT_SEVERITY = {
    "access_denied": "WARNING", "input_rejected": "WARNING", "rag_poisoning": "ERROR", "llm_guardrail": "WARNING", "tool_invoked": "INFO",
        "scan_start": "INFO", "scan_complete": "INFO", "approval_request": "WARNING", "approval_decision": "INFO",
}


def any_of(text: Column, patterns: list[str]) -> Column:
    """Whether any pattern is found: one pass over the text for all of them, each with its own flags."""
    return text.rlike("|".join(f"(?:{p})" for p in patterns)) if patterns else F.lit(False)


def validate(rows: DataFrame, text: str = "text", reject: bool = True, entropy_above: float = 5.5, repetition_above: float = 0.6) -> DataFrame:
    """rows with accepted, validation_score and flags."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = rows.withColumns({"_i": any_of(t, INJECTION), "_x": any_of(t, EXFILTRATION), "_e": entropy_is_above(t, entropy_above),
        "_r": repetition(t) > repetition_above})
    off = lambda c, w: F.when(F.col(c), F.lit(w)).otherwise(0.0)
    score = F.round(F.greatest(F.lit(0.0), 1.0 - off("_i", 0.5) - off("_x", 0.3) - off("_e", 0.2) - off("_r", 0.2)), 3)
    flags = F.array_compact(F.array(F.when(F.col("_i"), "injection_pattern"), F.when(F.col("_x"), "exfil_pattern"), F.when(F.col("_e"),
        "high_entropy"), F.when(F.col("_r"), "high_repetition")))
    return rows.withColumns({"accepted": ~F.col("_i") if reject else F.lit(True), "validation_score": score, "flags": flags}).drop("_i", "_x", "_e", "_r")


def trust_score(source: Column, author: Column, validation: Column) -> Column:
    tier = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in TRUST.items() for x in kv]), F.lower(F.coalesce(source, F.lit("")))),
        F.lit(TRUST["unknown"]))
    return F.round(F.least(F.lit(1.0), tier + F.when(F.coalesce(author, F.lit("")) != "", 0.05).otherwise(0.0)) * F.coalesce(validation, F.lit(1.0)), 3)


def trusted(rows: DataFrame, least: float, score: str = "trust_score") -> DataFrame:
    """rows with trusted: an unscored row counts as 1."""
    return rows.withColumn("trusted", F.coalesce(score, F.lit(1.0)) >= least)


def sanitised(text: Column, newlines: bool = True) -> Column:
    out = F.regexp_replace(text, CONTROL, "")
    return out if newlines else F.regexp_replace(out, r"[\n\r]", " ")


def reason(text: Column, most: int = MAX_INPUT, html: bool = False, extra: list[str] | None = None) -> Column:
    """The first check that a text (in NFC) fails, or null."""
    clean = F.regexp_replace(text, CONTROL, "")
    out = F.when(F.length(clean) > most, "length")
    if not html:
        out = out.when(clean.rlike(HTML_TAG), "html")
    out = out.when(clean.rlike(TRAVERSAL), "path_traversal").when(clean.rlike(PROMPT_INJECTION), "prompt_injection")
    for p in extra or []:
        out = out.when(clean.rlike(p), "blocked_pattern")
    return out


def map_strings(value: Column, kind: DataType, change: Callable[[Column], Column]) -> Column:
    """value with `change` applied to every string in it, however deep in structs, arrays and map values; the rest unchanged."""
    if isinstance(kind, StringType):
        return change(value)
    if isinstance(kind, StructType):
        parts = [map_strings(value[f.name], f.dataType, change).alias(f.name) for f in kind.fields]
        return F.when(value.isNotNull(), F.struct(*parts)) if parts else value
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda x: map_strings(x, kind.elementType, change))
    if isinstance(kind, MapType):
        return F.transform_values(value, lambda _, v: map_strings(v, kind.valueType, change))
    return value


def all_strings(value: Column, kind: DataType, at: str) -> Column:
    """array<struct<at, text>>: every string in value, with the names on the way to it."""
    none = F.array().cast("array<struct<at:string,text:string>>")
    if isinstance(kind, StringType):
        return F.when(value.isNotNull(), F.array(F.struct(F.lit(at).alias("at"), value.alias("text")))).otherwise(none)
    if isinstance(kind, StructType):
        return F.concat(none, *[F.when(value.isNotNull(), all_strings(value[f.name], f.dataType, f"{at}.{f.name}")).otherwise(none) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return F.coalesce(F.flatten(F.transform(value, lambda x: all_strings(x, kind.elementType, f"{at}[]"))), none)
    if isinstance(kind, MapType):
        own = lambda x: F.transform(all_strings(x["value"], kind.valueType, ""), lambda y: F.struct(F.concat(F.lit(f"{at}."), x["key"].cast("string"),
            y["at"]).alias("at"), y["text"].alias("text")))
        return F.coalesce(F.flatten(F.transform(F.map_entries(value), own)), none)
    return none


def sanitised_nested(rows: DataFrame, column: str, most: int = MAX_INPUT, html: bool = False) -> DataFrame:
    """rows with every string of a nested column sanitised, and `rejected`: where in it which checks fail (at, reason)."""
    kind = rows.schema[column].dataType
    found = F.transform(all_strings(F.col(column), kind, column), lambda x: F.struct(x["at"].alias("at"), reason(x["text"], most, html).alias("reason")))
    return rows.withColumn("rejected", F.filter(found, lambda x: x["reason"].isNotNull())).withColumn(column, map_strings(F.col(column), kind, sanitised))


def sanitised_json(json: Column) -> Column:
    """A JSON text with every string value in it sanitised, names as they are; null unless it is JSON.

    The text is written anew from its parsed form, cut at string literals and joined again, so it may have any shape and
    depth. A literal with a colon after it is a name. Escaped backslashes and quotes stand as control characters
    meanwhile, which written JSON can't hold, so a literal ends at its next quote. A text too large for a variant is null.
    """
    backslash, quote = F.lit("\x01"), F.lit("\x02")
    flat = F.replace(F.replace(F.to_json(F.try_parse_json(json)), F.lit("\\\\"), backslash), F.lit('\\"'), quote)
    back = lambda x: F.replace(F.replace(x, quote, F.lit('\\"')), backslash, F.lit("\\\\"))
    value = lambda x: F.get(F.from_json(F.concat(F.lit("["), back(x), F.lit("]")), "array<string>"), F.lit(0))
    literal = lambda x: F.regexp_replace(F.to_json(F.array(sanitised(value(x)))), r"^\[|\]$", "")
    parts = F.regexp_extract_all(flat, F.lit('"[^"]*":?|[^"]+'), F.lit(0))
    changed = F.transform(parts, lambda x: F.when(F.startswith(x, F.lit('"')) & ~F.endswith(x, F.lit(":")), literal(x)).otherwise(back(x)))
    return F.array_join(changed, "")


def json_rejects(rows: DataFrame, key: str, column: str, most: int = MAX_INPUT, html: bool = False) -> DataFrame:
    """key, at, reason: where in a JSON text of any shape which string fails a check."""
    strings = json_values(rows, key, column).filter("kind = 'STRING'")
    return strings.select(key, "at", reason(F.col("value"), most, html).alias("reason")).filter("reason is not null")


#: Characters that stand in NFC whatever is beside them; most texts hold no others.
SETTLED = r"[\x00-\u02ff\u0400-\u0482\u048a-\u0530\u2010-\u2027\u2030-\u205e\u20a0-\u20c0\u2190-\u21ff\u2500-\u27bf\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fff\uac00-\ud7a3]*"
#: Bytes of a batch's texts that a worker turns into Python strings at a time.
NFC_BYTES = 4_000_000


def _nfc(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        step = max(1, NFC_BYTES * len(batch) // max(1, batch.nbytes))
        done = [pa.array([None if x is None else unicodedata.normalize("NFC", x) for x in batch.slice(at, step).to_pylist()], pa.string()) for at in range(
            0, len(batch), step)]
        yield pa.concat_arrays(done) if done else pa.array([], pa.string())


def nfc(rows: DataFrame, text: str) -> DataFrame:
    """rows with text in Unicode NFC. There is no built-in for it, so texts with characters that may change go through Python; no other text does."""
    normal = F.arrow_udf(_nfc, "string", ArrowUDFType.SCALAR_ITER)
    open_ = F.when(~F.col(text).rlike(f"^(?:{SETTLED})$"), F.col(text))
    return rows.withColumn(text, F.coalesce(normal(open_), F.col(text)))


def clean_severity(raw: Column) -> Column:
    up = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    out = F.when(up.isin(*SEVERITIES), up)
    for name, hints in SEVERITY_HINTS:
        out = out.when(contains_any(up, hints), name)
    return out.otherwise("UNKNOWN")


def without_urls(text: Column) -> Column:
    """Addresses outside the known hosts are taken out."""
    keep = "|".join(h.replace(".", r"\.") for h in KNOWN_HOSTS)
    return F.regexp_replace(text, rf"(?i)https?://(?!(?:{keep}))[^\s]{{10,}}", "[URL REDACTED]")


def guarded(issues: DataFrame, fields: list[str]) -> DataFrame:
    """Issues with title, severity and description whose fields are neither over-long nor injections; severity and CWE cleaned, unknown addresses removed."""
    present = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    rows = issues.filter(present("title") & present("severity") & present("description"))
    for c in fields:
        v = F.coalesce(F.col(c), F.lit(""))
        rows = rows.filter((F.length(v) <= MAX_FIELD) & ~v.rlike(OUTPUT_INJECTION))
    out = {c: without_urls(F.col(c)) for c in fields}
    out["severity"] = clean_severity(F.col("severity"))
    if "cwe" in fields:
        out["cwe"] = F.when(F.col("cwe").rlike(r"(?i)^CWE-\d+$"), F.col("cwe")).otherwise("")
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in issues.columns])


def enforce_schema(rows: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Columns coerced to types (null where they can't be), missing ones added, others kept."""
    typed = [(F.col(c).try_cast(t) if c in rows.columns else F.lit(None).cast(t)).alias(c) for c, t in schema.items()]
    return rows.select(*typed, *[c for c in rows.columns if c not in schema])


def visible(issues: DataFrame, role: str | Column) -> DataFrame:
    """Issues that a role may see; severities outside the list pass."""
    role = F.lit(role) if isinstance(role, str) else role
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in ROLE_LEAST.items() for x in kv]), role), F.lit("INFO"))
    at = lambda c: severity_rank(c, SEVERITIES, -1)
    return issues.filter(at(F.upper("severity")) <= at(least))


def deliver(issues: DataFrame, role: str, most: int, order: list[str], texts: list[str], internal: tuple[str, ...] = ("_validation", "trust_score",
    "trust_source", "_cache_key", "_embedding")) -> DataFrame:
    """Redact, filter by role, keep the first `most`, drop internal columns; `truncated` tells whether any went."""
    rows = visible(issues.withColumns({c: redact(F.col(c)) for c in texts}), role).drop(*internal)
    total = rows.agg((F.count(F.lit(1)) > most).alias("truncated"))
    top = rows.orderBy(*order).limit(most) if most > 0 else rows
    return top.crossJoin(F.broadcast(total))


def _rows(spark: SparkSession, names: tuple[str, str], pairs: list[tuple[str, str]]) -> DataFrame:
    a, b = names
    return spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(x).alias(a), F.lit(y).alias(b)) for x, y in pairs])))


def registered(base: DataFrame, extra: DataFrame | None, key: str) -> DataFrame:
    """base and what was registered beside it; names count in lower case, and a registered one replaces the built-in."""
    if extra is None:
        return base
    extra = extra.select(F.lower(key).alias(key), *[c for c in base.columns if c != key])
    return base.join(extra.select(key).distinct(), key, "left_anti").select(*base.columns).unionByName(extra)


def grants(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """role, permission. extra: roles to register, a row for each permission."""
    return registered(_rows(spark, ("role", "permission"), [(r, p) for r, ps in GRANTS.items() for p in ps]), extra, "role")


def tools(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """tool, permission that it needs. extra: tools to register."""
    return registered(_rows(spark, ("tool", "permission"), list(TOOLS.items())), extra, "tool")


def access(requests: DataFrame, roles: DataFrame | None = None, extra_tools: DataFrame | None = None) -> DataFrame:
    """requests (role, tool) with allowed: an unknown tool needs run_scan, an unknown role has nothing."""
    spark = requests.sparkSession
    known = tools(spark, extra_tools).withColumnRenamed("tool", "_tool")
    need = requests.withColumns({"_role": F.lower("role"), "_name": F.lower("tool")}).join(known, F.col("_name") == F.col("_tool"), "left")
    need = need.drop("_name", "_tool").withColumn("permission", F.coalesce("permission", F.lit("run_scan")))
    have = grants(spark, roles).select(F.col("role").alias("_role"), "permission", F.lit(True).alias("_ok")).distinct()
    return need.join(have, ["_role", "permission"], "left").withColumn("allowed", F.coalesce("_ok", F.lit(False))).drop("_role", "_ok")


def accessible_tools(spark: SparkSession, roles: DataFrame | None = None, extra_tools: DataFrame | None = None) -> DataFrame:
    """role, tool for every tool that a role may use."""
    return grants(spark, roles).join(tools(spark, extra_tools), "permission").select("role", "tool").distinct()


def require(spark: SparkSession, role: str, permission: str = "", tool: str = "", roles: DataFrame | None = None, extra_tools: DataFrame | None = None) -> None:
    """Raises PermissionError unless the role holds a permission, or may use a tool."""
    if tool:
        allowed = access(_rows(spark, ("role", "tool"), [(role, tool)]), roles, extra_tools).first()["allowed"]
    else:
        allowed = not grants(spark, roles).filter((F.col("role") == role.lower()) & (F.col("permission") == permission)).isEmpty()
    if not allowed:
        raise PermissionError(f"{role} may not {'use ' + tool if tool else permission}")


def append_audit(events: DataFrame, path: str) -> None:
    """Adds events to a folder of JSON lines; what is there stays."""
    events.write.mode("append").json(path)


def audit(events: DataFrame, where: dict, since: Column | None = None, time: str = "ts") -> DataFrame:
    for c, v in where.items():
        if v is not None:
            events = events.filter(F.col(c) == F.lit(v))
    return events if since is None else events.filter(F.col(time) >= since)


def last_events(events: DataFrame, n: int, time: str = "ts", tie: str = "event_id") -> DataFrame:
    """The newest n events: a top-k, not a window over all rows."""
    return events.orderBy(F.desc(time), F.desc(tie)).limit(n)


def event_rows(kinds: DataFrame) -> DataFrame:
    """kinds (event_type, actor, resource) with the severity of the type."""
    return kinds.withColumn("severity", F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVENT_SEVERITY.items() for x in kv]),
        F.col("event_type")), F.lit("INFO")))


def approval(severity: Column, decision: Column, threshold: str = "HIGH", reviewer: bool = True) -> Column:
    """auto_approved below the threshold or without a reviewer; else the decision, or pending."""
    rank = lambda c: severity_rank(c, SEVERITIES, 5)
    below = rank(F.upper(severity)) > rank(F.lit(threshold))
    return F.when(below | ~F.lit(reviewer), "auto_approved").when(decision == "approve", "approved").when(decision == "reject", "rejected").otherwise("pending")


def approval_states(events: DataFrame) -> DataFrame:
    """approval_id, status: the first decision after submission counts. events: approval_id, ord, event."""
    first = events.filter("event in ('approve', 'reject')").groupBy("approval_id").agg(F.min(F.struct("ord", "event")).alias("f"))
    asked = events.filter("event = 'submit'").select("approval_id").distinct()
    return asked.join(first, "approval_id", "left").select("approval_id", F.when(F.col("f.event") == "approve",
        "approved").when(F.col("f.event") == "reject", "rejected").otherwise("pending").alias("status"))


def isolated(spark: SparkSession) -> SparkSession:
    """A session of its own settings and temporary views on the same cluster."""
    return spark.newSession()


