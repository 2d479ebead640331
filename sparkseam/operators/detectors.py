"""Line detectors: prompt injection and unsafe scripts in pipelines, secrets in any text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkseam.functions.text import entropy

# Patterns of the detectors.
OVERRIDES = [r"(?i)ignore\s+previous\s+instructions", r"(?i)override\s+system\s+prompt", r"(?i)exfiltrate\s+data",
    r"(?i)send\s+secrets\s+to\s+external\s+endpoint"]
REMOTE = r"(?i)\b(?:curl|wget)\b[^\n|;]*(https?://[^\s|;]+)[^\n]*\|\s*(?:bash|sh)\b"
EVAL = r"(?i)\beval\b\s+(.+)"
EVAL_TAINTED = r"(?i)\beval\b\s+.*(untrusted|github\.event|pull_request|\$\{|\$[A-Z_][A-Z0-9_]*)"
EXEC = r"(?i)\bexec\s*\("
UNTRUSTED = r"(?i)(github\.event\.pull_request\.(?:title|body)|github\.event\.issue\.(?:title|body)|system\.pullrequest|\bUNTRUSTED_INPUT\b)"
SINK = r"(?i)(--prompt\b|ollama\b|llm\b|eval\b|bash\b|sh\b|python\b.*--prompt)"
B64_TOKEN, HEX_TOKEN = r"[A-Za-z0-9+/]{20,}={0,2}", r"[0-9a-fA-F]{32,}"


def lines(rows: DataFrame, text: str, base: str | None = None) -> DataFrame:
    """One row for each line with line_number (from base, default 1) and line."""
    each = rows.select("*", F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n")).alias("_p", "line"))
    return each.withColumn("line_number", (F.col("_p") + (F.col(base) if base else F.lit(1))).cast("int")).drop("_p")


def _found(rows: DataFrame, kind: str, rule, severity, issue) -> DataFrame:
    c = lambda x: x if isinstance(x, Column) else F.lit(x)
    return rows.select("file_path", "line_number", F.substring("line", 1, 240).alias("line_content"), F.lit(kind).alias("type"),
        c(rule).alias("rule_id"), c(severity).alias("severity"), c(issue).alias("issue"))


def injection_lines(rows: DataFrame, text: str = "text", base: str | None = None, block: list[str] | None = None) -> DataFrame:
    """Lines with instruction overrides, one for each pattern and distinct line of a scanned block (default: the file)."""
    hits = lines(rows, text, base).withColumn("_k", F.explode(F.array_compact(F.array(*[F.when(F.col("line").rlike(p), F.lit(i)) for i,
        p in enumerate(OVERRIDES)]))))
    first = Window.partitionBy(*(block or ["file_path"]), "_k", F.lower(F.trim("line"))).orderBy("line_number")
    hits = hits.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return _found(hits, "prompt_injection", "PIPE-PROMPT-001", "HIGH", "A line tries to override the instructions of a model")


def script_lines(rows: DataFrame, text: str = "text", base: str | None = None) -> DataFrame:
    """At most one finding for each line: a remote script piped to a shell, else eval, else exec."""
    line = F.col("line")
    rule = F.when(line.rlike(REMOTE), 1).when(line.rlike(EVAL), 2).when(line.rlike(EXEC), 3)
    hits = lines(rows, text, base).withColumn("_r", rule).filter("_r is not null")
    issue = F.element_at(F.array(*map(F.lit, ["A downloaded script is piped to a shell", "eval runs a command that is put together at run time",
        "exec runs inside a step"])), F.col("_r"))
    severity = F.when((F.col("_r") == 1) | ((F.col("_r") == 2) & line.rlike(EVAL_TAINTED)), "HIGH").otherwise("MEDIUM")
    return _found(hits, "script_injection", F.concat(F.lit("PIPE-SCRIPT-00"), F.col("_r").cast("string")), severity, issue)


def input_trust_lines(rows: DataFrame, text: str = "text", base: str | None = None) -> DataFrame:
    hits = lines(rows, text, base).filter(F.col("line").rlike(UNTRUSTED))
    return _found(hits, "external_input", "PIPE-INPUT-001", F.when(F.col("line").rlike(SINK), "HIGH").otherwise("MEDIUM"),
        "Input from outside the repository reaches a command")


def pipeline_findings(snippets: DataFrame) -> DataFrame:
    """All findings of pipeline steps, once for each (type, file, line, issue)."""
    rows = snippets.withColumn("_block", F.xxhash64("file_path", "line_number", "script", "source")).withColumnRenamed("line_number", "base")
    all_ = injection_lines(rows, "serialized", "base", ["_block"]).unionByName(script_lines(rows, "script", "base")).unionByName(input_trust_lines(
        rows, "serialized", "base"))
    first = Window.partitionBy("type", "file_path", "line_number", "issue").orderBy("rule_id", "severity", "line_content")
    return all_.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


# ---- secrets

# Kind, pattern (group 1: the value), severity; an assignment's value may be quoted.
SECRETS = [
    ("private_key", r"(-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----)", "HIGH"),
    ("aws_key", r"(AKIA[0-9A-Z]{16})", "HIGH"),
    ("azure_connection_string", r"(?i)(DefaultEndpointsProtocol=[^\s\"']{20,})", "HIGH"),
    ("azure_storage_key", r"(?i)(?:AccountKey|storage[_-]?key)\s*[:=]\s*[\"']?([A-Za-z0-9+/=]{20,})", "HIGH"),
    ("api_key", r"(?i)(?:api[_-]?key|apikey)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_\-]{16,})", "HIGH"),
    ("token", r"(?i)(?:token|bearer)[\"']?\s*[:=]\s*[\"']?([A-Za-z0-9_.\-]{16,})", "HIGH"),
    ("password", r"(?i)(?:password|passwd|pwd)[\"']?\s*[:=]\s*[\"']?([^\s,\"']{8,})", "HIGH"),
]
PLACEHOLDERS = ["changeme", "change_me", "placeholder", "example", "your_", "your-", "xxxx", "dummy", "<", "${", "var.", "todo"]
# Patterns whose first group is redacted (the whole match where there is none).
REDACTIONS = [
    (r"(?i)((?:api[_\-]?key|apikey|access[_\-]?token|auth[_\-]?token|bearer)\s*[:=]\s*['\"]?)[A-Za-z0-9\-_]{16,64}['\"]?", True),
    (r"(?i)AKIA[0-9A-Z]{16}", False),
    (r"(?i)(aws[_\-]?secret[_\-]?access[_\-]?key\s*[:=]\s*['\"]?)[A-Za-z0-9+/]{40}['\"]?", True),
    (r"(?i)ghp_[A-Za-z0-9]{36}", False),
    (r"(?i)(github[_\-]?token\s*[:=]\s*['\"]?)[A-Za-z0-9\-_]{20,}['\"]?", True),
    (r"(?i)(password\s*[:=]\s*['\"]?)[^\s,'\"]{8,}['\"]?", True),
    (r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", False),
    (r"(?i)((?:connection[_\-]?string|conn[_\-]?str)\s*[:=]\s*['\"]?)[^'\"]{10,}['\"]?", True),
]


def redact(text: Column) -> Column:
    for pattern, grouped in REDACTIONS:
        text = F.regexp_replace(text, pattern, "$1[REDACTED]" if grouped else "[REDACTED]")
    return text


def high_entropy(rows: DataFrame, key: str, text: str, least: float = 4.5, length: int = 20) -> DataFrame:
    """key, token, entropy of the distinct long tokens at or above the threshold."""
    found = F.array_distinct(F.concat(F.regexp_extract_all(text, F.lit(B64_TOKEN), F.lit(0)), F.regexp_extract_all(text, F.lit(HEX_TOKEN), F.lit(0))))
    each = rows.select(key, F.explode(found).alias("token")).filter(F.length("token") >= length)
    return each.withColumn("entropy", F.round(entropy(F.col("token")), 6)).filter(F.col("entropy") >= least)


def masked(value: Column) -> Column:
    return F.concat(F.substring(value, 1, 4), F.lit("***"))


def secret_lines(rows: DataFrame, text: str = "text", least: float = 4.5) -> DataFrame:
    """file_path, line_number, secret_type, match (masked), confidence, severity, line_content (values masked).

    Each line gives one finding for each kind; placeholders are left out, and a line with a named kind gives no high_entropy.
    """
    each = lines(rows, text)
    line = F.col("line")
    low = lambda v: F.lower(v)
    plain = lambda v: ~F.exists(F.array(*map(F.lit, PLACEHOLDERS)), lambda p: F.contains(low(v), p))
    named = F.array_compact(F.array(*[F.when(line.rlike(p) & plain(F.regexp_extract(line, p, 1)), F.struct(F.lit(k).alias("secret_type"),
        F.regexp_extract(line, p, 1).alias("value"), F.lit(s).alias("severity"), F.lit("high").alias("confidence"))) for k, p, s in SECRETS]))
    token = F.filter(F.regexp_extract_all(line, F.lit(B64_TOKEN), F.lit(0)), lambda t: (entropy(t) >= least) & plain(t))
    loose = F.transform(F.array_distinct(token), lambda t: F.struct(F.lit("high_entropy").alias("secret_type"), t.alias("value"),
        F.lit("MEDIUM").alias("severity"), F.lit("medium").alias("confidence")))
    # of several kinds on one value the first counts
    rows = each.select("file_path", "line_number", "line", named.alias("_named"), loose.alias("_loose")).filter((F.size("_named") > 0) | (F.size("_loose") > 0))
    found = rows.select("file_path", "line_number", "line", F.explode(F.when(F.size("_named") > 0, F.array_distinct("_named")).otherwise(
        F.col("_loose"))).alias("f"))
    first = Window.partitionBy("file_path", "line_number", "f.value").orderBy(F.array_position(F.array(*[F.lit(k) for k, _, _ in SECRETS]),
        F.col("f.secret_type")))
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return found.select("file_path", "line_number", F.col("f.secret_type").alias("secret_type"), masked(F.col("f.value")).alias("match"),
        F.col("f.confidence").alias("confidence"), F.col("f.severity").alias("severity"), F.substring(F.replace("line", F.col("f.value"),
        masked(F.col("f.value"))), 1, 240).alias("line_content"))


def secret_findings(rows: DataFrame, text: str = "text") -> DataFrame:
    """Secrets as issues: rule id, title and advice added."""
    found = secret_lines(rows, text)
    return found.select("*", F.concat(F.lit("SEC-"), F.upper("secret_type")).alias("rule_id"), F.concat(F.lit("Hardcoded "), F.replace("secret_type",
        F.lit("_"), F.lit(" "))).alias("issue"), F.lit("Move the value into Azure Key Vault or another secret store and rotate it.").alias("fix"))


def secret_report(files: DataFrame, text: str = "text") -> DataFrame:
    """One row: issues by severity, files that were analysed (clean ones too), files with findings, the worst severity."""
    found = secret_findings(files, text)
    n = lambda s: F.count_if(F.col("severity") == s)
    counts = found.agg(F.count(F.lit(1)).alias("total"), n("HIGH").alias("high"), n("MEDIUM").alias("medium"), n("LOW").alias("low"),
        F.countDistinct("file_path").alias("files_with_findings"))
    worst = F.when(F.col("high") > 0, "HIGH").when(F.col("medium") > 0, "MEDIUM").when(F.col("low") > 0, "LOW").otherwise("NONE")
    return counts.crossJoin(F.broadcast(files.agg(F.countDistinct("file_path").alias("files_analysed")))).withColumn("worst", worst)
