"""The engine as one object: ingest files, search, route a question, scan a repository."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkseam.functions import classify as C
from sparkseam.functions.text import terms
from sparkseam.operators import analysers, chunking, context, detectors, federation, iam, prompts, report, rules, search, store
from sparkseam.operators.keyword_index import KeywordIndex
from sparkseam.sources import files as files_
from sparkseam.sources import parsers
from sparkseam.session import exists, materialise, remove, spread


def tagged(chunks: DataFrame) -> DataFrame:
    """chunks with resource_type, cloud_provider and category; what they have already wins."""
    kind = C.filled(F.col("resource_type"), C.resource_type(F.col("file_type"), F.col("text")))
    cloud = C.provider_alias(C.provider(kind, F.col("text"), F.col("file_path")))
    return chunks.withColumn("resource_type", kind).withColumn("cloud_provider", cloud).withColumn("category", C.category(kind, F.col("text")))


#: What each detector reads files with; a file that a reader fails on is an error of that detector.
READERS = {"pipeline": parsers.read_snippets, "iam": parsers.read_roles, "workload_identity": parsers.read_federation}
READS = {"pipeline": ("yaml",), "iam": ("terraform", "yaml", "json"), "workload_identity": ("terraform", "yaml", "json")}


def scan_issues(files: DataFrame) -> DataFrame:
    """Issues (file_path, rule_id, issue, line_number, severity, detector, ord) of all detectors over parsed files (file_path, file_type, content)."""
    text = spread(files.select("file_path", F.col("content").alias("text")))  # a few bytes of a table may be very many files
    of = lambda name: files.filter(F.col("file_type").isin(*READS[name]))
    line0 = F.lit(0)
    # each detector reads what was parsed several times; it is parsed once
    steps, roles = materialise(parsers.pipeline_snippets(of("pipeline")), "steps"), materialise(parsers.role_assignments(of("iam")), "roles")
    parts = [
        detectors.pipeline_findings(steps).select("file_path", "rule_id", "issue", "line_number", "severity",
            F.lit("pipeline").alias("detector")),
        detectors.secret_findings(text).select("file_path", "rule_id", "issue", "line_number", "severity", F.lit("secrets").alias("detector")),
        iam.analyse(roles).select("file_path", "rule_id", "issue", line0.alias("line_number"), "severity",
            F.lit("iam").alias("detector")),
        federation.findings(parsers.federation_configs(of("workload_identity"))).select("file_path", "rule_id", "issue", line0.alias("line_number"),
            "severity", F.lit("workload_identity").alias("detector")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("ord", F.xxhash64("file_path", "rule_id", "issue", "line_number", "severity"))


def scan_errors(files: DataFrame) -> DataFrame:
    """file_path, detector, error for every file that a detector can't read; its other files and the other detectors go on."""
    out = None
    for name, read in READERS.items():
        part = parsers.failures(files.filter(F.col("file_type").isin(*READS[name])), {name: read})
        out = part if out is None else out.unionByName(part)
    return out


@dataclass
class Cache:
    """Answers by all parameters of a question until their time is over. Holds as many as are asked within that time."""

    seconds: float = 300.0
    now: Callable[[], float] = time.time
    entries: dict = field(default_factory=dict)

    def get(self, key):
        value, expiry = self.entries.get(key, (None, 0.0))
        return value if self.seconds > 0 and self.now() < expiry else None

    def put(self, key, value) -> None:
        if self.seconds > 0:
            self.entries = {k: v for k, v in self.entries.items() if self.now() < v[1]}
            self.entries[key] = (value, self.now() + self.seconds)

    def stats(self) -> dict[str, int]:
        live = sum(self.now() < expiry for _, expiry in self.entries.values())
        return {"total": len(self.entries), "live": live, "expired": len(self.entries) - live}

    def clear(self) -> None:
        self.entries = {}


CHUNK_BUDGET, RULE_BUDGET = 1950, 1050
#: What is retrieved for an intent that is judged by rule: a filter before the search, and a test of what it finds.
ROUTES = {"iam": ({"cloud_provider": "azure"}, "category = 'identity'"), "workload_identity": (None, "category = 'identity'"),
    "secrets": (None, "category = 'secrets'"), "prompt_injection": (None, "file_type = 'yaml'")}
# What a model is told to look at for the other intents.
HINTS = {"network": "network exposure, firewall, and public access", "compliance": "compliance, benchmark, and policy violations",
    "general_security": "general security"}


@dataclass
class Engine:
    """The engine's state in a folder.

    An ingest appends a segment (chunks with embeddings, and the hashes of its files) and then a manifest that names the
    segments: the manifest with the highest number holds, so a reader sees all of an ingest or nothing of it, and what
    an ingest that failed has written is named by none. A file's chunks count in its latest segment only. compact()
    writes what counts into one segment.
    """

    spark: SparkSession
    root: str
    dimension: int = 64
    answer: prompts.Answer = prompts.silent
    cache: Cache = field(default_factory=Cache)

    def _manifests(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/manifest")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(path) if x.getPath().getName().isdigit()) if fs.exists(path) else []

    def _newest(self) -> tuple[int, list[str]]:
        """Number and segments of the newest manifest whose parts all exist; a damaged one gives way to the one before."""
        for number in reversed(self._manifests()):
            row = self.spark.read.text(f"{self.root}/manifest/{number}").first()
            names = row[0].split(",") if row else []
            if names and all(exists(self.spark, f"{self.root}/segments/{n}/{part}") for n in names for part in ("chunks", "files")):
                return number, names
        return 0, []

    def _segments(self) -> list[str]:
        return self._newest()[1]

    def _next(self) -> int:
        """A number above those of all manifests there are, and so above all segments'."""
        return (self._manifests() or [0])[-1] + 1

    def has_entries(self) -> bool:
        rows = self._read("files")
        return rows is not None and not rows.isEmpty()

    def _publish(self, segments: list[str]) -> None:
        """Writes the next manifest aside and renames it; a number that is taken already makes it fail."""
        number = self._next()
        aside, final = f"{self.root}/aside-{uuid.uuid4().hex}", f"{self.root}/manifest/{number}"
        self.spark.range(1).select(F.lit(",".join(segments)).alias("value")).coalesce(1).write.text(aside)
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(final).getFileSystem(self.spark._jsc.hadoopConfiguration())
        fs.mkdirs(p(f"{self.root}/manifest"))
        if fs.exists(p(final)) or not fs.rename(p(aside), p(final)):
            raise RuntimeError("another ingest was published meanwhile; ingest again")

    def _read(self, name: str) -> DataFrame | None:
        paths = [f"{self.root}/segments/{s}/{name}" for s in self._segments()]
        return self.spark.read.parquet(*paths) if paths else None

    def registry(self) -> DataFrame | None:
        """file_path, content_hash, segment: the latest of each file."""
        rows = self._read("files")
        return None if rows is None else rows.groupBy("file_path").agg(F.max_by("content_hash", "segment").alias("content_hash"),
            F.max("segment").alias("segment"))

    def chunks(self) -> DataFrame | None:
        """The chunks of the latest version of each file; a text that several files hold is there once, under its smallest id."""
        rows = self._live()
        if rows is None:
            return None
        first = rows.groupBy("content_hash").agg(F.min("index_id").alias("index_id"))  # ids alone are compared, texts are moved once
        return self._read("chunks").join(first.select("index_id"), "index_id", "left_semi")

    def _live(self) -> DataFrame | None:
        """The same with a row for each file that holds a text, so that a text outlives its first file."""
        rows = self._read("chunks")
        one = None if rows is None else rows.select(F.size("embedding")).first()  # all rows of a store have one dimension
        if one and one[0] != self.dimension:
            raise ValueError(f"the stored vectors don't have {self.dimension} dimensions")
        return None if rows is None else rows.join(self.registry().select("file_path", "segment"), ["file_path", "segment"], "left_semi")

    def _append(self, segments: list[str], chunks: DataFrame, files: DataFrame) -> None:
        name = uuid.uuid4().hex
        chunks.write.parquet(f"{self.root}/segments/{name}/chunks")
        files.write.parquet(f"{self.root}/segments/{name}/files")
        self._publish([*segments, name])

    def ingest(self, files: DataFrame, size: int = 400, overlap: int = 40, strategy: str = "hybrid") -> DataFrame:
        """Adds what changed of parsed files (file_path, file_type, content); chunks of a changed file are replaced."""
        segments, registry = self._segments(), self.registry()
        number = self._next()
        fresh = store.changed(files, registry) if registry is not None else files.withColumn("content_hash", store.content_hash("content"))
        fresh = materialise(fresh, "fresh")
        if not fresh.isEmpty():
            had = self._read("chunks")  # of all segments, so that no id is given twice
            chunks = chunking.structured_chunks(fresh, size, overlap, strategy).withColumn("ord", F.xxhash64("chunk_id", "file_path"))
            first = store.next_id(had if had is not None else self.spark.range(0).withColumnRenamed("id", "index_id"))
            # a chunk is moved once, to its number; it is tagged and embedded where it is written
            new = store.embed(tagged(store.numbered_by_hash(chunks, "ord", first)), self.dimension).withColumn("segment", F.lit(number))
            self._append(segments, new, fresh.select("file_path", "content_hash", F.lit(number).alias("segment")))
            self._index()
        self.cache.clear()
        return self.chunks()

    def _index(self) -> None:
        """Brings the keyword index to the newest manifest's chunks. Without its mark, from before the first change on, nobody reads it."""
        number = self._newest()[0]
        remove(self.spark, f"{self.root}/keywords-of")
        # a text's hash stands for it; only texts that are new to the index are read
        KeywordIndex(self.spark, f"{self.root}/keywords").sync(self.chunks(), "index_id", "text", "content_hash", self._read("chunks"))
        self.spark.range(1).select(F.lit(str(number)).alias("value")).coalesce(1).write.text(f"{self.root}/keywords-of")

    def _keywords(self) -> KeywordIndex | None:
        """The keyword index if it is the newest manifest's; an ingest that ended before its index leaves searches to scan the chunks."""
        path = f"{self.root}/keywords-of"
        if not exists(self.spark, f"{path}/_SUCCESS") or int(self.spark.read.text(path).first()[0]) != self._newest()[0]:
            return None
        return KeywordIndex(self.spark, f"{self.root}/keywords")

    def compact(self) -> None:
        """One segment in place of all. The old ones stay on disk until remove_old(), for readers that began before."""
        chunks, files = self._live(), self.registry()
        if chunks is not None:
            self._append([], chunks, files)
            self._index()

    def remove_old(self) -> int:
        """Deletes segments that the manifest doesn't name, and earlier manifests; returns how many segments went."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        fs = p(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())
        newest, names = self._newest()
        named = set(names)
        gone = [x.getPath() for x in fs.listStatus(p(f"{self.root}/segments")) if x.getPath().getName() not in named]
        for number in self._manifests():
            if number < newest:
                fs.delete(p(f"{self.root}/manifest/{number}"), True)
        for path in gone:
            fs.delete(path, True)
        return len(gone)

    def clear(self) -> None:
        remove(self.spark, self.root)
        self.cache.clear()

    def retrieve(self, query: str, k: int = 12, where: dict | None = None, depth: int = 0) -> DataFrame:
        """Hybrid top-k of the stored chunks, by the keyword index; with a depth, then what they depend on within so many levels."""
        have = self.chunks()
        if have is None:
            raise FileNotFoundError("nothing has been ingested")
        vector = store.embed(self.spark.range(1).select(F.lit(query).alias("text")), self.dimension).select("embedding").first()[0]
        asked = self.spark.range(1).select(terms(F.lit(query))).first()[0]
        found = search.hybrid(have, have, asked or [""], list(vector), k, "index_id", "text", "index_id", where, keywords=self._keywords(), agree=True).select("id",
            F.col("final_score").alias("score"), "rank", "semantic_score", "keyword_score")
        if depth > 0:
            rows = chunking.resolve(have.withColumn("_at", F.col("index_id")), "_at")
            named = rows.select("index_id", "chunk_id")
            edges = rows.select(F.col("index_id").alias("src"), F.explode("dependencies").alias("chunk_id")).join(named, "chunk_id").select("src",
                F.col("index_id").alias("dst"))
            met = chunking.expand(edges, found.select("id"), named.select(F.col("index_id").alias("id")), depth + 1)
            found = chunking.append_dependencies(found, met).join(found.select("id", "semantic_score", "keyword_score"), "id", "left")
        shown = have.select(F.col("index_id").alias("id"), "chunk_id", "file_path", "file_type", "resource_type", "cloud_provider", "category", "text")
        return found.withColumnRenamed("score", "final_score").join(shown, "id")

    def rules_for(self, found: DataFrame, k: int = 7) -> DataFrame:
        resources = found.groupBy("resource_type", "cloud_provider", "category").agg(F.min("rank").alias("rank"))
        return rules.rule_aware(resources, rules.catalogue(self.spark), k)

    def analyze(self, query: str, k: int = 12, k_rules: int = 7, where: dict | None = None, hint: str = "") -> dict:
        """A question's structured answer: issues and evidence as tables of k rows at most, the model's text, its summary, and how it was found.

        The answer is cached by all parameters.
        """
        key = (query, k, k_rules, json.dumps(where or {}, sort_keys=True), hint)
        if (kept := self.cache.get(key)) is not None:
            return kept | {"metadata": kept["metadata"] | {"cached": True}}
        one = F.lit(1).alias("qid")
        found = materialise(self.retrieve(query, k, where), "retrieved")
        hold = materialise(self.rules_for(found, k_rules).join(rules.catalogue(self.spark).select("rule_id", "title", "resource_type",
            "cloud_provider", "category"), "rule_id"), "rules")
        texts = rules.rule_text(rules.catalogue(self.spark))
        head = context.header(F.col("rank"), F.col("chunk_id"), F.col("cloud_provider"), F.col("resource_type"), F.col("file_path"), F.col("file_type"))
        code = context.pack_code(found.select(one, "rank", head.alias("header"), "text"), CHUNK_BUDGET, ["qid"])
        entries = context.pack_rules(hold.join(texts, "rule_id").select(one, "rank", F.concat(F.lit("["), F.col("rank"), F.lit("] "),
            F.col("rule_id")).alias("header"), "text"), RULE_BUDGET, ["qid"])
        resources = found.groupBy("resource_type", "cloud_provider", "category").agg(F.min("rank").alias("rank")).select(one, "*")
        asked = self.spark.range(1).select(one, F.lit(query).alias("query"), F.lit(hint).alias("hint"))
        raw = materialise(prompts.answered(prompts.review(asked, code, entries, resources), self.answer), "answer")
        said = parsers.model_output(raw)
        issues = rules.enrich(parsers.normal_issues(said), hold.filter("rank = 1").select("rule_id", "title"))
        first = raw.join(said.select("qid", "summary"), "qid").first()
        counts = {"code_count": found.count(), "rule_count": hold.count()}
        out = {"query": query, "issues": issues, "code": found, "rules": hold, "analysis": first["raw"], "summary": first["summary"],
            "metadata": {"k_code": k, "k_rules": k_rules, "retrieval": counts, "cached": False}}
        self.cache.put(key, out)
        return out

    def retrieve_within(self, query: str, k: int, where: dict | None = None, kept: str | None = None) -> DataFrame:
        """The k best that pass a test, out of three times as many (at least 10)."""
        found = self.retrieve(query, max(3 * k, 10), where)
        if kept is None:
            return found.filter(F.col("rank") <= k)
        return search.post_filtered(found, F.expr(kept), k, "final_score")

    def dispatch(self, query: str, k: int = 5, k_rules: int = 3, intent: str | None = None, said: DataFrame | None = None) -> dict:
        """A question answered by its intent (by keywords, if none is given), in one form for all intents.

        intent, query; findings (analysers.FINDING; `issues` is the same); code: what was retrieved; sources: file_path of code and findings,
        each once; rules; summary and metadata. Access, federation, secrets and pipeline questions are judged by rule over what
        was retrieved for them (said: a model's findings, merged in); others go to analyze() with the intent's hint.
        """
        intent = intent or self.spark.range(1).select(C.intent(F.lit(query))).first()[0]
        if intent in ROUTES:
            where, kept = ROUTES[intent]
            code = materialise(self.retrieve_within(query, k, where, kept), "code")
            units = analysers.access_chunks(code, self._live().drop("index_id")) if intent == "iam" else code
            done = analysers.analyse(intent, analysers.of_chunks(units), said, all_files=True)
            findings, summary, hold, analysis = done.findings, done.summary.first().asDict(), None, ""
            meta = {"files_analyzed": summary["files"], "units": summary["units"], "retrieval": {"code_count": code.count(), "rule_count": 0}}
        else:
            out = self.analyze(query, k, k_rules, hint=HINTS.get(intent, HINTS[C.DEFAULT_INTENT]))
            code, hold, analysis, summary, meta = out["code"], out["rules"], out["analysis"], out["summary"], out["metadata"]
            issues = out["issues"].withColumnsRenamed({"title": "issue"})
            findings = analysers.finding(issues.withColumn("type", F.lit(intent)))
        return {"intent": intent, "query": query, "findings": findings, "issues": findings, "code": code, "rules": hold, "analysis": analysis,
            "summary": summary, "sources": report.sources(code, findings), "chunks_retrieved": meta["retrieval"]["code_count"], "metadata": meta}

    def ci_scan(self, files: DataFrame, policy: dict | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Issues, summary (with the number of detector errors) and policy verdict of a repository."""
        issues, summary = report.run([scan_issues(files)], scan_errors(files), "ord")
        return issues, summary, report.evaluate(issues, report.policy_frame(self.spark, policy or report.DEFAULT_POLICY))

    def scan_folder(self, folder: str) -> DataFrame:
        return files_.parse(files_.scan(self.spark, folder), **files_.provenance(folder))
