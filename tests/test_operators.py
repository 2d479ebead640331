"""Boundary values and stateful operators."""

import math
import random
import re
import unicodedata

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkseam.functions import text as T
from sparkseam.operators import chunking, context, detectors, governance, iam, quality, ranges, report, rules, search, store
from sparkseam.operators.keyword_index import KeywordIndex
from sparkseam.plans.engine import Cache, Engine
from sparkseam.plans.fixtures import frame
from sparkseam.sources import files, parsers


def one(spark, value, **cols):
    row = frame(spark, list(cols), [tuple(cols.values())]) if cols else spark.range(1)
    return row.select(value.alias("v")).first()["v"]


def test_windows_stop_at_the_first_that_reaches_the_end(spark):
    rng = random.Random(1)
    for _ in range(12):
        w = [f"w{i}" for i in range(rng.randint(0, 30))]
        size = rng.randint(2, 9)
        over = rng.randint(0, size - 1)
        want, at = [], 0
        while w:
            want.append(" ".join(w[at : at + size]))
            if at + size >= len(w):
                break
            at += size - over
        assert (one(spark, T.windows(F.col("t"), size, over), t="  ".join(w) or " ") or []) == want
    with pytest.raises(ValueError):
        T.windows(F.col("t"), 4, 4)


def test_entropy(spark):
    for t in ("", "aaaa", "abcd", "aab é🙂"):
        want = -sum(p * math.log2(p) for p in (t.count(c) / len(t) for c in set(t))) if t else 0.0
        assert one(spark, T.entropy(F.col("t")), t=t) == pytest.approx(want)
        assert one(spark, T.long_text_entropy(F.col("t")), t=t) == pytest.approx(want)


def test_entropy_bound_holds_and_the_gate_changes_nothing(spark):
    rng = random.Random(5)
    texts = ["", "a", "aaaa", "the cat sat on the mat " * 9, "".join(map(chr, range(33, 127))), "日本語🙂é" * 3, "".join(map(chr, range(0x4E00, 0x4E60))),
        *("".join(rng.choices([*map(chr, range(32, 127)), "é", "日"], k=rng.randint(1, 400))) for _ in range(40))]
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select(T.long_text_entropy(F.col("t")).alias("e"), T.entropy_bound(F.col("t")).alias("b"),
        *[T.entropy_is_above(F.col("t"), x).alias(f"g{i}") for i, x in enumerate((2.0, 4.0, 5.5, 6.0))])
    for r in rows.collect():
        assert r["b"] >= r["e"] - 1e-9
        assert [r[f"g{i}"] for i in range(4)] == [r["e"] > x for x in (2.0, 4.0, 5.5, 6.0)]


def test_patterns_in_one_pass_keep_their_flags(spark):
    patterns = ["(?i)drop\\s+it", "Stop", "(?s)a.b"]
    texts = ["DROP  it", "stop", "Stop", "a\nb", "A\nB", "", "x"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", governance.any_of(F.col("t"), patterns).alias("v")).collect()
    assert {r["t"]: r["v"] for r in got} == dict(zip(texts, [True, False, True, True, False, False, False]))


def test_high_entropy_threshold_is_inclusive(spark):
    rows = frame(spark, ["k", "t"], [("a", "abcdefghijklmnopqrst"), ("b", "abcdefghijklmnopqrs"), ("c", "a" * 40)])
    exact = math.log2(20)
    assert [r["k"] for r in detectors.high_entropy(rows, "k", F.col("t"), round(exact, 6)).collect()] == ["a"]


def test_trust_and_policy_limits(spark):
    rows = frame(spark, ["i", "trust_score"], [("a", 0.7), ("b", 0.69), ("c", None)])
    assert {r["i"]: r["trusted"] for r in governance.trusted(rows, 0.7).collect()} == {"a": True, "b": False, "c": True}
    issues = frame(spark, ["severity", "file_path"], [("MEDIUM", "f")] * 5)
    verdict = lambda n: {r["severity"]: r["violated"] for r in report.evaluate(issues, report.policy_frame(spark,
        {"max_allowed": {"medium": n}})).collect()}["MEDIUM"]
    assert not verdict(5) and verdict(4)
    with pytest.raises(ValueError):
        report.policy_of("environments: {}", "prod")
    assert report.policy_of("[not a mapping")["max_allowed"]["medium"] == 5


def test_short_answers_count_below_five_words(spark):
    rows = frame(spark, ["query", "answer", "docs"], [("q", "a b c d e", "a b c d e"), ("q", "a b c d", "a b c d")]).withColumn("docs", F.array("docs"))
    assert sorted(r["confidence_score"] for r in quality.signals(rows).collect()) == [0.6, 1.0]


def test_bfs_depth_one_is_the_seeds(spark):
    edges = frame(spark, ["src", "dst"], [("a", "b"), ("b", "c"), ("c", "a")])
    nodes, seeds = frame(spark, ["id"], [("a",), ("b",), ("c",)]), frame(spark, ["id"], [("a",), ("zz",)])
    got = lambda d: {r["id"]: r["level"] for r in chunking.expand(edges, seeds, nodes, d).collect()}
    assert got(1) == {"a": 0} and got(2) == {"a": 0, "b": 1} and got(9) == {"a": 0, "b": 1, "c": 2}


def test_fusion_with_one_weight_is_the_branch(spark):
    a, b = frame(spark, ["id", "score"], [(1, 0.5), (2, 0.25)]), frame(spark, ["id", "score"], [(2, 1.0), (3, 0.5)])
    only = lambda s, k: {r["id"]: r["final_score"] for r in search.fuse(a, b, s, k).collect()}
    assert only(1.0, 0.0) == {1: 0.5, 2: 0.25, 3: 0.0} and only(0.0, 1.0) == {1: 0.0, 2: 1.0, 3: 0.5}
    with pytest.raises(ValueError):
        search.fuse(a, b, 1.5, 0.0)


def test_insert_is_idempotent(spark):
    batch = frame(spark, ["ord", "text"], [(1, "a"), (2, "b"), (3, "a"), (4, "")])
    empty = batch.limit(0).withColumn("content_hash", F.lit("")).withColumn("index_id", F.lit(0).cast("long"))
    first = store.insert_new(empty, batch, "ord")
    assert sorted((r["text"], r["index_id"]) for r in first.collect()) == [("", 2), ("a", 0), ("b", 1)]
    assert store.insert_new(first, batch, "ord").count() == 0


def test_empty_tables(spark):
    none = frame(spark, ["ord", "text", "file_path", "content", "file_type"], [(1, "a", "f", "x", "yaml")]).filter("false")
    assert chunking.fixed_windows(none, 4, 2).count() == 0 and chunking.structured_chunks(none).count() == 0
    assert detectors.secret_lines(none).count() == 0 and parsers.pipeline_snippets(none).count() == 0
    assert search.bm25(none, ["a"], "ord", "text").count() == 0


def test_truncation_and_packing(spark):
    text = " ".join(f"w{i}" for i in range(200))
    assert one(spark, context.truncated(F.col("t"), F.lit(30)), t=text).split()[-1] == "w39…"
    rows = frame(spark, ["g", "rank", "header", "text"], [("x", i, f"[{i}]", text) for i in range(1, 6)])
    got = context.pack_code(rows, 400, ["g"]).orderBy("rank").collect()
    assert [r["whole"] for r in got] == [True, True, False]


def test_redaction_keeps_the_prefix(spark):
    assert one(spark, detectors.redact(F.col("t")), t="api_key = 'abcdefghijklmnop1234' and ghp_" + "a" * 36) == "api_key = '[REDACTED] and [REDACTED]"


def test_model_output_shapes(spark):
    rows = frame(spark, ["raw"], [('{"issues": [{"title": "x", "severity": "HIGH", "cwe": "CWE-1"}]}',), ("nothing",)])
    got = parsers.normal_issues(parsers.model_output(rows)).collect()
    assert len(got) == 1 and got[0]["errors"] == ["affected_resource", "evidence_snippet"]


def test_scan_parse_and_engine(spark, tmp_path):
    root = tmp_path / "repo"
    (root / "a").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "a" / "main.tf").write_text('resource "aws_s3_bucket" "b" {\n  acl = "public-read"\n}\n')
    (root / "a" / "pod.YAML").write_text("kind: Pod\nmetadata:\n  name: web\n")
    (root / "bad.json").write_text("{")
    (root / "node_modules" / "x.json").write_text("{}")
    (root / "readme.md").write_text("no")
    parsed = files.parse(files.scan(spark, str(root)))
    assert {(r["file_path"], r["file_type"]) for r in parsed.collect()} == {("a/main.tf", "terraform"), ("a/pod.YAML", "yaml")}
    with pytest.raises(Exception):
        files.scan(spark, str(root / "missing")).count()
    engine = Engine(spark, str(tmp_path / "state"))
    with pytest.raises(FileNotFoundError):
        engine.retrieve("bucket")
    assert engine.ingest(parsed).count() == 2
    assert engine.ingest(parsed).count() == 2
    (root / "a" / "main.tf").write_text('resource "aws_s3_bucket" "c" {\n  acl = "private"\n}\n')
    again = engine.ingest(files.parse(files.scan(spark, str(root))))
    assert {r["chunk_id"] for r in again.collect()} == {"main_resource_aws_s3_bucket_c", "pod_yaml_Pod_web"}
    assert engine.retrieve("s3 bucket acl", 1).first()["file_path"] == "a/main.tf"
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "state"), dimension=3).chunks()
    # compaction keeps the state, and old segments can go
    before = sorted(r["chunk_id"] for r in engine.chunks().collect())
    engine.compact()
    assert sorted(r["chunk_id"] for r in engine.chunks().collect()) == before and len(engine._segments()) == 1
    assert engine.remove_old() >= 2 and sorted(r["chunk_id"] for r in engine.chunks().collect()) == before
    assert engine.has_entries()
    # a manifest that names a segment which isn't there gives way to the one before
    spark.range(1).selectExpr("'missing' as value").coalesce(1).write.text(str(tmp_path / "state" / "manifest" / "99"))
    assert sorted(r["chunk_id"] for r in engine.chunks().collect()) == before
    engine.clear()
    assert engine.chunks() is None and not engine.has_entries()


def held(engine):
    return sorted(r["text"] for r in engine.chunks().collect())


def tf(name, value):
    return f'variable "{name}" {{\n  default = {value}\n}}\n'


def test_store_after_old_versions_went(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"))
    put = lambda *rows: engine.ingest(frame(spark, ["file_path", "file_type", "content"], [(p, "terraform", c) for p, c in rows]))
    for value in (1, 2):
        put(("a.tf", tf("a", value)), ("b.tf", tf("b", value)))
    engine.compact()
    assert engine.remove_old() == 2
    put(("a.tf", tf("a", 3)))
    assert held(engine) == [tf("a", 3).strip(), tf("b", 2).strip()]
    # a damaged manifest on top doesn't cost the one that counts
    spark.range(1).selectExpr("'missing' as value").coalesce(1).write.text(str(tmp_path / "state" / "manifest" / "99"))
    engine.remove_old()
    put(("a.tf", tf("a", 4)))
    assert held(engine) == [tf("a", 4).strip(), tf("b", 2).strip()]


def test_a_text_outlives_its_first_file(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"))
    put = lambda p, c: engine.ingest(frame(spark, ["file_path", "file_type", "content"], [(p, "terraform", c)]))
    put("a.tf", tf("same", 1))
    put("d.tf", tf("same", 1))
    assert held(engine) == [tf("same", 1).strip()]
    put("a.tf", tf("other", 1))
    assert held(engine) == [tf("other", 1).strip(), tf("same", 1).strip()]
    engine.compact()
    put("a.tf", tf("same", 1))
    put("d.tf", tf("third", 1))
    assert held(engine) == [tf("same", 1).strip(), tf("third", 1).strip()]
    ids = [r["index_id"] for r in engine._read("chunks").collect()]
    assert len(set(ids)) == len(ids)


def test_answers_are_kept_by_all_parameters(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "state"))
    engine.ingest(frame(spark, ["file_path", "file_type", "content"], [(f"{i}.tf", "terraform", tf(f"v{i}", i)) for i in range(4)]))
    one, more = engine.analyze("variable default", 1, 1), engine.analyze("variable default", 3, 2)
    assert one["metadata"]["k_code"] == 1 and more["metadata"]["k_code"] == 3 and not more["metadata"]["cached"] and more["code"].count() == 3
    assert engine.analyze("variable default", 3, 2)["metadata"]["cached"]


def test_retrieval_follows_dependencies(spark, tmp_path):
    parsed = frame(spark, ["file_path", "file_type", "content"],
        [("m.tf", "terraform", 'variable "zone" {\n  default = "x"\n}\nresource "aws_instance" "web" {\n  size = var.zone\n}\n')])
    engine = Engine(spark, str(tmp_path / "state"))
    engine.ingest(parsed)
    near = engine.retrieve("aws_instance web size", 1).collect()
    far = engine.retrieve("aws_instance web size", 1, depth=1).orderBy("rank").collect()
    assert [r["chunk_id"] for r in near] == ["m_resource_aws_instance_web"]
    assert [(r["chunk_id"], r["rank"]) for r in far] == [("m_resource_aws_instance_web", 1), ("m_variable_zone", 2)] and far[1]["final_score"] == 0


def test_cache_ends_with_its_time():
    now = [0.0]
    cache = Cache(10, lambda: now[0])
    cache.put("a", 1)
    now[0] = 5
    cache.put("b", 2)
    assert cache.get("a") == 1 and cache.stats() == {"total": 2, "live": 2, "expired": 0}
    now[0] = 12
    assert cache.get("a") is None and cache.get("b") == 2 and cache.stats() == {"total": 2, "live": 1, "expired": 1}
    cache.clear()
    assert cache.stats()["total"] == 0 and Cache(0).put("a", 1) is None


def test_provenance_and_configuration(tmp_path):
    import subprocess

    run = lambda *c, at: subprocess.run(["git", "-c", "user.name=a", "-c", "user.email=a@b.c", *c], cwd=at, check=True, capture_output=True)
    source = tmp_path / "source"
    source.mkdir()
    run("init", "-b", "trunk", at=source)
    (source / "a.tf").write_text("x")
    run("add", "a.tf", at=source)
    run("commit", "-m", "m", at=source)
    got = files.fetch(f"file://{source}", str(tmp_path / "copy"))
    assert got["branch"] == "trunk" and len(got["commit"]) == 8 and got["repo"].endswith("/source")
    assert files.fetch(f"file://{source}", str(tmp_path / "copy")) == got and (tmp_path / "copy" / "a.tf").exists()
    run("remote", "set-url", "origin", "https://me:secret@host.example/x.git", at=tmp_path / "copy")
    assert files.provenance(str(tmp_path / "copy"))["repo"] == "https://host.example/x.git"
    assert files.provenance(str(tmp_path)) == {"repo": "", "branch": "", "commit": ""}
    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "config.yaml").write_text("a: 1")
    assert files.read_config(files.config_path(str(tmp_path))) == {"a": 1}
    (tmp_path / "config.yaml").write_text("a: 2")
    assert files.read_config(files.config_path(str(tmp_path))) == {"a": 2} and files.read_config(files.config_path(str(tmp_path), given="other.yaml")) == {}


def test_rows_are_numbered_in_ranges(spark):
    rows = spark.range(997).selectExpr("id * 7919 % 997 as k", "id % 3 as tie")
    for per in (10**6, 50):
        got = ranges.row_numbers(rows, [F.col("tie"), F.col("k")], "n", per).collect()
        assert [r["n"] for r in sorted(got, key=lambda r: (r["tie"], r["k"]))] == list(range(1, 998))
    assert ranges.row_numbers(rows.filter("false"), [F.col("k")], "n").count() == 0


def test_first_of_each_key(spark):
    rows = frame(spark, ["k", "o", "v"], [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "z"), ("b", 3, "w"), (None, 1, "n"), (None, 0, "m")]).coalesce(1)
    assert sorted((str(r["k"]), r["v"]) for r in store.first_of_each(rows, ["k"], "o").collect()) == [("None", "m"), ("a", "y"), ("b", "w")]
    assert sorted((str(r["k"]), r["v"]) for r in store.first_of_each(rows, ["k"], "o", last=True).collect()) == [("None", "n"), ("a", "x"), ("b", "w")]


def test_keyword_index_is_kept(spark, tmp_path):
    docs = frame(spark, ["id", "text"], [(1, "alpha beta"), (2, "alpha alpha gamma"), (3, "delta")])
    index = KeywordIndex(spark, str(tmp_path / "k"))
    index.add(docs, "id", "text")
    same = lambda rows: {r["id"]: (round(r["raw"], 9), round(r["score"], 9)) for r in rows.collect()}
    assert same(index.bm25(["alpha", "delta"])) == same(search.bm25(docs, ["alpha", "delta"], "id", "text"))
    index.add(frame(spark, ["id", "text"], [(2, "delta only")]), "id", "text")
    index.remove(docs.filter("id = 3"), "id")
    now = frame(spark, ["id", "text"], [(1, "alpha beta"), (2, "delta only")])
    assert same(index.bm25(["alpha", "delta"])) == same(search.bm25(now, ["alpha", "delta"], "id", "text"))
    assert KeywordIndex(spark, str(tmp_path / "k")).docs().count() == 2
    index.clear()
    assert index.docs().count() == 0 and index.sync(now, "id", "text") and not index.sync(now, "id", "text")


def test_query_blocks_need_no_broadcast(spark):
    rng = random.Random(2)
    rows = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(300)] + [(None, [1.0] * 8), (999, None)],
        "vec_id long, embedding array<double>").repartition(5)
    asked = rows.filter("vec_id % 10 = 0")
    both = [sorted(map(tuple, search.vector_batch_topk(rows, asked, 4, broadcast_bytes=size).collect())) for size in (10**9, -1)]
    assert both[0] == both[1] and len(both[0]) == 120
    assert search.vector_batch_topk(rows, asked.filter("false"), 4).count() == 0


def test_knowledge_base(spark, tmp_path):
    kb = rules.KnowledgeBase(spark, str(tmp_path / "kb"))
    assert kb.load_or_build() == 37 == kb.load_or_build()
    raw = ["id", "category", "severity", "title", "description", "indicators", "remediation", "references", "resource_type", "cloud_provider"]
    own = frame(spark, raw, [("own-1", "storage", "low", "Quiet lagoon", "Lagoon shown to herons", "heron", "close it", "none", "lagoon", "azure"),
        ("gcp-01", "storage", "low", "Replaced", "", "", "", "", "x", "gcp")])
    assert kb.add_rules(own) == 2 and kb.load_or_build() == 38
    first = kb.search("lagoon herons", 1).first()
    assert first["rule_id"] == "own-1" and "Indicators: heron" in first["text"] and "Lagoon shown to herons" in first["text"]
    assert kb.rules().filter("rule_id = 'gcp-01'").first()["title"] == "Replaced"


def test_permissions_are_required(spark):
    governance.require(spark, "Admin", permission="manage_users")
    governance.require(spark, "viewer", tool="ledger", extra_tools=frame(spark, ["tool", "permission"], [("Ledger", "read_report")]))
    for wrong in ({"permission": "manage_users"}, {"tool": "unheard_of"}):
        with pytest.raises(PermissionError):
            governance.require(spark, "viewer", **wrong)


def test_overlaps_against_every_pair(spark):
    """Classes of assignments give the findings of all pairs of assignments."""
    rng = random.Random(9)
    roles = ["Owner", "Contributor", "Reader", "Custom A", "Custom B", "Storage Blob Data Contributor"]
    scopes = [("subscription", "/s/1"), ("resource_group", "/s/1/g"), ("resource", "/s/1/g/r"), ("resource", "/S/1/g/"), ("unknown", "var.x"),
        ("unknown", ""), ("resource_group", "/s/1"), ("subscription", "/s/2")]
    data = [(i, rng.choice("ab"), rng.choice(roles), *rng.choice(scopes), f"f{i}", f"b{i}") for i in range(70)]
    rng.shuffle(data)
    names = ["ord", "identity_name", "role", "scope_type", "scope_value", "file_path", "block_name"]
    order, path = (lambda r: {"subscription": 0, "resource_group": 1, "resource": 2, "unknown": 3}[r[3]]), (lambda r: r[4].lower().rstrip("/"))
    level = lambda r: iam.PRIVILEGE.get(r[2], 0)
    holds = lambda a, b: order(a) < order(b) and path(a) and (path(b) == path(a) or path(b).startswith(path(a) + "/"))
    best, needless = {}, set()
    for x in data:
        for y in data:
            if x[1] != y[1]:
                continue
            if x[2] == y[2] and x[0] != y[0] and holds(x, y):
                needless.add(x[0])
            if x[0] < y[0] and ((x[4] == y[4] != "") or holds(x, y) or holds(y, x)):
                d, e = (x, y) if x[2] == y[2] or level(x) > level(y) else (y, x) if level(y) > level(x) else (None, None)
                if d:
                    key = (d[1], f"{d[2]} + {e[2]}", d[4] or e[4])
                    best[key] = min(best.get(key, (999, 999, None)), (x[0], y[0], d))
    rows = frame(spark, names, data)
    got = {(r["identity"], r["role"], r["scope_value"]): (r["ord"], r["scope"], r["file_path"]) for r in iam.overlap(rows).collect()}
    assert got == {k: (a, d[3], d[5]) for k, (a, _, d) in best.items()}
    assert {r["ord"] for r in iam.broad_redundant(rows).collect()} == needless


def test_state_is_reconciled(spark, tmp_path):
    frame(spark, ["a"], [("x",)]).write.parquet(str(tmp_path / "chunks"))
    assert not store.reconcile(spark, str(tmp_path / "chunks"), str(tmp_path / "registry"))
    assert not (tmp_path / "chunks").exists()


def test_reports_are_written(spark, tmp_path):
    issues = frame(spark, ["ord", "file_path", "rule_id", "issue", "line_number", "severity", "detector"], [(1, "a\\b.tf", "R1", "bad", 0, "CRITICAL",
        "d"), (2, "c.tf", "", "worse", 3, "odd", "d")])
    report.write_sarif(issues, "ord", str(tmp_path / "sarif"))
    levels = {r["level"]: r["start_line"] for r in spark.read.json(str(tmp_path / "sarif" / "results")).collect()}
    assert levels == {"error": 1, "note": 3}
    assert {r["level"] for r in report.sarif_results(issues, critical_as_note=True).collect()} == {"note"}
    report.write_json(issues, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2


def test_sessions_are_isolated(spark):
    other = governance.isolated(spark)
    other.range(1).createOrReplaceTempView("only_there")
    assert not spark.catalog.tableExists("only_there") and other.catalog.tableExists("only_there")


def test_iam_queries_see_every_row(spark, sf):
    """Roles and service-wide findings against brute force over all of lineitem; all findings are the parts' sum."""
    from sparkseam.plans import detector_queries as Q

    rows = [r.asDict() for r in Q.assignments(spark, sf).collect()]
    assert len(rows) == spark.read.parquet(f"{sf}/lineitem.parquet").count()
    own = {}
    for r in sorted(rows, key=lambda r: r["ord"]):
        own.setdefault(r["identity_name"], []).append(r["role"])
    got = {r["identity"]: r["role"] for r in Q.Q["iam_multi_role"](spark, sf).collect()}
    assert got == {k: ", ".join(v) for k, v in own.items() if len(v) > 3}
    wide = ("subscription", "resource_group")
    assert Q.Q["iam_service_wide"](spark, sf).count() == sum(r["role"] in Q.iam.SERVICE_WIDE and r["scope_type"] in wide for r in rows)
    parts = sum(Q.Q[f"iam_{x}"](spark, sf).count() for x in ("rule_chain", "multi_role", "overlap", "broad_redundant", "service_wide"))
    assert Q.Q["iam_findings_all"](spark, sf).count() == parts


def test_rerank_reaches_candidates_below_k(spark, tmp_path):
    """The best vector stands behind 12 documents with keywords: it is cut before a rerank of the first 10, and first after a rerank of all."""
    from sparkseam.plans import search_queries as Q

    texts = ["plain words"] + ["the of tion thand erer"] * 12 + ["plain words"] * 20
    vectors = [[1.0, 0.0]] + [[0.8, 0.6]] * 12 + [[0.0, 1.0]] * 20
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r["doc_id"], r["rank"]) for r in Q.rerank_prefix(spark, str(tmp_path)).orderBy("rank").collect()]
    assert got == [(0, 1), *((i, i + 1) for i in range(1, 10))]
    assert 0 not in [r["doc_id"] for r in Q.hybrid_topk(spark, str(tmp_path)).collect()]


def test_secrets_over_documents_hold_every_kind(spark, tmp_path):
    from sparkseam.plans import detector_queries as Q

    spark.createDataFrame([(i, text) for i, (_, text) in enumerate(Q.SEC_ROWS, 1)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r["file_path"], r["line_number"], r["secret_type"]) for r in Q.Q["secrets_lines_all"](spark, str(tmp_path)).collect())
    assert got == sorted((p + k[1:], n, kind) for k, n, kind in Q.SEC_OUT for p in "ds") and "high_entropy" in [g[2] for g in got]


def test_a_cluster_needs_a_shared_folder(spark):
    from types import SimpleNamespace

    from sparkseam import session

    def fake(master, there=None):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: there), sparkContext=SimpleNamespace(master=master))

    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,512]"):
        with pytest.raises(RuntimeError):
            session.shared_dir(fake(master))
        assert session.shared_dir(fake(master, "hdfs://x/y/")) == "hdfs://x/y"
    assert session.shared_dir(fake("local[2]")) == session.shared_dir(fake("local[2]"))
    mark, kept = session.written(), session.materialise(spark.range(3), "kept")
    gone = session.materialise(spark.range(4), "gone")
    assert gone.count() == 4
    session.release(spark, mark, keep=kept)
    assert kept.count() == 3 and session.written() == mark + 1
    with pytest.raises(Exception):
        gone.count()


def test_hybrid_takes_equal_rows_that_both_branches_find(spark):
    """Two hundred rows hold the word alike; of those near the vector the smallest ids are others than of all."""
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("word again").alias("text"), F.when(F.col("id") >= 120, F.array(F.lit(1.0),
        F.lit(0.0))).otherwise(F.array(F.lit(0.6), F.lit(0.8))).alias("embedding"))
    corpus = rows.unionByName(spark.range(200, 400).select(F.col("id").alias("doc_id"), F.lit("other thing").alias("text"), F.array(F.lit(0.0),
        F.lit(1.0)).alias("embedding")))
    found = search.hybrid(corpus, corpus, ["word"], [1.0, 0.0], 3, vec_id="doc_id", agree=True).collect()
    assert [(r["id"], r["semantic_score"], r["keyword_score"]) for r in found] == [(120, 1.0, 1.0), (121, 1.0, 1.0), (122, 1.0, 1.0)]


def test_nfc_of_texts_that_may_change_only(spark):
    texts = ["plain\ntext\n", "na\u00efve \u2014 \u00e9", "e\u0301", "\u1100\u1161\u11a8", "\u212b", "\uac00\u11a8", "", None, "\U0001d15e", "\u0958 \u4e2d", "a\u0323\u0307", "\u2126" * 3000]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = {r["id"]: r["text"] for r in governance.nfc(rows, "text").collect()}
    assert got == {i: None if t is None else unicodedata.normalize("NFC", t) for i, t in enumerate(texts)}
    settled = re.compile(governance.SETTLED)
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]):
        if settled.fullmatch(c):
            assert unicodedata.normalize("NFC", c) == c and not unicodedata.combining(c)


def test_nfc_holds_few_texts_at_once(monkeypatch):
    monkeypatch.setattr(governance, "NFC_BYTES", 100)
    sizes, normalise = [], pa.array
    monkeypatch.setattr(governance.pa, "array", lambda values, kind: sizes.append(len(values)) or normalise(values, kind))
    out = list(governance._nfc(iter([normalise(["e\u0301" * 5] * 50), normalise([], pa.string())])))
    assert out[0].to_pylist() == ["\u00e9" * 5] * 50 and len(out[1]) == 0 and max(sizes) <= 7


def test_only_files_that_may_hold_a_finding_are_parsed(spark):
    """Files without any of a reader's words don't reach Python; those that say them in disguise do."""
    arm = '{"resources": [{"type": "Microsoft.Authorization/%s", "name": "r", "properties": {"roleDefinitionName": "Owner", "scope": "/subscriptions/1"}}]}'
    said = [("a.json", "json", arm % "roleAssignments"), ("b.json", "json", arm % "role\\u0041ssignments"), ("c.yaml", "yaml",
        'resources:\n- type: "x/\\x72oleAssignments"\n  name: r\n  properties: {roleDefinitionName: Owner}\n'), ("d.tf", "terraform",
        'RESOURCE "AZURERM_ROLE_ASSIGNMENT" "r" {\n  role_definition_name = "Owner"\n}\n'), ("e.tf", "terraform",
        'resource "azurerm_role_a\u017fsignment" "r" {\n  role_definition_name = "Owner"\n}\n')]
    mute = [("f.yaml", "yaml", "db:\n  password: secret\n"), ("g.tf", "terraform", 'variable "n" {}\n'), ("h.json", "json", "{}"), ("i.yaml", "yaml", None)]
    files = spark.createDataFrame(said + mute, "file_path string, file_type string, content string")
    held = files.filter(parsers.may_hold(F.col("content"), parsers.ROLE_WORDS))
    assert sorted(r[0] for r in held.collect()) == [f[0] for f in said]
    every = {r["file_path"] for r in parsers.per_file(files, parsers.read_roles, parsers.ROLE_ROWS).collect()}
    assert {r["file_path"] for r in parsers.role_assignments(files).collect()} == every == {f[0] for f in said}


def test_steps_are_found_in_known_places_and_by_words(spark):
    step = "%s:\n- run: make\n"
    rows = [(".github/workflows/a.yml", "x:\n  steps:\n  - run: make\n"), ("b/Azure-Pipelines.yml", "- name: s\n  run: make : all: x\n"), ("c.yml", step % "steps"),
        ("d.yml", step % '"\\x73teps"'), ("e.yml", "PR: 1\nx:\n  Steps:\n  - bash: make\n"), ("f.yml", "x: 1\ny: password\n"), ("g.yml", "on:\n  - run: make : all: x\n"),
        ("workflows/.github/h.yml", "- run: make : all: x\n")]
    files = spark.createDataFrame(rows, "file_path string, content string")
    every = parsers.per_file(files.select("file_path", F.lit("yaml").alias("file_type"), "content"), parsers.read_snippets, parsers.SNIPPET_ROWS)
    assert sorted(parsers.pipeline_snippets(files).collect()) == sorted(every.collect()) and every.count() >= 6


def test_terms_are_counted_where_their_text_is(spark):
    rows = search.tfidf_terms(frame(spark, ["id", "text"], [(1, "oak oak elm"), (2, None)]), "id", "text")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(") == 1 and "hashpartitioning(id#" in plan and ", term#" not in plan.split("hashpartitioning(")[1].split(")")[0]
    assert {(r["id"], r["term"]) for r in rows.collect()} == {(1, "oak"), (1, "elm")}


def test_iam_pairs_meet_in_one_join_and_scopes_of_slashes_only_their_equals(spark):
    scopes = [("//", "resource"), ("//", "subscription"), ("/", "resource"), ("", "resource"), (None, "unknown"), ("/S/1/", "subscription"), ("/s/1", "resource"), ("/s/1/x", "unknown")]
    rows = spark.createDataFrame([(i, "a", "user", r, t, v, f"f{i}", "b") for i, ((v, t), r) in enumerate((s, r) for s in scopes for r in ("Owner", "Reader"))],
        "ord long, identity_name string, identity_type string, role string, scope_type string, scope_value string, file_path string, block_name string")
    out = iam.overlap(rows)
    assert out._jdf.queryExecution().sparkPlan().toString().count("Join") == 1
    got = {(r["role"], r["scope_value"], r["ord"]) for r in out.collect()}
    assert got == {("Owner + Reader", "//", 0), ("Owner + Owner", "//", 0), ("Reader + Reader", "//", 1), ("Owner + Reader", "/", 4),
        ("Owner + Reader", "/S/1/", 10), ("Owner + Owner", "/S/1/", 10), ("Reader + Reader", "/S/1/", 11), ("Owner + Reader", "/s/1", 11),
        ("Owner + Owner", "/s/1", 12), ("Reader + Reader", "/s/1", 13), ("Owner + Reader", "/s/1/x", 11), }, got
    needless = {(r["ord"], r["scope_value"]) for r in iam.broad_redundant(rows).collect()}
    assert needless == {(10, "/S/1/"), (11, "/S/1/"), (12, "/s/1"), (13, "/s/1")}
    plan = iam.broad_redundant(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "_top" in plan  # rows of the narrowest type are dropped before the join
