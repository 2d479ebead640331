"""The overlap rule over classes that are moved once."""

from sparkseam.operators import iam

SCHEMA = "ord long, identity_name string, role string, scope_type string, scope_value string, file_path string, block_name string"


def found(rows):
    return sorted((r["identity"], r["role"], r["scope"], r["scope_value"], r["file_path"], r["ord"]) for r in iam.overlap(rows).collect())


def test_overlap_moves_classes_once_and_pairs_never(spark):
    rows = spark.createDataFrame([
        (1, "a", "Owner", "subscription", "/s/1", "f1", "b"), (2, "a", "Reader", "resource", "/S/1/g/x/", "f2", "b"), (3, "a", "Reader", "resource", "/s/2", "f3", "b"),
        (4, "b", "Reader", "subscription", "/s/1", "f4", "b"), (5, "b", "Owner", "resource", "/s/1/g", "", "b"), (6, "c", "Reader", "unknown", "//", "f6", "b"),
        (7, "c", "Reader", "unknown", "//", "f7", "b"), (8, None, "Owner", "subscription", "/s/1", "f8", "b"), (9, None, "Reader", "subscription", "/s/1", "f9", "b")], SCHEMA)
    plan = iam.overlap(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 2, plan
    assert found(rows) == [("a", "Owner + Reader", "subscription", "/s/1", "f1", 1), ("b", "Owner + Reader", "resource", "/s/1/g", "f4", 4),
        ("c", "Reader + Reader", "unknown", "//", "f6", 6)]


def test_several_roles_of_an_identity_by_their_order(spark):
    rows = spark.createDataFrame([(9 - i, "a" if i % 3 else None, f"r{i}", f"s{i}", "/s", f"f{i}", "b") for i in range(9)] + [(50, "z", "r", "s", "/s", "f", "b")], SCHEMA)
    got = [(r["identity"], r["role"], r["scope"], r["file_path"], r["ord"], r["issue"]) for r in iam.multi_role(rows).collect()]
    assert got == [("a", "r8, r7, r5, r4, r2, r1", "s8", "f8", 1, "Identity 'a' has 6 role assignments")]
