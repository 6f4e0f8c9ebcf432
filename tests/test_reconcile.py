"""Validation of plans, approvals and ledger rows by literal cases; their queries are held against SQL with all others."""

import pytest

from lakeshelf.operators import reconcile

PLAN = "id long, action string, old_path string, new_path string, filepath string, review_tier string, risk string, confidence string, report_only boolean, unresolved boolean, is_approved boolean"
CASES = [
    (("update_path_reference", "/lib/a", "/lib/b", None, "AUTO_SAFE_CANDIDATE", "LOW", "0.9", None, None, False), "valid", []),
    (("update_path_reference", "/lib/./a", "/lib/b", None, None, None, None, None, None, False), "invalid", ["old_path_missing_on_disk"]),
    (("mark_orphan_candidate", "", "", None, "WEAK_MATCH", None, "x", None, None, False), "skipped", []),
    (("rename", "/lib/a", None, None, None, None, None, True, None, False), "skipped", []),
    (("rename", "/lib/a", None, None, "WEAK_MATCH", "LOW", None, None, None, False), "invalid", ["unsupported_action_type:rename", "weak_match_rejected"]),
    ((None, None, None, None, None, None, None, None, None, False), "invalid", ["missing_action_type"]),
    (("update_path_reference", "/lib/a", "/lib/b", None, "REVIEW_CAREFULLY", "HIGH", "2", None, None, False), "invalid", ["invalid_risk_for_review_tier:HIGH", "confidence_out_of_range"]),
    (("update_path_reference", "/lib/a", "/lib/b", None, "REVIEW_CAREFULLY", None, "much", None, None, False), "invalid", ["invalid_risk_for_review_tier:missing", "confidence_not_numeric"]),
    (("update_path_reference", "/lib/a", "/lib/b", None, None, "REVIEW_REQUIRED", None, None, None, False), "invalid", ["review_required_not_approved"]),
    (("update_path_reference", "/lib/a", "/lib/b", None, None, "REVIEW_REQUIRED", None, None, None, True), "valid", []),
    (("update_path_reference", "", "", None, None, None, None, None, None, False), "invalid", ["missing_old_path", "missing_new_path"]),
    (("update_path_reference", "/lib/a", "/other/z", None, None, None, None, None, None, False), "invalid", ["new_path_missing_on_disk", "new_path_outside_root"]),
    (("update_queue_reference", "/lib/a", "/lib/z", None, None, None, None, None, True, False), "valid", []),
    (("update_queue_reference", "/gone/a", "/lib/z", None, None, None, None, None, None, False), "invalid", ["new_path_missing_on_disk", "old_path_not_in_canonical_db", "old_path_outside_root"]),
]


def test_every_issue(spark):
    plan = spark.createDataFrame([(k, *row) for k, (row, _, _) in enumerate(CASES)], PLAN)
    files = spark.createDataFrame([("/lib/a",), ("/lib/b",), ("/lib/b",), (None,)], "filepath string")
    got = {r["id"]: (r["status"], r["issues"]) for r in reconcile.validated(plan, files, spark.createDataFrame([("/lib/a",)], "path string"), "/lib").collect()}
    assert got == {k: (status, issues) for k, (_, status, issues) in enumerate(CASES)}


@pytest.mark.parametrize(
    ("entry", "item", "approved"),
    [
        (("a1", None, None, None, None), None, True), (("a2", None, None, None, None), None, False), (("a1", None, "x", "/o", "/n"), None, True), (("a1", None, "y", "/o", "/n"), None, False), ((None, "l", None, None, None), None, False),
        (None, ("x|/o|/n|", None, None, None, "approved"), True), (None, ("-", "a1", None, None, "Approved"), True), (None, ("-", "a1", None, None, "rejected"), False), (None, ("-", None, "/o", "/n", "approved"), True), (None, ("-", None, "/o", None, "approved"), False),
    ],
)
def test_approvals(spark, entry, item, approved):
    fields = "action_id string, ledger_id string, action string, old_path string, new_path string"
    # the action has all its fields in the cases of a whole entry, its id alone in the others
    whole = entry is None or entry[2] is not None
    plan = spark.createDataFrame([("a1", None, "x" if whole else None, "/o" if whole else None, "/n" if whole else "", None, None, None)], f"{fields}, queue_file string, approved boolean, review_status string")
    entries = spark.createDataFrame([entry] if entry else [], fields)
    items = spark.createDataFrame([item] if item else [], "signature string, action_id string, old_path string, new_path string, review_status string")
    rows = reconcile.with_approval(plan, entries, items).collect()
    assert [r["is_approved"] for r in rows] == [approved]


def test_ledger(spark):
    names = "ledger_id string, created_at string, operation_type string, status string, root string, old_path string, new_path string, affected_tables string, before_values_json string, after_values_json string"
    rows = [("l", "now", "u", "ok", "/lib", "/lib/a", "", '["t", " "]', "{}", "[]"), (" ", None, "u", "ok", "/x", "/lib/z", None, "", "", "{"), ("l", "now", "u", "ok", None, None, None, '{"a": 1}', "1", '"x"'), ("l", "now", "u", "ok", None, None, None, "a, b,", "1", "1")]
    got = [(r["tables"], r["issues"]) for r in reconcile.ledger_issues(spark.createDataFrame(rows, names).coalesce(1), spark.createDataFrame([("/lib",), ("/lib/a",)], "filepath string")).collect()]
    want = [
        (["t"], []), ([], ["missing_required_field:ledger_id", "missing_required_field:created_at", "missing_root_path:/x", "missing_referenced_path:old_path:/lib/z", "missing_affected_tables", "missing_before_values_json", "invalid_json:after_values_json", "empty_affected_tables"]),
        ([], ["affected_tables_not_list", "empty_affected_tables"]), (["a", "b"], []),
    ]
    assert sorted(got, key=str) == sorted(want, key=str)
