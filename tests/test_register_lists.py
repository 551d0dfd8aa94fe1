"""A merge of duplicates unites every list of its records."""

from lodesift.operators import register

KIND = "record_id BIGINT, finding_id STRING, dedupe_key STRING, title STRING, severity STRING, confidence STRING, status STRING, audit_skill STRING, surface STRING, affected_claims ARRAY<STRING>, evidence ARRAY<STRUCT<type: STRING, description: STRING, file: STRING, location: STRING, excerpt: STRING>>, impact STRING, severity_rationale STRING, recommended_fix STRING, retest_steps ARRAY<STRING>, limitations ARRAY<STRING>, affected_skills_to_rerun ARRAY<STRING>, fix_commits ARRAY<STRUCT<commit: STRING>>, retest_evidence ARRAY<STRING>, status_history ARRAY<STRUCT<status: STRING>>"


def finding(n, title, impact, rerun=None, commits=None, retest=None, history=None):
    return (n, f"A-{n}", "k", title, "low", "high", "open", None, None, None, None, impact, None, None, None, None, rerun, commits, retest, history)


def test_merge_unites_reruns_and_optional_lists(spark):
    rows = spark.createDataFrame([
        finding(1, "Plain", "first", commits=[("c1",)], retest=["r1"], history=[("open",)]),
        finding(2, "Request payload leak", "telemetry", commits=[("c1",), ("c2",)], retest=["r2", "r1"]),
        finding(3, "Request payload leak", None, rerun=["own-review"], history=[("open",), ("fixed",)]),
    ], KIND)
    got = register.merged(register.normalized(rows, ["record_id"])).first()
    assert got["rerun"] == ["network-payload-zero-knowledge-test", "telemetry-crash-logs-support-leakage-audit", "own-review"]
    assert got["fix_commits"] == ['{"commit":"c1"}', '{"commit":"c2"}'] and got["retest_evidence"] == ["r1", "r2"] and got["status_history"] == ['{"status":"open"}', '{"status":"fixed"}']
    plain = rows.drop("affected_skills_to_rerun", "fix_commits", "retest_evidence", "status_history")
    assert register.merged(register.normalized(plain, ["record_id"])).first()["rerun"] == ["network-payload-zero-knowledge-test", "telemetry-crash-logs-support-leakage-audit"]
