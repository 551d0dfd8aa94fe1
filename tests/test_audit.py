import json

import pytest
from pyspark.sql import functions as F

from lodesift.functions import dims
from lodesift.operators import coverage, leakscan, patternscan, register
from lodesift.sources.har import parse_har

LEAK = "CANARY::run-1::PLAINTEXT::Abcdef123456"
CONTROL = "CANARY::run-1::CONTROL::Abcdef123456"


def capture(spark, url="http://third.test/api", **request):
    doc = {"log": {"entries": [{"request": {"method": "POST", "url": url} | request, "response": {"status": 200, "headers": [{"name": "Set-Cookie", "value": LEAK}]}}]}}
    return parse_har(spark.createDataFrame([(1, "a.har", json.dumps(doc))], "capture_id BIGINT, artifact STRING, har STRING"))


def scan(spark, sentinels, first_party=(), **more):
    fields = leakscan.har_candidates(capture(spark, **more), ["capture_id", "artifact"])
    return {r["location"]: r for r in leakscan.leak_matches(fields, ["capture_id"], "artifact", sentinels, list(first_party)).collect()}


BODY = {"id": "body-001", "value": LEAK, "category": "plaintext_content"}


def test_third_party_and_masked_headers(spark):
    got = scan(spark, [BODY], ["first.test"], postData={"text": json.dumps({"note": LEAK, "more": "password=hunter2hunter2"})}, headers=[{"name": "Authorization", "value": "Bearer " + LEAK}])
    body = got["entries[0].request.postData.text"]
    assert body["classification"] == "third_party_unencrypted_transport" and body["classification_tags"] == ["third_party_network_payload", "unencrypted_transport"]
    assert body["confidence"] == "high" and body["decode_transforms"][:2] == ["raw", "raw -> json:$/note"] and "hunter2" not in body["excerpt"] and LEAK not in body["excerpt"]
    head = got["entries[0].request.headers[0].value"]
    assert head["surface"] == "request_header_sensitive" and head["excerpt"] == f"<redacted-sensitive-header; sentinel=body-001; offset=7; length={len(LEAK)}>"
    assert got["entries[0].response.headers[0].value"]["surface"] == "response_header_sensitive"
    assert len(body["fingerprint"]) == 16


def test_control_is_no_finding(spark):
    fields = leakscan.har_candidates(capture(spark, url="https://a.test/login?x=" + CONTROL), ["capture_id", "artifact"])
    hits = leakscan.leak_matches(fields, ["capture_id"], "artifact", [{"id": "c", "value": CONTROL, "category": dims.CONTROL}])
    assert hits.count() == 1 and leakscan.findings(hits, "artifact", ["capture_id", "ord"]).count() == 0
    parsed = capture(spark)
    assert leakscan.scan_summary(parsed, hits, leakscan.skipped_fields(fields), [1]).first()["control_matches"] == 1


@pytest.mark.parametrize(
    "row, label, severity",
    [
        (("low_sensitivity_control", "http", "x.test", "/", "request_url", "request"), "expected_control_value", "low"),
        (("sensitive_metadata", "http", "x.test", "/", "request_body", "request"), "third_party_unencrypted_transport", "medium"),
        (("credential", "http", "own.test", "/", "request_body", "request"), "unencrypted_transport", "high"),
        (("credential", "https", "x.test", "/", "request_body", "request"), "third_party_network_payload", "high"),
        (("sensitive_metadata", "http", "a.own.test", "/", "request_query", "request"), "url_or_header_exposure", "medium"),
        (("credential", "https", "own.test", "/v1/logs", "request_body", "request"), "telemetry_payload", "high"),
        (("credential", "https", "own.test", "/login", "request_body", "request"), "outbound_plaintext_to_service", "high"),
        (("sensitive_metadata", "https", "own.test", "/", "response_body", "response"), "inbound_plaintext_from_service", "medium"),
    ],
)
def test_ladder(spark, row, label, severity):
    df = spark.createDataFrame([row], "category STRING, scheme STRING, host STRING, path STRING, surface STRING, direction STRING")
    got = leakscan.classified(df, ["own.test"]).first()
    assert (got["classification"], got["severity"]) == (label, severity)


def test_sentinels(tmp_path):
    a, b = leakscan.sentinel_manifest("run", "seed"), leakscan.sentinel_manifest("run", "seed")
    assert a == b and len(a) == 6 and all(s["value"].startswith("CANARY::run::") for s in a)
    (tmp_path / "m.json").write_text(json.dumps({"sentinels": [{"value": LEAK}, LEAK]}))
    assert [s["id"] for s in leakscan.load_sentinels([str(tmp_path / "m.json")], [LEAK])] == ["literal-001", "m-001", "m-002"]
    for bad in ("", " " * 20, "short"):
        with pytest.raises(ValueError):
            leakscan.load_sentinels(literals=[bad])


def test_skipped_and_byte_limit(spark):
    fields = leakscan.har_candidates(capture(spark, postData={"text": "é" * 60}), ["capture_id", "artifact"])
    assert [r["surface"] for r in leakscan.skipped_fields(fields, 100).collect()] == ["request_body"]
    assert leakscan.skipped_fields(fields, 0).count() == 0


def test_lines(spark):
    df = spark.createDataFrame([(1, "a\r\nb\rc\n"), (2, ""), (3, None), (4, "\n"), (5, "x")], "k INT, t STRING")
    got = sorted((r["k"], r["line"], r["text"]) for r in patternscan.lines(df, ["k"], "t").collect())
    assert got == [(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (4, 1, ""), (5, 1, "x")]


def test_static_scan(spark):
    code = 'const apiKey = "abcdefghijklmnop";\nconst secret = "abcdefghijklmnop";\nconst iv = "000000000000";\nMath.random();\nconsole.log("x");\nprintln!("no");\n'
    df = spark.createDataFrame([("src/a.ts", code), ("tests/b.test.ts", "Math.random()"), ("node_modules/c.js", "Math.random()"), (".cache1/d.js", "Math.random()"), ("e.ts", None)], "path STRING, text STRING")
    got = {(r["path"], r["line"], r["category"]): r for r in patternscan.static_scan(df, "path", "text").collect()}
    assert {c for p, _, c in got if p == "src/a.ts"} >= {"hardcoded_secret_material", "static_iv_or_salt_literal", "weak_randomness", "plaintext_sink", "crypto_envelope_field"}
    assert got["tests/b.test.ts", 1, "weak_randomness"]["test_path"] and {p for p, _, _ in got} == {"src/a.ts", "tests/b.test.ts"}
    assert not any(p == "src/a.ts" and line == 6 and c == "plaintext_sink" for p, line, c in got)
    assert "abcdefghijklmnop" not in got["src/a.ts", 2, "hardcoded_secret_material"]["excerpt"]
    assert patternscan.capped(patternscan.static_scan(df, "path", "text"), 2).count() == 2


def test_boundary_scan(spark):
    df = spark.createDataFrame([("a.rs", 'let t = Command::new("sh");'), ("b.toml", "allow_origin = 1"), ("target/c.rs", "Command::new"), ("d.py", "Command::new")], "path STRING, text STRING")
    got = {(r["path"], r["section"]) for r in patternscan.boundary_scan(df, "path", "text").collect()}
    assert ("a.rs", "Shell command sinks") in got and ("b.toml", "CORS configuration") in got and {p for p, _ in got} == {"a.rs", "b.toml"}


FINDING = "record_id BIGINT, loaded_at BIGINT, finding_id STRING, dedupe_key STRING, title STRING, severity STRING, confidence STRING, status STRING, audit_skill STRING, surface STRING, affected_claims ARRAY<STRING>, evidence ARRAY<STRUCT<type: STRING, description: STRING, file: STRING, location: STRING, excerpt: STRING>>, impact STRING, severity_rationale STRING, recommended_fix STRING, retest_steps ARRAY<STRING>, limitations ARRAY<STRING>"


def findings(spark, *rows):
    base = dict(finding_id=None, dedupe_key="K", title="t", severity="low", confidence="high", status="fixed", audit_skill=None, surface=None, affected_claims=None, evidence=None, impact=None, severity_rationale=None, recommended_fix=None, retest_steps=None, limitations=None)
    full = [base | dict(record_id=k, loaded_at=k) | r for k, r in enumerate(rows)]
    names = [c.split(" ")[0] for c in FINDING.replace("ARRAY<STRUCT<type: STRING, description: STRING, file: STRING, location: STRING, excerpt: STRING>>", "X").split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in full], FINDING)


def test_merge(spark):
    rows = findings(spark, {"dedupe_key": " k ", "confidence": "High", "affected_claims": [" a ", "b", ""], "finding_id": "A-001"}, {"status": "Partially fixed", "confidence": "medium", "severity": "info", "impact": "late", "affected_claims": ["b", "c"], "finding_id": "A-002"}, {"severity": "critical", "impact": "", "finding_id": "A-001"})
    got = register.merged(register.normalized(rows, ["loaded_at", "record_id"])).collect()
    assert len(got) == 1 and (got[0]["status"], got[0]["confidence"], got[0]["severity"], got[0]["impact"]) == ("partially_fixed", "medium", "critical", "late")
    assert got[0]["affected_claims"] == ["a", "b", "c"] and got[0]["source_ids"] == ["A-001", "A-002"] and got[0]["records"] == 3
    assert register.merged(register.normalized(rows.limit(0), ["loaded_at", "record_id"])).count() == 0


def test_rerun_and_key(spark):
    rows = findings(spark, {"title": "Cryptocurrency wallet login"}, {"title": "Request payload leak"}, {"title": "Key reuse", "recommended_fix": "encrypt it"}, {"dedupe_key": None, "title": "A b!"}, {"dedupe_key": " ", "title": "a B"})
    got = register.normalized(rows, ["record_id"]).select("ord.record_id", "dedupe_key", register.reviews_to_rerun(F.col("source_skills"), F.col("title"), F.col("surface"), F.col("impact"), F.col("recommended_fix")).alias("r")).orderBy("record_id").collect()
    assert got[0]["r"] == [] and got[1]["r"] == ["network-payload-zero-knowledge-test"] and got[2]["r"] == dims.CRYPTO_REVIEWS
    assert got[3]["dedupe_key"] == got[4]["dedupe_key"] and len(got[3]["dedupe_key"]) == 16


def test_sequence_ids_references(spark):
    rows = register.normalized(findings(spark, {"dedupe_key": "a", "finding_id": "X-100"}, {"dedupe_key": "a"}, {"dedupe_key": "b", "finding_id": "bad id"}), ["record_id"])
    # The duplicate and the next new key fall back to the same number: only new keys advance it.
    assert [r["seq"] for r in register.sequence(rows).orderBy("ord").collect()] == [1, 2, 2]
    for most in (0, 100):
        named = register.with_ids(rows, "REG", most_broadcast=most).orderBy("ord").collect()
        assert [(r["id"], r["source_ids"]) for r in named] == [("X-100", ["X-100"]), ("UNASSIGNED-002", ["UNASSIGNED-002"]), ("REG-002", ["bad id"])]
    assert register.with_ids(rows.limit(0)).count() == 0
    refs = spark.createDataFrame([("X-100",), ("none",)], "reference STRING")
    assert {r["reference"]: r["matches"] for r in register.referenced(register.merged(rows), refs).collect()} == {"X-100": 1, "none": 0}


def test_summary_pivot_counts_every_row(spark):
    rows = findings(spark, {"status": "open", "severity": "HIGH"}, {"status": None, "severity": None}, {"status": "fixed", "severity": "low"})
    got = register.status_by_severity(rows).collect()
    assert len(got) == 5 and sum(r["total"] for r in got) == 3


def test_synonyms_and_steps(spark):
    df = spark.createDataFrame([("", "b", None, "X-001")], "surface STRING, boundary_surface STRING, remediation STRING, id STRING")
    got = register.resolved(df).first()
    assert (got["surface"], got["recommended_fix"], got["finding_id"], got["dedupe_key"]) == ("b", None, "X-001", None)
    steps = spark.createDataFrame([([" a ", ""], ["b", "b"]), ([], [])], "s ARRAY<STRING>, r ARRAY<STRING>").select(register.retest_steps(F.col("s"), F.col("r")).alias("x")).collect()
    assert steps[0]["x"] == ["a", "Re-run original reproduction: b"] and len(steps[1]["x"]) == 1


def test_report(spark):
    rows = findings(spark, {"status": "open", "severity": "high", "title": "a|b", "finding_id": "X-001"}, {"status": "fixed", "severity": "low", "finding_id": "X-000"})
    text = register.summary_report(rows, "finding_id")
    assert "| Open | 0 | 1 | 0 | 0 | 0 | 1 |" in text and text.index("X-001") < text.index("X-000") and "a\\|b" in text
    assert "No critical" in register.summary_report(rows.filter("status = 'fixed'"), "finding_id")


def test_coverage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "b")], "source STRING, destination STRING")
    assert {r["node"] for r in coverage.cyclic_nodes(edges).collect()} == {"b", "c"}
    assert {r["node"] for r in coverage.reachable(edges, spark.createDataFrame([("a",)], "start STRING")).collect()} == {"a", "b", "c", "d"}
    assert {r["node"]: (r["fan_out"], r["fan_in"]) for r in coverage.fan(edges, "source", "destination").collect()} == {"a": (1, 0), "b": (1, 2), "c": (2, 1), "d": (0, 1)}
    paths = spark.createDataFrame([("std::fs::File",), ("std::fs::self",), ("crate::b::X",), ("crate::b::*",), ("serde::de",)], "path STRING")
    got = [tuple(r) for r in coverage.grouped_imports(paths).orderBy("group_rank", "prefix").collect()]
    assert got == [(0, "std::fs", "self, File"), (1, "serde", "de"), (2, "crate::b", "*")]
    a, b = spark.createDataFrame([(1, 2), (2, 5)], "k INT, r INT"), spark.createDataFrame([(2, 3), (3, 1)], "k INT, r INT")
    assert sorted(tuple(r) for r in coverage.two_reviewers(a, b, "k", "r").collect()) == [(1, 2, "A"), (2, 3, "Both"), (3, 1, "B")]
    assert coverage.exploded_counts(spark.createDataFrame([(["x", "x", "y"],), (None,)], "m ARRAY<STRING>"), "m").count() == 2


def test_markdown_cells(spark):
    assert spark.range(1).select(register.markdown_cell(F.lit("a|b\r\nc"))).first()[0] == "a\\|b  c"
