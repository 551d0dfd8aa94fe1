"""The registered queries of the leak scan do the operator's whole job, over small tables of their own."""

import base64
import json

import pytest

from lodesift.operators import decode
from lodesift.plans import audit_queries

HOST = "node-1.scheduler.example"


@pytest.fixture(scope="module")
def captures(spark, tmp_path_factory):
    """A folder with one capture: a host in a long body, one in base64, one in a field too large to be searched."""
    folder = str(tmp_path_factory.mktemp("captures"))
    bodies = ["x" * 60 + HOST, base64.b64encode(f"see {HOST} there".encode()).decode(), HOST + "x" * 2_000_000]
    entries = [{"request": {"method": "POST", "url": "https://a.test/", "postData": {"text": b}}, "response": {"status": 200}} for b in bodies]
    row = (1, "a.har", json.dumps({"log": {"entries": entries}}))
    spark.createDataFrame([row], "capture_id BIGINT, artifact STRING, har STRING").write.parquet(f"{folder}/har_captures.parquet")
    return folder


def test_summary_counts_long_and_encoded_fields(spark, captures):
    got = audit_queries.scan_summary(spark, captures).first()
    assert (got["entries_scanned"], got["matches"], got["findings"], got["skipped_fields"]) == (3, 2, 2, 1)
    assert audit_queries.leak_scan_har(spark, captures).count() == 2


def test_findings_of_encoded_leaks(spark, captures):
    got = [json.loads(r["evidence"])[0] for r in audit_queries.leak_findings(spark, captures).orderBy("id").collect()]
    assert [e["location"] for e in got] == [f"entries[{k}].request.postData.text" for k in (0, 1)]
    assert got[0]["description"].endswith("transform raw.") and "raw -> base64" in got[1]["description"]


def test_every_form_of_a_sentinel(spark, tmp_path):
    value = 'Café "Nine"\nScheduler-70'
    spark.createDataFrame([("R-1", value), ("R-2", None)], "register_id STRING, product STRING").write.parquet(f"{tmp_path}/registers.parquet")
    rows = audit_queries.sentinel_variants_all(spark, str(tmp_path))
    got = [(r["variant"], r["text"]) for r in rows.collect()]
    assert {v for v, _ in got} == {"exact", "lower", "normalized", "base64", "base64url", "hex", "url", "sha256", "truncated", "json", "json_ascii", "trace", "gzip", "token"}
    assert {t for v, t in got if v == "token"} == {"café", "nine", "scheduler", "70"}
    forms = dict(got)
    assert forms["json"] == 'Café \\"Nine\\"\\nScheduler-70' and forms["json_ascii"] == 'Caf\\u00e9 \\"Nine\\"\\nScheduler-70' and forms["trace"] == 'Café "Nine"\\nScheduler-70'
    packed = decode.decoded_values(rows.filter("variant = 'gzip'"), ["variant"], "text", depth=1)
    assert packed.filter(packed["decoded"] == value).count() == 1
    assert audit_queries.sentinel_variants(spark, str(tmp_path)).count() == rows.count() - 1
