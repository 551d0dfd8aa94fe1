import json

import pytest

from lodesift.sources import files
from lodesift.streaming import adapters


def test_source_tree(spark, tmp_path):
    for name, data in {"a/x.py": b"import os\n", "a/build/y.py": b"no", ".cache2/z.py": b"no", "b/t.PY": b"no", "b/bin": b"\x00\x01", "b/README": "é".encode()[:1] + b"ok"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    assert [r["path"] for r in files.read_sources(spark, str(tmp_path)).collect()] == ["a/x.py"]
    more = {r["path"]: r["text"] for r in files.read_sources(spark, str(tmp_path), all_text=True).collect()}
    assert set(more) == {"a/x.py", "b/README", "b/t.PY"} and more["b/README"] == "�ok"
    assert files.read_sources(spark, str(tmp_path), ["a"]).count() == 0


def test_findings_documents(spark, tmp_path):
    one = {"id": "A-001", "title": "t", "evidence": [{"type": "x", "description": "d", "more": 1}]}
    for k, doc in enumerate([one, [one, one], {"findings": [one]}]):
        (tmp_path / f"{k}.json").write_text(json.dumps(doc))
    got = files.read_findings(spark, str(tmp_path)).collect()
    assert len(got) == 4 and {r["finding_id"] for r in got} == {"A-001"} and got[0]["evidence"][0]["type"] == "x"
    (tmp_path / "bad.json").write_text("[1]")
    with pytest.raises(Exception, match="no findings document"):
        files.read_findings(spark, str(tmp_path)).collect()
    assert files.read_findings(spark, str(tmp_path), strict=False).count() == 4


def test_registers_and_single_values(spark, tmp_path):
    finding = {"id": "A-001", "source_skills": "one-review", "evidence": {"type": "x"}, "limitations": ["a"], "fix_commits": [{"commit": "c"}], "metadata_surface": "m"}
    (tmp_path / "r.json").write_text("\ufeff" + json.dumps({"findings": [finding, {"id": "A-002"}]}))
    got = files.read_register(spark, str(tmp_path / "r.json")).orderBy("at").collect()
    assert [r["finding_id"] for r in got] == ["A-001", "A-002"] and got[0]["source_skills"] == ["one-review"] and got[0]["evidence"][0]["type"] == "x"
    assert got[0]["fix_commits"] == ['{"commit":"c"}'] and got[0]["metadata_surface"] == "m" and got[1]["evidence"] is None
    for bad in ("[]", "{}", '{"findings": {}}', "{"):
        (tmp_path / "r.json").write_text(bad)
        with pytest.raises(Exception, match="no register"):
            files.read_register(spark, str(tmp_path / "r.json")).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("g", "a|b", 1), ("h", "c\nd", None)], "g STRING, t STRING, n INT")
    files.write_json(df, str(tmp_path / "out"))
    with pytest.raises(Exception, match="(?i)exists"):
        files.write_json(df, str(tmp_path / "out"))
    files.write_json(df, str(tmp_path / "out"), replace=True)
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    files.write_document(str(tmp_path / "d" / "x.json"), {"b": 1, "a": 2})
    assert (tmp_path / "d" / "x.json").read_text().index('"a"') < (tmp_path / "d" / "x.json").read_text().index('"b"')
    with pytest.raises(FileExistsError):
        files.write_document(str(tmp_path / "d" / "x.json"), {})
    report = files.markdown_report(df, "g")
    assert "## g" in report and "a\\|b" in report and "c d" in report
    assert files.gate(df) == 1 and files.gate(df.limit(0)) == 0


def test_skill_catalog(spark, tmp_path):
    for name in ("b", "a", "only-one"):
        (tmp_path / "p" / "skills" / name).mkdir(parents=True)
        (tmp_path / "p" / "skills" / name / "SKILL.md").write_text("x")
    assert [r["skill"] for r in files.skill_catalog(spark, str(tmp_path), ["only-one"]).collect()] == ["a", "b"]


def test_streams_give_what_batches_give(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(k, f"src/{k}.ts", "Math.random();\nok" if k % 2 else "x", "open" if k < 5 else "fixed", k) for k in range(10)]
    df = spark.createDataFrame(rows, "k INT, path STRING, text STRING, status STRING, at INT")
    df.repartition(3).write.parquet(src)
    hits = adapters.stream_patterns(adapters.stream_table(spark, df, src, 1), "path", "text").select("path", "line", "category")
    adapters.run_once(hits, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    leaks = adapters.stream_leaks(adapters.stream_table(spark, df, src), ["k"], "text", ["Math.random();\nok"], 1).select("k", "pos")
    adapters.run_once(leaks, str(tmp_path / "out2"), str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 5
    state = adapters.stream_status(adapters.stream_table(spark, df, src).selectExpr("*", "k % 2 AS e"), "e", "status", "at", "k")
    q = state.writeStream.outputMode("complete").format("memory").queryName("state").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["status"] for r in spark.sql("SELECT * FROM state").collect()} == {"fixed"}
