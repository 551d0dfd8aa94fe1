import json

from pyspark.sql import functions as F

from lodesift.operators.nested import complete_json, flatten
from lodesift.sources.har import har_lists, har_table, parse_har

BOM = "﻿"


def entry(**more):
    return {"startedDateTime": "2025-01-01T00:00:00Z", "request": {"method": "GET", "url": "http://a.test/x", "headers": [{"name": "A", "value": "1"}, None, {"name": "B"}]}, "response": {"status": 200, "headers": []}} | more


def captures(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "capture_id BIGINT, har STRING")


def headers(spark, docs):
    parsed = parse_har(captures(spark, docs))
    return sorted(tuple(r) for r in har_lists(parsed, ["capture_id"], ["request.headers", "response.headers"]).select("capture_id", "entry_index", "list", "item_index", "name").collect())


def test_headers_count_all_elements(spark):
    doc = json.dumps({"log": {"entries": [None, entry(), 7, "x", entry(request=None), entry(response={"headers": json.dumps([{"name": "T"}])})]}})
    assert headers(spark, [doc]) == [(0, 1, "request.headers", 0, "A"), (0, 1, "request.headers", 2, "B"), (0, 5, "request.headers", 0, "A"), (0, 5, "request.headers", 2, "B"), (0, 5, "response.headers", 0, "T")]


def test_single_objects_marks_and_broken_documents(spark):
    good = json.dumps({"log": {"entries": entry()}})
    docs = [good, BOM + good, " " + good + "\n", good[:-5], good + "x", good + good, "", None, "[]", "null", '"x"', json.dumps({"log": {}}), json.dumps({"log": {"entries": None}}), json.dumps({"log": {"entries": "no"}}), json.dumps({"log": []})]
    found = headers(spark, docs)
    assert {f[0] for f in found} == {0, 1, 2} and len(found) == 6


def test_members_of_unexpected_type_spoil_nothing_else(spark):
    doc = json.dumps({"log": {"pages": {"id": 1}, "entries": [entry(request={"url": {"a": 1}, "method": 5, "headers": {"name": "S"}, "cookies": "no", "postData": []}, response=[1])], "_vendor": {"deep": [[{"entries": 1}]]}}})
    assert headers(spark, [doc]) == [(0, 0, "request.headers", 0, "S")]
    row = har_table(parse_har(captures(spark, [doc])), ["capture_id"], "entries").first()
    assert (row["request_method"], row["request_url"]) == ("5", '{"a":1}')
    assert har_table(parse_har(captures(spark, [doc])), ["capture_id"], "pages").count() == 1


def test_empty_table(spark):
    assert har_table(parse_har(captures(spark, [])), ["capture_id"], "entries").count() == 0


def test_flatten_any_nesting_against_brute_force(spark):
    rows = [(1, {"a": [{"b": [{"c": 1}, None, {"c": 2}]}, None, {"b": None}, {"b": []}]}), (2, None), (None, {"a": [{"b": [{"c": 3}]}]}), (1, {"a": []}), (1, {"a": None})]
    df = spark.createDataFrame(rows, "k INT, d STRUCT<a: ARRAY<STRUCT<b: ARRAY<STRUCT<c: INT>>>>>")
    want = sorted(str((k, i, j, x["c"])) for k, d in rows if d and d["a"] for i, e in enumerate(d["a"]) if e and e["b"] for j, x in enumerate(e["b"]) if x)
    for parts in (1, 3):
        got = flatten(df.repartition(parts), ["k"], "d", "a[].b[]", ["i", "j"]).collect()
        assert sorted(str(tuple(r)) for r in got) == want
    assert flatten(df, ["k"], "d", "a[].b[]", ["i", "j"], keep_null=True).count() == len(want) + 1


def test_names_that_clash_and_scalars(spark):
    df = spark.createDataFrame([(1, [{"k": 5, "i": 6, "s": {"k": 7}}], ["x", None])], "k INT, d ARRAY<STRUCT<k: INT, i: INT, s: STRUCT<k: INT>>>, t ARRAY<STRING>").select("k", F.struct("d", "t").alias("n"))
    got = flatten(df, ["k"], "n", "d[]", ["i"])
    assert got.columns == ["k", "i", "k_2", "i_2", "s_k"] and tuple(got.first()) == (1, 0, 5, 6, 7)
    assert [tuple(r) for r in flatten(df, ["k"], "n", "t[]", ["i"]).collect()] == [(1, 0, "x")]


def test_carry_takes_members_of_parents(spark):
    doc = json.dumps({"log": {"entries": [entry(), entry(request={"url": "u2", "headers": [{"name": "C"}]})]}})
    got = har_lists(parse_har(captures(spark, [doc])), ["capture_id"], ["request.headers"], carry={"url": "entries[].request.url"}).select("name", "url").collect()
    assert [tuple(r) for r in got] == [("A", "http://a.test/x"), ("B", "http://a.test/x"), ("C", "u2")]


def test_complete_json(spark):
    texts = {'{"a":1}': True, '{"a":1} x': False, '{"a":1': False, "[1,2]": True, "1,2": False, "": False, BOM + "{}": True, "nul": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", complete_json(F.col("t")).isNotNull().alias("c")).collect()
    assert {r["t"]: r["c"] for r in rows} == texts
