"""Numbers over all rows, notes of merges, limits and moments."""

import random

import pytest
from pyspark.sql import functions as F

from lodesift.functions import dims
from lodesift.functions.audit_values import utc_text, without_value
from lodesift.operators import leakscan, order, patternscan, register


def test_running_sums_against_a_loop(spark):
    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1, 2, 3]), rng.randint(-5, 5)) for k in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k INT, g INT, v INT").repartition(7)
    got = {r["k"]: r["s"] for r in order.with_running_sum(df, ["g", "k"], F.col("v"), "s").collect()}
    total, want = 0, {}
    for k, g, v in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        total += v
        want[k] = total
    assert got == want
    assert sorted(r["n"] for r in order.with_place(df, ["k"], "n").collect()) == list(range(1, 401))
    assert order.with_place(df.limit(0), ["k"], "n").count() == 0


def test_notes_against_a_fold(spark):
    rng = random.Random(4)
    rows = [(k, f"X-{k:03d}", rng.choice("ab"), rng.choice(dims.CONFIDENCES), rng.choice(dims.STATUSES)) for k in range(60)]
    df = spark.createDataFrame(rows, "k INT, finding_id STRING, dedupe_key STRING, confidence STRING, status STRING")
    got = {r["k"]: (r["status"], r["note"]) for r in register.merge_notes(register.with_ids(register.normalized(df, ["k"]))).select("ord.k", "status", "note").collect()}
    now, want = {}, {}
    for k, i, key, c, s in rows:
        if key in now:
            (pc, ps), text = now[key], register.MERGED % i
            if dims.CONFIDENCES.index(c) > dims.CONFIDENCES.index(pc):
                text, pc = text + register.LOWERED % (pc, c), c
            elif c != pc:
                text += register.HIGHER % (c, pc)
            if dims.STATUS_PRECEDENCE.index(s) < dims.STATUS_PRECEDENCE.index(ps):
                text, ps = text + register.KEPT % s, s
            want[k] = ps, text
            now[key] = pc, ps
        else:
            now[key] = c, s
    assert got == want


def test_synonyms_reach_the_register(spark):
    df = spark.createDataFrame([(1, "bad", None, "crypto wall", "do it", None), (2, None, "s", None, None, " KEY ")], "k INT, id STRING, surface STRING, crypto_surface STRING, remediation STRING, duplicate_key STRING")
    got = register.normalized(df, ["k"]).orderBy("ord").collect()
    assert (got[0]["surface"], got[0]["recommended_fix"], got[0]["source_ids"]) == ("crypto wall", "do it", ["bad"]) and got[1]["dedupe_key"] == "key" and len(got[0]["dedupe_key"]) == 16


def test_negative_limits(spark):
    df = spark.createDataFrame([(1, "x")], "k INT, value STRING")
    for limits in ({"depth": -1}, {"most_bytes": -1}, {"most_values": -1}):
        with pytest.raises(ValueError, match="negative"):
            leakscan.leak_matches(df, ["k"], "k", [], **limits)
    with pytest.raises(ValueError, match="negative"):
        leakscan.skipped_fields(df, -1)
    with pytest.raises(ValueError, match="negative"):
        patternscan.capped(df, -1)


def test_moments_and_long_blanks(spark):
    assert spark.range(1).select(utc_text(F.lit("2025-01-31 12:34:56").cast("timestamp"))).first()[0] == "2025-01-31T12:34:56Z"
    assert len(spark.range(1).select(utc_text()).first()[0]) == 20
    texts = [None, " " * 41, "-" * 60, "(" * 50 + "n/a" + ")" * 50, "n/a but" + "x" * 90]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k INT, t STRING").select(without_value(F.col("t"))).collect()
    assert [r[0] for r in got] == [True, True, True, True, False]


def test_static_scan_rules(spark):
    rows = [("a/x.ts", "  Math.random()  "), ("a/x.TS", "Math.random()"), ("a/Makefile", "Math.random()"), ("dist/x.ts", "Math.random()"), ("own/x.ts", "Math.random()"), ("b.ts", None), ("c.ts", "")]
    df = spark.createDataFrame(rows, "path STRING, text STRING")
    paths = lambda **k: sorted(r["path"] for r in patternscan.static_scan(df, "path", "text", **k).collect())
    assert paths() == ["a/x.ts", "own/x.ts"] and paths(leave_out=["own"]) == ["a/x.ts"] and paths(all_text=True) == ["a/Makefile", "a/x.TS", "a/x.ts", "own/x.ts"]
    placed = patternscan.in_report_order(patternscan.static_scan(df, "path", "text")).orderBy("place").collect()
    assert [(r["place"], r["path"], r["excerpt"]) for r in placed] == [(1, "a/x.ts", "Math.random()"), (2, "own/x.ts", "Math.random()")]
