import random

import pytest
from pyspark.sql import functions as F

from lodesift.functions.audit_values import status, unix_time, without_value
from lodesift.operators.history import version_history

KIND = "e STRING, t BIGINT, r BIGINT, s STRING, n STRING"


def brute(rows, needed):
    out = []
    for e in {r[0] for r in rows if r[0] is not None}:
        at = {}
        for row in rows:
            if row[0] == e and row[1] is not None and not (needed and row[3] is None):
                rank = tuple((x is not None, x if x is not None else 0) for x in (row[2],)) + tuple((x is not None, x or "") for x in row[3:5])
                if row[1] not in at or rank > at[row[1]][0]:
                    at[row[1]] = (rank, row[3], row[4])
        versions = []
        for t in sorted(at):
            if not versions or versions[-1][1:] != at[t][1:]:
                versions.append((t, *at[t][1:]))
        for k, (t, s, n) in enumerate(versions):
            out.append((e, s, n, t, versions[k + 1][0] if k + 1 < len(versions) else -1))
    return sorted(map(str, out))


@pytest.mark.parametrize("heavy", [20_000, 5])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, heavy, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", "c", None]), rng.choice([None, rng.randrange(0, 400_000) // 500 * 500, -rng.randrange(1, 200_000)]), rng.choice([None, rng.randrange(9)]), rng.choice(["x", "y", None]), rng.choice(["n", None])) for _ in range(400)]
    rows += rows[:50]
    got = version_history(spark.createDataFrame(rows, KIND), "e", "t", "r", ["s", "n"], ["s"], heavy_rows=heavy)
    assert sorted(str(tuple(r)) for r in got.collect()) == brute(rows, True)


def test_highest_rank_holds_and_equal_states_merge(spark):
    rows = [("a", 10, 1, "x", None), ("a", 10, 2, "y", None), ("a", 20, 3, "y", None), ("a", 30, 4, "x", None), ("a", 30, 4, "x", None)]
    got = version_history(spark.createDataFrame(rows, KIND), "e", "t", "r", ["s", "n"]).orderBy("valid_from").collect()
    assert [tuple(r) for r in got] == [("a", "y", None, 10, 30), ("a", "x", None, 30, -1)]


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], KIND + ", valid_from STRING, _k STRING, vs INT")
    assert version_history(empty, "e", "t", "r", ["s", "n"]).columns == ["e", "s", "n", "valid_from", "valid_to"]
    assert version_history(empty, "e", "t", "r", ["s", "n"]).count() == 0
    one = spark.createDataFrame([("a", 1, 1, "x", "", "no", "k", 3)], KIND + ", valid_from STRING, _k STRING, vs INT")
    assert tuple(version_history(one, "e", "t", "r", ["s", "n"]).first()) == ("a", "x", "", 1, -1)


def test_very_long_state(spark):
    rows = [("a", k, k, "x" * 200_000 if k % 2 else "y", None) for k in range(6)]
    assert version_history(spark.createDataFrame(rows, KIND), "e", "t", "r", ["s", "n"]).count() == 6


TIMES = {
    "2025-01-01T00:00:00Z": 1735689600, " 2025-01-01 00:00:00 ": 1735689600, "2025-01-01T01:00:00+01:00": 1735689600, "2024-12-31T19:00:00-0500": 1735689600, "20250101T000000Z": 1735689600,
    "2025-01-01T00:00:00.999Z": 1735689600, "1735689600": 1735689600, "2025-01-01": 1735689600, "2025-01-01T00:00": 1735689600, "0000-00-00": None, "2025-02-30T00:00:00Z": None, "2025-01-01T25:00:00Z": None,
    "yesterday": None, "n/a": None, "": None, "unknown": None, "12:30": None, "2025-13-01T00:00:00Z": None, None: None,
}


def test_times(spark):
    rows = spark.createDataFrame([(t,) for t in TIMES], "t STRING").select("t", unix_time(F.col("t")).alias("u")).collect()
    assert {r["t"]: r["u"] for r in rows} == TIMES


def test_values(spark):
    texts = {"TBD": True, "n/a": True, " ": True, "—": True, "[todo]": True, "(empty)": True, "None.": True, None: True, "Nothing leaks here.": False, "Pending requests are replayed.": False, "x": False}
    rows = spark.createDataFrame([(t,) for t in texts], "t STRING").select("t", without_value(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == texts
    forms = {" Partially fixed ": "partially_fixed", "ACCEPTED-RISK": "accepted_risk", "open": "open", "TBD": None, None: None, "": None}
    rows = spark.createDataFrame([(t,) for t in forms], "t STRING").select("t", status(F.col("t")).alias("v")).collect()
    assert {r["t"]: r["v"] for r in rows} == forms
