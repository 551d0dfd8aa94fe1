import random

import pytest
from pyspark.sql import functions as F

from lodesift.llm.consensus import BLOCK, Profile, Value, aligned, best_values, by_rank, distance, settle, tokens, tree

FIELDS = ["a", "b"]
KIND = "key STRING, id BIGINT, trust INT, at BIGINT, weight BIGINT, a STRING, b STRING"


def wanted(rows):
    out = set()
    for key in {r[0] for r in rows if r[0] is not None}:
        group = [r for r in rows if r[0] == key and r[1] is not None]
        if len({r[1] for r in group}) < 2:
            continue
        for n, f in ((5, "a"), (6, "b")):
            there = [r for r in group if r[n] is not None]
            if there:
                best = min(there, key=lambda r: (r[2] if r[2] is not None else 10**9, -(r[3] if r[3] is not None else -(10**9)), -r[1]))
                out.add((key, f, best[1]))
    return out


def random_rows(seed, n=300, keys=30):
    rng = random.Random(seed)
    words = "the key of a note is kept in log and sent to host".split()
    text = lambda: rng.choice([None, "", " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))])
    rows = [(rng.choice([None, *map(str, range(keys))]), rng.choice([None, *range(200)]), rng.choice([None, 1, 2, 3]), rng.choice([None, 5, 6, 7]), rng.randint(0, 9), text(), text()) for _ in range(n)]
    by_id = {}
    return [by_id.setdefault(r[1], r) if r[1] is not None else r for r in rows] + rows[:0]


@pytest.mark.parametrize("heavy", [5_000, 3])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_precedence_against_brute_force(spark, heavy, seed):
    rows = random_rows(seed)
    got = best_values(spark.createDataFrame(rows, KIND), FIELDS, precedence=True, heavy_rows=heavy).collect()
    assert {(r["key"], r["field_name"], r["id"]) for r in got} == wanted(rows) and len(got) == len(wanted(rows))


def test_one_hot_key(spark):
    rows = [("hot" if k % 3 else str(k), k, k % 5, k % 7, 1, f"value {k % 11} of the hot key", None) for k in range(900)]
    df = spark.createDataFrame(rows, KIND).repartition(5)
    got = {(r["key"], r["field_name"], r["id"]) for r in best_values(df, FIELDS, precedence=True, heavy_rows=50).collect()}
    assert got == wanted(rows)


def test_consensus_drops_what_one_says(spark):
    rows = [("k", 1, 1, 1, 1, "wrap the key at the client", None), ("k", 2, 1, 2, 1, "wrap the key twice at the client", None), ("k", 3, 1, 3, 1, "wrap the key at the clients", None), ("k", 4, 1, 4, 1, "wrap a key at the client", None)]
    for heavy in (100, 2):
        got = best_values(spark.createDataFrame(rows, KIND), FIELDS, heavy_rows=heavy).collect()
        assert [(r["field_name"], r["id"], r["value"]) for r in got] == [("a", 1, "wrap the key at the client")]


def test_ties_repeats_and_single_records(spark):
    rows = [("k", 1, 1, 1, 1, "x", None), ("k", 2, 1, 1, 1, "x", None), ("one", 3, 1, 1, 1, "x", "y"), ("one", 3, 1, 1, 1, "x", "y"), (None, 4, 1, 1, 1, "x", "y"), (None, 5, 1, 1, 1, "x", "y")]
    assert [(r["key"], r["id"]) for r in best_values(spark.createDataFrame(rows, KIND), FIELDS).collect()] == [("k", 2)]


def test_empty_long_and_clashing(spark):
    df = spark.createDataFrame([], KIND + ", goal INT, n INT, far INT")
    assert best_values(df, FIELDS).count() == 0
    rows = [("k", k, k, 1, 1, "word " * 4000 + str(k), None, 1, 2, 3) for k in range(3)]
    assert best_values(spark.createDataFrame(rows, KIND + ", goal INT, n INT, far INT"), FIELDS, precedence=True).first()["id"] == 0


def test_alignment():
    p = aligned(Profile(tokens(t), w) for t, w in (("a b c d", 2), ("a c d", 1), ("a b x d e", 1)))
    assert p.consensus() == ["a", "b", "c", "d"]
    assert distance(tokens("a b c"), tokens("a c")) == 1 and distance([], ["x"]) == 1 and distance(["x"], ["x"]) == 0
    q, r = Profile(tokens("a b"), 1), Profile(tokens("a c b"), 3)
    q.merge(r)
    assert q.consensus() == ["a", "c", "b"] and q.total == 4


def test_settle_prefers_precedence_by_rank_weights():
    values = [Value("many say this", (2, -5, -4), 5), Value("one says that", (1, -1, -9), 1)]
    assert settle(values, precedence=True).text == "one says that" and settle(values).text == "many say this"
    assert all(by_rank(k) > sum(map(by_rank, range(k + 1, 200))) for k in range(63)) and by_rank(63) == by_rank(5_000) == 0


def planted(rng, n):
    """A text and ``n`` copies, each with errors in places of its own; one has fewer errors than all others."""
    words = [f"w{k}" for k in range(40)]
    least = rng.randrange(n)
    copies = []
    for k in range(n):
        row = list(words)
        for at in sorted(rng.sample(range(len(row)), 1 if k == least else 3), reverse=True):
            row[at : at + 1] = rng.choice([[], [f"e{rng.randint(0, 10**6)}"], [row[at], f"i{rng.randint(0, 10**6)}"]])
        copies.append(" ".join(row))
    return words, copies, least


@pytest.mark.parametrize("heavy", [5_000, 2])
def test_outvoting_finds_the_planted_text(spark, heavy):
    """The weighted sum decides: no single record has the text that all errors are taken out of."""
    rng = random.Random(11)
    rows, want = [], {}
    for key, n in enumerate([5, 7, 9, 30, 200]):
        words, copies, least = planted(rng, n)
        assert tree([Profile(tokens(c), 1) for c in copies]).consensus() == words
        rows += [(str(key), 1000 * key + k, 1, k, 1, c, None) for k, c in enumerate(copies)]
        want[str(key)] = 1000 * key + least
    # The record first in precedence is the latest one; here it never is the best.
    got = {r["key"]: r["id"] for r in best_values(spark.createDataFrame(rows, KIND), FIELDS, heavy_rows=heavy).collect()}
    assert got == want


@pytest.mark.parametrize("precedence", [False, True])
def test_same_result_whatever_the_stages(spark, precedence):
    rng = random.Random(12)
    words = "the key of a note is kept in log and sent to host".split()
    rows = [(rng.choice("ab"), k, rng.choice([1, 2]), rng.randint(1, 5), rng.randint(1, 3), " ".join(rng.choice(words) for _ in range(rng.randint(1, 9))), rng.choice("xyz")) for k in range(6 * BLOCK)]
    results = set()
    for heavy, parts in ((5_000, 1), (5_000, 7), (10, 1), (10, 9)):
        rng.shuffle(rows)
        got = best_values(spark.createDataFrame(rows, KIND).repartition(parts), FIELDS, precedence, heavy_rows=heavy).collect()
        results.add(tuple(sorted(map(tuple, got))))
    assert len(results) == 1


def test_status_is_a_value_like_any_other(spark):
    df = spark.createDataFrame([("k", 1, 2, 1, 1, "open", None), ("k", 2, 1, 1, 1, None, "z")], KIND)
    assert {(r["field_name"], r["id"]) for r in best_values(df.withColumn("more", F.lit(1)), FIELDS).collect()} == {("a", 1), ("b", 2)}
