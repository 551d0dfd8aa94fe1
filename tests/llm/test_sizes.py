import random

import numpy as np
import pytest

from lodesift.llm import mixing, packing
from lodesift.llm.tokens import encoding, vocabulary_path, with_tokens

ITEMS = "id BIGINT, tokens BIGINT"
KINDS = "container_kind STRING, capacity_tokens INT"


def test_tokens_of_whole_texts(spark):
    rows = [(1, "a b c"), (2, None), (3, ""), (4, "word " * 30_000), (5, "<|endoftext|> ünï"), (5, "<|endoftext|> ünï")]
    got = sorted(tuple(r) for r in with_tokens(spark.createDataFrame(rows, "i BIGINT, tokens STRING"), ["i"], "tokens").collect())
    encode = encoding(vocabulary_path()).encode_ordinary
    assert got == sorted((i, len(encode(t)) if t else 0) for i, t in rows)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_whole_and_close_to_the_bound(seed):
    rng = np.random.default_rng(seed)
    sizes, capacity = rng.integers(1, 300, 400), 1000
    windows = packing.pack(sizes, capacity)
    filled = np.bincount(windows, weights=sizes)
    assert filled.max() <= capacity and len(windows) == 400 and len(filled) <= 1.03 * packing.lower_bound(sizes, capacity) + 1


@pytest.mark.parametrize("seed", range(3))
def test_few_items_a_window(seed):
    rng = np.random.default_rng(seed)
    sizes = rng.integers(1, 512, 220)
    filled = np.bincount(packing.pack(sizes, 512), weights=sizes)
    assert filled.max() <= 512 and filled.min() > 0 and len(filled) <= 1.08 * packing.lower_bound(sizes, 512)


def test_fullest_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(50):
        sizes = rng.integers(1, 60, 7).tolist()
        best, bits = packing._fullest(sizes, 100)
        sums = [sum(x for j, x in enumerate(sizes) if b >> j & 1) for b in range(128)]
        assert best == max(x for x in sums if x <= 100) == sum(x for j, x in enumerate(sizes) if bits >> j & 1)


def test_differencing_balances():
    assert sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), weights=[8, 7, 6, 5, 4])) == [14, 16]
    assert len(set(packing.differencing(np.array([5, 5]), 4))) == 2
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 200)
    sums = np.bincount(packing.differencing(sizes, 10), weights=sizes)
    assert sums.max() - sums.min() <= 3


def test_containers(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0, 1, 5, 40, 90, 100, 101, 250, 1000])) for k in range(500)] + [(3, 40), (None, 40)]
    kinds = [("small", 100), ("large", 400), ("none", 0), (None, None)]
    got = packing.fill_containers(spark.createDataFrame(rows, ITEMS), spark.createDataFrame(kinds, KINDS), windows=8)
    for kind, capacity in kinds[:2]:
        mine = [r for r in got.collect() if r["container_kind"] == kind]
        filled = {}
        for r in mine:
            filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["tokens"]
        assert max(filled.values()) <= capacity
        assert sum(filled.values()) == sum(t or 0 for _, t in rows)
        for r in mine:
            if r["part"] or r["token_from"]:
                assert r["token_from"] == r["part"] * capacity
        whole = {i for i, t in rows if t and t <= capacity}
        assert all(r["part"] == 0 for r in mine if r["id"] in whole and r["id"] != 3)
        assert sum(filled.values()) / (len(filled) * capacity) > 0.85
    assert {r["container_kind"] for r in packing.fill_report(got, spark.createDataFrame(kinds, KINDS)).collect()} == {"small", "large"}
    assert packing.fill_containers(spark.createDataFrame([], ITEMS), spark.createDataFrame(kinds, KINDS)).count() == 0
    assert packing.fill_containers(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([], KINDS)).count() == 0


def test_repeated_ids_are_separate_items(spark):
    """Two texts of one id, each longer than a container, and two of none."""
    rows = [(1, 25), (1, 25), (None, 30), (None, 30), (2, 25)]
    got = packing.fill_containers(spark.createDataFrame(rows, ITEMS), spark.createDataFrame([("k", 10)], KINDS)).collect()
    filled = {}
    for r in got:
        filled[r["container_id"]] = filled.get(r["container_id"], 0) + r["tokens"]
    assert max(filled.values()) == 10 and sum(filled.values()) == 135 and "full-2-0" in filled


@pytest.mark.parametrize("seed", range(5))
def test_lower_bound_counts_every_size(seed):
    rng = np.random.default_rng(seed)
    sizes, capacity = rng.integers(1, 2000, 700), 2000
    want = -(-int(sizes.sum()) // capacity)
    for t in range(1, capacity // 2 + 1):
        large, half = sizes[sizes > capacity - t], sizes[(sizes > capacity // 2) & (sizes <= capacity - t)]
        small = sizes[(sizes >= t) & (sizes <= capacity // 2)].sum()
        want = max(want, len(large) + len(half) + max(0, -(-int(small - (len(half) * capacity - half.sum())) // capacity)))
    assert packing.lower_bound(sizes, capacity) == want


def test_many_tiny_items_and_a_huge_one():
    sizes = np.array([1] * 5000 + [1000])
    windows = packing.pack(sizes, 1000)
    assert np.bincount(windows, weights=sizes).max() <= 1000 and len(set(windows.tolist())) <= 7


MIX = "id BIGINT, source STRING, tokens BIGINT"
TARGETS = "source STRING, target_share DOUBLE, max_repeats INT"


def mixture(spark, rows, targets, **more):
    mixed, budgets = mixing.mix(spark.createDataFrame(rows, MIX), spark.createDataFrame(targets, TARGETS), **more)
    return [tuple(r) for r in mixed.collect()], {r["source"]: r for r in mixing.shares(mixed, budgets).collect()}


@pytest.mark.parametrize("ranges", [20_000, 10])
def test_shares_are_met(spark, ranges):
    rng = random.Random(2)
    rows = [(k, rng.choice(["big", "Big ", "BIG"]), rng.randint(1, 20)) for k in range(3000)] + [(10_000 + k, "small-one", 10) for k in range(60)] + [(20_000, "untargeted", 50), (20_001, None, 5), (None, "big", 5), (20_002, "big", 0), (20_003, "big", None)]
    targets = [("big", 0.5, 1), ("small_one", 0.4, 3), ("absent", 0.1, 2)]
    mixed, told = mixture(spark, rows, targets, total=3000, range_rows=ranges)
    assert abs(told["big"]["tokens_used"] - 1500) <= 20 and abs(told["small_one"]["tokens_used"] - 1200) <= 10
    assert told["small_one"]["most_copies"] == 2 and told["absent"]["tokens_used"] == 0
    assert abs(told["big"]["actual_share"] - 1500 / 2700) < 0.02
    copies = {i: c for i, s, _, c in mixed if s == "small_one"}
    assert set(copies.values()) <= {1, 2, 3} and len(copies) == 60
    assert len({i for i, *_ in mixed}) == len(mixed)


def test_repeats_are_capped_and_ranges_change_nothing(spark):
    rows = [(k, "a", 7) for k in range(500)] + [(1000 + k, "b", 3) for k in range(20)]
    targets = [("a", 0.5, 1), ("b", 0.5, 4)]
    one, told = mixture(spark, rows, targets)
    two, _ = mixture(spark, rows, targets, range_rows=13)
    assert sorted(one) == sorted(two) and told["b"]["most_copies"] == 4 and told["b"]["tokens_used"] == 240 and told["b"]["filled"] < 1


def test_empty_mixture(spark):
    mixed, told = mixture(spark, [], [("a", 1.0, 1)])
    assert mixed == [] and told["a"]["tokens_used"] == 0 and told["a"]["actual_share"] == 0
    assert mixture(spark, [(1, "a", 5)], []) == ([], {})
