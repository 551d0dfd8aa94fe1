import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodesift.llm import near


def texts(seed, n=150):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(20, 60))] for _ in range(n)]
    out = []
    for k, b in enumerate(base):
        out.append(b)
        for _ in range(rng.choice([0, 0, 1, 3])):
            c = list(b)
            for _ in range(rng.randint(0, 8)):
                c[rng.randrange(len(c))] = rng.choice(words)
            if rng.random() < 0.4:
                rng.shuffle(c)
            out.append(c)
    return [(k, " ".join(w)) for k, w in enumerate(out)]


def brute(rows, threshold):
    bags = [(i, Counter(t.split())) for i, t in rows]
    out = set()
    for x, (i, a) in enumerate(bags):
        for j, b in bags[x + 1 :]:
            common = sum((a & b).values())
            if common >= threshold * (sum(a.values()) + sum(b.values()) - common):
                out.add((min(i, j), max(i, j)))
    return out


def pairs(spark, rows, threshold=0.7, crowd=256, **more):
    records, copies = near.classes(spark.createDataFrame(rows, "rid BIGINT, t STRING"), "rid", near.words_of(F.col("t")))
    return near.expand_copies(near.similar_pairs(records, threshold, most=crowd), copies, **more)


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_against_brute_force(spark, seed):
    rows = texts(seed)
    got = {tuple(r) for r in pairs(spark, rows).collect()}
    want = brute(rows, 0.7)
    assert got <= want and len(want - got) <= 0.01 * len(want) + 1


def test_crowded_buckets_lose_no_pair(spark):
    rng = random.Random(9)
    common = [f"c{k}" for k in range(6)]
    # Unlike texts that share their most frequent words, so that they crowd some buckets; and likes among them.
    rows = [(k, t + " " + " ".join(rng.sample(common, 3) * 2)) for k, t in texts(8, 220)]
    # And a crowd of likes, which no key parts.
    base = [f"b{k}" for k in range(60)]
    rows += [(10_000 + k, " ".join([*base[:k], f"own{k}", *base[k + 1 :]])) for k in range(60)]
    want, got = brute(rows, 0.7), {tuple(r) for r in pairs(spark, rows, crowd=5).collect()}
    assert got <= want and len(want - got) <= 0.01 * len(want) + 1
    assert {p for p in want if p[0] >= 10_000} <= got


def test_keys_meet_across_batches():
    import pyarrow as pa

    rng = np.random.default_rng(5)
    keys = np.sort(np.concatenate([np.repeat(rng.integers(0, 10**9, 40), rng.integers(1, 9, 40)), np.repeat(7, 30)]))
    ids, s = rng.permutation(len(keys)), np.zeros(len(keys), np.int64)
    want_pairs, want_crowd = set(), set()
    for key in set(keys.tolist()):
        mine = sorted(ids[keys == key].tolist())
        if len(mine) > 6:
            want_crowd |= {(i, key) for i in mine}
        else:
            want_pairs |= {(a, b) for n, a in enumerate(mine) for b in mine[n + 1 :]}
    for step in (1, 2, 5, 13, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[k : k + step]) for x in (keys, ids, s, s)], names=["band", "id", "s0", "s1"]) for k in range(0, len(keys), step)]
        got = [r for b in near._meet(6, 0)(iter(batches)) for r in zip(*[c.to_pylist() for c in b.columns])]
        assert {(a, b) for a, b, _ in got if b is not None} == want_pairs, step
        assert {(a, key) for a, b, key in got if b is None} == want_crowd, step


def test_a_record_delivered_with_two_texts(spark):
    rows = [(1, "a b c d e f g h"), (1, "r s t u v w x y"), (2, "a b c d e f g i"), (3, "r s t u v w x z")]
    for parts in (1, 4):
        records, copies = near.classes(spark.createDataFrame(rows, "rid BIGINT, t STRING").repartition(parts), "rid", F.col("t"))
        assert {tuple(r) for r in near.expand_copies(near.similar_pairs(records, 0.7), copies).collect()} == {(1, 2), (1, 3)}


def test_links(spark):
    rows = [(1, "a b c d e f g h"), (2, "A b c d e f g h!"), (3, "a b c d e f g i"), (4, "quite another text")]
    records, copies = near.classes(spark.createDataFrame(rows, "rid BIGINT, t STRING"), "rid", near.words_of(F.col("t")))
    got = {tuple(r) for r in near.links(records, copies, near.similar_pairs(records, 0.7)).collect()}
    assert got == {(1, 1, 2, 2), (2, 1, 2, 2), (3, 3, 1, 2), (4, 4, 1, 0)}


def test_repeated_words_count(spark):
    rows = [(1, "a a a a b c d"), (2, "a b c d"), (3, "a a a a b c d"), (4, "d c b a a a a")]
    got = {tuple(r) for r in pairs(spark, rows).collect()}
    assert got == brute(rows, 0.7) == {(1, 3), (1, 4), (3, 4)}


def test_hot_group_of_copies_keeps_every_link(spark):
    rows = [(k, "one and the same text for all of these rows here") for k in range(200)] + [(500, "one and the same text for all of these rows there")] + texts(3, 40)[:0]
    got = {tuple(r) for r in pairs(spark, rows, most=16).collect()}
    assert got == {(0, k) for k in range(1, 200)} | {(0, 500)}
    full = {tuple(r) for r in pairs(spark, rows, most=1000).collect()}
    assert full == brute(rows, 0.7)


def test_nulls_blanks_repeats_long_and_empty(spark):
    long = " ".join(f"x{k}" for k in range(5000))
    rows = [(1, None), (2, ""), (3, "  ...  "), (None, "a b c d e"), (4, "a b c d e"), (4, "a b c d e"), (5, "A, b! C d e"), (6, long), (7, long + " y")]
    assert {tuple(r) for r in pairs(spark, rows).collect()} == {(4, 5), (6, 7)}
    assert pairs(spark, rows[:0]).count() == 0


def test_words(spark):
    df = spark.createDataFrame([("Ab-Cd_1é \u212a", None), (None, None)], "t STRING, u STRING")
    assert [r[0] for r in df.select(near.words_of(F.col("t"), F.col("u"))).collect()] == ["ab cd 1", ""]


def test_minima_estimate_similarity():
    a = " ".join(f"w{k}" for k in range(100))
    b = " ".join(f"w{k}" for k in range(30, 130))
    s = near.Minima(1000).of([a, b, a])
    assert (s[0] == s[2]).all() and abs(float(np.mean(s[0] == s[1])) - 70 / 130) < 0.06
    small = near.Minima(1000, keep=10)
    assert (small.of([a]) == s[:1]).all() and (small.of([b]) == s[1:2]).all()


def test_components_against_union_find(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2080)] + [(5, 5)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["group"] for r in near.components(spark.createDataFrame(edges, "a BIGINT, b BIGINT")).collect()}
    assert got == {x: find(x) for x in parent}
    assert near.components(spark.createDataFrame([], "a BIGINT, b BIGINT")).count() == 0
