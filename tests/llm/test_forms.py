import json
import random
import re

import pytest

from lodesift.llm import forms

READ = forms.json_members(["title", "surface", "fix"], "findings")


def canonical(t):
    return re.sub(r"[^\w]|_", "", t.casefold())


def spelled(rng, text):
    out = []
    for c in text:
        out.append(rng.choice([c, c.upper(), c.lower()]))
        if rng.random() < 0.3:
            out.append(rng.choice([" ", "-", " ", "’", "\n", ".", " "]))
    return "".join(out)


def test_hash_and_comparison_agree_with_canonical_texts():
    rng = random.Random(1)
    base = ["Straße 12 é", "strasse 12 é", "", "...", "abc", "ab c", "abd", "ÀÉ", "x" * 5000, "İi", "ﬁn", "fin", "Σσς"]
    rows = [(spelled(rng, rng.choice(base)), spelled(rng, rng.choice(base))) for _ in range(300)]
    hashes = forms.form_hashes(rows)
    for k in range(0, 299, 2):
        a, b = rows[k], rows[k + 1]
        same = tuple(map(canonical, a)) == tuple(map(canonical, b))
        assert (hashes[k] == hashes[k + 1]) == same, (a, b)
        assert all(map(forms.same_form, a, b)) == same


def test_parts_dont_flow_into_each_other():
    h = forms.form_hashes([("ab", "c"), ("a", "bc"), ("abc", ""), ("", "abc")])
    assert len(set(h.tolist())) == 4


def payload(rng, t, s, f, shape):
    names = rng.choice([str.lower, str.upper, str.title])
    members = [(names("title"), t), (names("surface"), s), (names("fix"), f), ("severity", rng.choice(["low", "high"]))]
    rng.shuffle(members)
    doc = dict(members)
    doc = [doc] if shape == 1 else {"findings": [doc]} if shape == 2 else doc
    return json.dumps(doc, indent=rng.choice([None, 1, 4]), ensure_ascii=rng.random() < 0.5)


@pytest.mark.parametrize("batch", [10_000, 7])
def test_records_against_brute_force(spark, batch):
    rng = random.Random(2)
    base = [(f"Title é {k % 40}", f"surface {k % 3}", f"do this, then {k % 5}") for k in range(120)]
    rows = []
    for k in range(600):
        b = rng.choice(base[:1] * 60 + base)
        rows.append((k, payload(rng, *[spelled(rng, x) for x in b], rng.randrange(3)), b))
    first = {}
    for k, _, b in rows:
        first.setdefault(tuple(map(canonical, b)), k)
    want = sorted((first[tuple(map(canonical, b))], k) for k, _, b in rows if first[tuple(map(canonical, b))] != k)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame([r[:2] for r in rows], "raw_id BIGINT, payload STRING").repartition(3)
        collapsed = forms.collapse_forms(df, "raw_id", ["payload"], READ)
        assert sorted(tuple(r) for r in forms.form_copies(collapsed).collect()) == want
        counts = {r["first"]: r["copies"] for r in forms.form_counts(collapsed).collect()}
        assert sum(counts.values()) == 600 and set(counts) == set(first.values())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_what_is_no_record():
    for bad in (None, "", "{", '{"title": "a"', '{"title": "a"} x', "[]", "[1]", '[{"title": 1}, {"title": 2}]', "3", '"x"', "null", '{"a": NaN}', "[" * 5000, '{"findings": [{"title": "a"}, {"title": "b"}]}'):
        assert READ(bad) is None, bad
    assert READ('{"TITLE": "a", "fix": null}') == ("a", "", "") and READ('[{"title": 5, "surface": ["x"]}]') == ("5", '["x"]', "")
    assert READ('{"findings": [{"Title": "a"}]}') == ("a", "", "")


def test_collisions_keep_records_apart(spark, monkeypatch):
    batches = [forms._lead(None)(iter([])), None]
    assert list(batches[0]) == []
    import pyarrow as pa

    monkeypatch.setattr(forms, "form_hashes", lambda rows: __import__("numpy").zeros(len(rows), "int64"))
    batch = pa.RecordBatch.from_arrays([pa.array([3, 1, 2, 4]), pa.array(["A b", "c", "ab", "C."])], names=["id", "t"])
    leads = next(iter(forms._lead(None)(iter([batch]))))
    assert sorted(map(sorted, leads.column(3).to_pylist())) == [[1, 4], [2, 3]]
    # The same four records, each the leader of its own batch, all with one hash.
    rows = [(0, 1, 10, ["c"]), (0, 2, 20, ["ab"]), (0, 3, 30, ["A b"]), (0, 4, 40, ["C."])]
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()))
    parts = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in half], t) for k, t in enumerate(kinds)], names=["h", "id", "leader", "texts"]) for half in (rows[:2], rows[2:])]
    got = [pair for b in forms._settle(iter(parts)) for pair in zip(*[c.to_pylist() for c in b.columns])]
    assert got == [(30, 2), (40, 1)]


def test_blocks_end_between_characters():
    """Texts whose characters of two to four bytes lie across every edge of a block."""
    for pad in range(forms.BLOCK + 2):
        for c in ("é", "ＡＢ", "𝐀", "ß", "語", "🙂"):
            a, b = "x" * pad + c * 40 + "End", "-".join("X" * pad + c * 40) + " eND"
            h = forms.form_hashes([(a,), (b,), (a + "1",), ("",)]).tolist()
            assert forms.same_form(a, b) and h[0] == h[1] and len({*h}) == 3, (pad, c)


def test_columns_nulls_repeats_long_and_empty(spark):
    rows = [(1, "A-b", None), (2, "ab", ""), (2, "ab", ""), (3, None, None), (4, "", "?"), (None, "ab", None), (5, "x" * 200_000, "y"), (6, "X " * 200_000, "Y!")]
    df = spark.createDataFrame(rows, "i BIGINT, h STRING, texts STRING")
    got = sorted(tuple(r) for r in forms.form_copies(forms.collapse_forms(df, "i", ["h", "texts"])).collect())
    assert got == [(1, 2), (3, 4), (5, 6)]
    assert forms.form_copies(forms.collapse_forms(df.limit(0), "i", ["h", "texts"])).count() == 0
