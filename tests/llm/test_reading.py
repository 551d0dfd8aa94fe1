import random

import numpy as np
import pytest

from lodesift.llm import reading

EASY = ["Go to the {n} and find the {n}.", "We saw the {n} in the {n}.", "Tell us when the {n} is new.", "I close each {n} by hand."]
HARD = ["Notwithstanding the {h} of {h}, the prevailing implementation of {h} necessitates comprehensive reconsideration.", "Any determination regarding {h} must accordingly incorporate an appraisal of {h}."]
MIDDLE = ["The {n} tracker stores the {n} status whenever the queue is full.", "Because the account is shared, the exporter forwards the {n} label to the report."]
NOUNS = "box door key list note card lamp page team map".split()
HARD_NOUNS = "institutional accountability|pseudonymization methodology|authentication infrastructure|probabilistic identification".split("|")


def text(rng, kinds, n=40):
    out = []
    for _ in range(n):
        s = rng.choice(rng.choice(kinds))
        while "{n}" in s:
            s = s.replace("{n}", rng.choice(NOUNS), 1)
        while "{h}" in s:
            s = s.replace("{h}", rng.choice(HARD_NOUNS), 1)
        out.append(s)
    return " ".join(out)


MIXES = {1: [EASY, EASY, EASY, MIDDLE], 2: [MIDDLE, MIDDLE, MIDDLE, EASY], 3: [HARD, HARD, HARD, MIDDLE]}
YEARS = {1: 4, 2: 11, 3: 17}


def corpus(seed, n=90):
    rng = random.Random(seed)
    docs, ratings, levels = {}, [], {}
    for d in range(n):
        level = rng.choice([1, 2, 3])
        docs[d], levels[d] = text(rng, MIXES[level]), level
        for r in rng.sample(["a", "b", "c", "noise"], 3):
            ratings.append((d, r, float(rng.randint(1, 20)) if r == "noise" else YEARS[level] + rng.choice([-1.0, 0.0, 1.0])))
    return docs, ratings, levels


def test_held_out_accuracy(spark):
    docs, ratings, _ = corpus(1)
    more, _, levels = corpus(2, 120)
    rows = [(d, t) for d, t in docs.items()] + [(1000 + d, t) for d, t in more.items()]
    labels = spark.createDataFrame([(d, r, int(y)) for d, r, y in ratings] + [(1, "a", None), (None, "a", 3), (99_999, "a", 5)], "doc_id BIGINT, rater STRING, years_of_school INT")
    got = reading.reading_levels(spark, spark.createDataFrame(rows, "doc_id BIGINT, text STRING"), labels).collect()
    right = [r["level"] == levels[r["id"] - 1000] for r in got if r["id"] >= 1000]
    assert len(right) == 120 and np.mean(right) >= 0.97


def test_unreliable_raters_get_no_weight():
    _, ratings, _ = corpus(3, 200)
    weights = reading.rater_weights(ratings)
    assert weights["noise"] == 0 and min(weights[r] for r in "abc") > 0


PROSE = "The team will find the box. It is new."
DOCUMENT = f"""# A heading of some length

{PROSE}

```python
x = "The code is not prose."
```

| a | b |
|---|---|
| The table | is not prose |

- The list is not prose.
- https://x.example/y

    at lichen.planner.author(Album.java:169)
Traceback (most recent call last):
  File "x.py", line 3, in run

key.name = 12
{{
  "json": "The value"
}}

Das ist die Prüfung der Ablage und nicht mehr.
"""


def test_reading_in_parts_changes_nothing():
    docs, _, _ = corpus(5, 12)
    texts = [*docs.values(), "It is - as _ said – 3 & 4.", "x", None, ""]
    whole = reading.Reader().read(texts)
    for k, t in enumerate(texts):
        one = reading.Reader().read([t])
        mine = whole.doc == k
        assert one.sentences == [s for s, m in zip(whole.sentences, mine) if m] and one.counts.tolist() == whole.counts[mine].tolist() and one.english.tolist() == whole.english[mine].tolist() and one.sizes.tolist() == whole.sizes[mine].tolist()
        assert one.counts.tolist() == [sum(any(c.isalnum() for c in w) for w in s.split()) for s in one.sentences]
    sizes = [p.stop - p.start for p in reading._portions(["a" * 3_000_000, "b" * 2_000_000, None, "c" * 9_000_000, ""])]
    assert sum(sizes) == 5 and len(sizes) == 4


def test_a_bounded_choice_of_sentences():
    docs, _, _ = corpus(6, 3)
    few = reading.chosen_sentences([*docs.values(), None], 7)
    assert [len(f) for f in few] == [7, 7, 7, 0] and few[:3] == reading.chosen_sentences(list(docs.values()), 7)


def test_prose_only():
    for t in (DOCUMENT, DOCUMENT.replace("\n", "\r\n")):
        read = reading.Reader().read([t, None, "", t])
        assert read.counts[read.english].sum() == 18 and len(read.counts) == 6 and set(read.doc.tolist()) == {0, 3}
    assert reading.sentences("A wrapped sentence\ngoes on here. And 3 more.\nThe end?") == ["A wrapped sentence goes on here.", "And 3 more.", "The end?"]


def test_nulls_blanks_long_repeats_and_no_labels(spark):
    docs, ratings, _ = corpus(4, 30)
    rows = [(d, t) for d, t in docs.items()] + [(500, None), (501, ""), (502, " \n"), (503, "x"), (504, text(random.Random(1), [EASY], 4000)), (505, "Ein Satz, der nicht auf Englisch ist."), (0, docs[0]), (506, "a" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING").selectExpr("*", "1 AS words", "2 AS id")
    labels = spark.createDataFrame([(d, r, int(y)) for d, r, y in ratings], "doc_id BIGINT, rater STRING, years_of_school INT")
    got = reading.reading_levels(spark, df, labels).collect()
    by = {r["id"]: r for r in got}
    assert len(got) == len(rows) and all(by[k]["level"] is None for k in (500, 501, 502)) and by[504]["level"] == 1 and by[504]["words"] > 20_000 and by[505]["words"] == 0
    none = reading.reading_levels(spark, df, labels.limit(0))
    assert none.filter("level IS NOT NULL").count() == 0 and none.count() == len(rows)
    assert reading.reading_levels(spark, df.limit(0), labels).count() == 0


@pytest.mark.parametrize("years, level", [(1, 1), (7.4, 1), (7.5, 2), (14.4, 2), (14.5, 3), (20, 3)])
def test_levels(years, level):
    assert reading.level_of(years) == level
