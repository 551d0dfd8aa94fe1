"""Reading level of documents: sentences are classified, documents calibrated from their sentences.

Running prose is taken out of a document line by line (no headings, code, tables, traces, lists), cut
into sentences, and sentences of other languages are left aside. A regularised multinomial model over
words, character n-grams within words, and a sentence's length gives each sentence's level; it is fitted
on sentences of rated documents, then on its own sharpened view of them, since a document of one level
has sentences of others. The distributions over levels of a document's sentences are averaged, by words and
by sentences, and calibrated, by a second such model, to the level and the years of school that reliable
raters give; how reliable a rater is shows in how far their ratings are from what text and other raters say.

Fitting uses a bounded sample: at most ``most_docs`` rated documents, the first by hash of their id,
and at most ``most_sentences`` sentences of each, by hash of the sentence, chosen where the texts lie.
Everything is scored. Sentences of a batch are read, classified and averaged all at once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEVELS = 3
# The last year of school of a level, and words that tell languages apart.
LEVEL_ENDS = (7, 14)
ENGLISH = frozenset("the of and to that it for with by this are not or from which you we they who what when where how if its your our their has have had been were was be but until into than then these those there us them each every some any should could would can may will as an at is on in i my do does did go out".split())
OTHER = frozenset("der das und ist nicht mit von für auf den dem ein eine einen einem wir haben sie wird werden wurde nach bitte kein keine auch bei zum zur sich als noch hier oder aber le la les un une est dans sur il elle nous vous avons après sans du au aux que qui ne pas ce cette et avant fois plus el los las del por para con se hay una después antes es está esta este lo y pero sin al como más di il che per una non sono della nel com uma não são para pelo pela os".split()) - {"plus", "sin", "on", "os"}

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
FENCE = re.compile(r"\s*(?:```|~~~)")
# Lines that are no prose, wherever they stand.
NO_PROSE = re.compile(r"""(?x) \s*(?: \#{1,6}\s | \|.* | .*\|.*\|.* | [-*+•–]\s+ | \(?\d{1,3}[.)]\s+ | >{1,}\s*\S* | at\s+[\w$.<>]+\(.*\) | Traceback\b.* | File\s".* | Caused\sby:.* | [{}\[\]();,]+\s*$ | ["'][\w\-. ]+["']\s*:.* | [\w.\-\[\]"]+\s*(?:=|:=|\+=|=>)\s*\S.* | <[/!?\w].*>\s*$ | [\w.\-]+:\s*$ | \w+://\S+\s*$ | [$>]\s+\S+ | [-=*_~]{3,}\s*$ | [\w.+\-]+@[\w\-]+\.\S+\s*$ | (?:import|from|def|class|return|const|let|var|public|private|function|if|for|while|SELECT|INSERT|UPDATE|DELETE|CREATE)\b.*[;{}()]\s*$ )""")
UNDERLINE = re.compile(r"\s*(?:={3,}|-{3,})\s*$")
BARE = re.compile(r"(?:^| )(?:[^\w ]|_)+(?= |$)")  # what stands between blanks without a letter or digit
TOKENS = re.compile(WORD.pattern + r"|\n")
MOST_TEXT = 4_000_000  # characters read at once, or one text
SENTENCE_END = re.compile(r"(?<=[.!?])[\"'”’)]*\s+(?=[\"'“‘(]*[^\W_a-z])|(?<=[.!?])\s+(?=\d)")


def prose_blocks(text: str) -> list[str]:
    """The paragraphs of running prose of a text, each as one line."""
    lines, blocks, held, fenced = re.split(r"\r\n|\r|\n", text), [], [], False

    def close() -> None:
        if held:
            blocks.append(" ".join(" ".join(held).split()))
            held.clear()

    for k, line in enumerate(lines):
        if FENCE.match(line):
            fenced = not fenced
            close()
        elif fenced or not line.strip():
            close()
        elif NO_PROSE.match(line) or (line.startswith(("    ", "\t")) and re.search(r"[=;{}()<>]|\w\.\w", line)):
            close()
        elif k + 1 < len(lines) and not held and UNDERLINE.match(lines[k + 1]) and len(line) < 80:
            close()  # a heading, underlined
        else:
            held.append(line)
    close()
    return blocks


def sentences(text: str) -> list[str]:
    """Sentences of a text's prose; a block without any sentence end and of few words is a heading."""
    out = []
    for block in prose_blocks(text):
        if not re.search(r"[.!?]", block) and len(block.split()) < 10:
            continue
        out += [s for s in SENTENCE_END.split(block) if s]
    return out


class Model(NamedTuple):
    weights: np.ndarray  # buckets x levels
    lengths: np.ndarray  # length classes x levels
    bias: np.ndarray
    calibration: np.ndarray  # shares of words and of sentences in each level, and 1: scores of levels
    years: np.ndarray  # mean years of the rated documents of each level


BUCKETS = 1 << 15
LENGTH_CLASSES = 12


def word_features(word: str) -> list[int]:
    """Hashed features of a word: itself, its character n-grams with marks at its ends, and its length."""
    if word[0].isdigit():
        return [crc32(b"0") % BUCKETS]
    w = f"<{word}>"
    grams = {w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1)}
    return [crc32(f"{x}".encode()) % BUCKETS for x in (f"w={word}", f"n={min(len(word), 16)}", *sorted(grams))]


def _length_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n, 1)) * 2, LENGTH_CLASSES - 1).astype(np.int64)


class Read(NamedTuple):
    """The sentences of several texts."""

    sentences: list[str]
    doc: np.ndarray  # the text of each
    words: np.ndarray  # the words of all, by index
    of: np.ndarray  # the sentence of each word
    sizes: np.ndarray  # words of each sentence
    counts: np.ndarray  # the same by blanks
    english: np.ndarray


class _Indexes(dict):
    """A word's index, given when it is first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = k = len(self) - 1
        return k


class Reader:
    """Words, languages and features of sentences, kept by word up to a bound."""

    def __init__(self, model: Model | None = None) -> None:
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.known = _Indexes({"\n": -1})
        self.tongue, self.scores = np.zeros(0, np.int8), np.zeros((0, LEVELS))

    def _learn(self) -> None:
        """Features of the words that are new."""
        new = list(self.known)[len(self.tongue) + 1 :]
        self.tongue = np.append(self.tongue, np.array([1 if w in ENGLISH else -1 if w in OTHER or not w.isascii() else 0 for w in new], np.int8))
        if self.model is not None and new:
            features = [word_features(w) for w in new]
            sizes = np.array([len(f) for f in features])
            sums = np.add.reduceat(self.model.weights[np.concatenate([np.array(f) for f in features])], np.cumsum(sizes) - sizes, axis=0)
            self.scores = np.concatenate([self.scores, sums / sizes[:, None]])

    def read(self, texts: list[str | None]) -> Read:
        """The sentences of texts, their words, and whether each is English."""
        if len(self.known) > 200_000:
            self._clear()
        found = [sentences(t) if t else [] for t in texts]
        flat = [s for f in found for s in f]
        doc = np.repeat(np.arange(len(texts)), [len(f) for f in found])
        tokens = np.fromiter(map(self.known.__getitem__, TOKENS.findall("\n".join(flat).lower())), np.int64)
        self._learn()
        ends = tokens < 0
        of, n = np.cumsum(ends)[~ends], len(flat)
        words = tokens[~ends]
        counts = np.fromiter((s.count(" ") + 1 - len(BARE.findall(s)) for s in flat), np.int64, n)
        tongue = np.bincount(of, self.tongue[words], n)
        english = tongue > 0
        # A sentence that doesn't tell goes with the rest of the document.
        ours, theirs = (np.bincount(doc[side], counts[side], len(texts)) for side in (tongue > 0, tongue < 0))
        tells = np.bincount(doc[tongue != 0], minlength=len(texts)) > 0
        english |= (tongue == 0) & (tells & (ours >= theirs))[doc]
        return Read(flat, doc, words, of, np.bincount(of, minlength=n), counts, english)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit_sentences(rows: list[list[int]], features: list[list[int]], lengths: np.ndarray, goal: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 2e-4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multinomial regression with an L2 penalty, by adaptive gradient steps; a feature's value is its share."""
    word_of = np.array([w for r in rows for w in r], np.int64)
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    share = 1.0 / np.array([max(1, len(r)) for r in rows])
    n_words = len(features)
    f_of, w_of = np.concatenate([np.array(f) for f in features]), np.repeat(np.arange(n_words), [len(f) for f in features])
    f_share = 1.0 / np.array([len(f) for f in features])
    W, L, b = np.zeros((BUCKETS, LEVELS)), np.zeros((LENGTH_CLASSES, LEVELS)), np.zeros(LEVELS)
    GW, GL, Gb = np.full_like(W, 1e-8), np.full_like(L, 1e-8), np.full_like(b, 1e-8)
    weight = weight / weight.sum()

    def spread(at: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
        return np.stack([np.bincount(at, x[:, k], n) for k in range(LEVELS)], 1)

    for _ in range(rounds):
        by_word = spread(w_of, W[f_of], n_words) * f_share[:, None]
        p = _softmax(spread(row_of, by_word[word_of], len(rows)) * share[:, None] + L[lengths] + b)
        d = (p - goal) * weight[:, None]
        g_word = spread(word_of, (d * share[:, None])[row_of], n_words) * f_share[:, None]
        gW = spread(f_of, g_word[w_of], BUCKETS) + ridge * W / BUCKETS
        gL, gb = spread(lengths, d, LENGTH_CLASSES) + ridge * L, d.sum(0)
        for x, g, G in ((W, gW, GW), (L, gL, GL), (b, gb, Gb)):
            G += g * g
            x -= 0.5 * g / np.sqrt(G)
    return W, L, b


def _shares(p: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """For each document the mean distribution of its words' sentences, then of its sentences, and 1."""
    each = lambda x: np.stack([np.bincount(doc, x[:, k], docs) for k in range(LEVELS)], 1)
    words, lines = np.bincount(doc, counts, docs), np.bincount(doc, minlength=docs)
    return np.concatenate([each(p * counts[:, None]) / np.maximum(1, words)[:, None], each(p) / np.maximum(1, lines)[:, None], np.ones((docs, 1))], 1)


def _calibrated(x: np.ndarray, goal: np.ndarray, weight: np.ndarray, rounds: int = 400, ridge: float = 1e-3) -> np.ndarray:
    """Multinomial regression of a document's level on its shares."""
    C = np.zeros((x.shape[1], LEVELS))
    C[np.arange(2 * LEVELS), np.arange(2 * LEVELS) % LEVELS] = 1.0  # what a document mostly has is its level
    start, G, weight = C.copy(), np.full_like(C, 1e-8), weight / weight.sum()
    for _ in range(rounds):
        g = x.T @ ((_softmax(x @ C) - goal) * weight[:, None]) + ridge * (C - start)
        G += g * g
        C -= 0.5 * g / np.sqrt(G)
    return C


def rater_weights(ratings: list[tuple[int, str, float]], expected: dict[int, float] | None = None) -> dict[str, float]:
    """1 / mean squared distance of each rater to what others (or ``expected``) say; 0 for an unreliable one.

    A rater is unreliable whose distance is over twice the median of raters, or whose ratings don't
    rise with what is expected.
    """
    by_doc: dict[int, list[tuple[str, float]]] = {}
    for d, r, y in ratings:
        by_doc.setdefault(d, []).append((r, y))
    off: dict[str, list[tuple[float, float]]] = {}
    for d, r, y in ratings:
        others = [v for q, v in by_doc[d] if q != r]
        goal = expected.get(d) if expected is not None else float(np.median(others)) if others else None
        if goal is not None:
            off.setdefault(r, []).append((y, goal))
    far = {r: float(np.mean([(y - g) ** 2 for y, g in v])) for r, v in off.items()}
    if not far:
        return {r: 1.0 for _, r, _ in ratings}
    middle = float(np.median(list(far.values())))
    out = {}
    for _, r, _ in ratings:
        v = off.get(r, [])
        together = np.corrcoef(np.array(v).T)[0, 1] if len(v) > 4 and np.std([x[0] for x in v]) > 0 and np.std([x[1] for x in v]) > 0 else 1.0
        out[r] = 0.0 if r in far and (far[r] > 4 * max(middle, 1.0) or together < 0.4) else 1.0 / max(1.0, far.get(r, middle))
    return out


def level_of(years: float) -> int:
    return 1 + sum(years >= end + 0.5 for end in LEVEL_ENDS)


def chosen_sentences(texts: list[str | None], most: int) -> list[list[str]]:
    """Of each text at most so many English sentences, the first by hash."""
    read = Reader().read(texts)
    out: list[list[str]] = [[] for _ in texts]
    for k in np.flatnonzero(read.english & (read.sizes > 0)):
        out[read.doc[k]].append(read.sentences[k])
    return [f if len(f) <= most else sorted(f, key=lambda s: (crc32(s.encode("utf-8", "replace")), s))[:most] for f in out]


def fit(sample: dict[int, list[str]], ratings: list[tuple[int, str, float]], rounds: int = 3) -> Model | None:
    """A model from sentences of rated documents; None if no rating has a document with English prose."""
    order = [d for d in sorted(sample) if sample[d]]
    reader, flat = Reader(), [s for d in order for s in sample[d]]
    lower = [WORD.findall(s.lower()) for s in flat]
    rows = [[reader.known[w] for w in ws] for ws in lower]
    lengths = [s.count(" ") + 1 - len(BARE.findall(s)) for s in flat]
    doc_of = [d for d in order for _ in sample[d]]
    there = set(doc_of)
    ratings = [(d, r, y) for d, r, y in ratings if d in there]
    if not ratings:
        return None
    names = list(reader.known)[1:]
    features = [word_features(w) for w in names]
    lengths_, docs = np.array(lengths), np.array(doc_of)
    classes = _length_class(lengths_)
    trust = rater_weights(ratings)
    order, at = np.unique(docs, return_inverse=True)
    goal = None
    for n in range(rounds):
        said = {d: ([], []) for d in there}
        for d, r, y in ratings:
            if trust[r] > 0:
                said[d][0].append(y)
                said[d][1].append(trust[r])
        years = {d: float(np.average(y, weights=w)) for d, (y, w) in said.items() if y}
        rated = np.array([d in years for d in docs])
        if not rated.any():
            return None
        level = np.array([level_of(years.get(d, 0.0)) - 1 for d in docs])
        hard = np.eye(LEVELS)[level]
        per_level = np.maximum(1, np.bincount(level[rated], minlength=LEVELS))
        weight = np.where(rated, 1.0 / per_level[level], 0.0)
        target = hard if goal is None else goal
        W, L, b = _fit_sentences(rows, features, classes, target, weight)
        by_word = np.stack([np.array([W[f, k].mean() for f in features]) for k in range(LEVELS)], 1)
        p = _softmax(np.array([by_word[r].mean(0) for r in rows]) + L[classes] + b)
        # A sentence's own view, sharpened: what its words say weighs more than its document's level.
        sharp = p**4
        goal = sharp / sharp.sum(1, keepdims=True)
        goal[~rated] = 1 / LEVELS
        x = _shares(p, lengths_, at, len(order))
        known = np.array([d in years for d in order])
        y = np.array([years[d] for d in order[known]])
        of = np.array([level_of(v) - 1 for v in y])
        calibration = _calibrated(x[known], np.eye(LEVELS)[of], 1.0 / np.bincount(of, minlength=LEVELS)[of])
        centre = np.array([4.0, 10.5, 17.5])  # of a level that no rating shows
        centre = np.array([y[of == k].mean() if (of == k).any() else centre[k] for k in range(LEVELS)])
        expected = dict(zip(order.tolist(), (_softmax(x @ calibration) @ centre).tolist()))
        trust = rater_weights(ratings, expected)
    return Model(W, L, b, calibration, centre)


def _portions(texts: list[str | None]) -> Iterator[slice]:
    """Runs of texts of so many characters together, or single ones."""
    start, size = 0, 0
    for k, t in enumerate(texts):
        n = len(t) if t else 0
        if size and size + n > MOST_TEXT:
            yield slice(start, k)
            start, size = k, 0
        size += n
    yield slice(start, len(texts))


def _scored(model: Model):  # noqa: ANN202
    names = ["id", "words", "years", "level", "easy", "middle", "hard"]

    def score(reader: Reader, texts: list[str | None]) -> list[pa.Array]:
        read, n = reader.read(texts), len(texts)
        at = np.flatnonzero(read.english & (read.sizes > 0))
        counts, doc = read.counts[at], read.doc[at]
        sums = np.stack([np.bincount(read.of, reader.scores[read.words, k], len(read.sizes)) for k in range(LEVELS)], 1)[at]
        p = _softmax(sums / read.sizes[at][:, None] + model.lengths[_length_class(counts)] + model.bias)
        share, words = _shares(p, counts, doc, n), np.bincount(doc, counts, n).astype(np.int64)
        chance, none = _softmax(share @ model.calibration), words == 0
        told = [pa.array(x, t, mask=none) for x, t in ((chance @ model.years, pa.float64()), (chance.argmax(1) + 1, pa.int32()), *((share[:, k], pa.float64()) for k in range(LEVELS)))]
        return [pa.array(words), *told]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _portions(texts):
                if part.stop > part.start:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), *score(reader, texts[part])], names=names)

    return run


def rated_sample(documents: DataFrame, labels: DataFrame, most_docs: int = 800, most_sentences: int = 60) -> tuple[dict[int, list[str]], list[tuple[int, str, float]]]:
    """Sentences and ratings of at most ``most_docs`` rated documents, the first by hash of their id.

    The sentences are chosen on the executors, at most ``most_sentences`` of a document.
    """
    usable = labels.select("doc_id", "rater", F.col("years_of_school").cast("double").alias("years")).filter(F.col("doc_id").isNotNull() & F.col("rater").isNotNull() & F.col("years").isNotNull())
    chosen = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in _portions(texts):
                if part.stop > part.start:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(part.start, part.stop - part.start), pa.array(chosen_sentences(texts[part], most_sentences), pa.list_(pa.string()))], names=["doc_id", "sentences"])

    rated = documents.join(F.broadcast(chosen), "doc_id").filter(F.col("text").isNotNull()).select("doc_id", "text")
    found = rated.mapInArrow(choose, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, sentences ARRAY<STRING>").collect()  # at most most_docs rows of most_sentences
    ratings = usable.join(F.broadcast(chosen), "doc_id").distinct().collect()
    sample: dict[int, list[str]] = {}
    for r in sorted(found, key=lambda r: (r[0], r[1])):
        sample.setdefault(r[0], r[1])
    return sample, sorted((r["doc_id"], r["rater"], r["years"]) for r in ratings)


def reading_levels(spark: SparkSession, documents: DataFrame, labels: DataFrame, most_docs: int = 800) -> DataFrame:
    """``id``, ``words``, ``years``, ``level``, and the shares of words in ``easy``, ``middle`` and ``hard`` sentences.

    One row for each document of ``doc_id`` and ``text``; ``words`` counts running English prose, and a
    document without any has null ``years`` and ``level``. Repeated ids are scored one by one, other
    columns are ignored. Without a usable rating every ``years`` and ``level`` is null.
    """
    model = fit(*rated_sample(documents, labels, most_docs))
    kind = documents.schema["doc_id"].dataType.simpleString()
    schema = f"id {kind}, words BIGINT, years DOUBLE, level INT, easy DOUBLE, middle DOUBLE, hard DOUBLE"
    rows = documents.select("doc_id", "text")
    if model is None:
        blank = Model(np.zeros((BUCKETS, LEVELS)), np.zeros((LENGTH_CLASSES, LEVELS)), np.zeros(LEVELS), np.zeros((2 * LEVELS + 1, LEVELS)), np.zeros(LEVELS))
        nothing = [F.lit(None).cast(t).alias(n) for n, t in (("years", "double"), ("level", "int"), ("easy", "double"), ("middle", "double"), ("hard", "double"))]
        return rows.mapInArrow(_scored(blank), schema).select("id", "words", *nothing)
    return rows.mapInArrow(_scored(model), schema)
