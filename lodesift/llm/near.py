"""Near-duplicate records: word multisets whose Jaccard similarity reaches a threshold.

A multiset becomes a set by numbering the repetitions of a word, so min-hashing estimates the multiset
similarity without bias. Minima of many universal hashes are banded; records that meet in a band are
compared by a sketch of one bit of each of 128 minima (signature verification), and what passes is
compared exactly by words. Records with the same word sequence are one class from the start, so a text
repeated any number of times takes part once.

Bands are shuffled once and met in sorted order. A bucket of more records than ``most`` isn't compared: its
records get finer keys, of the bucket and of further minima, and meet again by those; unlike records, which
fill such buckets, part there, like ones don't. What three finer rounds can't part is alike, and is compared
whole, in blocks dealt to many tasks.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodesift.sources.tables import join_small, stored

WORDS = re.compile("[a-z0-9]+")
BITS = 128
MERSENNE = np.uint64(2**61 - 1)
MOST_BROADCAST = 200_000


def words_of(*columns: Column) -> Column:
    """The words of the texts one after another, lower-cased, single blanks between: runs of ASCII letters and digits."""
    # Lower-cased when only ASCII is left: lower() would make ASCII letters of a few others.
    return F.trim(F.lower(F.regexp_replace(F.concat_ws(" ", *columns), "[^A-Za-z0-9]+", " ")))


@lru_cache(4)
def _hashes(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**31 - 1, n, dtype=np.uint64), rng.integers(0, 2**61 - 1, n, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Minima:
    """Signatures of word multisets: the least of each universal hash over the words.

    A word's hashes are kept once computed, up to ``keep`` words; then the table starts anew, which
    changes nothing but time.
    """

    def __init__(self, n: int, seed: int = 7, keep: int = 60_000) -> None:
        self.n, self.keep = n, keep
        self.a, self.b = _hashes(n, seed)
        self.rows: dict[tuple[str, int] | str, int] = {}
        self.table = np.zeros((1024, n), np.uint32)

    def _row(self, word: tuple[str, int] | str) -> int:
        row = self.rows.get(word)
        if row is None:
            row = self.rows[word] = len(self.rows)
            if row >= len(self.table):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            text = (word if isinstance(word, str) else f"{word[0]} {word[1]}").encode()
            x = np.uint64(int.from_bytes(blake2b(text, digest_size=8).digest(), "little"))
            low, high = x & np.uint64(0x3FFFFFFF), (x >> np.uint64(30)) & np.uint64(0x3FFFFFFF)
            with np.errstate(over="ignore"):
                h = (self.a * low + self.b + (self.a ^ np.uint64(0x2545F491)) % np.uint64(2**31) * high) % MERSENNE
                self.table[row] = (_mixed(h) >> np.uint64(32)).astype(np.uint32)
        return row

    def of(self, texts: list[str]) -> np.ndarray:
        if len(self.rows) > self.keep:
            self.rows = {}
        indexes = []
        for text in texts:
            seen: dict[str, int] = {}
            row = []
            for w in text.split(" "):
                k = seen.get(w, 0)
                seen[w] = k + 1
                row.append(self._row((w, k) if k else w))
            indexes.append(np.array(row, np.int64))
        sizes = np.array([len(x) for x in indexes])
        out = np.empty((len(texts), self.n), np.uint32)
        order = np.argsort(-sizes, kind="stable")
        for at in range(0, len(order), 128):  # blocks whose signatures stay in the cache
            block = order[at : at + 128]
            longest = sizes[block[0]]
            padded = np.empty((longest, len(block)), np.int64)
            for j, k in enumerate(block):
                x = indexes[k]
                padded[: len(x), j] = x
                padded[len(x) :, j] = x[0]
            live = sizes[block]
            signature = self.table[padded[0]]
            for t in range(1, longest):
                n = int(np.searchsorted(-live, -t, "left"))  # the block is sorted: only texts longer than t
                np.minimum(signature[:n], self.table[padded[t, :n]], out=signature[:n])
            out[block] = signature
        return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """A key for each band: its number above 40 bits that mix the band's minima."""
    n = signatures.shape[1] // rows
    with np.errstate(over="ignore"):
        out = np.empty((len(signatures), n), np.int64)
        for k in range(n):
            h = np.full(len(signatures), k + 1, np.uint64)
            for j in range(k * rows, (k + 1) * rows):
                h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + signatures[:, j].astype(np.uint64))
            out[:, k] = (np.uint64(k) << np.uint64(40) | h >> np.uint64(24)).astype(np.int64)
    return out


def sketch_bits(signatures: np.ndarray) -> np.ndarray:
    """Two 64-bit words of the lowest bits of the first 128 minima."""
    return np.packbits((signatures[:, :BITS] & 1).astype(np.uint8), axis=1).view(np.int64)


MET = "band BIGINT, id BIGINT, s0 BIGINT, s1 BIGINT"


def _keyed(keys: np.ndarray, ids: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    """A row for each key of each record."""
    n = keys.shape[1]
    return pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *[pa.array(np.repeat(x, n)) for x in (ids, bits[:, 0], bits[:, 1])]], names=["band", "id", "s0", "s1"])


def _banded(bands: int, rows: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(max(bands * rows, BITS))
        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for at in range(0, len(texts), 1000):
                signatures = minima.of(texts[at : at + 1000])
                yield _keyed(band_keys(signatures[:, : bands * rows], rows), ids[at : at + 1000], sketch_bits(signatures))

    return run


FINER_KEYS, FINER_ROWS, FINER_ROUNDS = 18, 4, 3  # keys a record gets in a crowded bucket, their minima, how often
BAND = np.int64(40)  # bits below a band's number


def _finer(bands: int, rows: int, level: int):  # noqa: ANN202
    """Records with the crowded keys they lie in (id, words, keys): the finer keys of each."""
    total = max(bands * rows, BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(total)
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(2)
            owner, key = np.repeat(np.arange(len(keys)), np.asarray(keys.value_lengths())), np.asarray(keys.flatten())
            signatures = minima.of(batch.column(1).to_pylist())
            bits, ids = sketch_bits(signatures), np.asarray(batch.column(0))
            band = key >> BAND
            # Minima behind those of the band, others in each round.
            first = (band + 1) * rows + level * FINER_KEYS * FINER_ROWS
            out = np.empty((len(key), FINER_KEYS), np.int64)
            with np.errstate(over="ignore"):
                for k in range(FINER_KEYS):
                    h = _mixed(key.astype(np.uint64) + np.uint64(k + 1))
                    for j in range(FINER_ROWS):
                        at = (first + k * FINER_ROWS + j) % total
                        h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + signatures[owner, at].astype(np.uint64))
                    out[:, k] = (band.astype(np.uint64) << np.uint64(BAND) | h >> np.uint64(64 - BAND)).astype(np.int64)
            yield _keyed(out, ids[owner], bits[owner])

    return run


def _meet(most: int | None, allowed: int):  # noqa: ANN202
    """Rows sorted by key: the pairs ``a`` < ``b`` of a key whose sketches differ in no more than ``allowed`` bits.

    Of a key with more than ``most`` rows come its records instead, as ``a`` with no ``b``, each with the key.
    """

    def pairs(ids: np.ndarray, s: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> pa.RecordBatch:
        found = [np.zeros((0, 2), np.int64)]

        def compare(x: np.ndarray, y: np.ndarray) -> None:
            near = np.bitwise_count(s[x, 0] ^ s[y, 0]) + np.bitwise_count(s[x, 1] ^ s[y, 1]) <= allowed
            a, b = ids[x[near]], ids[y[near]]
            found.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1)[a != b])

        for m in range(2, 9):  # all small runs of a size at once, larger ones one by one
            at = starts[sizes == m]
            if len(at):
                i, j = np.triu_indices(m, 1)
                compare((at[:, None] + i).ravel(), (at[:, None] + j).ravel())
        for at, m in zip(starts[sizes > 8], sizes[sizes > 8]):
            i, j = np.triu_indices(m, 1)
            compare(at + i, at + j)
        pair = np.concatenate(found)
        return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), pa.nulls(len(pair), pa.int64())], names=["a", "b", "band"])

    def crowd(ids: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.nulls(len(ids), pa.int64()), pa.array(keys)], names=["a", "b", "band"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # the last key's rows so far
        crowded = None  # a key known to be crowded

        def settled(columns: list[np.ndarray], open_: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, crowded
            keys, ids = columns[0], columns[1]
            if crowded is not None:
                n = int(np.searchsorted(keys, crowded, "right"))
                if n:
                    yield crowd(ids[:n], keys[:n])
                columns = [c[n:] for c in columns]
                keys, ids = columns[0], columns[1]
            starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            sizes = np.diff(np.append(starts, len(keys)))
            held = [c[:0] for c in columns]
            if open_ and len(starts) and (most is None or sizes[-1] <= most):
                held = [c[starts[-1] :] for c in columns]
                starts, sizes = starts[:-1], sizes[:-1]
            if most is not None and (sizes > most).any():
                rows = np.repeat(sizes > most, sizes)
                yield crowd(ids[: len(rows)][rows], keys[: len(rows)][rows])
                crowded = keys[-1] if open_ and sizes[-1] > most and not len(held[0]) else crowded
                starts, sizes = starts[sizes <= most], sizes[sizes <= most]
            yield pairs(ids, np.stack(columns[2:], 1).view(np.uint64), sizes, starts)

        for batch in batches:
            yield from settled([np.concatenate([h, np.asarray(c)]) for h, c in zip(held, batch.columns)], True)
        yield from settled(held, False)

    return run


def least_agreement(threshold: float, sigmas: float = 3.5) -> int:
    """Bits of the sketch that a pair at the threshold has in common but for a chance of about 1 to 4000."""
    p = (1 + threshold) / 2
    return math.floor(BITS * p - sigmas * math.sqrt(BITS * p * (1 - p)))


def classes(df: DataFrame, id_column: str, words: Column) -> tuple[DataFrame, DataFrame]:
    """Records by word sequence, and what stands for each class.

    The first table has a row for each class: ``id``, its number, ``record``, the least record in it, and
    ``words``. The second has the other records: ``id``, ``first`` (that least record), ``record``. Rows with a
    null id or no words are out. A class is told by two 64-bit hashes of its words; a record delivered with
    two texts is in two classes.
    """
    # Written once: the words are read again for bands and for the exact check.
    rows = stored(df.select(F.col(id_column).cast("bigint").alias("record"), words.alias("words")).withColumn("id", F.monotonically_increasing_id())).filter(F.col("record").isNotNull() & (F.col("words") != ""))
    keyed = rows.select("id", "record", "words", F.xxhash64("words").alias("c0"), F.xxhash64(F.lit(1), "words").alias("c1"))
    several = stored(keyed.groupBy("c0", "c1").agg(F.min(F.struct("record", "id")).alias("head"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    joined = join_small(keyed, several, ["c0", "c1"], "left", several.count(), MOST_BROADCAST)
    heads = joined.filter(F.col("head").isNull() | (F.col("head.id") == F.col("id"))).select("id", "record", "words")
    copies = joined.filter(F.col("head.record") < F.col("record")).select(F.col("head.id").alias("id"), F.col("head.record").alias("first"), "record").distinct()
    return heads, copies


class Bag:
    """The words of a text of single blanks: the different ones, and those that occur more than once."""

    __slots__ = ("n", "once", "again")

    def __init__(self, text: str) -> None:
        words = text.split()
        self.n, self.once = len(words), frozenset(words)
        self.again = {} if len(self.once) == self.n else {w: c for w, c in Counter(words).items() if c > 1}

    def similarity(self, other: Bag) -> float:
        """Words in common over words in either, each as often as it occurs."""
        common = len(self.once & other.once) + sum(min(c, other.again[w]) - 1 for w, c in self.again.items() if w in other.again)
        return common / max(1, self.n + other.n - common)


def multiset_similarity(a: str, b: str) -> float:
    return Bag(a).similarity(Bag(b))


def _alike(a: list[str], b: list[str], threshold: float) -> list[bool]:
    """Which pairs reach the threshold; those whose lengths forbid it aren't compared."""
    bags: dict[str, Bag] = {}

    def bag(text: str) -> Bag:
        found = bags.get(text)
        if found is None:
            found = bags[text] = Bag(text)
        return found

    sizes = ((x.count(" ") + 1, y.count(" ") + 1) for x, y in zip(a, b))
    return [min(n, m) >= threshold * max(n, m) - 1e-9 and bag(x).similarity(bag(y)) >= threshold - 1e-12 for x, y, (n, m) in zip(a, b, sizes)]


def _met(keyed: DataFrame, most: int | None, allowed: int) -> DataFrame:
    """``_meet`` of all keys, each in one place; the number of places keeps to the rows, not to their bytes."""
    here = keyed.repartition(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), "band").sortWithinPartitions("band")
    return stored(here.mapInArrow(_meet(most, allowed), "a BIGINT, b BIGINT, band BIGINT"))


def _candidates(classes: DataFrame, threshold: float, bands: int, rows: int, most: int) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes that meet in a key and whose sketches are near."""
    allowed = BITS - least_agreement(threshold)
    met = _met(classes.select("id", "words").mapInArrow(_banded(bands, rows), MET), most, allowed)
    found = met.filter("b IS NOT NULL").select("a", "b")
    for level in range(FINER_ROUNDS + 1):
        crowds = met.filter("b IS NULL").select(F.col("a").alias("id"), "band")
        if crowds.isEmpty():
            break
        if level < FINER_ROUNDS:
            lists = crowds.groupBy("id").agg(F.collect_list("band").alias("keys"))  # of a record no more than its keys
            met = _met(classes.select("id", "words").join(lists, "id").mapInArrow(_finer(bands, rows, level), MET), most, allowed)
        else:
            met = _met(_dealt(classes, crowds, bands, rows, most), None, allowed)
        found = found.union(met.filter("b IS NOT NULL").select("a", "b"))
    return stored(found.distinct())


def _dealt(classes: DataFrame, crowds: DataFrame, bands: int, rows: int, most: int) -> DataFrame:
    """Crowded buckets cut into blocks of about ``most`` records: a key for each two blocks."""
    blocks = crowds.groupBy("band").agg(F.ceil(F.count("*") / most).alias("n"))
    mine = crowds.join(blocks, "band").withColumn("mine", F.pmod(F.xxhash64("id", "band"), F.col("n")))
    each = mine.select("id", "band", "mine", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("other"))
    keyed = each.select("id", F.xxhash64("band", F.least("mine", "other"), F.greatest("mine", "other")).alias("band"))
    sketches = stored(classes.select("id", "words").join(crowds.select("id").distinct(), "id", "left_semi").mapInArrow(_banded(1, rows), MET)).drop("band")
    return keyed.join(sketches, "id").select("band", "id", "s0", "s1")


def similar_pairs(classes: DataFrame, threshold: float, bands: int = 40, rows: int = 6, most: int = 256) -> DataFrame:
    """Pairs ``a`` < ``b`` of classes (``id``, ``record``, ``words``) of at least ``threshold`` similarity, with ``record_a``, ``record_b``.

    The chance that a pair at the threshold meets in no band is (1 - threshold ** rows) ** bands: 0.7 percent
    for 0.7 by default, and 0.04 percent for 0.75. In a bucket of more than ``most`` records the pair must
    also meet by a finer key, which at 0.7 fails in 0.7 percent of the buckets it shares; the sketch turns
    away a pair at the threshold in 0.02 percent. Every pair given is checked by its words. ``id`` must be
    unique; no bucket is capped.
    """
    candidates = _candidates(classes, threshold, bands, rows, most)
    # Only the words of classes in candidates are moved to the pairs.
    needed = candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct()
    words = classes.select("id", "record", "words").join(needed, "id", "left_semi")
    side = lambda n: words.select(F.col("id").alias(n), F.col("record").alias(f"record_{n}"), F.col("words").alias(f"words_{n}"))
    pairs = candidates.join(side("a"), "a").join(side("b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = _alike(batch.column(4).to_pylist(), batch.column(5).to_pylist(), threshold)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good, pa.bool_()))

    return pairs.select("a", "b", "record_a", "record_b", "words_a", "words_b").mapInArrow(check, "a BIGINT, b BIGINT, record_a BIGINT, record_b BIGINT")


def expand_copies(pairs: DataFrame, copies: DataFrame, most: int = 64) -> DataFrame:
    """Pairs ``a`` < ``b`` of records from pairs of classes; a record is no pair with itself.

    The pairs of a class of up to ``most`` records and of two such classes are all given. A larger class,
    of which all pairs would be too many to give, keeps the short form: its records are paired with its
    first, which alone stands for them in pairs with other texts. ``links`` tells classes and links apart.
    """
    size = copies.groupBy("id").agg((F.count("*") + 1).alias("n"))
    small = copies.join(size.filter(F.col("n") <= most), "id").select("id", "record")
    within = small.alias("x").join(small.alias("y"), "id").filter("x.record < y.record").select(F.col("x.record").alias("a"), F.col("y.record").alias("b"))
    side = lambda n: small.select(F.col("id").alias(n), F.col("record").alias(f"copy_{n}"))
    a = pairs.join(side("a"), "a", "left").select("b", "record_b", F.explode(F.array_compact(F.array("record_a", "copy_a"))).alias("x")).distinct()
    across = a.join(side("b"), "b", "left").select("x", F.explode(F.array_compact(F.array("record_b", "copy_b"))).alias("y"))
    every = across.union(copies.select("first", "record")).union(within)
    return every.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def links(classes: DataFrame, copies: DataFrame, pairs: DataFrame) -> DataFrame:
    """``record``, ``class``, ``copies``, ``links``: for each record its class, named by its first record, and how many it is like.

    ``copies`` counts the records of the class, ``links`` these but one and those of all similar classes. A
    record delivered with two texts has a row for each.
    """
    size = copies.groupBy("id").agg((F.count("*") + 1).alias("copies"))
    both = pairs.select("a", "b").union(pairs.select("b", "a"))
    sizes = size.select(F.col("id").alias("b"), "copies")
    far = both.join(sizes, "b", "left").groupBy(F.col("a").alias("id")).agg(F.sum(F.coalesce("copies", F.lit(1))).alias("far"))
    told = classes.select("id", F.col("record").alias("class")).join(size, "id", "left").join(far, "id", "left")
    told = told.select("id", "class", F.coalesce("copies", F.lit(1)).alias("copies"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("far", F.lit(0))).alias("links"))
    members = classes.select("id", "record").union(copies.select("id", "record"))
    return members.join(told, "id").select("record", "class", "copies", "links")


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``group`` of every node of the edges ``a``, ``b``: the least id it is linked with.

    Alternating large-star and small-star: the large star ties a node's greater neighbours to its
    least neighbour, the small star its lesser ones and itself; each round is written to the shared
    folder. Ends when a round changes no edge; a graph of n nodes takes about log(n) ** 2 rounds.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u > v").distinct()
        now = stored(small)
        seen = now.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    return now.select(F.col("u").alias("id"), F.col("v").alias("group")).union(now.select(F.col("v").alias("id"), F.col("v").alias("group"))).distinct()
