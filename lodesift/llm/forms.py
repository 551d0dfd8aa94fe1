"""Duplicates that differ in form only: white space, letter case, punctuation, order of members.

The bytes of texts stream through a lookup table that folds letters and digits and tells what to skip,
into two rolling polynomial hashes. Texts are walked in blocks of some bytes, all blocks of a batch side
by side, one byte of each at a time; only the states of the hashes are kept, no folded text or array of
folded characters is built, and a text's blocks are then joined by the same recurrence. Rows with equal
hashes are compared by two pointers that skip and fold as they go, so a collision can't join records.

Each Arrow batch keeps one leader for each form it holds. Only hashes are shuffled to find those that
several leaders share; the texts of these leaders alone move, sorted by hash, and of a form only its
texts are in memory. The ids of copies stay out of that: they find their form's first id by their leader.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.sources.tables import join_small, stored

PRIME = np.uint64(2**31 - 1)
BASES = np.array([1_000_003, 69_069_069], np.uint64)  # below 2**30, so that a state below 2**32 has room
BITS = np.uint64(31)
BLOCK = 48  # bytes
MOST_BROADCAST = 500_000


@lru_cache(1)
def fold_table() -> np.ndarray:
    """For each code point the up to three it folds to, 0 for none; all 0 if it is skipped.

    Letters and digits are the Unicode classes L and N; folding is Unicode's full case folding, so
    that a sharp s and its capital form ``SS`` meet.
    """
    table = np.zeros((3, 0x110000), np.uint32)
    for code in range(0x110000):
        c = chr(code)
        if unicodedata.category(c)[0] in "LN":
            folded = [ord(x) for x in c.casefold() if unicodedata.category(x)[0] in "LN"]
            table[: len(folded), code] = folded
    return table


def _composed(text: str) -> str:
    """``text``, composed if it has combining marks."""
    return text if text.isascii() or not any(unicodedata.combining(c) for c in text) else unicodedata.normalize("NFC", text)


def _rolled(states: np.ndarray, at: np.ndarray, values: np.ndarray, kept: np.ndarray) -> None:
    """One step of both recurrences, h = h * base + value, for the blocks ``at``."""
    for h, base in zip(states, BASES):
        x = h[at] * base + values
        h[at] = (x & PRIME) + (x >> BITS)  # below 2**32
    kept[at] += 1


def _walk(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The states of both hashes and the number of letters and digits of the blocks ``start`` to ``end``."""
    table = fold_table()
    plain = np.where(np.arange(256) < 128, table[0, :256], 0).astype(np.uint64)
    states, kept = np.zeros((2, len(start)), np.uint64), np.zeros(len(start), np.int64)
    order = np.argsort(start - end, kind="stable")  # the longest first: those still open are a prefix
    start, longest = start[order], (end - start)[order]
    code, more = np.zeros(len(start), np.uint32), np.zeros(len(start), np.int8)  # of a character of several bytes
    for step in range(int(longest[0]) if len(longest) else 0):
        n = int(np.searchsorted(-longest, -step, "left"))
        b = data[start[:n] + step]
        values = plain[b]
        at = np.flatnonzero(values)
        _rolled(states, at, values[at], kept)
        wide = np.flatnonzero(b & 128)
        if len(wide):
            w = b[wide]
            goes_on = w < 192
            lead = np.where(w >= 240, w & 7, np.where(w >= 224, w & 15, w & 31))
            code[wide] = np.where(goes_on, code[wide] << 6 | (w & 63), lead)
            more[wide] = np.where(goes_on, more[wide] - 1, np.where(w >= 240, 3, np.where(w >= 224, 2, 1)))
            done = wide[more[wide] == 0]
            for folded in table[:, code[done]].astype(np.uint64):
                some = np.flatnonzero(folded)
                if not len(some):
                    break
                _rolled(states, done[some], folded[some], kept)
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return states[:, back], kept[back]


def _power(base: np.uint64, most: int) -> np.ndarray:
    out = np.ones(most + 1, np.uint64)
    for k in range(1, most + 1):
        out[k] = out[k - 1] * base % PRIME
    return out


def form_hashes(texts: list[tuple[str, ...]]) -> np.ndarray:
    """A 62-bit hash of each tuple of texts; equal if the letters and digits of each text are."""
    if not texts:
        return np.zeros(0, np.int64)
    parts = [p.encode("utf-8", "replace") for t in texts for p in t]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    data = np.frombuffer(b"".join(parts) + b"\0", np.uint8)
    first = np.cumsum(size) - size
    blocks = -(-size // BLOCK)
    owner = np.repeat(np.arange(len(parts)), blocks)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    start = first[owner] + place * BLOCK
    for _ in range(3):  # no block begins within a character
        start += (data[start] & 192 == 128) & (start < (first + size)[owner])
    end = np.append(start[1:], len(data) - 1)
    last = np.append(owner[1:] != owner[:-1], True) if len(owner) else np.zeros(0, bool)
    end[last] = (first + size)[owner[last]]
    states, kept = _walk(data, start, end)
    whole, n = np.zeros((2, len(parts)), np.uint64), np.bincount(owner, kept, len(parts)).astype(np.int64)
    powers = [_power(b, int(kept.max(initial=0))) for b in BASES]
    by_place = np.argsort(place, kind="stable")
    edges = np.searchsorted(place[by_place], np.arange(int(blocks.max(initial=0)) + 1))
    for a, b in zip(edges, edges[1:]):  # every text's first block, then every second one, and so on
        at = by_place[a:b]
        for h, power, state in zip(whole, powers, states):
            h[owner[at]] = (h[owner[at]] * power[kept[at]] + state[at]) % PRIME
    width, halves = len(texts[0]), []
    for h, base in zip(whole, BASES):
        each = (h % PRIME * np.uint64(257) + n.astype(np.uint64)) % PRIME
        out = np.zeros(len(texts), np.uint64)
        for k in range(width):
            out = (out * (base + np.uint64(2)) + each[k::width] + np.uint64(1)) % PRIME
        halves.append(out)
    return (halves[0] << BITS | halves[1]).astype(np.int64)


@lru_cache(100_000)
def _folded(c: str) -> str:
    return "".join(chr(x) for x in fold_table()[:, ord(c)] if x)


def same_form(a: str, b: str) -> bool:
    """Whether two texts have the same letters and digits in order: two pointers that skip and fold."""
    if a == b:
        return True
    i = j = 0
    rest_a = rest_b = ""
    while True:
        while not rest_a and i < len(a):
            rest_a, i = _folded(a[i]), i + 1
        while not rest_b and j < len(b):
            rest_b, j = _folded(b[j]), j + 1
        if not rest_a or not rest_b:
            return rest_a == rest_b
        if rest_a[0] != rest_b[0]:
            return False
        rest_a, rest_b = rest_a[1:], rest_b[1:]


def _as_text(value: object) -> str:
    return "" if value is None else _composed(value) if isinstance(value, str) else json.dumps(value, sort_keys=True)


def _no_constant(name: str) -> None:
    raise ValueError(name)


def json_members(members: list[str], wrapper: str | None = None) -> Callable[[str | None], tuple[str, ...] | None]:
    """A reader of JSON records: gives the texts of ``members``, or None if it is no complete record.

    A record is an object, a list of one object, or an object whose member ``wrapper`` is such a list.
    Names of members are read without case. A missing or null member is an empty text; one that is no
    text counts by its JSON form.
    """

    def read(payload: str | None) -> tuple[str, ...] | None:
        try:
            record = json.loads(payload, parse_constant=_no_constant) if payload else None
        except (ValueError, RecursionError):
            return None
        for _ in range(2):
            if isinstance(record, list):
                record = record[0] if len(record) == 1 else None
            if isinstance(record, dict) and wrapper:
                inner = next((v for k, v in record.items() if k.lower() == wrapper), None)
                if isinstance(inner, list):
                    record = inner
        if isinstance(record, list):
            record = record[0] if len(record) == 1 else None
        if not isinstance(record, dict):
            return None
        named = {}
        for k, v in record.items():
            named.setdefault(k.lower(), v)
        return tuple(_as_text(named.get(m)) for m in members)

    return read


def _lead(read: Callable[[object], tuple[str, ...] | None] | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            if read is None:
                rows = list(zip(*[[_as_text(v) for v in batch.column(k).to_pylist()] for k in range(1, batch.num_columns)]))
            else:
                rows = [read(v) for v in batch.column(1).to_pylist()]
            there = [k for k, (i, r) in enumerate(zip(ids, rows)) if r is not None and i is not None]
            hashes = form_hashes([rows[k] for k in there]).tolist()
            found: dict[int, list[list]] = {}
            for k, h in zip(there, hashes):
                for leader in found.setdefault(h, []):
                    if all(map(same_form, leader[0], rows[k])):
                        leader[1].append(ids[k])
                        break
                else:
                    found[h].append([rows[k], [ids[k]]])
            flat = [(h, min(m), list(t), m) for h, leaders in found.items() for t, m in leaders]
            columns = list(zip(*flat)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64())))], names=["h", "id", "texts", "copies"])

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Leaders sorted by hash and id (h, id, leader, texts): gives each but the first of a form that one's id."""
    now, forms = None, []
    for batch in batches:
        rows = []
        for h, i, leader, texts in zip(*[c.to_pylist() for c in batch.columns]):
            if h != now:
                now, forms = h, []
            first = next((f for t, f in forms if all(map(same_form, t, texts))), None)
            if first is None:
                forms.append((texts, i))
            else:
                rows.append((leader, first))
        columns = list(zip(*rows)) or [[], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["leader", "first"])


def collapse_forms(df: DataFrame, id_column: str, columns: list[str], read: Callable[[object], tuple[str, ...] | None] | None = None) -> DataFrame:
    """``first``, ``id``: every record with the lowest id of its form.

    The form is that of the texts in ``columns``, or of what ``read`` makes of the single column. Rows
    with a null id, or of which ``read`` makes nothing, are out; null texts count as empty ones, so
    records without any letter or digit are copies of each other. A repeated id gives a row each time.
    Very long texts are hashed and compared whole. An empty table gives no row; other columns are ignored.
    """
    found = df.select(F.col(id_column).cast("bigint"), *columns).mapInArrow(_lead(read), "h BIGINT, id BIGINT, texts ARRAY<STRING>, copies ARRAY<BIGINT>")
    leaders = stored(found.withColumn("leader", F.monotonically_increasing_id()))
    shared = stored(leaders.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"))
    together = join_small(leaders.select("h", "id", "leader", "texts"), shared, ["h"], "left_semi", shared.count(), MOST_BROADCAST)
    ordered = together.repartition("h").sortWithinPartitions("h", "id")
    later = stored(ordered.mapInArrow(_settle, "leader BIGINT, first BIGINT"))
    told = join_small(leaders.select("leader", "id", "copies"), later, ["leader"], "left", later.count(), MOST_BROADCAST)
    return told.select(F.coalesce("first", "id").alias("first"), F.explode("copies").alias("id"))


def form_copies(collapsed: DataFrame) -> DataFrame:
    """``first``, ``id``: every record but the first of its form."""
    return collapsed.filter(F.col("id") != F.col("first")).distinct()


def form_counts(collapsed: DataFrame) -> DataFrame:
    """``first``, ``copies``: one row for each form with its number of rows."""
    return collapsed.groupBy("first").agg(F.count("*").alias("copies"))
