"""Best representative of each duplicate group, field by field, by token-level consensus.

A group's different values of a field are put in order, the weightiest first, and aligned progressively:
each joins a profile of columns, anchored at the tokens both have in the same order, with what lies
between anchors set against each other. Blocks of values that follow each other are aligned first, then
the blocks' profiles, up a tree that depends on the order alone. Each value votes in every column for its
token, or for a gap, with its weight; votes add up, the winners of the columns are the consensus, and the
existing value closest to it is given, of equally close ones that of the record first in precedence.

Weights are whole numbers, so sums don't depend on the order of rows. By default they are those of the
records. Where precedence must decide alone, a value's weight comes from its rank in the group, each
greater than all those behind it together: the first one outvotes the rest in every column.

Most groups are settled where their rows meet. Those of more than ``heavy_rows`` rows climb the same tree
in stages, a block a task at a time, and are searched for the closest value where the values lie; no task
holds such a group, and the result is the same whatever ``heavy_rows`` is.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.operators.order import with_place
from lodesift.sources.tables import join_small, stored

TOKEN = re.compile(r"\w+|[^\w\s]")
MOST_BROADCAST = 10_000
MOST_GOAL_BYTES = 64 << 20
BLOCK = 64  # values, or profiles, that one step of the tree aligns


def tokens(value: str) -> list[str]:
    return TOKEN.findall(value)


def _chain(profile: dict[str, list[int]], row: list[str]) -> list[tuple[int, int]]:
    """The longest chain of pairs (column, position) with equal tokens, rising in both (Hunt and Szymanski)."""
    ends: list[int] = []
    links: list[tuple] = []
    for j, t in enumerate(row):
        for i in reversed(profile.get(t, ())):
            k = bisect_left(ends, i)
            link = (i, j, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(i)
                links.append(link)
            else:
                ends[k] = i
                links[k] = link
    out, link = [], links[-1] if links else None
    while link:
        out.append(link[:2])
        link = link[2]
    return out[::-1]


class Profile:
    """Aligned values: for each column the weight of each token, None standing for a gap."""

    def __init__(self, row: list[str], weight: int) -> None:
        self.columns: list[dict[str | None, int]] = [{t: weight} for t in row]
        self.total = weight

    def _places(self) -> dict[str, list[int]]:
        places: dict[str, list[int]] = {}
        for i, c in enumerate(self.columns):
            for t in c:
                if t is not None:
                    places.setdefault(t, []).append(i)
        return places

    def merge(self, other: Profile) -> None:
        """Aligns another profile; its columns are matched by their strongest tokens."""
        mine, theirs, out = self.columns, other.columns, []
        i = j = 0
        for at, to in [*_chain(self._places(), other.strongest()), (len(mine), len(theirs))]:
            while i < at and j < to:
                out.append(_added(mine[i], theirs[j]))
                i, j = i + 1, j + 1
            while i < at:
                out.append(_added(mine[i], {None: other.total}))
                i += 1
            while j < to:
                out.append(_added(theirs[j], {None: self.total}))
                j += 1
            if at < len(mine) and to < len(theirs):
                out.append(_added(mine[at], theirs[to]))
                i, j = at + 1, to + 1
        self.columns, self.total = out, self.total + other.total

    def strongest(self) -> list[str]:
        """Of each column its strongest token, even if a gap is stronger."""
        return [max((t for t in c if t is not None), key=lambda t: (c[t], t)) for c in self.columns]

    def consensus(self) -> list[str]:
        """The winning tokens; a token wins over a gap of the same weight."""
        winners = (max(c, key=lambda t: (c[t], t is not None, t or "")) for c in self.columns)
        return [t for t in winners if t is not None]


def _added(votes: dict[str | None, int], more: dict[str | None, int]) -> dict[str | None, int]:
    for t, w in more.items():
        votes[t] = votes.get(t, 0) + w
    return votes


def aligned(profiles: Iterable[Profile]) -> Profile:
    """One profile of several, neighbours first: those of as many members are merged."""
    done: list[tuple[int, Profile]] = []  # falling numbers of members
    for profile in profiles:
        members = 1
        while done and done[-1][0] <= members:
            before, left = done.pop()
            left.merge(profile)
            profile, members = left, members + before
        done.append((members, profile))
    _, out = done.pop()
    while done:
        _, left = done.pop()
        left.merge(out)
        out = left
    return out


def tree(profiles: list[Profile]) -> Profile:
    """The profile of all: block by block, then the blocks' profiles, until one is left."""
    while len(profiles) > 1:
        profiles = [aligned(profiles[k : k + BLOCK]) for k in range(0, len(profiles), BLOCK)]
    return profiles[0]


def distance(a: list[str], b: list[str]) -> int:
    """Tokens to delete and insert to make one of the other."""
    if a == b:
        return 0
    places: dict[str, list[int]] = {}
    for i, t in enumerate(a):
        places.setdefault(t, []).append(i)
    return len(a) + len(b) - 2 * len(_chain(places, b))


class Value(NamedTuple):
    """A different value of a group: its best precedence (least first, ending with the record id) and weight."""

    text: str
    first: tuple[int, int, int]
    weight: int


def by_rank(rank: int) -> int:
    """The weight of a rank, from 0: greater than that of all ranks behind it together.

    From rank 63 on it is 0: the first value votes in every column and outweighs the rest, so what is
    left to those can't count.
    """
    return 1 << 62 - rank if rank < 63 else 0


def in_order(values: Iterable[Value], precedence: bool) -> list[Value]:
    """A group's values in the order of alignment, with the weights they vote with."""
    if precedence:
        return [v._replace(weight=by_rank(k)) for k, v in enumerate(sorted(values, key=lambda v: (v.first, v.text)))]
    return sorted(values, key=lambda v: (-v.weight, v.first, v.text))


def settle(values: Iterable[Value], precedence: bool = False) -> Value:
    """The value that is closest to the consensus of all."""
    ordered = in_order(values, precedence)
    if len(ordered) == 1:
        return ordered[0]
    rows = [tokens(v.text) for v in ordered]
    goal = tree([Profile(row, v.weight) for row, v in zip(rows, ordered)]).consensus()
    return min(zip(rows, ordered), key=lambda x: (distance(x[0], goal), x[1].first, x[1].text))[1]


RANK = "trust"
AT = "at"
OUT = "key STRING, field_name STRING, id BIGINT, value STRING"


def _out(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string()))], names=["key", "field_name", "id", "value"])


def _light(fields: list[str], precedence: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by key and id: settles one group of at least two ids after the other."""

    def group(key: str, values: list[dict[str, Value]]) -> Iterator[tuple]:
        for f, found in zip(fields, values):
            if found:
                won = settle(found.values(), precedence)
                yield key, f, -won.first[2], won.text

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, one, several, held = None, None, False, []
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("key", "id", RANK, AT, "weight", *fields)]
            out = []
            for key, i, trust, at, weight, *texts in zip(*columns):
                if key != now:
                    out += group(now, held) if several else ()
                    now, one, several, held = key, i, False, [{} for _ in fields]
                several = several or i != one
                first = (trust, -at, -i)
                for found, text in zip(held, texts):
                    if text is not None:
                        known = found.get(text)
                        found[text] = Value(text, min(first, known.first), weight + known.weight) if known else Value(text, first, weight)
            yield _out(out)
        if several:
            yield _out(list(group(now, held)))

    return run


PARTS = "key STRING, field_name STRING, place BIGINT, profile BINARY"


def _step(read: Callable[[object, int], Profile]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Members sorted by group and place (key, field_name, place, member, weight): a profile for each block of places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def given() -> pa.RecordBatch:
            profile = aligned(held)
            data = pickle.dumps((profile.columns, profile.total))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*now, data), (pa.string(), pa.string(), pa.int64(), pa.binary()))], names=["key", "field_name", "place", "profile"])

        for batch in batches:
            for key, f, place, member, weight in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, f, place // BLOCK) != now:
                    if held:
                        yield given()
                    now, held = (key, f, place // BLOCK), []
                held.append(read(member, weight))
        if held:
            yield given()

    return run


def _unpacked(data: bytes, _: int) -> Profile:
    profile = Profile([], 0)
    profile.columns, profile.total = pickle.loads(data)
    return profile


def _far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        far = [distance(tokens(v), g) for v, g in zip(batch.column("value").to_pylist(), batch.column("goal").to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(n) for n in ("key", "field_name", "value", "first")] + [pa.array(far, pa.int64())], names=["key", "field_name", "value", "first", "far"])


def _goals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        goals = pa.array([_unpacked(p, 0).consensus() for p in batch.column("profile").to_pylist()], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("field_name"), goals], names=["key", "field_name", "goal"])


def best_values(df: DataFrame, fields: list[str], precedence: bool = False, heavy_rows: int = 5_000) -> DataFrame:
    """``key``, ``field_name``, ``id``, ``value``: for each key and field the surviving value and its record.

    ``df`` has ``key``, ``id`` (BIGINT), ``trust`` (the least is best), ``at`` (BIGINT, the greatest is
    best), ``weight`` (BIGINT, unused with ``precedence``) and the fields as text, null where a record has
    no value. Precedence is by trust, then time, then the highest id; null trust or time comes last. The
    record of a value is that first in precedence.

    Keys with fewer than two different ids, null keys and null ids give no row, nor does a field for
    which no record has a value. A repeated row votes again, which changes nothing with ``precedence``.
    A null weight counts 0. Very long values are aligned whole. Other columns are ignored.
    """
    rows = df.select("key", F.col("id").cast("bigint").alias("id"), F.coalesce(F.col(RANK).cast("bigint"), F.lit(2**53)).alias(RANK), F.coalesce(F.col(AT).cast("bigint"), F.lit(-(2**53))).alias(AT), F.coalesce(F.col("weight").cast("bigint"), F.lit(0)).alias("weight"), *fields)
    rows = rows.filter(F.col("key").isNotNull() & F.col("id").isNotNull())
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"))
    heavy = stored(groups.filter((F.col("n") > heavy_rows) & (F.col("lo") < F.col("hi"))).select("key"))
    n_heavy = heavy.count()
    light = rows if not n_heavy else join_small(rows, heavy, ["key"], "left_anti", n_heavy, MOST_BROADCAST)
    out = light.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_light(fields, precedence), OUT)
    if n_heavy:
        out = out.union(_heavy(join_small(rows, heavy, ["key"], "left_semi", n_heavy, MOST_BROADCAST), fields, precedence))
    return out


def _heavy(rows: DataFrame, fields: list[str], precedence: bool) -> DataFrame:
    first = F.struct(RANK, (-F.col(AT)).alias(AT), (-F.col("id")).alias("id"))
    long = rows.select("key", first.alias("first"), "weight", F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in fields])).alias("_f"))
    group = ["key", "field_name"]
    # Equal values are one before anything is shuffled.
    values = long.select("key", "first", "weight", "_f.*").filter(F.col("value").isNotNull()).groupBy(*group, "value").agg(F.min("first").alias("first"), F.sum("weight").alias("weight"))
    order = ["first", "value"] if precedence else ["_down", "first", "value"]
    placed = stored(with_place(values.withColumn("_down", -F.col("weight")), [*group, *order], "place").drop("_down"))
    starts = stored(placed.groupBy(*group).agg(F.min("place").alias("start")))
    n = starts.count()
    numbered = join_small(placed, starts, group, "inner", n, MOST_BROADCAST).withColumn("place", F.col("place") - F.col("start"))
    weight = F.expr("IF(place < 63, shiftleft(1L, CAST(62 - place AS INT)), 0L)") if precedence else F.col("weight")
    members, read = numbered.select(*group, "place", "value", weight.cast("bigint").alias("weight")), lambda text, w: Profile(tokens(text), w)
    while True:
        blocks = members.repartition(*group, F.floor(F.col("place") / BLOCK)).sortWithinPartitions(*group, "place")
        profiles = stored(blocks.mapInArrow(_step(read), PARTS))
        if not profiles.agg(F.max("place")).first()[0]:
            break
        members, read = profiles.select(*group, "place", "profile", F.lit(0).cast("bigint").alias("weight")), _unpacked
    goals = stored(profiles.mapInArrow(_goals, "key STRING, field_name STRING, goal ARRAY<STRING>"))
    size = goals.agg(F.sum(F.octet_length(F.array_join("goal", " ")))).first()[0] or 0
    near = join_small(placed.select(*group, "value", "first"), goals, group, "inner", n if size <= MOST_GOAL_BYTES else MOST_BROADCAST + 1, MOST_BROADCAST)
    kind = placed.schema["first"].dataType.simpleString()
    far = near.mapInArrow(_far, f"key STRING, field_name STRING, value STRING, first {kind}, far BIGINT")
    # Partial aggregation settles each batch where it lies.
    best = far.groupBy(*group).agg(F.min(F.struct("far", "first", "value")).alias("_b"))
    return best.select(*group, (-F.col("_b.first.id")).alias("id"), "_b.value")
