"""Filling containers of fixed capacity with whole texts, by multiway differencing.

Items are dealt at random to groups that fill about ``windows`` containers each; a group is packed by
one task. There Karmarkar and Karp's differencing merges partial partitions, the one with the greatest
imbalance with the next, the fullest windows of one meeting the emptiest of the other, until one
partition of near-equal windows is left. Windows that come out filled to the brim stay as they are; the
items of the others are differenced anew, into as few windows as they may need, with a little more room
allowed each time. What is left at the end is differenced into the least number of windows that none
exceeds the capacity, searched from the lower bound upwards. Windows of few items, which differencing
leaves unevenly filled, are then parted anew two by two, one as full as can be, until the emptier ones
are used up.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodesift.sources.tables import join_small, stored

MOST_BROADCAST = 100_000
PIECES = 64  # items below a 64th of the capacity are bundled before they are packed


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, of ``k``, of each item, windows being as equal as differencing makes them."""
    n = len(sizes)
    if k >= n:
        return np.arange(n)
    # A partial partition: its windows' sums in rising order, and the items of each; windows that are
    # empty come first and are not stored.
    heap = [(-int(s), i, [int(s)], [[i]]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = n
    while len(heap) > 1:
        _, _, a_sums, a_items = heapq.heappop(heap)
        _, _, b_sums, b_items = heapq.heappop(heap)
        cut = k - len(a_sums)  # windows that only b fills
        if len(b_sums) > cut:
            # The fullest windows of b meet the emptiest of a.
            b_sums, b_items = b_sums[::-1], b_items[::-1]
            more = len(b_sums) - cut
            sums = b_sums[:cut] + [x + y for x, y in zip(a_sums, b_sums[cut:])] + a_sums[more:]
            items = b_items[:cut] + [x + y for x, y in zip(a_items, b_items[cut:])] + a_items[more:]
        else:
            sums, items = a_sums + b_sums, a_items + b_items
        order = sorted(range(len(sums)), key=sums.__getitem__)
        sums, items = [sums[j] for j in order], [items[j] for j in order]
        spread = sums[-1] - (sums[0] if len(sums) == k else 0)
        tie += 1
        heapq.heappush(heap, (-spread, tie, sums, items))
    out = np.zeros(n, np.int64)
    for w, it in enumerate(heap[0][3]):
        out[it] = w
    return out


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Windows that any packing needs: by the sum, and by items too large to share (Martello and Toth)."""
    s = np.sort(sizes)
    total = np.concatenate([[0], np.cumsum(s)])
    mid, best = int(np.searchsorted(s, capacity // 2, "right")), -(-int(total[-1]) // capacity)
    at_least = np.unique(s[:mid])  # every size up to half a window, as the least item that counts
    if len(at_least):
        high, low = np.searchsorted(s, capacity - at_least, "right"), np.searchsorted(s, at_least, "left")
        room = (high - mid) * capacity - (total[high] - total[mid])
        best = max(best, int((len(s) - mid + np.maximum(0, -(-(total[mid] - total[low] - room) // capacity))).max()))
    return max(best, len(s) - mid, 1 if len(s) else 0)


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The window of each item, none fuller than ``capacity``, with as few windows as differencing fits."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    small = sizes * PIECES < capacity
    bundle = np.arange(len(sizes))
    if small.sum() > 1:
        at = np.flatnonzero(small)
        filled = np.cumsum(sizes[at])
        number = (filled - sizes[at]) // max(1, capacity // PIECES)
        first = np.concatenate([[True], number[1:] != number[:-1]])
        bundle[at] = at[first][np.cumsum(first) - 1]
    heads, bundle = np.unique(bundle, return_inverse=True)
    units = np.bincount(bundle, weights=sizes).astype(np.int64)

    return _squeezed(_windows(units, capacity), units, capacity)[bundle]


def _windows(units: np.ndarray, capacity: int, slack: float = 0.01, growth: float = 1.6, most_slack: float = 0.12) -> np.ndarray:
    """Windows of items of any size: brimful ones are kept, the others' items go round again."""
    out, left, used = np.zeros(len(units), np.int64), np.arange(len(units)), 0
    while len(left) > 5 and slack <= most_slack:
        sizes = units[left]
        windows = differencing(sizes, lower_bound(sizes, capacity))
        sums = np.bincount(windows, weights=sizes)
        fits = sums <= capacity
        keep = (fits if fits.all() else fits & (sums >= capacity * (1 - slack)))[windows]
        if keep.any():
            numbers, windows = np.unique(windows[keep], return_inverse=True)
            out[left[keep]] = used + windows
            used, left = used + len(numbers), left[~keep]
        if keep.mean() < 0.1:
            slack *= growth
    if len(left):
        out[left] = used + _fewest(units[left], capacity)
    return out


def _fullest(sizes: list[int], capacity: int) -> tuple[int, int]:
    """The greatest sum of a choice of sizes up to ``capacity``, and the choice as bits."""
    sums = {0: 0}
    for k, x in enumerate(sizes):
        for s, bits in [*sums.items()]:
            if s + x <= capacity and s + x not in sums:
                sums[s + x] = bits | 1 << k
    best = max(sums)
    return best, sums[best]


def _squeezed(windows: np.ndarray, units: np.ndarray, capacity: int, most_items: int = 10) -> np.ndarray:
    """Fewer windows: the emptiest gives its items to the others, of which each takes the choice that fills it best.

    Two windows of more than ``most_items`` items together are left alone.
    """
    n = int(windows.max()) + 1
    if len(units) > n * most_items / 2:
        return windows
    held: list[list[int]] = [[] for _ in range(n)]
    for k, w in enumerate(windows.tolist()):
        held[w].append(k)
    sums = np.bincount(windows, weights=units, minlength=n).astype(np.int64)
    size = units.tolist()
    while sum(map(bool, held)) > 1:
        open_ = min((w for w in range(n) if held[w]), key=lambda w: (sums[w], w))
        gained = True
        while held[open_] and gained:
            gained = False
            for w in sorted((w for w in range(n) if w != open_ and held[w] and sums[w] < capacity), key=lambda w: (sums[w], w)):
                items = held[w] + held[open_]
                if len(items) > most_items:
                    continue
                best, bits = _fullest([size[k] for k in items], capacity)
                if best > sums[w]:
                    held[w], held[open_] = [k for j, k in enumerate(items) if bits >> j & 1], [k for j, k in enumerate(items) if not bits >> j & 1]
                    sums[open_] -= best - sums[w]
                    sums[w] = best
                    gained = True
                    if not held[open_]:
                        break
        if held[open_]:
            break  # no window takes any more of the emptiest
    out = np.zeros(len(units), np.int64)
    for number, h in enumerate(h for h in held if h):
        out[h] = number
    return out


def _fewest(units: np.ndarray, capacity: int) -> np.ndarray:
    """The least number of windows for which no window of the differencing exceeds the capacity."""

    def fits(k: int) -> np.ndarray | None:
        windows = differencing(units, k)
        return windows if np.bincount(windows, weights=units).max() <= capacity else None

    k = low = lower_bound(units, capacity)
    step, found = 1, fits(k)
    while found is None:
        low = k + 1
        k = min(len(units), k + step)
        step *= 2
        found = fits(k)
    high = k
    while low < high:  # between the last that failed and the first that fits
        mid = (low + high) // 2
        got = fits(mid)
        if got is None:
            low = mid + 1
        else:
            high, found = mid, got
    return found


def fill_containers(items: DataFrame, targets: DataFrame, windows: int = 96) -> DataFrame:
    """Containers of every kind: ``container_kind``, ``container_id``, ``id``, ``part``, ``token_from``, ``tokens``.

    ``items`` has ``id`` and ``tokens``; ``targets`` has ``container_kind`` and ``capacity_tokens``, a
    table of a few rows. A text longer than a capacity is cut into full containers of that kind and a
    last part, which is packed like any text; all others stay whole. Texts without tokens, null sizes
    and kinds without a positive capacity give no row. Repeated ids are separate items; the names of
    containers that one part fills tell them apart by a number.
    """
    sizes = items.filter(F.col("tokens") > 0).select("id", "tokens")
    kinds = targets.filter(F.col("capacity_tokens") > 0).select("container_kind", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct().collect()  # a row for each kind
    each = F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in sorted(kinds)]) if kinds else F.expr("CAST(array() AS ARRAY<STRUCT<container_kind: STRING, capacity: BIGINT>>)")
    least = min((c for _, c in kinds), default=0)
    long = sizes.filter(F.col("tokens") >= least)  # only these fill containers of their own
    again = stored(long.groupBy(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("_name")).agg(F.count("*").alias("_n")).filter("_n > 1"))
    named = join_small(sizes.withColumn("_name", F.coalesce(F.col("id").cast("string"), F.lit(""))), again, ["_name"], "left", again.count(), MOST_BROADCAST)
    item = F.when(F.col("_n").isNull(), F.col("_name")).otherwise(F.concat_ws("-", F.col("_name"), F.monotonically_increasing_id().cast("string")))
    wanted = named.select("id", item.alias("_item"), "tokens", F.explode(each).alias("_k")).select("id", "_item", "tokens", "_k.*")
    n = F.floor((F.col("tokens") - 1) / F.col("capacity"))  # full parts in front of the last
    parts = wanted.select("container_kind", "capacity", "id", "_item", "tokens", F.explode(F.sequence(F.lit(0), n)).alias("part"))
    parts = parts.select("container_kind", "capacity", "id", "_item", F.col("part").cast("int").alias("part"), (F.col("part") * F.col("capacity")).alias("token_from"), F.least("capacity", F.col("tokens") - F.col("part") * F.col("capacity")).alias("tokens"))
    groups = wanted.groupBy("container_kind").agg(F.ceil(F.sum(F.col("tokens") % F.col("capacity")) / (F.max("capacity") * windows)).alias("groups"))
    dealt = parts.join(F.broadcast(groups), "container_kind")  # a row for each kind
    full = F.col("tokens") == F.col("capacity")
    alone = dealt.filter(full).select("container_kind", F.concat_ws("-", F.lit("full"), "_item", "part").alias("container_id"), "id", "part", "token_from", "tokens")
    rest = dealt.filter(~full).withColumn("deal", F.pmod(F.xxhash64("id", "part"), F.greatest("groups", F.lit(1))))
    packed = rest.select("container_kind", "capacity", "deal", "id", "part", "token_from", "tokens").groupBy("container_kind", "deal").applyInPandas(
        _pack_group, f"container_kind STRING, container_id STRING, id {items.schema['id'].dataType.simpleString()}, part INT, token_from BIGINT, tokens BIGINT"
    )
    return alone.unionByName(packed)


def _pack_group(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["tokens", "id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    windows = pack(rows["tokens"].to_numpy(np.int64), int(rows["capacity"].iloc[0]))
    names = [f"{d}-{w}" for d, w in zip(rows["deal"], windows)]
    return rows.assign(container_id=names)[["container_kind", "container_id", "id", "part", "token_from", "tokens"]]


def fill_report(filled: DataFrame, targets: DataFrame) -> DataFrame:
    """For each kind: containers, texts, tokens, and the share of the capacity that is filled."""
    per = filled.groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("items"))
    total = per.groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return total.join(F.broadcast(targets), "container_kind").select("container_kind", "containers", "items", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity_tokens"))).alias("filled"))


def packed_texts(texts: DataFrame, id_column: str, text: str, targets: DataFrame, windows: int = 96, path: str | None = None) -> DataFrame:
    """``fill_containers`` for texts, measured in tokens of a public tokenizer."""
    from lodesift.llm.tokens import with_tokens

    sizes = stored(with_tokens(texts, [id_column], text, path))
    return fill_containers(sizes.withColumnRenamed(id_column, "id"), targets, windows)
