"""History of changing attributes: versions with the period in which each was valid.

Per entity, the sorted array of its observations is folded by a higher-order function that appends a
version only where the attributes change; the versions are exploded with the next one's start as end.
An entity whose rows might not fit one array is cut into days first; each day is folded alone, and the
days' first and last states tell each day what held before it and what comes after.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.sources.tables import join_small, stored

DAY = 86_400


BLOCK = 64  # observations that one fold appends to: an array that grows is copied with each version


def _fold(rows: Column, states: list[str], kind: str) -> Column:
    """Versions of a sorted array of observations with one row for each instant.

    Folded in blocks, each beginning with the observation before it, so the time is in proportion to the
    rows, whatever the number of versions.
    """
    same = lambda a, b: _all([F.lit(True), *[a[s].eqNullSafe(b[s]) for s in states]])
    start = F.expr(f"CAST(array() AS ARRAY<{kind}>)")
    step = lambda done, row: F.when((F.size(done) > 0) & same(F.element_at(done, -1), row), done).otherwise(F.concat(done, F.array(row)))
    first = F.aggregate(F.slice(rows, 1, BLOCK), start, step)

    def block(at: Column) -> Column:
        before = F.array(F.get(rows, at - 1))
        return F.slice(F.aggregate(F.slice(rows, at + 1, F.lit(BLOCK)), before, step), 2, BLOCK)

    more = F.flatten(F.transform(F.sequence(F.lit(BLOCK), F.size(rows) - 1, F.lit(BLOCK)), block))
    return F.when(F.size(rows) <= BLOCK, first).otherwise(F.concat(first, more))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def version_history(df: DataFrame, entity: str, at: str, rank: str, states: list[str], needed: list[str] = (), heavy_rows: int = 20_000, most_broadcast: int = 10_000) -> DataFrame:
    """One row for each version: ``entity``, ``states``, ``valid_from``, ``valid_to`` (-1 for the last).

    ``at`` holds seconds (BIGINT). Rows with a null entity, a null time or a null in one of the ``needed``
    states are left out; other null states are states like any other. At one instant the row
    with the highest ``rank`` holds, null being the lowest; rows equal in that too are told apart by their
    states, so the result doesn't depend on the order of rows. Repeated rows change nothing, an empty
    table gives no row, other columns are ignored.

    An entity of more than ``heavy_rows`` rows goes by days: after the reduction to one row for each
    instant a day holds at most 86,400 rows, and days are told what comes before and after by windows.
    """
    rows = df.select(F.col(entity).alias("_k"), F.col(at).cast("bigint").alias("at"), F.col(rank).alias("_r"), *[F.col(s).alias(f"_s{i}") for i, s in enumerate(states)])
    names = [f"_s{i}" for i in range(len(states))]
    heavy = stored(df.groupBy(F.col(entity).alias("_k")).agg(F.count("*").alias("_n")).filter((F.col("_n") > heavy_rows) & F.col("_k").isNotNull()).select("_k"))
    n_heavy = heavy.count()
    kept = _all([F.col(c).isNotNull() for c in ("at", *[n for n, s in zip(names, states) if s in needed])])
    rows = rows.withColumn("_o", F.when(kept, F.struct("at", "_r", *names))).select("_k", "_o")
    light = rows if not n_heavy else join_small(rows, heavy, ["_k"], "left_anti", n_heavy, most_broadcast)
    out = _ends(_light(light, names), names)
    if n_heavy:
        out = out.unionByName(_heavy(join_small(rows, heavy, ["_k"], "left_semi", n_heavy, most_broadcast), names))
    return out.select(F.col("_k").alias(entity), *[F.col(n).alias(s) for n, s in zip(names, states)], F.col("at").alias("valid_from"), "valid_to")


def _versions(rows: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Folds the observations ``_o`` of each key, null ones aside: adds ``vs``, the versions.

    Unusable rows come as null observations, which collect_list passes over: a filter would compute
    the normalised values twice.
    """
    kind = rows.schema["_o"].dataType.simpleString()
    grouped = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_o")).alias("_a")).filter(F.size("_a") > 0)
    last_at = F.filter("_a", lambda x, i: F.coalesce(F.get("_a", i + 1)["at"] != x["at"], F.lit(True)))
    return grouped.select(*keys, last_at.alias("_a")).select(*keys, _fold(F.col("_a"), names, kind).alias("vs"), F.element_at("_a", -1).alias("_last"))


def _light(rows: DataFrame, names: list[str]) -> DataFrame:
    return _versions(rows.filter(F.col("_k").isNotNull()), ["_k"], names).select("_k", "vs", F.lit(-1).cast("bigint").alias("_after"))


def _ends(versions: DataFrame, names: list[str]) -> DataFrame:
    """Explodes ``vs``; a version ends where the next one starts, the last one at ``_after``."""
    ended = F.transform("vs", lambda v, i: F.struct(v["at"].alias("at"), *[v[n].alias(n) for n in names], F.coalesce(F.get("vs", i + 1)["at"], F.col("_after")).alias("valid_to")))
    return versions.select("_k", F.explode(ended).alias("_v")).select("_k", "_v.*")


def _heavy(rows: DataFrame, names: list[str]) -> DataFrame:
    rows = rows.filter(F.col("_o").isNotNull()).select("_k", "_o.*")
    one = rows.groupBy("_k", "at").agg(F.max(F.struct("_r", *names)).alias("_m")).select("_k", "at", "_m.*", F.floor(F.col("at") / DAY).alias("_d"))
    days = stored(_versions(one.select("_k", "_d", F.struct("at", "_r", *names).alias("_o")), ["_k", "_d"], names))
    first = F.element_at("vs", 1)
    # Of a day: its first and last state, the first instant, and the second version's start.
    summary = days.select("_k", F.struct("_d", first["at"].alias("from"), F.get("vs", F.lit(1))["at"].alias("second"), F.struct(*[first[n].alias(n) for n in names]).alias("first"), F.struct(*[F.col("_last")[n].alias(n) for n in names]).alias("last")).alias("_x"))
    # An entity's days in turn, a row for each. goes_on: its first version is the one that held the day before;
    # starts: its first new version; _after: the next start behind it.
    ahead = Window.partitionBy("_k").orderBy("_d")
    behind = Window.partitionBy("_k").orderBy(F.desc("_d")).rowsBetween(Window.unboundedPreceding, -1)
    told = summary.select("_k", "_x.*").withColumn("goes_on", F.coalesce(F.lag(F.struct("last")).over(ahead)["last"].eqNullSafe(F.col("first")) & (F.row_number().over(ahead) > 1), F.lit(False)))
    told = told.withColumn("starts", F.when(F.col("goes_on"), F.col("second")).otherwise(F.col("from")))
    after = told.select("_k", "_d", "goes_on", F.coalesce(F.last("starts", ignorenulls=True).over(behind), F.lit(-1)).alias("_after"))
    joined = days.join(after, ["_k", "_d"])
    return _ends(joined.select("_k", F.when(F.col("goes_on"), F.slice("vs", 2, 2_000_000_000)).otherwise(F.col("vs")).alias("vs"), "_after"), names)
