"""Mixing sources to target weights, with capped repetition and exact cuts.

Each text gets a random key by hash. Keys are cut into equal ranges, so that the ranges' token sums per
source, added up in order, are prefix sums of the source sorted by key. A source's budget ends in one
range; only that range is sorted, and cut where the prefix sum reaches the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.sources.tables import join_small, stored


def source_form(c: Column) -> Column:
    """A source's name without case, outer blanks, and the kind of its separators."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s_\-]+", "_")


def _budgets(sizes: DataFrame, targets: DataFrame, total: int | None) -> DataFrame:
    """For each source with a target: what it has and what it takes; a row for each target."""
    wanted = targets.groupBy(source_form(F.col("source")).alias("source")).agg(F.sum("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats")).filter(F.col("source").isNotNull())
    there = sizes.groupBy("source").agg(F.count("*").alias("texts"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("longest"))
    rows = wanted.join(there, "source", "left").fillna(0, ["texts", "tokens", "longest"])
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(1))) if total is None else F.lit(total)
    rows = rows.withColumn("budget", F.floor(F.coalesce("target_share", F.lit(0.0)) * whole))
    repeats = F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(0))
    rows = rows.withColumn("takes", F.least("budget", F.col("tokens") * repeats))
    return rows.withColumns({"epochs": F.when(F.col("tokens") > 0, F.floor(F.col("takes") / F.col("tokens"))).otherwise(0), "rest": F.when(F.col("tokens") > 0, F.col("takes") % F.col("tokens")).otherwise(0)})


def mix(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 17, range_rows: int = 20_000, most_broadcast: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Texts with their ``copies`` in the mixture; and for each source the shares reached.

    ``sizes`` has ``id``, ``source``, ``tokens``; ``targets`` has ``source``, ``target_share``,
    ``max_repeats``, a table of a row for each source. The mixture has ``total`` tokens, by default as
    many as the texts of all sources with a target; a source takes its share of it, in whole texts, every
    text once before any twice and none more than ``max_repeats`` times. What a source can't fill stays
    open: the report tells its actual share. A source's last text is taken if that brings it closer to
    its budget. Texts without tokens, id, source or target are out; sources without texts are reported
    with 0. Equal keys are told apart by id; a repeated id is a separate text.
    """
    rows = sizes.select("id", source_form(F.col("source")).alias("source"), "tokens").filter((F.col("tokens") > 0) & F.col("id").isNotNull())
    named = targets.select(source_form(F.col("source")).alias("source")).distinct()
    rows = rows.join(F.broadcast(named), "source")  # a row for each source with a target
    n = rows.count()
    ranges = max(1, -(-n // range_rows))
    keyed = rows.withColumn("key", F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1))  # 63 bits, evenly spread
    keyed = keyed.withColumn("range", F.least(F.floor(F.col("key") / F.lit(2.0**63) * ranges), F.lit(ranges - 1)).cast("bigint"))
    budgets = stored(_budgets(rows, targets, total))
    sums = keyed.groupBy("source", "range").agg(F.sum("tokens").alias("s"), F.count("*").alias("c"))
    before = F.sum("s").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    # One row for each source and range, a 20,000th of the texts.
    offsets = stored(sums.withColumn("before", F.coalesce(before, F.lit(0))).join(F.broadcast(budgets.select("source", "epochs", "rest")), "source"))
    placed = join_small(keyed, offsets.select("source", "range", "before", "s", "epochs", "rest"), ["source", "range"], "inner", offsets.count(), most_broadcast)
    inside, across = F.col("before") + F.col("s") <= F.col("rest"), (F.col("before") < F.col("rest")) & (F.col("before") + F.col("s") > F.col("rest"))
    plain = placed.filter(~across).withColumn("extra", F.when(inside, 1).otherwise(0))
    upto = F.sum("tokens").over(Window.partitionBy("source", "range").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0))
    cut = placed.filter(across).withColumn("upto", F.col("before") + upto)
    cut = cut.withColumn("extra", F.when(F.col("upto") <= F.col("rest"), 1).when(2 * (F.col("rest") - (F.col("upto") - F.col("tokens"))) > F.col("tokens"), 1).otherwise(0))
    mixed = plain.unionByName(cut.drop("upto")).withColumn("copies", F.col("epochs") + F.col("extra")).filter("copies > 0").select("id", "source", "tokens", "copies")
    return mixed, budgets


def shares(mixed: DataFrame, budgets: DataFrame) -> DataFrame:
    """For each target: what the source had and what it takes of the mixture."""
    used = mixed.groupBy("source").agg(F.count("*").alias("texts_used"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens_used"), F.max("copies").alias("most_copies"))
    rows = budgets.join(used, "source", "left").fillna(0, ["texts_used", "tokens_used", "most_copies"])
    whole = F.sum("tokens_used").over(Window.partitionBy(F.lit(1)))  # a row for each target
    return rows.select("source", "target_share", "max_repeats", "texts", "tokens", "budget", "texts_used", "tokens_used", "most_copies", F.when(whole > 0, F.col("tokens_used") / whole).otherwise(0.0).alias("actual_share"), F.when(F.col("budget") > 0, F.col("tokens_used") / F.col("budget")).alias("filled"))
