"""Running sums and numbers over all rows in one order, without a task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodesift.sources.tables import stored


def with_running_sum(df: DataFrame, order: list[str], value: Column, to: str) -> DataFrame:
    """Adds ``to``: the sum of ``value`` (BIGINT) over the rows up to each one, itself included, in ``order``.

    Rows are cut into ranges of the order; a range's sum, added up range by range, is the offset of the
    next, so each task sums its own range only. ``order`` should tell all rows apart; rows equal in it get
    their places in no certain order. An empty table gives no row.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.withColumn("_v", value.cast("bigint")).repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    sums = ranged.groupBy("_p").agg(F.sum("_v").alias("_s"))  # a row for each range
    before = F.sum("_s").over(Window.partitionBy(F.lit(1)).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.sum("_v").over(Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(offsets), "_p").withColumn(to, F.col("_before") + within).drop("_p", "_v", "_before")


def with_place(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """Adds ``to``: each row's place in ``order``, from 1."""
    return with_running_sum(df, order, F.lit(1), to)
