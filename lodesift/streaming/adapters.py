"""The scans and the register's status over streams. The batch operators are used as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodesift.functions import dims
from lodesift.operators.decode import contained
from lodesift.operators.patternscan import lines, masked_line, pattern_hits


def stream_table(spark: SparkSession, like: DataFrame, folder: str, files_a_batch: int = 100) -> DataFrame:
    """A stream of the parquet files that arrive in a folder, with the columns of ``like``."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def stream_leaks(values: DataFrame, keys: list[str], value: str, needles: list[str], depth: int = 3) -> DataFrame:
    """Sentinels in a stream of values; no state."""
    return contained(values, keys, value, needles, depth)


def stream_patterns(sources: DataFrame, path: str, text: str) -> DataFrame:
    """Pattern hits in a stream of source texts; no state."""
    return pattern_hits(lines(sources, [path], text), "text", dims.PATTERNS).withColumn("excerpt", masked_line(F.col("text")))


def stream_counts(events: DataFrame, at: str, by: str, late: str = "1 hour", window: str = "1 hour") -> DataFrame:
    """Events by window and value; rows later than ``late`` are dropped with the window's state."""
    return events.withWatermark(at, late).groupBy(F.window(at, window).alias("window"), by).agg(F.count("*").alias("rows"))


def stream_status(log: DataFrame, entity: str, status: str, at: str, rank: str) -> DataFrame:
    """The status that holds for each entity so far: the last by time, then by rank (update mode)."""
    return log.groupBy(entity).agg(F.max_by(status, F.struct(at, rank)).alias(status), F.max(at).alias(at))


def run_once(df: DataFrame, folder: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Writes what is there to parquet, then stops."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
