"""Parquet tables of a data folder, and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodesift.sources.ship import ship


_kept: list[str] = []  # folders of intermediate tables


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The parquet table ``name`` of ``folder``; the executors get the package first."""
    ship(spark)
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a temporary one where it is unset.

    The temporary folder is only for a session that runs on one machine (tests); a cluster names its
    folder in ``spark.checkpoint.dir``.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    known = spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lodesift-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back: cuts lineage and survives lost executors.

    The files are removed by ``drop_stored``, or when the Python process ends.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch(spark: SparkSession) -> str:
    """A new folder for an intermediate table in the shared folder."""
    if not _kept:
        atexit.register(drop_stored, spark)
    _kept.append(f"{shared_folder(spark)}/lodesift-{uuid.uuid4().hex}")
    return _kept[-1]


def drop_stored(spark: SparkSession) -> None:
    """Removes the intermediate tables written so far; for a long session, once a query's result is written."""
    while _kept:
        _remove(spark, _kept.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    except Exception:
        pass  # the session is gone already


def join_small(left: DataFrame, small: DataFrame, on: list[str], how: str, rows: int, most_rows: int) -> DataFrame:
    """Join with a side of ``rows`` counted rows: broadcast up to ``most_rows``, else as Spark sees fit."""
    return left.join(F.broadcast(small) if rows <= most_rows else small, on, how)
