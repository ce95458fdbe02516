"""Session helpers: settings the engine relies on, and the shared checkpoint
folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def configure(spark: SparkSession, by_owner: bool = False) -> SparkSession:
    """Settings every operator assumes.  All can be changed at run time.

    ``by_owner``: rows that lie together by owner and bill, or by some other part of
    a longer key, are joined by the whole key where they lie; else they are dealt again.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", str(not by_owner).lower())
    return spark


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A local session may leave it unset and then gets a temporary folder; on a
    cluster that would be a folder of the driver alone, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="ledgerlane-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread rows ahead of work that is heavy per row.

    Adaptive execution merges partitions by bytes; text mining costs far more
    per byte than that assumes.  A fixed partition count is left alone.
    """
    spark = df.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(count, key)
