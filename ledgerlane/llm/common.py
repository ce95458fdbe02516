"""Helpers the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of an Arrow batch handed to a Python task.  Texts can be long, so the
# bound on a task's memory is this many texts.
BATCH_ROWS = 512


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of texts small (a session setting)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share.

    Only a local session may leave it unset; it then gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="ledgerlane-llm-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def fresh_folder(spark: SparkSession, what: str) -> str:
    """A path below the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str) -> DataFrame:
    """``df`` written as a Parquet table below the shared folder, and read back."""
    path = fresh_folder(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remainder(column: Column, base: int) -> Column:
    """crc32 of a value as text, modulo ``base``; a null counts as empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % base


def unit_hash(*parts: Column) -> Column:
    """A number in [0, 1) from the md5 of the parts joined by ``:``.

    52 bits of the digest, so the number is an exact double.
    """
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(2.0**52)


def small_side(df: DataFrame, weight: Column, limit: int) -> DataFrame:
    """``df``, to be broadcast if its weights really add up to ``limit`` at most.

    It is made once, in the shared folder, and measured; a larger one is
    returned without a hint, and joins by a shuffle that can split hot keys.
    """
    made = cut(df)
    total = made.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(made) if total <= limit else made
