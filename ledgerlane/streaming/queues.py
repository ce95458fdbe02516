"""Queues that look at changed rows only, and send each message once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerlane.streaming.state import _written

MESSAGES = "message_key string, batch_id long, kind string, day date"


def sent(spark: SparkSession, folder: str) -> DataFrame:
    """``kind, day, message_key, batch_id`` of all messages sent to the outbox in ``folder``."""
    return spark.read.schema(MESSAGES).parquet(folder).select("kind", "day", "message_key", "batch_id")


def send_batch(messages: DataFrame, folder: str, batch_id: int) -> None:
    """Write the messages of one batch that no earlier batch has sent.

    A batch has a folder of its own, named by its id and replaced as a whole, so
    a batch that is run again, after a failure in the middle or at its end, adds
    nothing.  Of earlier batches only the days that the new messages fall on are
    read.  ``messages`` (of ``snapshot.outbox``): kind, day, message_key; a key
    that is repeated within them is sent once, on its first day.  The day belongs to
    the message, so a repeat has the same; having none counts as one more day.
    """
    here = f"{folder}/batch_id={batch_id}"
    if _written(messages.sparkSession, here):
        return
    new = messages.groupBy("kind", "message_key").agg(F.min("day").alias("day"))
    if batch_id:
        earlier = sent(messages.sparkSession, folder).filter(F.col("batch_id") < batch_id)
        touched = new.select("kind", "day").distinct()
        known = F.col("new.kind").eqNullSafe(F.col("known.kind")) & F.col("new.day").eqNullSafe(F.col("known.day")) & (
            F.col("new.message_key") == F.col("known.message_key"))
        days = F.col("e.kind").eqNullSafe(F.col("t.kind")) & F.col("e.day").eqNullSafe(F.col("t.day"))
        earlier = earlier.alias("e").join(touched.alias("t"), days, "left_semi")
        new = new.alias("new").join(earlier.alias("known"), known, "left_anti")
    new.select("message_key", "kind", "day").write.mode("overwrite").partitionBy("kind", "day").parquet(here)


def send_changes(changes: DataFrame, messages: Callable[[DataFrame], DataFrame], folder: str, checkpoint: str) -> StreamingQuery:
    """Turn the rows of a stream that no earlier run has seen into messages.

    Reads what has arrived and stops (``availableNow``).  ``checkpoint`` keeps
    which rows were seen and numbers the batches; of two runs with the same
    checkpoint one is refused by Spark, so a batch id is never used twice for
    different rows.
    """
    writer = changes.writeStream.foreachBatch(lambda rows, batch_id: send_batch(messages(rows), folder, batch_id))
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
