"""The keyed-state rules as Structured Streaming jobs."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql import types as T

from ledgerlane.operators.state import Rule, describe


class KeyedRule(StatefulProcessor):
    """Runs one rule's step over the events of a key, micro-batch by
    micro-batch, keeping the key's state in the state store."""

    def __init__(self, rule: Rule):
        self.rule = rule

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", T.StructType([T.StructField("state", T.BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        state = pickle.loads(self.state.get()[0]) if self.state.exists() else {}
        # events of one micro-batch come in any order
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        out = []
        for event in batch.to_dict("records"):
            state, outcome = self.rule.step(state, event)
            out.append((*key, event["event_id"], outcome, describe(state)))
        self.state.update((pickle.dumps(state),))
        yield pd.DataFrame(out, columns=[*self.rule.key, "event_id", "outcome", "state"])

    def close(self) -> None:
        pass


def fold_stream(events: DataFrame, rule: Rule) -> DataFrame:
    """Streaming twin of ``operators.state.fold``.

    One micro-batch of a key is held in memory at a time; cap the batch at the
    source (``maxFilesPerTrigger`` and the like) to bound it.
    """
    schema = events.select(*rule.key, "event_id").schema.add("outcome", "string").add("state", "string")
    return events.groupBy(*rule.key).transformWithStateInPandas(
        statefulProcessor=KeyedRule(rule), outputStructType=schema, outputMode="Append", timeMode="None"
    )


def first_sight(events: DataFrame, lateness: str = "1 hour") -> DataFrame:
    """Accounts as they first appear on a stream."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["user_id"]).select("user_id", "ts", "event_id")


# --- late events ------------------------------------------------------------
def _written(spark, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def split_late(events: DataFrame, folder: str, lateness: str = "1 hour", time: str = "ts"):
    """A stream writer that parts events of a stream from those that are late.

    An event is late if it is older than the newest event of all earlier
    batches less ``lateness``.  Below ``folder`` each batch writes ``on_time``,
    ``late`` and ``newest``, in folders named by its id; a batch that is run
    again leaves what it has written, so both tables hold every event once.
    Events without a time are late.  Read them with ``parted``.
    """
    def write(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        here = f"batch_id={batch_id}"
        if _written(spark, f"{folder}/newest/{here}"):
            return
        before = None
        if batch_id:
            # One row, of the batch before, which has the newest event so far.
            before = spark.read.parquet(f"{folder}/newest/batch_id={batch_id - 1}").first()["newest"]
        rows.persist()
        try:
            late = F.col(time).isNull()
            if before is not None:
                late |= F.col(time) < F.lit(before) - F.expr(f"INTERVAL {lateness}")
            for name, part in (("late", rows.filter(late)), ("on_time", rows.filter(~late))):
                if not _written(spark, f"{folder}/{name}/{here}"):
                    part.write.mode("overwrite").parquet(f"{folder}/{name}/{here}")
            newest = rows.agg(F.max(time).alias("newest")).select(F.greatest("newest", F.lit(before).cast("timestamp")).alias("newest"))
            newest.coalesce(1).write.mode("overwrite").parquet(f"{folder}/newest/{here}")
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(write)


def parted(spark, folder: str, name: str, schema: T.StructType, stream: bool = True) -> DataFrame:
    """The events of ``split_late`` that came in time (``on_time``) or not (``late``)."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(f"{folder}/{name}").drop("batch_id")
