"""Outbox batches that are repeated, fail, or bring the same rows again."""

import datetime as dtm

import pytest
from pyspark.sql import functions as F

from ledgerlane.sources import snapshot
from ledgerlane.streaming import queues

SCHEMA = "id string, at timestamp, open boolean"
DAY = dtm.datetime(2024, 5, 1, 12)


def rows(spark, *found):
    return spark.createDataFrame([(i, DAY + dtm.timedelta(days=d) if d is not None else None, o) for i, d, o in found], SCHEMA)


def messages(df):
    return snapshot.outbox(df.filter("open"), "welcome", ["id"], F.col("at"))


def keys(spark, folder):
    return sorted((r.message_key, r.batch_id) for r in queues.sent(spark, folder).collect())


def test_a_repeated_batch_adds_nothing(spark, tmp_path):
    folder = str(tmp_path / "out")
    one = messages(rows(spark, ("a", 0, True), ("a", 0, True), ("b", 1, True), ("c", 1, False), ("n", None, True)))
    queues.send_batch(one, folder, 0)
    queues.send_batch(one, folder, 0)
    assert keys(spark, folder) == [("welcome/a", 0), ("welcome/b", 0), ("welcome/n", 0)]
    two = messages(rows(spark, ("b", 1, True), ("c", 1, True), ("n", None, True)))
    for _ in range(2):
        queues.send_batch(two, folder, 1)
    queues.send_batch(messages(rows(spark).filter("false")), folder, 2)
    queues.send_batch(two, folder, 3)
    assert keys(spark, folder) == [("welcome/a", 0), ("welcome/b", 0), ("welcome/c", 1), ("welcome/n", 0)]


def test_a_batch_broken_off_is_replaced(spark, tmp_path):
    folder = tmp_path / "out"
    queues.send_batch(messages(rows(spark, ("a", 0, True))), str(folder), 0)
    half = messages(rows(spark, ("b", 0, True))).select("message_key", "kind", "day")
    half.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").partitionBy("kind", "day").parquet(f"{folder}/batch_id=1")
    assert not (folder / "batch_id=1" / "_SUCCESS").exists()
    queues.send_batch(messages(rows(spark, ("a", 0, True), ("b", 0, True), ("c", 0, True))), str(folder), 1)
    assert keys(spark, str(folder)) == [("welcome/a", 0), ("welcome/b", 1), ("welcome/c", 1)]


def test_a_run_reads_only_new_rows(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / name) for name in ("rows", "out", "checkpoint"))
    seen = []

    def counted(df):
        seen.append(df.count())
        return messages(df)

    def run():
        changes = spark.readStream.schema(SCHEMA).parquet(source)
        queues.send_changes(changes, counted, folder, checkpoint).awaitTermination(120)

    rows(spark, ("a", 0, True), ("b", 0, False)).write.mode("append").parquet(source)
    run()
    rows(spark, ("a", 0, True), ("b", 0, True), ("c", 3, True)).write.mode("append").parquet(source)
    run()
    run()
    assert seen == [2, 3]
    assert keys(spark, folder) == [("welcome/a", 0), ("welcome/b", 1), ("welcome/c", 1)]


def test_a_failed_run_goes_on_where_it_was(spark, tmp_path):
    source, folder, checkpoint = (str(tmp_path / name) for name in ("rows", "out", "checkpoint"))
    rows(spark, ("a", 0, True), ("b", 0, True)).write.parquet(source)
    changes = spark.readStream.schema(SCHEMA).parquet(source)

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(Exception):
        queues.send_changes(changes, fails, folder, checkpoint).awaitTermination(120)
    queues.send_changes(changes, messages, folder, checkpoint).awaitTermination(120)
    assert keys(spark, folder) == [("welcome/a", 0), ("welcome/b", 0)]
