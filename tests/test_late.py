"""Late events go to a side table and into no count; failed batches are sent again."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlane.operators import state as st
from ledgerlane.streaming.state import fold_stream, parted, split_late

T0 = datetime(2026, 1, 1)
SCHEMA = "event_id long, user_id long, ts timestamp, created_at timestamp"


def feed(spark, folder, number, events):
    rows = [(i, 1, None if hours is None else T0 + timedelta(hours=hours), T0) for i, hours in events]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)


def run(spark, source, out, check):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    q = split_late(stream, out, "2 hours").option("checkpointLocation", check).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and q.exception() is None


def ids(df):
    return sorted(r.event_id for r in df.collect())


def test_late_events(spark, tmp_path):
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    feed(spark, source, 0, [(1, 1), (2, 10)])
    run(spark, source, out, check)
    feed(spark, source, 1, [(3, 8), (4, 7.9), (5, 11), (6, None)])  # 8 is just in time
    run(spark, source, out, check)
    feed(spark, source, 2, [(7, 8.5), (8, 9), (9, 3)])
    run(spark, source, out, check)
    schema = spark.read.parquet(source).schema
    assert ids(parted(spark, out, "late", schema, stream=False)) == [4, 6, 7, 9]
    assert ids(parted(spark, out, "on_time", schema, stream=False)) == [1, 2, 3, 5, 8]

    # A quota on the stream counts what came in time, as the batch does.
    rule = st.upload_quota(3)
    q = (fold_stream(parted(spark, out, "on_time", schema), rule).writeStream.format("memory").queryName("late_quota").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "fold")).trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    got = {r.event_id: r.outcome for r in spark.table("late_quota").collect()}
    want = {r.event_id: r.outcome for r in st.fold(parted(spark, out, "on_time", schema, stream=False), rule).collect()}
    assert got == want and set(got) == {1, 2, 3, 5, 8}


def test_a_batch_run_again_writes_nothing_more(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    feed(spark, source, 0, [(1, 1), (2, 10)])
    run(spark, source, out, str(tmp_path / "check"))
    run(spark, source, out, str(tmp_path / "lost its checkpoint"))
    assert ids(parted(spark, out, "on_time", spark.read.parquet(source).schema, stream=False)) == [1, 2]


def test_failed_batches_are_sent_with_the_next(spark):
    edits = [("d", 1, "name", "A"), ("d", 1, "brand", "x"), ("d", 2, "name", "B"), ("d", 3, "notes", None), ("d", 4, "name", "C"),
             ("d", 5, "brand", "y"), ("e", 2, "name", "E")]
    batches = spark.createDataFrame(edits, "document_id string, start int, field string, value string").withColumn("run", F.lit(1))
    failed = spark.createDataFrame([("d", 1), ("d", 2), ("d", 2), ("d", 5), ("f", 1)], "document_id string, start int")
    got = sorted(map(tuple, st.resent_batches(batches.drop("run"), failed).collect()), key=str)
    assert got == sorted([
        ("d", 1, False, "name", "A"), ("d", 1, False, "brand", "x"),
        ("d", 2, False, "name", "B"), ("d", 2, False, "brand", "x"),
        ("d", 3, True, "name", "B"), ("d", 3, True, "brand", "x"), ("d", 3, True, "notes", None),
        ("d", 4, True, "name", "C"), ("d", 5, False, "brand", "y"), ("e", 2, True, "name", "E")], key=str)
