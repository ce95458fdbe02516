"""What is written and shuffled once is not written and shuffled again."""

from pyspark.sql import functions as F

from ledgerlane.operators import reminders as rm
from ledgerlane.session import configure
from ledgerlane.sources import derive, snapshot

REMINDERS = ("user_id string, item_id string, deadline_type string, remind_at timestamp, channel string, id string, status string, sent_at timestamp, "
             "snoozed_until timestamp, delivery_started_at timestamp, delivery_attempts int")


def test_schedules_are_applied_where_the_bills_lie(spark):
    old = spark.createDataFrame([], REMINDERS)
    planned = spark.createDataFrame([("1", "a", "return")] * 2, "user_id string, item_id string, deadline_type string").select(
        "*", F.lit("2024-01-01").cast("timestamp").alias("remind_at"), F.lit("email").alias("channel"))
    rebuilt = spark.createDataFrame([("1", "a")], "user_id string, item_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        configure(spark, by_owner=True)
        rows = rm.apply_schedule(old, planned, rebuilt)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "FullOuter" in plan and not [x for x in plan.split("\n") if "Exchange hashpartitioning" in x and "remind_at" in x]
        assert [(r.id, r.status) for r in rows.collect()] == [("a/return/1704067200/email", "scheduled")] * 2
    finally:
        configure(spark)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_snapshot_makes_each_table_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(n):
        made.add(1)
        return n

    tables = {"users": spark.range(7).select(counted(F.col("id").cast("int")).alias("n"), F.lit(None).cast("string").alias("s")), "bills": spark.createDataFrame([], "n int")}
    want = {"users": snapshot.fingerprint(spark.range(7).select(F.col("id").cast("int").alias("n"), F.lit(None).cast("string").alias("s"))).first(), "bills": snapshot.fingerprint(tables["bills"]).first()}
    snapshot.write_snapshot(tables, str(tmp_path / "s"))
    assert made.value == 7
    got = {r.table: r for r in spark.read.parquet(str(tmp_path / "s" / "manifest")).collect()}
    assert {t: (r.row_count, r.row_hash) for t, r in got.items()} == {t: (r.row_count, r.row_hash) for t, r in want.items()}


def test_the_smallest_of_several_lines_wins_without_its_status(spark, tmp_path):
    columns = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double, l_tax double, l_shipdate timestamp, l_returnflag string, l_linestatus string"
    rows = [(1, 1, 2, 3, 4.0, 5.0, 0.1, 0.0, None, f, s) for f, s in (("R", "F"), ("A", "O"), ("A", "F"))]
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "lineitem.parquet"))
    lines = derive.line_items(spark, str(tmp_path))
    assert [r.l_returnflag for r in lines.collect()] == ["A"]
    assert "l_linestatus" not in lines._jdf.queryExecution().analyzed().toString().split("Relation")[0]
