"""Notices stay where their bill was dealt, and nothing sorts them."""

import datetime

from pyspark.sql import functions as F

from ledgerlane.operators import reminders as ops

DAY = datetime.date(2024, 5, 31)


def test_notices_are_neither_sorted_nor_merged_into_one_task(spark):
    bills = spark.createDataFrame(
        [("u", "a", DAY, None, [7, 1, 7]), ("u", "b", None, DAY, [30]), (None, "c", DAY, DAY, [1]), ("w", "d", DAY, None, [1])],
        "user_id string, id string, warranty_expires_at date, return_expires_at date, reminder_days array<int>")
    users = spark.createDataFrame([("u", "UTC", 9, True), ("v", "UTC", 9, True), (None, "UTC", 9, True)],
                                  "id string, timezone string, reminder_hour int, email_reminders boolean")
    planned = ops.schedule(bills, users, F.lit("2024-01-01").cast("timestamp"))
    rows = ops.owner_zone(planned, users)
    assert sorted((r.item_id, r.channel, str(r.local_day)) for r in rows.collect()) == sorted(
        (item, channel, day) for item, day in (("a", "2024-05-24"), ("a", "2024-05-30"), ("b", "2024-05-01")) for channel in ("email", "in_app"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Sort [" not in plan
