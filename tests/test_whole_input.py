"""Nothing is dropped for its size, and rules hold where they used to fail."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import amounts as am
from ledgerlane.operators import ocr, reminders, state
from ledgerlane.sources.snapshot import fingerprint

DAY = dt.datetime(2026, 1, 1)


def test_long_readings_stay_whole(spark):
    text = "total 1 " * 30_000
    rows = spark.createDataFrame([("d", 1, 1, text, 0.9)], "document_id string, page int, pass int, text string, confidence double")
    assert ocr.best_reading(rows).first()["text"] == text.strip()
    assert len(ocr.best_reading(rows, limit=100).first()["text"]) == 100


def test_account_with_many_reminders(spark):
    many = spark.createDataFrame(
        [("u", "i", f"{n:04d}", "in_app", "scheduled", DAY + dt.timedelta(days=n), None) for n in range(450)],
        "user_id string, item_id string, id string, channel string, status string, remind_at timestamp, snoozed_until timestamp",
    )
    bills = spark.createDataFrame([("u", "i", "n", "r", None, None)],
                                  "user_id string, id string, name string, retailer string, warranty_expires_at date, return_expires_at date")
    as_of = F.lit(DAY)
    listed = reminders.listed(many, bills)
    assert reminders.reminder_tabs(listed, as_of).first()["upcoming"] == 450
    assert reminders.reminder_view(listed, "upcoming", as_of).count() == 450
    assert reminders.listed(many, bills, k=200).count() == 200


def test_every_stale_job_is_handled(spark):
    jobs = spark.createDataFrame(
        [(f"d{n}", n % 4, "reading", DAY, DAY) for n in range(400)],
        "document_id string, generation int, status string, dispatched_at timestamp, updated_at timestamp",
    )
    got = state.recover_stale(jobs, F.lit(DAY + dt.timedelta(hours=2))).groupBy("action").count().collect()
    assert {r["action"]: r["count"] for r in got} == {"fail": 100, "requeue": 300, "dispatch": 300}


def test_one_quiet_period_per_document(spark):
    edits = [(0, "name", "a"), (400, "brand", "b"), (800, "name", "c"), (2000, "name", "d")]
    df = spark.createDataFrame([("doc", DAY + dt.timedelta(milliseconds=t), i, f, v) for i, (t, f, v) in enumerate(edits)],
                               "document_id string, ts timestamp, event_id long, field string, value string")
    got = sorted((r["start"], r["field"], r["value"]) for r in state.client_batches(df, 600).collect())
    assert got == [(DAY, "brand", "b"), (DAY, "name", "c"), (DAY + dt.timedelta(seconds=2), "name", "d")]


def test_two_actions_on_one_bill(spark):
    columns = "user_id string, item_id string, deadline_type string, id string, channel string, status string, remind_at timestamp, snoozed_until timestamp"
    rows = spark.createDataFrame([("u", "i", "return", str(n), "in_app", "scheduled", DAY + dt.timedelta(days=n), None) for n in range(4)], columns)
    actions = spark.createDataFrame([("u", "0", "snooze", 3), ("u", "2", "dismiss", 0), ("u", "2", "snooze", 9)], "user_id string, id string, action string, days int")
    got = sorted((r["id"], r["status"]) for r in reminders.apply_actions(rows, actions, F.lit(DAY)).collect())
    assert got == [("0", "cancelled"), ("1", "cancelled"), ("2", "cancelled"), ("3", "scheduled")]


@pytest.mark.parametrize("height, left", [(1_000_000.0, 50.0), (10.0, 1e12)])
def test_wild_boxes_cost_no_more_cells(spark, height, left):
    boxes = [("d", 1, 0, n, float(30 * n), float(30 * n + 25), 100.0 + 0.5 * n, 10.0) for n in range(10)] + [("d", 1, 0, 99, left, left + 20, 100.0, height)]
    words = spark.createDataFrame(boxes, "document_id string, page int, block int, ord int, left double, right double, center double, height double")
    slopes = ocr.neighbour_slopes(words).collect()
    assert len(slopes) == 9 and all(abs(r["value"] - 0.5 / 30) < 1e-9 for r in slopes)


def test_words_are_not_collected_for_a_join(spark):
    boxes = [("d", 1, n, f"w{n}", [(float(30 * n), 0.5 * n), (float(30 * n + 25), 0.5 * n), (float(30 * n + 25), 10 + 0.5 * n), (float(30 * n), 10 + 0.5 * n)]) for n in range(6)]
    found = spark.createDataFrame(boxes, "document_id string, page int, ord int, text string, points array<struct<x:double,y:double>>")
    for rows in (ocr.block_slopes(ocr.split_sections(ocr.position_words(found))), ocr.read_layout(found)):
        assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
        assert rows.count() == 1


def test_words_at_one_place_have_no_slope(spark):
    boxes = [("d", 1, 0, n, 5.0, 5.0, 100.0, 10.0) for n in range(3)] + [("d", 1, 0, 3, 6.0, 30.0, 101.0, 10.0)]
    words = spark.createDataFrame(boxes, "document_id string, page int, block int, ord int, left double, right double, center double, height double")
    assert sorted(r["ord"] for r in ocr.neighbour_slopes(words).collect()) == [0, 1, 2]


def test_rows_that_differ_in_the_place_of_a_null(spark):
    one, two = (spark.createDataFrame([r], "a string, b string") for r in ((None, "x"), ("x", None)))
    assert fingerprint(one).first() != fingerprint(two).first()


def test_composed_money_signs(spark):
    cells = ["₨ 500", "Rs 500", "５００", "﹩500", "①500", "𝟓𝟎𝟎", "₨500.00"]
    df = spark.createDataFrame([(c,) for c in cells], "raw string").withColumn("cues", am.separator_cues(F.col("raw")))
    got = [r["v"] for r in df.select(am.parse_amount(F.col("raw"), F.col("cues")).cast("string").alias("v")).collect()]
    assert got == ["500.00"] * 4 + ["1500.00", "500.00", "500.00"]


def test_attempts_are_checked_again(spark):
    rows = [("r1", None), ("r2", DAY + dt.timedelta(days=3)), ("r3", None)]
    notices = spark.createDataFrame([("u", "i", r, "email", "warranty", DAY, s) for r, s in rows],
                                    "user_id string, item_id string, id string, channel string, deadline_type string, remind_at timestamp, snoozed_until timestamp")
    bills = spark.createDataFrame([("u", "i", "n", "r", (DAY + dt.timedelta(days=5)).date(), None)],
                                  "user_id string, id string, name string, retailer string, warranty_expires_at date, return_expires_at date")
    users = spark.createDataFrame([("u", "UTC", "a@x", True)], "id string, timezone string, email string, email_reminders boolean")
    tries = [("r1", 1, "a@x"), ("r1", 1, "b@x"), ("r1", 6, "a@x"), ("r2", 1, "a@x"), ("r2", 4, "a@x"), ("r9", 1, "a@x")]
    attempts = spark.createDataFrame([(r, DAY + dt.timedelta(days=d), to) for r, d, to in tries], "reminder_id string, ts timestamp, recipient string")
    got = {(r["reminder_id"], r["ts"].day - 1, r["recipient"]): r["allowed"] for r in reminders.sendable(attempts, notices, bills, users).collect()}
    assert got == dict(zip(tries, [True, False, False, False, True, False]))
    event = {"kind": "attempt", "ts": DAY, "token": 1, "recipient": "a@x"}
    assert state.delivery_step({}, {**event, "allowed": False}) == ({}, "skipped")
    assert state.delivery_step({}, {**event, "allowed": True})[1] == "claimed"
