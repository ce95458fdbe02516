"""Reminder schedules, their upkeep and the queues read from them."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.functions import deadlines as dl
from ledgerlane.session import spread

KEY = ["user_id", "item_id", "deadline_type", "remind_at", "channel"]


def _effective() -> Column:
    return F.coalesce(F.col("snoozed_until"), F.col("remind_at"))


# --- schedules ------------------------------------------------------------
def _offsets(bills: DataFrame) -> DataFrame:
    """One row per bill, deadline and distinct day offset."""
    kinds = F.array(
        F.struct(F.lit("warranty").alias("deadline_type"), F.col("warranty_expires_at").alias("expires")),
        F.struct(F.lit("return").alias("deadline_type"), F.col("return_expires_at").alias("expires")),
    )
    return (
        bills.select("user_id", F.col("id").alias("item_id"), "reminder_days", F.explode(kinds).alias("k"))
        .filter(F.col("k.expires").isNotNull())
        .select("user_id", "item_id", "k.*", F.explode(F.array_distinct("reminder_days")).alias("days"))
        .withColumn("day", F.date_sub("expires", F.col("days")))
    )


def schedule(bills: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Planned notices at each account's local hour, strictly after ``as_of``.

    Bills are dealt by account while they are one row each; their notices stay
    where they are, and accounts are hashed, so that nothing sorts notices.
    """
    prefs = users.select(F.col("id").alias("user_id"), "timezone", "reminder_hour", "email_reminders")
    local = F.timestamp_add("HOUR", F.col("reminder_hour"), F.col("day").cast("timestamp"))
    channels = F.when(
        F.col("email_reminders"), F.array(F.lit("in_app"), F.lit("email"))
    ).otherwise(F.array(F.lit("in_app")))
    dealt = spread(bills.select("user_id", "id", "reminder_days", "warranty_expires_at", "return_expires_at"), "user_id")
    return (
        _offsets(dealt)
        .join(prefs.hint("shuffle_hash"), "user_id")
        .withColumn("remind_at", F.to_utc_timestamp(local, F.col("timezone")))
        .filter(F.col("remind_at") > as_of)
        .select("user_id", "item_id", "deadline_type", "remind_at", F.explode(channels).alias("channel"))
    )


def schedule_utc(bills: DataFrame, as_of: Column) -> DataFrame:
    """Plan at 09:00 UTC without channels."""
    return (
        _offsets(bills)
        .withColumn("remind_at", F.timestamp_add("HOUR", F.lit(9), F.col("day").cast("timestamp")))
        .filter(F.col("remind_at") > as_of)
        .select("user_id", "item_id", "deadline_type", "remind_at")
    )


def schedule_changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Saved bills whose schedule must be rebuilt (or that are new)."""
    def offsets(side: str) -> Column:
        return F.array_sort(F.array_distinct(F.col(f"{side}.reminder_days")))

    same = (
        F.col("o.id").isNotNull()
        & F.col("o.warranty_expires_at").eqNullSafe(F.col("n.warranty_expires_at"))
        & F.col("o.return_expires_at").eqNullSafe(F.col("n.return_expires_at"))
        & offsets("o").eqNullSafe(offsets("n"))
    )
    return (
        new.alias("n")
        .join(old.alias("o"), (F.col("n.user_id") == F.col("o.user_id")) & (F.col("n.id") == F.col("o.id")), "left")
        .select(F.col("n.user_id").alias("user_id"), F.col("n.id").alias("id"), (~same).alias("rebuild"))
    )


def upsert_schedule(reminders: DataFrame, planned: DataFrame, cancel: Column) -> DataFrame:
    """New snapshot of the reminders.

    Scheduled rows matching ``cancel`` are cancelled first; then the planned
    rows are added.  A planned row that exists already comes back to life only
    if it was never sent and never started.
    """
    cancelled = reminders.withColumn(
        "status",
        F.when((F.col("status") == "scheduled") & F.coalesce(cancel, F.lit(False)), "cancelled").otherwise(F.col("status")),
    )
    plan = planned.select(*KEY, F.lit(True).alias("planned"))
    joined = cancelled.join(plan, KEY, "full_outer")
    is_new = F.col("id").isNull()
    revive = F.col("planned") & F.col("sent_at").isNull() & F.col("delivery_started_at").isNull()
    new_id = F.concat_ws("/", "item_id", "deadline_type", F.unix_seconds("remind_at"), "channel")
    return joined.withColumns(
        {
            "status": F.when(is_new | revive, "scheduled").otherwise(F.col("status")),
            "snoozed_until": F.when(~is_new & F.coalesce(revive, F.lit(False)), F.lit(None)).otherwise(F.col("snoozed_until")),
            "delivery_attempts": F.coalesce("delivery_attempts", F.lit(0)),
            "id": F.coalesce("id", new_id),
        }
    ).drop("planned")


def apply_schedule(reminders: DataFrame, planned: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """``upsert_schedule`` for the bills in ``rebuilt`` (user_id, item_id)."""
    touched = rebuilt.select("user_id", "item_id").distinct().withColumn("touched", F.lit(True))
    marked = reminders.join(touched, ["user_id", "item_id"], "left")
    plan = planned.join(touched.drop("touched"), ["user_id", "item_id"], "left_semi")
    return upsert_schedule(marked, plan, F.col("touched")).drop("touched")


def apply_preferences(users_old: DataFrame, users_new: DataFrame, bills: DataFrame, reminders: DataFrame, as_of: Column) -> DataFrame:
    """Reminders after accounts changed zone, hour or the e-mail choice."""
    changed = (
        users_old.alias("o")
        .join(users_new.alias("n"), F.col("o.id") == F.col("n.id"))
        .select(
            F.col("n.id").alias("user_id"),
            (~F.col("o.timezone").eqNullSafe(F.col("n.timezone"))
             | ~F.col("o.reminder_hour").eqNullSafe(F.col("n.reminder_hour"))).alias("clock_changed"),
            (~F.col("o.email_reminders").eqNullSafe(F.col("n.email_reminders"))).alias("email_changed"),
        )
        .filter(F.col("clock_changed") | F.col("email_changed"))
    )
    affected = F.col("clock_changed") | (F.col("email_changed") & (F.col("channel") == "email"))
    owners = changed.select("user_id")
    planned = (
        schedule(bills.join(owners, "user_id", "left_semi"), users_new, as_of)
        .join(changed, "user_id")
        .filter(affected)
    )
    marked = reminders.join(changed.hint("shuffle_hash"), "user_id", "left")
    return upsert_schedule(marked, planned, affected).drop("clock_changed", "email_changed")


def apply_actions(reminders: DataFrame, actions: DataFrame, as_of: Column) -> DataFrame:
    """Dismiss or snooze a notice together with the older ones beside it.

    ``actions``: user_id, id, action, days.  Of several actions on the notices
    of one bill and deadline, the one on the latest notice counts; on the same
    notice, dismissing comes before snoozing and a longer snooze before a
    shorter one.
    """
    reached = (
        actions.join(
            reminders.filter((F.col("channel") == "in_app") & (F.col("status") == "scheduled")), ["user_id", "id"]
        )
        .select(
            "user_id", "item_id", "deadline_type", "action",
            F.col("remind_at").alias("up_to"),
            F.timestamp_add("HOUR", F.col("days") * 24, F.greatest(as_of, _effective())).alias("until"),
        )
    )
    key = ["user_id", "item_id", "deadline_type"]
    strongest = F.max(F.struct("up_to", (F.col("action") == "dismiss").alias("dismisses"), "until", "action"))
    notice = reached.groupBy(*key).agg(strongest.alias("one")).select(*key, "one.action", "one.up_to", "one.until")
    hit = (F.col("status") == "scheduled") & (F.col("remind_at") <= F.col("up_to"))
    return (
        reminders.join(notice, ["user_id", "item_id", "deadline_type"], "left")
        .withColumns(
            {
                "snoozed_until": F.when(hit & (F.col("action") == "snooze"), F.col("until")).otherwise(F.col("snoozed_until")),
                "status": F.when(hit & (F.col("action") == "dismiss"), "cancelled").otherwise(F.col("status")),
            }
        )
        .drop("action", "up_to", "until")
    )


# --- reading reminders ----------------------------------------------------
def reminder_bills(reminders: DataFrame, bills: DataFrame) -> DataFrame:
    """Reminders with the bill they belong to, on the composite owner key."""
    facts = bills.select("user_id", F.col("id").alias("item_id"), "name", "retailer", "warranty_expires_at", "return_expires_at")
    return reminders.join(facts, ["user_id", "item_id"])


def _deadline() -> Column:
    return F.when(F.col("deadline_type") == "warranty", F.col("warranty_expires_at")).otherwise(F.col("return_expires_at"))


def _owners(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id"), "timezone", "email", "email_reminders")


def due_notices(reminders: DataFrame, bills: DataFrame, users: DataFrame, as_of: Column) -> DataFrame:
    """Latest due notice of each bill and deadline whose day has not passed."""
    due = reminders.filter(
        (F.col("channel") == "in_app") & (F.col("status") == "scheduled") & (_effective() <= as_of)
    )
    latest = Window.partitionBy("user_id", "item_id", "deadline_type").orderBy(F.col("remind_at").desc(), F.col("id").asc())
    return (
        reminder_bills(due, bills)
        .join(_owners(users), "user_id")
        .filter(_deadline() >= dl.local_date(as_of, F.col("timezone")))
        .withColumn("rn", F.row_number().over(latest))
        .filter(F.col("rn") == 1)
        .select("user_id", "item_id", "id", "deadline_type", "name", "remind_at")
    )


def due_email(reminders: DataFrame, bills: DataFrame, users: DataFrame, as_of: Column, only_to: str | None = None) -> DataFrame:
    """E-mail reminders that may be sent now."""
    owners = _owners(users).filter(F.col("email_reminders"))
    if only_to:
        owners = owners.filter(F.lower("email") == only_to.strip().lower())
    open_rows = reminders.filter(
        (F.col("channel") == "email")
        & (F.col("status") == "scheduled")
        & (_effective() <= as_of)
        & (F.col("delivery_lease_until").isNull() | (F.col("delivery_lease_until") < as_of))
    )
    return (
        reminder_bills(open_rows, bills)
        .join(owners, "user_id")
        .filter(_deadline() >= dl.local_date(as_of, F.col("timezone")))
    )


def due_batch(due: DataFrame, k: int | None = None) -> DataFrame:
    """The queue in its order, or only its earliest ``k`` rows."""
    ordered = due.orderBy("remind_at", "id")
    return ordered if k is None else ordered.limit(k)


def sendable(attempts: DataFrame, reminders: DataFrame, bills: DataFrame, users: DataFrame) -> DataFrame:
    """Attempts with ``allowed``: at the time of the attempt the owner wants
    mail at that address, the notice is due and its deadline has not passed.

    ``attempts``: reminder_id, ts, recipient and any other columns.
    """
    facts = (
        reminder_bills(reminders.filter(F.col("channel") == "email"), bills)
        .join(_owners(users), "user_id")
        .select(F.col("id").alias("reminder_id"), "email", "email_reminders", "timezone",
                _effective().alias("effective"), _deadline().alias("deadline"))
    )
    now = F.col("email_reminders") & (F.col("recipient") == F.col("email")) & (F.col("effective") <= F.col("ts"))
    day = F.col("deadline") >= dl.local_date(F.col("ts"), F.col("timezone"))
    own = [c for c in attempts.columns if c != "allowed"]
    return attempts.join(facts, "reminder_id", "left").select(*own, F.coalesce(now & day, F.lit(False)).alias("allowed"))


def opted_in(reminders: DataFrame, users: DataFrame) -> DataFrame:
    """Reminders whose owner wants mail at the address noted on the row."""
    wanted = users.filter(F.col("email_reminders")).select(F.col("id").alias("user_id"), F.col("email").alias("recipient"))
    return reminders.join(wanted, ["user_id", "recipient"], "left_semi")


def owner_zone(reminders: DataFrame, users: DataFrame) -> DataFrame:
    """Each reminder with the zone and local calendar day of its owner."""
    # accounts are hashed, as sorting would hold many notices in memory
    zones = users.select(F.col("id").alias("user_id"), "timezone").hint("shuffle_hash")
    return reminders.join(zones, "user_id", "left").withColumn(
        "local_day", dl.local_date(F.col("remind_at"), F.col("timezone"))
    )


def _is_snoozed(as_of: Column) -> Column:
    return F.coalesce(F.col("snoozed_until") > as_of, F.lit(False))


def listed(reminders: DataFrame, bills: DataFrame, k: int | None = None) -> DataFrame:
    """In-app reminders of each account, or only the first ``k`` of them."""
    rows = reminder_bills(reminders.filter(F.col("channel") == "in_app"), bills)
    if k is None:
        return rows
    first = Window.partitionBy("user_id").orderBy("remind_at", "id")
    return rows.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= k).drop("rn")


def reminder_tabs(records: DataFrame, as_of: Column) -> DataFrame:
    scheduled = F.col("status") == "scheduled"
    return records.groupBy("user_id").agg(
        F.count_if(scheduled & ~_is_snoozed(as_of)).alias("upcoming"),
        F.count_if(scheduled & _is_snoozed(as_of)).alias("snoozed"),
        F.count("*").alias("all_reminders"),
    )


def reminder_view(records: DataFrame, tab: str, as_of: Column) -> DataFrame:
    """One tab of the listed reminders, each with its place in the list."""
    scheduled = F.col("status") == "scheduled"
    if tab == "upcoming":
        records = records.filter(scheduled & ~_is_snoozed(as_of))
    elif tab == "snoozed":
        records = records.filter(scheduled & _is_snoozed(as_of))
    by_time = Window.partitionBy("user_id").orderBy(_effective(), "remind_at", "id")
    return records.withColumn("position", F.row_number().over(by_time))


# --- messages -------------------------------------------------------------
def escape_html(value: Column) -> Column:
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        value = F.replace(value, F.lit(mark), F.lit(entity))
    return value


def render_reminders(due: DataFrame, base_url: str, sender: str) -> DataFrame:
    """Mail content of due reminders: subject, plain text and escaped HTML."""
    origin = "/".join(base_url.split("/")[:3])
    label = F.when(F.col("deadline_type") == "warranty", "Warranty").otherwise("Return")
    link = F.concat(F.lit(origin + "/item/"), F.url_encode("item_id"))
    settings = F.lit(origin + "/reminders")
    day = dl.display_date(_deadline())
    shop = F.col("retailer")
    has_shop = shop.isNotNull() & (shop != "")
    text = F.concat(
        F.col("name"), F.lit("\n"), label, F.lit(" deadline: "), day, F.lit("\n"),
        F.when(has_shop, F.concat(F.lit("Retailer: "), shop, F.lit("\n"))).otherwise(F.lit("")),
        F.lit("\nView your saved bill: "), link, F.lit("\n\nManage reminders: "), settings,
    )
    html = F.concat(
        F.lit("<p>"), escape_html(F.col("name")), F.lit("</p><p>"), label, F.lit(" deadline: "), escape_html(day), F.lit("</p>"),
        F.when(has_shop, F.concat(F.lit("<p>Retailer: "), escape_html(shop), F.lit("</p>"))).otherwise(F.lit("")),
        F.lit('<p><a href="'), escape_html(link), F.lit('">View your saved bill</a></p><p><a href="'),
        escape_html(settings), F.lit('">Manage or turn off reminders</a></p>'),
    )
    subject = F.concat(label, F.lit(" reminder: "), F.regexp_replace("name", "[\r\n]+", " "))
    return due.select(
        "user_id", "id", F.lit(sender).alias("sender"), F.col("email").alias("recipient"),
        subject.alias("subject"), text.alias("text"), html.alias("html"),
    )


def known_zones(spark: SparkSession) -> DataFrame:
    """Names of the public time zone database (some hundred rows)."""
    return spark.createDataFrame([(z,) for z in sorted(zoneinfo.available_timezones())], "timezone string")


def valid_preferences(users: DataFrame, zones: DataFrame | None = None) -> DataFrame:
    """Accounts with a known zone and an hour of the day.

    ``zones``: a table with a column ``timezone``, by default ``known_zones``.
    """
    zones = known_zones(users.sparkSession) if zones is None else zones
    known = zones.select("timezone").distinct().withColumn("known", F.lit(True))
    return users.join(known, "timezone", "left").select(
        F.col("id").alias("user_id"),
        (
            F.coalesce("known", F.lit(False))
            & (F.length("timezone") <= 100)
            & F.coalesce(F.col("reminder_hour").between(0, 23), F.lit(False))
        ).alias("valid"),
    )


# --- queues of accounts and jobs ------------------------------------------
def welcome_queue(users: DataFrame, as_of: Column) -> DataFrame:
    """Accounts still owed a welcome message."""
    return users.filter(
        (F.col("welcome_status") == "pending")
        & (F.col("welcome_attempts") < fixed.DELIVERY_ATTEMPTS)
        & (F.col("welcome_lease_until").isNull() | (F.col("welcome_lease_until") < as_of))
    )


def welcome_batch(users: DataFrame, as_of: Column, k: int | None = None) -> DataFrame:
    """The queue in its order, or only its earliest ``k`` rows."""
    ordered = welcome_queue(users, as_of).orderBy("created_at", "id")
    return ordered if k is None else ordered.limit(k)
