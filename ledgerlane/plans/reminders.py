"""Registered queries over reminders and queues."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.operators import reminders as ops
from ledgerlane.plans import sql
from ledgerlane.plans.registry import query
from ledgerlane.plans.sql import with_
from ledgerlane.plans.bills import before_edit, edited, sql_date
from ledgerlane.sources import derive

TS = "strftime({}, '%Y-%m-%d %H:%M:%S')"


def ts(column: str, name: str | None = None) -> str:
    return TS.format(column) + f" AS {name or column.split('.')[-1]}"


@query("r01_schedule", with_(sql.PLANNED, f"""
SELECT user_id, item_id, deadline_type, {ts('remind_at')}, channel FROM channels WHERE remind_at > {sql.AS_OF}"""))
def schedule(spark, folder):
    return ops.schedule(derive.bills(spark, folder), derive.users(spark, folder), derive.as_of())


@query("r02_schedule_utc", with_(sql.PLANNED, f"""
SELECT user_id, item_id, deadline_type, strftime(r, '%Y-%m-%d %H:%M:%S') AS remind_at FROM
 (SELECT d.*, CAST(expires - n AS TIMESTAMP) + INTERVAL 9 HOUR AS r FROM deadlines d CROSS JOIN (VALUES (30), (7), (1)) t(n)) WHERE r > {sql.AS_OF}"""))
def schedule_utc(spark, folder):
    return ops.schedule_utc(derive.bills(spark, folder), derive.as_of())


@query("r03_schedule_changed", with_(sql.BILLS, """
SELECT user_id, id, CASE WHEN o % 8 = 1 THEN warranty_expires_at IS DISTINCT FROM DATE '2005-05-05' ELSE false END OR o % 6 = 2 AS rebuild FROM bills"""))
def schedule_changed(spark, folder):
    o = derive.order_of(F.col("id"))
    # the same set in another order and with a repeat is no change
    days = F.when(o % 6 == 2, F.array(F.lit(14))).when(o % 6 == 4, F.array(F.lit(1), F.lit(7), F.lit(30), F.lit(7)))
    new = derive.bills(spark, folder).withColumn("reminder_days", F.coalesce(days, F.col("reminder_days")))
    return ops.schedule_changed(before_edit(spark, folder), new)


@query("r04_apply_schedule", with_(sql.REMINDERS, f"""
, told AS (SELECT *, o % 3 = 0 AND remind_at > {sql.AS_OF} AND sent_at IS NULL AND delivery_started_at IS NULL AS planned FROM reminders)
SELECT user_id, item_id, deadline_type, {ts('remind_at')}, channel,
 CASE WHEN planned THEN 'scheduled' WHEN status = 'scheduled' AND o % 3 = 0 THEN 'cancelled' ELSE status END AS status,
 CASE WHEN NOT planned THEN {TS.format('snoozed_until')} END AS snoozed_until
FROM told"""))
def apply_schedule(spark, folder):
    bills, users = derive.bills(spark, folder), derive.users(spark, folder)
    touched = bills.filter(derive.order_of(F.col("id")) % 3 == 0)
    planned = ops.schedule(touched, users, derive.as_of())
    rebuilt = touched.select("user_id", F.col("id").alias("item_id"))
    return ops.apply_schedule(derive.reminders(spark, folder), planned, rebuilt).select(
        "user_id", "item_id", "deadline_type", "remind_at", "channel", "status", "snoozed_until"
    )


@query("r05_apply_preferences", with_(sql.REMINDERS, f"""
, new_users AS (SELECT id AS user_id, timezone, reminder_hour, email_reminders AS was_on,
   CASE WHEN CAST(id AS BIGINT) % 4 = 1 THEN true ELSE email_reminders END AS is_on,
   CASE WHEN CAST(id AS BIGINT) % 5 = 0 THEN 8 ELSE reminder_hour END AS new_hour FROM users),
new_plan AS (
  SELECT d.user_id, d.item_id, d.deadline_type,
   timezone('UTC', timezone(u.timezone, CAST(d.expires - n AS TIMESTAMP) + to_hours(CAST(u.new_hour AS BIGINT)))) AS remind_at, ch AS channel
  FROM deadlines d JOIN new_users u USING (user_id) CROSS JOIN (VALUES (30), (7), (1)) t(n) CROSS JOIN (VALUES ('in_app'), ('email')) c(ch)
  WHERE (ch = 'in_app' OR u.is_on) AND (u.new_hour <> u.reminder_hour OR (u.is_on <> u.was_on AND ch = 'email'))),
plan AS (SELECT * FROM new_plan WHERE remind_at > {sql.AS_OF}),
old AS (SELECT r.*, u.new_hour <> u.reminder_hour OR (u.is_on <> u.was_on AND channel = 'email') AS hit FROM reminders r JOIN new_users u USING (user_id))
SELECT coalesce(r.user_id, p.user_id) AS user_id, coalesce(r.item_id, p.item_id) AS item_id, coalesce(r.deadline_type, p.deadline_type) AS deadline_type,
 strftime(coalesce(r.remind_at, p.remind_at), '%Y-%m-%d %H:%M:%S') AS remind_at, coalesce(r.channel, p.channel) AS channel,
 CASE WHEN r.id IS NULL THEN 'scheduled' WHEN p.item_id IS NOT NULL AND r.sent_at IS NULL AND r.delivery_started_at IS NULL THEN 'scheduled'
      WHEN r.status = 'scheduled' AND r.hit THEN 'cancelled' ELSE r.status END AS status
FROM old r FULL JOIN plan p ON p.user_id = r.user_id AND p.item_id = r.item_id AND p.deadline_type = r.deadline_type
 AND p.remind_at = r.remind_at AND p.channel = r.channel"""))
def apply_preferences(spark, folder):
    users = derive.users(spark, folder)
    key = F.col("id").cast("long")
    changed = users.withColumns(
        {
            "email_reminders": F.when(key % 4 == 1, True).otherwise(F.col("email_reminders")),
            "reminder_hour": F.when(key % 5 == 0, 8).otherwise(F.col("reminder_hour")),
        }
    )
    rows = ops.apply_preferences(users, changed, derive.bills(spark, folder), derive.reminders(spark, folder), derive.as_of())
    return rows.select("user_id", "item_id", "deadline_type", "remind_at", "channel", "status")


@query("r06_apply_actions", with_(sql.REMINDERS, f"""
, latest AS (SELECT user_id, item_id, deadline_type, max(remind_at) AS up_to FROM reminders
   WHERE channel = 'in_app' AND status = 'scheduled' AND remind_at <= {sql.AS_OF} GROUP BY ALL),
acts AS (SELECT l.*, CASE WHEN r.o % 2 = 0 THEN 'dismiss' ELSE 'snooze' END AS action,
   greatest({sql.AS_OF}, coalesce(r.snoozed_until, r.remind_at)) + INTERVAL 48 HOUR AS until
   FROM latest l JOIN reminders r ON r.user_id = l.user_id AND r.item_id = l.item_id AND r.deadline_type = l.deadline_type AND r.remind_at = l.up_to AND r.channel = 'in_app')
SELECT r.user_id, r.id,
 CASE WHEN r.status = 'scheduled' AND r.remind_at <= a.up_to AND action = 'dismiss' THEN 'cancelled' ELSE r.status END AS status,
 strftime(CASE WHEN r.status = 'scheduled' AND r.remind_at <= a.up_to AND action = 'snooze' THEN until ELSE snoozed_until END, '%Y-%m-%d %H:%M:%S') AS snoozed_until
FROM reminders r LEFT JOIN acts a ON a.user_id = r.user_id AND a.item_id = r.item_id AND a.deadline_type = r.deadline_type"""))
def apply_actions(spark, folder):
    reminders = derive.reminders(spark, folder)
    due = reminders.filter(
        (F.col("channel") == "in_app") & (F.col("status") == "scheduled") & (F.col("remind_at") <= derive.as_of())
    )
    acts = due.groupBy("user_id", "item_id", "deadline_type").agg(F.max_by("id", F.struct("remind_at", "id")).alias("id"))
    o = derive.order_of(F.col("item_id"))
    acts = acts.select("user_id", "id", F.when(o % 2 == 0, "dismiss").otherwise("snooze").alias("action"), F.lit(2).alias("days"))
    return ops.apply_actions(reminders, acts, derive.as_of()).select("user_id", "id", "status", "snoozed_until")


DUE_EMAIL = f"""
due AS (SELECT r.*, b.name, b.retailer, u.email FROM reminders r JOIN bills b ON b.user_id = r.user_id AND b.id = r.item_id JOIN users u ON u.id = r.user_id
 WHERE channel = 'email' AND status = 'scheduled' AND u.email_reminders AND coalesce(snoozed_until, remind_at) <= {sql.AS_OF}
 AND (delivery_lease_until IS NULL OR delivery_lease_until < {sql.AS_OF})
 AND r.expires >= CAST(timezone(u.timezone, timezone('UTC', {sql.AS_OF})) AS DATE))"""


def _due(spark, folder):
    return ops.due_email(derive.reminders(spark, folder), derive.bills(spark, folder), derive.users(spark, folder), derive.as_of())


@query("r07_render_reminders", with_(sql.REMINDERS, f""", {DUE_EMAIL},
parts AS (SELECT *, CASE deadline_type WHEN 'warranty' THEN 'Warranty' ELSE 'Return' END AS label, {sql_date('expires')} AS day FROM due)
SELECT user_id, id, 'reminders@example.com' AS sender, email AS recipient, label || ' reminder: ' || name AS subject,
 name || chr(10) || label || ' deadline: ' || day || chr(10) || 'Retailer: ' || retailer || chr(10) || chr(10) || 'View your saved bill: https://vault.example.com/item/' || item_id
 || chr(10) || chr(10) || 'Manage reminders: https://vault.example.com/reminders' AS text,
 '<p>' || name || '</p><p>' || label || ' deadline: ' || day || '</p><p>Retailer: ' || retailer || '</p><p><a href="https://vault.example.com/item/' || item_id ||
 '">View your saved bill</a></p><p><a href="https://vault.example.com/reminders">Manage or turn off reminders</a></p>' AS html FROM parts"""))
def render(spark, folder):
    return ops.render_reminders(_due(spark, folder), "https://vault.example.com/app", "reminders@example.com")


@query("k09_due_email", with_(sql.REMINDERS, f", {DUE_EMAIL} SELECT user_id, id, {ts('remind_at')} FROM due"))
def due_email(spark, folder):
    return _due(spark, folder).select("user_id", "id", "remind_at")


@query("k09_due_email_batch", with_(sql.REMINDERS, f", {DUE_EMAIL} SELECT user_id, id, {ts('remind_at')} FROM due "))
def due_email_batch(spark, folder):
    return ops.due_batch(_due(spark, folder)).select("user_id", "id", "remind_at")


@query("r09_valid_preferences", with_(sql.USERS, """
SELECT id AS user_id, CAST(id AS BIGINT) % 10 <> 3 AND CAST(id AS BIGINT) % 11 <> 4 AS valid FROM users"""))
def valid_preferences(spark, folder):
    users = derive.users(spark, folder)
    key = F.col("id").cast("long")
    broken = users.withColumns(
        {
            "timezone": F.when(key % 10 == 3, "Invalid/Zone").otherwise(F.col("timezone")),
            "reminder_hour": F.when(key % 11 == 4, 24).otherwise(F.col("reminder_hour")),
        }
    )
    return ops.valid_preferences(broken)


@query("j01_reminder_bills", with_(sql.REMINDERS, "SELECT r.user_id, r.id, b.name FROM reminders r JOIN bills b ON b.user_id = r.user_id AND b.id = r.item_id"))
def reminder_bills(spark, folder):
    return ops.reminder_bills(derive.reminders(spark, folder), derive.bills(spark, folder)).select("user_id", "id", "name")


@query("j02_reminder_users_bills", with_(sql.REMINDERS, """
SELECT r.user_id, r.id, b.name, u.email FROM reminders r JOIN users u ON u.id = r.user_id JOIN bills b ON b.user_id = r.user_id AND b.id = r.item_id WHERE channel = 'email'"""))
def reminder_users_bills(spark, folder):
    email = derive.reminders(spark, folder).filter(F.col("channel") == "email")
    owners = derive.users(spark, folder).select(F.col("id").alias("user_id"), "email")
    return ops.reminder_bills(email, derive.bills(spark, folder)).join(owners, "user_id").select("user_id", "id", "name", "email")


@query("j03_opted_in", with_(sql.REMINDERS, """
SELECT r.user_id, r.id FROM reminders r WHERE channel = 'email' AND r.o % 9 <> 0
 AND EXISTS (SELECT 1 FROM users u WHERE u.id = r.user_id AND u.email_reminders)"""))
def opted_in(spark, folder):
    reminders = derive.reminders(spark, folder).filter(F.col("channel") == "email")
    users = derive.users(spark, folder)
    addressed = reminders.join(users.select(F.col("id").alias("user_id"), "email"), "user_id").withColumn(
        "recipient", F.when(derive.order_of(F.col("item_id")) % 9 == 0, "old@example.com").otherwise(F.col("email"))
    )
    return ops.opted_in(addressed, users).select("user_id", "id")


@query("j04_owner_zone", with_(sql.REMINDERS, """
SELECT r.user_id, r.id, u.timezone, CAST(CAST(timezone(u.timezone, timezone('UTC', r.remind_at)) AS DATE) AS VARCHAR) AS local_day
FROM reminders r LEFT JOIN users u ON u.id = r.user_id"""))
def owner_zone(spark, folder):
    return ops.owner_zone(derive.reminders(spark, folder), derive.users(spark, folder)).select("user_id", "id", "timezone", "local_day")


@query("w01_due_notices", with_(sql.REMINDERS, f"""
SELECT user_id, item_id, id, deadline_type, name, {ts('remind_at')} FROM (
 SELECT r.*, b.name, row_number() OVER (PARTITION BY r.user_id, r.item_id, r.deadline_type ORDER BY remind_at DESC, r.id) AS rn
 FROM reminders r JOIN bills b ON b.user_id = r.user_id AND b.id = r.item_id JOIN users u ON u.id = r.user_id
 WHERE channel = 'in_app' AND status = 'scheduled' AND coalesce(snoozed_until, remind_at) <= {sql.AS_OF}
 AND r.expires >= CAST(timezone(u.timezone, timezone('UTC', {sql.AS_OF})) AS DATE)) WHERE rn = 1"""))
def due_notices(spark, folder):
    return ops.due_notices(derive.reminders(spark, folder), derive.bills(spark, folder), derive.users(spark, folder), derive.as_of())


LISTED = """
listed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY remind_at, id) AS rn FROM reminders WHERE channel = 'in_app'))"""


def _listed(spark, folder):
    return ops.listed(derive.reminders(spark, folder), derive.bills(spark, folder))


@query("a04_reminder_tabs", with_(sql.REMINDERS, f""", {LISTED}
SELECT user_id, count(*) FILTER (status = 'scheduled' AND NOT coalesce(snoozed_until > {sql.AS_OF}, false)) AS upcoming,
 count(*) FILTER (status = 'scheduled' AND coalesce(snoozed_until > {sql.AS_OF}, false)) AS snoozed, count(*) AS all_reminders FROM listed GROUP BY user_id"""))
def tabs(spark, folder):
    return ops.reminder_tabs(_listed(spark, folder), derive.as_of())


def _view(tab: str):
    def run(spark, folder):
        return ops.reminder_view(_listed(spark, folder), tab, derive.as_of()).select("user_id", "id", "position")

    return run


for _tab, _where in (
    ("upcoming", f"status = 'scheduled' AND NOT coalesce(snoozed_until > {sql.AS_OF}, false)"),
    ("snoozed", f"status = 'scheduled' AND coalesce(snoozed_until > {sql.AS_OF}, false)"),
    ("all", "true"),
):
    query(f"w05_reminder_view_{_tab}", with_(sql.REMINDERS, f""", {LISTED}
SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(snoozed_until, remind_at), remind_at, id) AS position FROM listed WHERE {_where}"""))(_view(_tab))


@query("k11_welcome_queue", with_(sql.USERS, f"""
SELECT id, email, {ts('created_at')} FROM users WHERE welcome_status = 'pending' AND welcome_attempts < 5
 AND (welcome_lease_until IS NULL OR welcome_lease_until < {sql.AS_OF})"""))
def welcome_queue(spark, folder):
    return ops.welcome_queue(derive.users(spark, folder), derive.as_of()).select("id", "email", "created_at")


@query("k11_welcome_batch", with_(sql.USERS, f"""
SELECT id, email, {ts('created_at')} FROM users WHERE welcome_status = 'pending' AND welcome_attempts < 5
 AND (welcome_lease_until IS NULL OR welcome_lease_until < {sql.AS_OF}) """))
def welcome_batch(spark, folder):
    return ops.welcome_batch(derive.users(spark, folder), derive.as_of()).select("id", "email", "created_at")


@query("u01_deadline_rows", with_(sql.PLANNED, "SELECT user_id, item_id, deadline_type, CAST(expires AS VARCHAR) AS expires FROM deadlines"))
def deadline_rows(spark, folder):
    rows = ops._offsets(derive.bills(spark, folder).withColumn("reminder_days", F.array(F.lit(0))))
    return rows.select("user_id", "item_id", "deadline_type", "expires")


@query("u02_distinct_offsets", with_(sql.BILLS, "SELECT user_id, id AS item_id, CASE WHEN o % 2 = 0 THEN '7,30' ELSE '1,7,30' END AS days FROM bills"))
def distinct_offsets(spark, folder):
    o = derive.order_of(F.col("id"))
    days = F.when(o % 2 == 0, F.array(*[F.lit(d) for d in (30, 7, 7)])).otherwise(F.array(*[F.lit(d) for d in (30, 7, 1)]))
    return derive.bills(spark, folder).select(
        "user_id", F.col("id").alias("item_id"), F.array_join(F.array_sort(F.array_distinct(days)), ",").alias("days")
    )
