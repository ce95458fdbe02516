"""Registered queries over keyed state, integrity, snapshots and scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlane.operators import integrity as ig
from ledgerlane.operators import reminders
from ledgerlane.operators import scoring as sc
from ledgerlane.operators import state as st
from ledgerlane.plans import sql
from ledgerlane.plans.registry import query
from ledgerlane.plans.reminders import DUE_EMAIL
from ledgerlane.plans.sql import with_
from ledgerlane.session import checkpoint_folder
from ledgerlane.sources import derive, snapshot
from ledgerlane.sources.tables import read_star, read_tables
from ledgerlane.streaming import queues


def events(spark, folder):
    e = read_star(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    return e.withColumn("created_at", F.timestamp_add("HOUR", (F.col("user_id") % 24).cast("int"), F.lit("2023-12-31 12:00:00").cast("timestamp")))


def kind(**names):
    out = F.lit(None).cast("string")
    for event_type, name in names.items():
        out = F.when(F.col("event_type") == event_type, name).otherwise(out)
    return out


# Rows of each key in order, for the recursive SQL below.
EVENTS = """e AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_type,
  TIMESTAMP '2023-12-31 12:00:00' + to_hours(user_id % 24) AS created,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"""


@query("k01_upload_quota", f"""
WITH RECURSIVE {EVENTS},
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, min(created) AS start, CAST(0 AS BIGINT) AS cnt, false AS ok FROM e GROUP BY user_id
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, CASE WHEN f.start <= e.ts - INTERVAL 1 DAY THEN e.ts ELSE f.start END,
    CASE WHEN f.start <= e.ts - INTERVAL 1 DAY THEN 1 WHEN f.cnt < 3 THEN f.cnt + 1 ELSE f.cnt END,
    f.start <= e.ts - INTERVAL 1 DAY OR f.cnt < 3
  FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
SELECT user_id, event_id, CASE WHEN ok THEN 'accepted' ELSE 'refused' END AS outcome, cnt AS used FROM f WHERE rn > 0""")
def upload_quota(spark, folder):
    rows = st.fold(events(spark, folder), st.upload_quota(limit=3))
    return rows.select("user_id", "event_id", "outcome", F.regexp_extract("state", r"count=(\d+)", 1).cast("long").alias("used"))


@query("k02_assistant_quota", f"""
WITH RECURSIVE {EVENTS},
f AS (
  SELECT user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, min(created) AS start, CAST(0 AS BIGINT) AS cnt, CAST(NULL AS TIMESTAMP) AS last, false AS ok FROM e GROUP BY user_id
  UNION ALL
  SELECT user_id, rn, event_id, CASE WHEN ok AND expired THEN ts ELSE start END,
    CASE WHEN ok AND expired THEN 1 WHEN ok THEN cnt + 1 ELSE cnt END, CASE WHEN ok THEN ts ELSE last END, ok
  FROM (SELECT e.user_id, e.rn, e.event_id, e.ts, f.start, f.cnt, f.last, f.start <= e.ts - INTERVAL 1 DAY AS expired,
      (f.start <= e.ts - INTERVAL 1 DAY OR f.cnt < 3) AND (f.last IS NULL OR f.last < e.ts - INTERVAL 2 HOUR) AS ok
      FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, event_id, CASE WHEN ok THEN 'accepted' ELSE 'refused' END AS outcome FROM f WHERE rn > 0""")
def assistant_quota(spark, folder):
    return st.fold(events(spark, folder), st.assistant_quota(limit=3, gap_seconds=7200)).drop("state")


JOB_KIND = "CASE event_type WHEN 'view' THEN 'reading' WHEN 'click' THEN 'extracting' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'complete' ELSE 'retry' END"


def job_events(spark, folder):
    return events(spark, folder).select(
        "event_id", "ts", F.col("user_id").cast("string").alias("document_id"),
        kind(view="reading", click="extracting", error="failed", purchase="complete", signup="retry").alias("kind"),
        (F.col("event_id") % 3 + 1).cast("int").alias("generation"),
    )


@query("k05_k07_job_state", f"""
WITH RECURSIVE {EVENTS}, j AS (SELECT *, {JOB_KIND} AS kind, event_id % 3 + 1 AS gen FROM e),
f AS (
  SELECT user_id, rn, event_id, CAST(1 AS BIGINT) AS generation, 'queued' AS status, 'queued' AS outcome FROM j WHERE rn = 1
  UNION ALL
  SELECT j.user_id, j.rn, j.event_id,
    CASE WHEN j.kind = 'retry' AND f.status IN ('failed', 'complete') THEN f.generation + 1 ELSE f.generation END,
    CASE WHEN j.kind = 'retry' AND f.status IN ('failed', 'complete') THEN 'queued'
         WHEN j.kind = 'retry' OR f.status IN ('failed', 'complete') OR j.gen <> f.generation THEN f.status ELSE j.kind END,
    CASE WHEN j.kind = 'retry' AND f.status IN ('failed', 'complete') THEN 'queued'
         WHEN j.kind = 'retry' OR f.status IN ('failed', 'complete') OR j.gen <> f.generation THEN 'ignored' ELSE j.kind END
  FROM f JOIN j ON j.user_id = f.user_id AND j.rn = f.rn + 1)
SELECT CAST(user_id AS VARCHAR) AS document_id, event_id, outcome, 'generation=' || generation || ' status=' || status AS state FROM f""")
def job_state(spark, folder):
    return st.fold(job_events(spark, folder), st.job_state())


@query("k03_page_claims", f"""
WITH RECURSIVE e0 AS (SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, user_id, event_id % 4 AS page,
   CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'claim' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'done' ELSE 'local' END AS kind FROM events),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id, page ORDER BY ts, event_id) AS rn FROM e0),
f AS (
  SELECT user_id, page, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS status, 0 AS attempts, CAST(NULL AS TIMESTAMP) AS updated, '' AS outcome
  FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, page, rn, event_id,
    CASE outcome WHEN 'claimed' THEN 'processing' WHEN 'stored' THEN CASE kind WHEN 'failed' THEN 'failed' ELSE 'complete' END ELSE status END,
    CASE WHEN outcome = 'claimed' THEN attempts + 1 WHEN outcome = 'stored' AND kind = 'local' AND attempts = 0 THEN 1 ELSE attempts END,
    CASE WHEN outcome IN ('claimed', 'stored') THEN ts ELSE updated END, outcome
  FROM (SELECT e.*, f.status, f.attempts, f.updated,
     CASE WHEN e.kind IN ('done', 'failed') THEN CASE WHEN f.status IS NULL THEN 'ignored' ELSE 'stored' END
          WHEN f.status = 'complete' THEN 'reused'
          WHEN e.kind = 'local' THEN CASE WHEN f.status IS NULL OR f.status = 'failed' OR f.updated < e.ts - INTERVAL 2 MINUTE THEN 'stored' ELSE 'refused' END
          WHEN f.status IS NULL OR (f.attempts < 3 AND (f.status = 'failed' OR f.updated < e.ts - INTERVAL 2 MINUTE)) THEN 'claimed' ELSE 'refused' END AS outcome
     FROM f JOIN e ON e.user_id = f.user_id AND e.page = f.page AND e.rn = f.rn + 1))
SELECT CAST(user_id AS VARCHAR) AS document_id, page AS page_index, event_id, outcome FROM f WHERE rn > 0""")
def page_claims(spark, folder):
    rows = events(spark, folder).select(
        "event_id", "ts", F.col("user_id").cast("string").alias("document_id"), (F.col("event_id") % 4).alias("page_index"),
        kind(view="claim", click="claim", error="failed", purchase="done", signup="local").alias("kind"),
    )
    return st.fold(rows, st.page_claims()).drop("state")


@query("k04_extraction_budget")
def extraction_budget(spark, folder):
    rows = events(spark, folder).select(
        "event_id", "ts", F.concat_ws("-", "user_id", F.dayofyear("ts")).alias("document_id"),
        kind(view="run", click="call", error="call", purchase="result", signup="run").alias("kind"),
        F.concat(F.lit("r"), F.hour("ts").cast("string")).alias("request_id"),
    )
    return st.fold(rows, st.extraction_budget())


@query("k08_fold_drafts")
def fold_drafts(spark, folder):
    rows = events(spark, folder).select(
        "event_id", "ts", F.col("user_id").cast("string").alias("document_id"), (F.col("event_id") % 6).cast("int").alias("revision"),
        F.create_map("event_type", F.col("value").cast("string")).alias("patch"), (F.col("event_id") % 10 != 0).alias("editable"),
    )
    return st.fold(rows, st.fold_drafts())


def attempts(spark, folder):
    return events(spark, folder).select(
        "event_id", "ts", "user_id", F.concat(F.lit("rem-"), F.col("user_id")).alias("reminder_id"),
        kind(view="attempt", click="attempt", error="error", purchase="ok", signup="attempt").alias("kind"),
        F.concat(F.lit("t"), F.floor(F.col("event_id") / 300)).alias("token"),
        F.when(F.col("event_id") % 40 == 0, "new@example.com").otherwise("owner@example.com").alias("recipient"),
        (F.col("event_id") % 50 != 1).alias("allowed"),
    )


@query("k10_delivery_ledger")
def delivery_ledger(spark, folder):
    return st.fold(attempts(spark, folder), st.delivery_ledger())


@query("k12_welcome_ledger")
def welcome_ledger(spark, folder):
    return st.fold(attempts(spark, folder), st.welcome_ledger())


@query("k06_recover_stale", with_(sql.JOBS, """
, idle AS (SELECT *, coalesce(status IN ('queued','reading','extracting') AND dispatched_at IS NOT NULL AND updated_at < TIMESTAMP '1998-12-31 23:45:00', false) AS stale FROM jobs),
failed AS (SELECT * FROM idle WHERE stale AND generation >= 3),
after AS (SELECT document_id, generation + CASE WHEN stale AND generation < 3 THEN 1 ELSE 0 END AS generation,
  CASE WHEN stale AND generation < 3 THEN 'queued' ELSE status END AS status, CASE WHEN stale AND generation < 3 THEN NULL ELSE dispatched_at END AS dispatched_at,
  CASE WHEN stale AND generation < 3 THEN TIMESTAMP '1999-01-01' ELSE updated_at END AS updated_at FROM idle)
SELECT document_id, 'fail' AS action, generation FROM failed
UNION ALL SELECT document_id, 'requeue', generation + 1 FROM idle WHERE stale AND generation < 3
UNION ALL SELECT * FROM (SELECT document_id, 'dispatch', generation FROM after WHERE status = 'queued' AND (dispatched_at IS NULL OR dispatched_at < TIMESTAMP '1998-12-31 23:50:00')
  AND document_id NOT IN (SELECT document_id FROM failed))"""))
def recover_stale(spark, folder):
    return st.recover_stale(derive.document_jobs(spark, folder), derive.as_of())


@query("k13_account_upsert", "SELECT user_id, strftime(min(CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS created_at, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def account_upsert(spark, folder):
    return st.account_upsert(events(spark, folder))


CLIENT_BATCHES = """
WITH e AS (SELECT *, CAST(ts AS TIMESTAMP) AS t FROM events),
g AS (SELECT *, sum(CASE WHEN prev IS NULL OR t >= prev + INTERVAL 6 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS island
  FROM (SELECT *, lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) AS prev FROM e)),
s AS (SELECT *, min(t) OVER (PARTITION BY user_id, island) AS opened FROM g)
SELECT CAST(user_id AS VARCHAR) AS document_id, strftime(min(opened), '%Y-%m-%d %H:%M:%S') AS start, event_type AS field, arg_max(CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR), (t, event_id)) AS value
FROM s GROUP BY user_id, event_type, island"""


@query("k14_client_batches", CLIENT_BATCHES)
def client_batches(spark, folder):
    edits = events(spark, folder).select(
        F.col("user_id").cast("string").alias("document_id"), "ts", "event_id", F.col("event_type").alias("field"),
        F.col("value").cast("decimal(12,2)").cast("string").alias("value"),
    )
    return st.client_batches(edits, 6 * 3600 * 1000)


@query("k14_resent_batches", f"""
WITH b AS ({CLIENT_BATCHES}),
answers AS (
  SELECT document_id, start, row_number() OVER (PARTITION BY document_id ORDER BY start) % 7 <> 0 AS saved FROM (SELECT DISTINCT document_id, start FROM b)),
since AS (SELECT a.document_id, a.start, a.saved, coalesce(max(p.start), '') AS last_saved FROM answers a
  LEFT JOIN answers p ON p.document_id = a.document_id AND p.start < a.start AND p.saved GROUP BY ALL)
SELECT s.document_id, s.start, s.saved, b.field, arg_max(b.value, b.start) AS value
FROM since s JOIN b ON b.document_id = s.document_id AND b.start > s.last_saved AND b.start <= s.start GROUP BY ALL""")
def resent_batches(spark, folder):
    """Every seventh batch of a document is answered by an error."""
    batches = client_batches(spark, folder)
    nth = Window.partitionBy("document_id").orderBy("start")
    failed = batches.select("document_id", "start").distinct().withColumn("n", F.row_number().over(nth)).filter("n % 7 = 0")
    return st.resent_batches(batches, failed)


# --- integrity ------------------------------------------------------------
def thinned(spark, folder):
    """Tables whose bills lost every fiftieth order, and some rows' ranges."""
    t = derive.domain_tables(spark, folder)
    t["bills"] = t["bills"].filter(derive.order_of(F.col("id")) % 50 != 0)
    return t


@query("r10_check_owner_keys", with_(sql.REMINDERS, """
, lost AS (SELECT * FROM bills WHERE o % 50 = 0)
SELECT 'documents.item_id' AS relation, user_id, id AS parent_id FROM lost WHERE o % 3 <> 0
UNION ALL SELECT 'reminders.item_id', user_id, item_id FROM reminders WHERE o % 50 = 0"""))
def owner_keys(spark, folder):
    return ig.check_owner_keys(thinned(spark, folder))


@query("j06_orphan_reminders", with_(sql.REMINDERS, "SELECT user_id, id FROM reminders WHERE o % 50 = 0"))
def orphans(spark, folder):
    t = thinned(spark, folder)
    keys = t["bills"].select("user_id", F.col("id").alias("item_id"))
    return t["reminders"].join(keys, ["user_id", "item_id"], "left_anti").select("user_id", "id")


@query("r11_check_ranges", with_(sql.BILLS, """
SELECT 'bills' AS "table", id AS row_key, 'price_nonnegative' AS rule FROM bills WHERE o % 20 = 0 AND purchase_price IS NOT NULL
UNION ALL SELECT 'bills', id, 'warranty_months_valid' FROM bills WHERE o % 30 = 0 AND warranty_months IS NOT NULL
UNION ALL SELECT 'documents', id, 'page_count_valid' FROM bills WHERE o % 40 = 0
UNION ALL SELECT 'document_jobs', id, 'job_status_valid' FROM bills WHERE o % 60 = 0"""))
def ranges(spark, folder):
    t = derive.domain_tables(spark, folder)
    o, d = derive.order_of(F.col("id")), derive.order_of(F.col("document_id"))
    t["bills"] = t["bills"].withColumns({
        "purchase_price": F.when(o % 20 == 0, (-F.col("purchase_price")).cast("decimal(12,2)")).otherwise(F.col("purchase_price")),
        "warranty_months": F.when((o % 30 == 0) & F.col("warranty_months").isNotNull(), 1300).otherwise(F.col("warranty_months")),
    })
    t["documents"] = t["documents"].withColumn("page_count", F.when(o % 40 == 0, 11).otherwise(F.col("page_count")))
    t["document_jobs"] = t["document_jobs"].withColumn("status", F.when(d % 60 == 0, "lost").otherwise(F.col("status")))
    return ig.check_ranges(t)


@query("r12_check_unique", with_(sql.BILLS, """
SELECT 'bills' AS "table", user_id || '/' || id AS row_key, 2 AS copies FROM bills WHERE o % 25 = 0"""))
def unique(spark, folder):
    t = derive.domain_tables(spark, folder)
    t["bills"] = t["bills"].withColumn("n", F.explode(F.sequence(F.lit(1), F.when(derive.order_of(F.col("id")) % 25 == 0, 2).otherwise(1)))).drop("n")
    return ig.check_unique(t)


@query("r13_check_reminder_key", with_(sql.REMINDERS, """
SELECT user_id, item_id, deadline_type, strftime(remind_at, '%Y-%m-%d %H:%M:%S') AS remind_at, channel, 2 AS copies FROM reminders WHERE o % 25 = 0"""))
def reminder_key(spark, folder):
    copies = F.sequence(F.lit(1), F.when(derive.order_of(F.col("item_id")) % 25 == 0, 2).otherwise(1))
    return ig.check_reminder_key(derive.reminders(spark, folder).withColumn("n", F.explode(copies)).drop("n"))


def counts(tables):
    out = None
    for name, df in tables.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table"), "n")
        out = row if out is None else out.unionByName(row)
    return out


COUNTS = """, b AS (SELECT *, o % 6 = 1 AS dead FROM bills)
SELECT 'users' AS "table", count(*) AS n FROM users
UNION ALL SELECT 'bills', count(*) FILTER (NOT {bill}) FROM b
UNION ALL SELECT 'documents', count(*) FILTER (NOT {doc}) FROM b
UNION ALL SELECT 'document_pages', CAST(sum(o % 4 + 1) FILTER (NOT {doc}) AS BIGINT) FROM b
UNION ALL SELECT 'document_jobs', count(*) FILTER (NOT {doc}) FROM b
UNION ALL SELECT 'reminders', count(*) FILTER (NOT {rem}) FROM reminders"""


@query("r14_delete_bills", with_(sql.REMINDERS, COUNTS.format(bill="dead", doc="(dead AND o % 3 <> 0)", rem="(o % 6 = 1)")))
def delete_bills(spark, folder):
    t = derive.domain_tables(spark, folder)
    dead = t["bills"].filter(derive.order_of(F.col("id")) % 6 == 1).select("user_id", "id")
    return counts(ig.delete_bills(t, dead)[1])


@query("r14_publish_deletes", with_(sql.REMINDERS, COUNTS.format(bill="dead", doc="(dead AND o % 3 <> 0)", rem="(o % 6 = 1)")))
def publish_deletes(spark, folder):
    """The tables stored as one version, bills deleted, stored as the next."""
    root = f"{checkpoint_folder(spark)}/published-{uuid.uuid4().hex}"
    before = snapshot.publish(derive.domain_tables(spark, folder), root)
    t = snapshot.read_published(spark, root)
    dead = t["bills"].filter(derive.order_of(F.col("id")) % 6 == 1).select("user_id", "id")
    snapshot.publish(ig.delete_bills(t, dead)[1], root, base=before)
    return counts(snapshot.read_published(spark, root))


@query("r14_delete_bills_files", with_(sql.DOCUMENTS, "SELECT user_id, id AS document_id, storage_key FROM documents_d WHERE o % 6 = 1 AND item_id IS NOT NULL"))
def delete_bills_files(spark, folder):
    t = derive.domain_tables(spark, folder)
    dead = t["bills"].filter(derive.order_of(F.col("id")) % 6 == 1).select("user_id", "id")
    return ig.delete_bills(t, dead)[0]


@query("r15_delete_drafts", with_(sql.REMINDERS, COUNTS.format(bill="false", doc="(o % 2 = 0 AND o % 3 = 0)", rem="false")))
def delete_drafts(spark, folder):
    t = derive.domain_tables(spark, folder)
    dead = t["documents"].filter(derive.order_of(F.col("id")) % 2 == 0).select("user_id", "id")
    return counts(ig.delete_drafts(t, dead)[1])


@query("r08_save_bills", with_(sql.DOCUMENTS, """
SELECT user_id, id, CASE WHEN o % 3 <> 0 OR ocr_status <> 'pending' THEN id ELSE item_id END AS item_id,
 CASE WHEN o % 3 <> 0 OR ocr_status <> 'pending' THEN 'complete' ELSE ocr_status END AS ocr_status FROM documents_d"""))
def save_bills(spark, folder):
    t = derive.domain_tables(spark, folder)
    drafts = t["bills"]
    # bills of unlinked documents are not stored yet
    t["bills"] = drafts.filter(derive.order_of(F.col("id")) % 3 != 0)
    return ig.save_bills(t, drafts, derive.as_of())["documents"].select("user_id", "id", "item_id", "ocr_status")


@query("r08_save_bills_reminders", with_(sql.REMINDERS, """
, plan AS (SELECT c.*, split_part(item_id, '-', 1)::BIGINT AS o FROM channels c WHERE remind_at > TIMESTAMP '1999-01-01')
SELECT r.user_id, r.id, CASE WHEN r.o % 3 = 0 AND r.o % 12 <> 0 THEN
   CASE WHEN r.remind_at > TIMESTAMP '1999-01-01' AND r.sent_at IS NULL AND r.delivery_started_at IS NULL THEN 'scheduled'
        WHEN r.status = 'scheduled' THEN 'cancelled' ELSE r.status END ELSE r.status END AS status FROM reminders r"""))
def save_bills_reminders(spark, folder):
    t = derive.domain_tables(spark, folder)
    drafts = t["bills"]
    t["bills"] = drafts.filter(derive.order_of(F.col("id")) % 3 != 0)
    return ig.save_bills(t, drafts, derive.as_of())["reminders"].select("user_id", "id", "status")


# --- snapshot and outbox --------------------------------------------------
@query("s06_s07_snapshot", with_(sql.REMINDERS, """
, b AS (SELECT * FROM bills), n AS (
SELECT 'users' AS t, count(*) AS n FROM users UNION ALL SELECT 'bills', count(*) FROM b UNION ALL SELECT 'documents', count(*) FROM b
UNION ALL SELECT 'document_pages', CAST(sum(o % 4 + 1) AS BIGINT) FROM b UNION ALL SELECT 'document_jobs', count(*) FROM b UNION ALL SELECT 'reminders', count(*) FROM reminders)
SELECT t AS "table", n AS row_count, n AS restored_count, true AS same, 0 AS broken_rules FROM n"""))
def take_snapshot(spark, folder):
    path = f"{checkpoint_folder(spark)}/snapshot-{uuid.uuid4().hex}"
    snapshot.write_snapshot(derive.domain_tables(spark, folder), path)
    return snapshot.verify_snapshot(spark, path)


def stored(spark, folder):
    """The six domain tables, written once and read with their declared types."""
    path = f"{checkpoint_folder(spark)}/tables-{uuid.uuid4().hex}"
    for name, df in derive.domain_tables(spark, folder).items():
        df.write.parquet(f"{path}/{name}")
    return read_tables(spark, path)


@query("s01_read_tables", with_(sql.DOCUMENTS, "SELECT user_id, id, storage_key FROM documents_d"))
def read_back(spark, folder):
    return stored(spark, folder)["documents"].select("user_id", "id", "storage_key")


@query("s01_read_all_tables", with_(sql.REMINDERS, COUNTS.format(bill="false", doc="false", rem="false")))
def read_all(spark, folder):
    return counts(stored(spark, folder))


@query("s08_outbox", with_(sql.REMINDERS + sql.JOBS.removeprefix(sql.BILLS), f""", {DUE_EMAIL}
SELECT 'document' AS kind, CAST(CAST(updated_at AS DATE) AS VARCHAR) AS day, 'document/' || document_id || '/' || generation AS message_key FROM jobs WHERE status = 'queued'
UNION SELECT 'reminder', CAST(CAST(remind_at AS DATE) AS VARCHAR), 'reminder/' || id FROM due
UNION SELECT 'welcome', CAST(CAST(created_at AS DATE) AS VARCHAR), 'welcome/' || id FROM users WHERE welcome_status = 'pending' AND welcome_attempts < 5
 AND (welcome_lease_until IS NULL OR welcome_lease_until < {sql.AS_OF})"""))
def outbox(spark, folder):
    """All messages, written to an outbox twice and read back: a repeat adds nothing."""
    users = derive.users(spark, folder)
    due = reminders.due_email(derive.reminders(spark, folder), derive.bills(spark, folder), users, derive.as_of())
    messages = (
        snapshot.outbox(derive.document_jobs(spark, folder).filter("status = 'queued'"), "document", ["document_id", "generation"], F.col("updated_at"))
        .unionByName(snapshot.outbox(due, "reminder", ["id"], F.col("remind_at")))
        .unionByName(snapshot.outbox(reminders.welcome_queue(users, derive.as_of()), "welcome", ["id"], F.col("created_at")))
    )
    path = f"{checkpoint_folder(spark)}/outbox-{uuid.uuid4().hex}"
    snapshot.emit_outbox(messages.filter("kind <> 'welcome'"), path)
    snapshot.emit_outbox(messages, path)
    return spark.read.schema(messages.schema).parquet(path)


@query("k06_k11_changed_rows", with_(sql.REMINDERS + sql.JOBS.removeprefix(sql.BILLS), f"""
SELECT 'document' AS kind, CAST(CAST(updated_at AS DATE) AS VARCHAR) AS day, 'document/' || document_id || '/' || generation AS message_key FROM jobs WHERE status = 'queued'
UNION SELECT 'welcome', CAST(CAST(created_at AS DATE) AS VARCHAR), 'welcome/' || id FROM users WHERE welcome_status = 'pending' AND welcome_attempts < 5
 AND (welcome_lease_until IS NULL OR welcome_lease_until < {sql.AS_OF})"""))
def changed_rows(spark, folder):
    """Jobs and accounts that arrive in two lots, the second with rows of the first; a run sends what is new."""
    root = f"{checkpoint_folder(spark)}/queue-{uuid.uuid4().hex}"
    jobs = derive.document_jobs(spark, folder).filter("status = 'queued'")
    users = derive.users(spark, folder)
    for name, df, key, messages in (
        ("jobs", jobs, "document_id", lambda rows: snapshot.outbox(rows.filter("status = 'queued'"), "document", ["document_id", "generation"], F.col("updated_at"))),
        ("users", users, "id", lambda rows: snapshot.outbox(reminders.welcome_queue(rows, derive.as_of()), "welcome", ["id"], F.col("created_at"))),
    ):
        third = F.pmod(F.xxhash64(key), F.lit(3))
        for lot in (third < 2, third > 0):
            df.filter(lot).write.mode("append").parquet(f"{root}/{name}")
            changes = spark.readStream.schema(df.schema).parquet(f"{root}/{name}")
            queues.send_changes(changes, messages, f"{root}/outbox-{name}", f"{root}/seen-{name}").awaitTermination()
    both = queues.sent(spark, f"{root}/outbox-jobs").unionByName(queues.sent(spark, f"{root}/outbox-users"))
    return both.select("kind", "day", "message_key")


# --- scoring --------------------------------------------------------------
SCORED = ["name", "brand", "purchase_price", "purchase_date", "serial_number"]


def scored(spark, folder):
    """Expected and read fields of every bill under two modes, with misreads
    and omissions by order key."""
    b = derive.bills(spark, folder).withColumn("o", derive.order_of(F.col("id")))
    text = {c: F.col(c).cast("string") for c in SCORED}
    wanted = {**text, "name": F.when(F.col("o") % 10 == 0, "").otherwise(F.col("name"))}
    better = F.col("mode") == "thinking"
    got = {
        **text,
        "name": F.when((F.col("o") % 7 == 0) & ~better, F.lit(None).cast("string")).otherwise(F.col("name")),
        "brand": F.when(F.col("o") % 5 == 0, "Other").otherwise(F.col("brand")),
        "purchase_date": F.when(F.col("o") % 4 == 0, F.lit(None).cast("string")).otherwise(text["purchase_date"]),
    }
    def rows(values, name):
        pairs = F.array(*[F.struct(F.lit(c).alias("field"), values[c].alias(name)) for c in SCORED])
        return (
            b.withColumn("mode", F.explode(F.array(F.lit("standard"), F.lit("thinking"))))
            .select(F.col("id").alias("case_id"), "mode", F.explode(pairs).alias("p")).select("case_id", "mode", "p.*")
        )

    runs = b.withColumn("mode", F.explode(F.array(F.lit("standard"), F.lit("thinking")))).select(
        F.col("id").alias("case_id"), "mode", F.when(F.col("o") % 9 == 0, "labels").otherwise("model").alias("method"),
        F.when(F.col("mode") == "thinking", 2).otherwise(1).alias("calls"), (F.col("o") % 100).alias("milliseconds"),
        ((F.col("o") % 7 != 0) | (F.col("mode") == "thinking")).alias("named"),
    )
    return rows(wanted, "expected"), rows(got, "actual"), runs


OUTCOMES = """, m AS (SELECT * FROM bills CROSS JOIN (VALUES ('standard'), ('thinking')) t(mode)),
w AS (
 SELECT id AS case_id, mode, o, 'name' AS field, CASE WHEN o % 10 = 0 THEN '' ELSE name END AS expected, CASE WHEN o % 7 = 0 AND mode = 'standard' THEN NULL ELSE name END AS actual FROM m
 UNION ALL SELECT id, mode, o, 'brand', brand, CASE WHEN o % 5 = 0 THEN 'Other' ELSE brand END FROM m
 UNION ALL SELECT id, mode, o, 'purchase_price', CAST(purchase_price AS VARCHAR), CAST(purchase_price AS VARCHAR) FROM m
 UNION ALL SELECT id, mode, o, 'purchase_date', CAST(purchase_date AS VARCHAR), CASE WHEN o % 4 = 0 THEN NULL ELSE CAST(purchase_date AS VARCHAR) END FROM m
 UNION ALL SELECT id, mode, o, 'serial_number', serial_number, serial_number FROM m),
s AS (SELECT *, expected IS NOT DISTINCT FROM actual AS matched, expected IS DISTINCT FROM actual AND coalesce(actual, '') <> '' AS wrong_autofill,
 expected IS DISTINCT FROM actual AND coalesce(actual, '') = '' AND coalesce(expected, '') <> '' AS omission, coalesce(expected, '') = '' AS expected_blank FROM w),
c AS (SELECT case_id, mode, CASE WHEN o % 9 = 0 THEN 'labels' ELSE 'model' END AS method, CASE mode WHEN 'thinking' THEN 2 ELSE 1 END AS calls, o % 100 AS ms,
 o % 7 <> 0 OR mode = 'thinking' AS named, bool_and(matched) AS all_matched, count(*) FILTER (matched) AS n FROM s GROUP BY case_id, mode, o)"""


@query("a06_score_fields", with_(sql.BILLS, OUTCOMES + " SELECT case_id, mode, field, matched, wrong_autofill, omission, expected_blank FROM s"))
def score_fields(spark, folder):
    expected, actual, _ = scored(spark, folder)
    return sc.score_fields(expected, actual)


@query("a07_evaluation_report", with_(sql.BILLS, OUTCOMES + """,
f AS (SELECT mode, field, count(*) AS checked, count(*) FILTER (matched) AS matched, count(*) FILTER (wrong_autofill) AS wrong_autofills, count(*) FILTER (omission) AS omissions,
 count(*) FILTER (expected_blank) AS expected_blank, count(*) FILTER (field = 'name' AND expected_blank AND wrong_autofill) AS false_name_fills FROM s GROUP BY GROUPING SETS ((mode, field), (mode))),
g AS (SELECT mode, count(*) AS cases, count(*) FILTER (method = 'model' AND all_matched) AS passed, count(*) FILTER (method = 'model') AS model_cases,
 count(*) FILTER (method <> 'model') AS label_cases, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(ms) AS BIGINT) AS milliseconds, count(*) FILTER (named) AS name_coverage FROM c GROUP BY mode)
SELECT f.*, g.* EXCLUDE (mode) FROM f JOIN g USING (mode)"""))
def report(spark, folder):
    expected, actual, runs = scored(spark, folder)
    outcomes = sc.score_fields(expected, actual)
    return sc.evaluation_report(outcomes, sc.case_scores(outcomes, runs))


@query("a09_focus_fields", with_(sql.BILLS, OUTCOMES + " SELECT case_id, mode, field, matched, wrong_autofill, omission, expected_blank FROM s WHERE field IN ('brand', 'purchase_price', 'purchase_date')"))
def focus(spark, folder):
    expected, actual, _ = scored(spark, folder)
    return sc.focus_fields(sc.score_fields(expected, actual))


@query("a10_compare_modes", with_(sql.BILLS, OUTCOMES + """
SELECT case_id, bool_or(method = 'model' AND all_matched) FILTER (mode = 'standard') AS standard_passed, CAST(sum(n) FILTER (mode = 'standard') AS BIGINT) AS standard_matched,
 CAST(sum(calls) FILTER (mode = 'standard') AS BIGINT) AS standard_calls, bool_or(method = 'model' AND all_matched) FILTER (mode = 'thinking') AS thinking_passed,
 CAST(sum(n) FILTER (mode = 'thinking') AS BIGINT) AS thinking_matched, CAST(sum(calls) FILTER (mode = 'thinking') AS BIGINT) AS thinking_calls FROM c GROUP BY case_id"""))
def compare(spark, folder):
    expected, actual, runs = scored(spark, folder)
    return sc.compare_modes(sc.case_scores(sc.score_fields(expected, actual), runs), ["standard", "thinking"])


@query("a11_consensus", with_(sql.BILLS, """
SELECT user_id, CASE WHEN count(*) = count(category) AND min(category) = max(category) THEN min(category) END AS category FROM bills GROUP BY user_id"""))
def consensus(spark, folder):
    return sc.consensus(derive.bills(spark, folder), ["user_id"], "category")
