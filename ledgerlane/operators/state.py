"""Keyed state: quotas, claims, jobs, drafts and deliveries.

Each rule is a small step ``(state, event) -> (state, outcome)``.  Rules whose
states can be split (``operators.histories``) read the history of one key in
parallel.  The others spread events by key, sort inside the partitions
(spilling to disk when needed) and stream the rows through the step, so the
memory of a task does not grow with the size of a key.  ``streaming.state``
runs the same steps in Structured Streaming.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.operators.histories import Splitting, Step, fold_split

MICROSECOND = timedelta(microseconds=1)
DAY = timedelta(days=1)


@dataclass(frozen=True)
class Rule:
    """A step, the key it runs by, and the event columns it reads."""

    step: Step
    key: tuple[str, ...]
    columns: tuple[str, ...]
    splitting: Splitting | None = None


def fold(events: DataFrame, rule: Rule) -> DataFrame:
    """Outcome of every event, in (ts, event_id) order of its key.

    Adds ``outcome`` and ``state`` (the key's state after the event, as text).
    """
    if rule.splitting:
        return fold_split(events, rule, describe)
    key, columns = list(rule.key), list(dict.fromkeys([*rule.key, "event_id", "ts", *rule.columns]))
    step = rule.step
    schema = events.select(*key, "event_id").schema.add("outcome", "string").add("state", "string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = None, {}
        for batch in batches:
            outcomes, states = [], []
            for event in batch.to_dict("records"):
                owner = tuple(event[k] for k in key)
                if owner != current:
                    current, state = owner, {}
                state, outcome = step(state, event)
                outcomes.append(outcome)
                states.append(describe(state))
            yield batch[[*key, "event_id"]].assign(outcome=outcomes, state=states)

    ordered = events.select(*columns).repartition(*key).sortWithinPartitions(*key, "ts", "event_id")
    return ordered.mapInPandas(run, schema)


def describe(state: dict) -> str:
    """State as stable text; members starting with ``_`` stay inside."""
    return " ".join(f"{k}={state[k]}" for k in sorted(state) if not k.startswith("_") and state[k] is not None)


# --- quotas ---------------------------------------------------------------
def _open_window(state: dict, event: dict) -> dict:
    start, count = state.get("_start", event["created_at"]), state.get("count", 0)
    if start <= event["ts"] - DAY:
        start, count = event["ts"], 0
    return {**state, "_start": start, "count": count}


def upload_step(limit: int) -> Step:
    def step(state: dict, event: dict) -> tuple[dict, str]:
        opened = _open_window(state, event)
        if opened["count"] >= limit:
            return state, "refused"
        return {**opened, "count": opened["count"] + 1}, "accepted"

    return step


def assistant_step(limit: int, gap: timedelta) -> Step:
    def step(state: dict, event: dict) -> tuple[dict, str]:
        opened = _open_window(state, event)
        last = state.get("_last")
        if opened["count"] >= limit or (last is not None and last >= event["ts"] - gap):
            return state, "refused"
        return {**opened, "count": opened["count"] + 1, "_last": event["ts"]}, "accepted"

    return step


def upload_quota(limit: int = fixed.UPLOADS_PER_DAY) -> Rule:
    """Requests per account and day; a new window opens at the first request
    after the old one is a day old."""
    return Rule(upload_step(limit), ("user_id",), ("created_at",))


def assistant_quota(limit: int = fixed.ASSISTANT_PER_DAY, gap_seconds: int = fixed.ASSISTANT_GAP_SECONDS) -> Rule:
    return Rule(assistant_step(limit, timedelta(seconds=gap_seconds)), ("user_id",), ("created_at",))


# --- pages and extraction -------------------------------------------------
STALE = timedelta(seconds=fixed.CLAIM_STALE_SECONDS)


def page_step(state: dict, event: dict) -> tuple[dict, str]:
    kind, status = event["kind"], state.get("status")
    stale = status is not None and state["_updated"] < event["ts"] - STALE
    if kind == "done" or kind == "failed":
        if status is None:
            return state, "ignored"
        return {**state, "status": "complete" if kind == "done" else "failed", "_updated": event["ts"]}, "stored"
    if status == "complete":
        return state, "reused"
    if kind == "local":
        if status is None or status == "failed" or stale:
            return {"attempts": state.get("attempts", 1), "status": "complete", "_updated": event["ts"]}, "stored"
        return state, "refused"
    attempts = state.get("attempts", 0)
    if status is None or (attempts < fixed.PAGE_ATTEMPTS and (status == "failed" or stale)):
        return {"attempts": attempts + 1, "status": "processing", "_updated": event["ts"]}, "claimed"
    return state, "refused"


def extraction_step(state: dict, event: dict) -> tuple[dict, str]:
    kind, attempts = event["kind"], state.get("attempts", 0)
    mine = state.get("request") == event["request_id"]
    if kind == "run":
        if state.get("method") == "model":
            return state, "finished"
        busy = state.get("status") == "processing" and not state["_updated"] < event["ts"] - STALE
        if attempts >= fixed.EXTRACTION_ATTEMPTS or busy:
            return state, "refused"
        return {"attempts": attempts, "status": "processing", "request": event["request_id"], "_calls": 0, "_updated": event["ts"]}, "claimed"
    if kind == "call":
        if not mine or attempts >= fixed.EXTRACTION_ATTEMPTS or state["_calls"] >= fixed.CALLS_PER_RUN:
            return state, "refused"
        return {**state, "attempts": attempts + 1, "_calls": state["_calls"] + 1, "_updated": event["ts"]}, "charged"
    if not mine:
        return state, "dropped"
    return {**state, "status": "complete", "method": "model", "_updated": event["ts"]}, "stored"


def page_claims() -> Rule:
    """Who may read a page: new, failed or stale, at most three times."""
    finite = tuple({"status": s, "attempts": n} for s in ("processing", "failed", "complete") for n in range(fixed.PAGE_ATTEMPTS + 1))
    splitting = Splitting("_updated", MICROSECOND, finite, lambda event: [event["ts"] - STALE])
    return Rule(page_step, ("document_id", "page_index"), ("kind",), splitting)


def extraction_budget() -> Rule:
    """Provider calls of a document, charged before they are made."""
    return Rule(extraction_step, ("document_id",), ("kind", "request_id"))


# --- jobs -----------------------------------------------------------------
def job_step(state: dict, event: dict) -> tuple[dict, str]:
    kind, status = event["kind"], state.get("status")
    if status is None:
        return {"generation": 1, "status": "queued"}, "queued"
    if kind == "retry":
        if status in ("failed", "complete"):
            return {"generation": state["generation"] + 1, "status": "queued"}, "queued"
        return state, "ignored"
    if event["generation"] != state["generation"] or status in ("failed", "complete"):
        return state, "ignored"
    return {**state, "status": kind}, kind


def job_state() -> Rule:
    """Processing state of a document; old generations and finished jobs
    take no further progress."""
    def cuts(event: dict) -> list[int]:
        generation = event["generation"] or 0
        return [generation, generation + 1]

    finite = tuple({"status": s} for s in ("queued", "reading", "extracting", "failed", "complete"))
    return Rule(job_step, ("document_id",), ("kind", "generation"), Splitting("generation", 1, finite, cuts, moves=True))


def recover_stale(jobs: DataFrame, as_of: Column, batch: int | None = None) -> DataFrame:
    """What one recovery run does: fail, requeue and dispatch.

    Returns document_id, action, generation.  With a ``batch``, at most so many
    jobs fail per run and at most so many are dispatched, oldest first, after
    requeueing.
    """
    def first(rows: DataFrame) -> DataFrame:
        return rows if batch is None else rows.orderBy("updated_at", "document_id").limit(batch)

    open_job = F.col("status").isin("queued", "reading", "extracting")
    idle = open_job & F.col("dispatched_at").isNotNull() & (F.col("updated_at") < F.timestamp_add("MINUTE", F.lit(-15), as_of))
    spent = jobs.filter(idle & (F.col("generation") >= fixed.JOB_GENERATIONS))
    failed = first(spent).select("document_id", F.lit("fail").alias("action"), "generation")
    requeue = F.coalesce(idle & (F.col("generation") < fixed.JOB_GENERATIONS), F.lit(False))
    after = jobs.withColumn("requeued", requeue).select(
        "document_id",
        F.when(F.col("requeued"), F.col("generation") + 1).otherwise(F.col("generation")).alias("generation"),
        F.when(F.col("requeued"), "queued").otherwise(F.col("status")).alias("status"),
        F.when(~F.col("requeued"), F.col("dispatched_at")).alias("dispatched_at"),
        F.when(F.col("requeued"), as_of).otherwise(F.col("updated_at")).alias("updated_at"),
        "requeued",
    )
    requeued = after.filter("requeued").select("document_id", F.lit("requeue").alias("action"), "generation")
    waiting = (F.col("status") == "queued") & (
        F.col("dispatched_at").isNull() | (F.col("dispatched_at") < F.timestamp_add("MINUTE", F.lit(-10), as_of))
    )
    # failed jobs of this run are no longer queued
    dispatched = first(after.filter(waiting).join(failed.select("document_id"), "document_id", "left_anti")).select(
        "document_id", F.lit("dispatch").alias("action"), "generation")
    return failed.unionByName(requeued).unionByName(dispatched)


# --- drafts ---------------------------------------------------------------
def draft_step(state: dict, event: dict) -> tuple[dict, str]:
    revision, fields = state.get("revision", 0), state.get("_fields", {})
    patch = dict(event["patch"]) if not isinstance(event["patch"], dict) else event["patch"]
    if not event["editable"]:
        return state, "refused"
    if event["revision"] == revision:
        merged = {**fields, **patch}
        return {"revision": revision + 1, "_fields": merged, "fields": ",".join(f"{k}:{merged[k]}" for k in sorted(merged))}, "saved"
    if revision == event["revision"] + 1 and all(fields.get(k) == v for k, v in patch.items()):
        return state, "repeated"
    return state, "refused"


def fold_drafts() -> Rule:
    """Merge patches that name the current revision; a repeat of the last
    patch changes nothing."""
    return Rule(draft_step, ("document_id",), ("revision", "patch", "editable"))


def client_batches(edits: DataFrame, quiet_ms: int = fixed.AUTOSAVE_QUIET_MS) -> DataFrame:
    """Edits of a document merged until it pauses; the last value of each field
    wins.  An edit of any field restarts the one quiet period of its document.

    ``edits``: document_id, ts, event_id, field, value.
    """
    by_time = Window.partitionBy("document_id").orderBy("ts", "event_id")
    gap = F.col("ts") >= F.timestamp_add("MILLISECOND", F.lit(quiet_ms), F.lag("ts").over(by_time))
    batches = edits.withColumn("batch", F.sum(F.coalesce(gap, F.lit(False)).cast("long")).over(by_time))
    last = batches.groupBy("document_id", "batch", "field").agg(
        F.max_by("value", F.struct("ts", "event_id")).alias("value"), F.min("ts").alias("first"))
    whole = Window.partitionBy("document_id", "batch")
    return last.select("document_id", F.min("first").over(whole).alias("start"), "field", "value")


def resent_batches(batches: DataFrame, failed: DataFrame) -> DataFrame:
    """What each batch of a document sends, when some are not saved.

    ``batches``: document_id, start, field, value, as ``client_batches`` gives
    them.  ``failed``: document_id, start of those that were answered by an
    error; rows may repeat.  The fields of a failed batch stay pending: the next
    batch sends them again, under its own newer edits, and so on until one is
    saved.  Returns document_id, start, saved, field, value.  A null value is an
    edit that clears its field.  What failed last is sent by no later batch.
    """
    key = ["document_id", "start"]
    answers = batches.select(*key).distinct().join(failed.select(*key).distinct().withColumn("lost", F.lit(True)), key, "left")
    earlier = Window.partitionBy("document_id").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    answers = answers.select(*key, F.col("lost").isNull().alias("saved")).withColumn("run", F.coalesce(F.sum(F.col("saved").cast("long")).over(earlier), F.lit(0)))
    # Every field of a run of failures is looked at in each of its batches.
    edits = batches.select(*key, "field", F.struct("value").alias("edit")).join(answers, key)
    fields = edits.select("document_id", "run", "field").distinct()
    grid = answers.join(fields, ["document_id", "run"]).join(edits.select(*key, "field", "edit"), [*key, "field"], "left")
    so_far = Window.partitionBy("document_id", "run", "field").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    sent = grid.withColumn("sent", F.last("edit", ignorenulls=True).over(so_far)).filter("sent IS NOT NULL")
    return sent.select(*key, "saved", "field", F.col("sent.value").alias("value"))


# --- deliveries -----------------------------------------------------------
LEASE = timedelta(seconds=fixed.DELIVERY_LEASE_SECONDS)
WINDOW = timedelta(hours=fixed.DELIVERY_WINDOW_HOURS)


def delivery_step(state: dict, event: dict) -> tuple[dict, str]:
    kind, status, attempts = event["kind"], state.get("status", "scheduled"), state.get("attempts", 0)
    if kind == "attempt":
        if status != "scheduled" or not event.get("allowed", True):
            return state, "skipped"
        if "_started" in state and event["ts"] - state["_started"] >= WINDOW:
            return {**state, "status": "failed"}, "failed"
        if state.get("_to", event["recipient"]) != event["recipient"]:
            return {**state, "status": "cancelled"}, "skipped"
        lease = state.get("_lease")
        if attempts >= fixed.DELIVERY_ATTEMPTS or (lease is not None and not lease < event["ts"]):
            return state, "busy"
        return {
            "status": status, "attempts": attempts + 1, "_token": event["token"], "_lease": event["ts"] + LEASE,
            "_started": state.get("_started", event["ts"]), "_to": state.get("_to", event["recipient"]),
        }, "claimed"
    if state.get("_token") != event["token"]:
        return state, "dropped"
    if kind == "ok":
        return {**state, "status": "sent", "_lease": None}, "sent"
    if status != "scheduled":
        return state, "dropped"
    return {**state, "status": "failed" if attempts >= fixed.DELIVERY_ATTEMPTS else "scheduled", "_lease": None}, "retry"


def welcome_step(state: dict, event: dict) -> tuple[dict, str]:
    kind, status, attempts = event["kind"], state.get("status", "pending"), state.get("attempts", 0)
    if kind == "attempt":
        lease = state.get("_lease")
        if status != "pending" or attempts >= fixed.DELIVERY_ATTEMPTS or (lease is not None and not lease < event["ts"]):
            return state, "skipped"
        claimed = {**state, "status": status, "attempts": attempts + 1, "_token": event["token"], "_lease": event["ts"] + LEASE}
        if "_started" in state and event["ts"] - state["_started"] >= WINDOW:
            return {**claimed, "status": "failed", "_lease": None}, "failed"
        if not event["allowed"] or state.get("_to", event["recipient"]) != event["recipient"]:
            return {**claimed, "status": "skipped", "_lease": None}, "skipped"
        return {**claimed, "_started": state.get("_started", event["ts"]), "_to": event["recipient"]}, "claimed"
    if state.get("_token") != event["token"] or status != "pending":
        return state, "dropped"
    if kind == "ok":
        return {**state, "status": "sent", "_lease": None}, "sent"
    return {**state, "status": "failed" if attempts >= fixed.DELIVERY_ATTEMPTS else "pending", "_lease": None}, "retry"


def delivery_ledger() -> Rule:
    """Attempts to send one reminder: lease, fixed recipient, five tries.

    ``allowed`` says whether it might be sent at that time, see
    ``reminders.sendable``."""
    return Rule(delivery_step, ("reminder_id",), ("kind", "token", "recipient", "allowed"))


def welcome_ledger() -> Rule:
    return Rule(welcome_step, ("user_id",), ("kind", "token", "recipient", "allowed"))


# --- accounts -------------------------------------------------------------
def account_upsert(events: DataFrame) -> DataFrame:
    """First sight of every account; later sights change nothing."""
    return events.groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("first")).select(
        "user_id", F.col("first.ts").alias("created_at"), F.col("first.event_id").alias("event_id")
    )
