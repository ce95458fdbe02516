"""Keyed state: small sequences, and batch against stream."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import state as st
from ledgerlane.streaming.state import fold_stream

T0 = datetime(2026, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def run(step, events):
    state, outcomes = {}, []
    for e in events:
        state, outcome = step(state, e)
        outcomes.append(outcome)
    return state, outcomes


def test_upload_window_opens_at_account_creation():
    created = T0
    times = [0, 10, 20, 86399, 86400, 86401, 2 * 86400 + 1]
    _, got = run(st.upload_step(3), [{"ts": at(s), "created_at": created} for s in times])
    assert got == ["accepted", "accepted", "accepted", "refused", "accepted", "accepted", "accepted"]


def test_assistant_gap_is_strict():
    _, got = run(st.assistant_step(40, timedelta(seconds=3)), [{"ts": at(s), "created_at": T0} for s in [0, 3, 4, 6, 8]])
    assert got == ["accepted", "refused", "accepted", "refused", "accepted"]


def test_page_claims():
    seq = [("claim", 0), ("claim", 60), ("claim", 121), ("failed", 130), ("claim", 131), ("claim", 900), ("local", 901), ("claim", 902)]
    state, got = run(st.page_step, [{"kind": k, "ts": at(s)} for k, s in seq])
    assert got == ["claimed", "refused", "claimed", "stored", "claimed", "refused", "stored", "reused"]
    assert state["attempts"] == 3


def test_extraction_budget():
    seq = [("run", "a", 0), ("run", "b", 1), ("call", "a", 2), ("call", "b", 3), ("call", "a", 4), ("call", "a", 5), ("run", "c", 130),
           ("call", "c", 131), ("result", "a", 132), ("result", "c", 133), ("run", "d", 134)]
    _, got = run(st.extraction_step, [{"kind": k, "request_id": r, "ts": at(s)} for k, r, s in seq])
    assert got == ["claimed", "refused", "charged", "refused", "charged", "refused", "claimed", "charged", "dropped", "stored", "finished"]


def test_job_generations():
    seq = [("queued", 1), ("reading", 1), ("failed", 1), ("reading", 1), ("retry", 0), ("reading", 1), ("reading", 2), ("complete", 2), ("failed", 2)]
    _, got = run(st.job_step, [{"kind": k, "generation": g} for k, g in seq])
    assert got == ["queued", "reading", "failed", "ignored", "queued", "ignored", "reading", "complete", "ignored"]


def test_draft_revisions():
    seq = [(0, {"name": "A"}), (0, {"name": "A"}), (0, {"name": "B"}), (1, {"brand": "C"})]
    state, got = run(st.draft_step, [{"revision": r, "patch": p, "editable": True} for r, p in seq])
    assert got == ["saved", "repeated", "refused", "saved"] and state["fields"] == "brand:C,name:A"


def test_delivery_ledger():
    def e(kind, token, seconds, to="a@x"):
        return {"kind": kind, "token": token, "ts": at(seconds), "recipient": to}

    seq = [e("attempt", 1, 0), e("attempt", 2, 30), e("error", 1, 40), e("attempt", 3, 50), e("ok", 1, 60), e("ok", 3, 61), e("attempt", 4, 62)]
    _, got = run(st.delivery_step, seq)
    assert got == ["claimed", "busy", "retry", "claimed", "dropped", "sent", "skipped"]
    late, got = run(st.delivery_step, [e("attempt", 1, 0), e("attempt", 2, 23 * 3600)])
    assert got[-1] == "failed" and late["status"] == "failed"
    moved, got = run(st.delivery_step, [e("attempt", 1, 0), e("error", 1, 1), e("attempt", 2, 2, "b@x")])
    assert got[-1] == "skipped" and moved["status"] == "cancelled"


def test_welcome_ledger():
    def e(kind, token, seconds, to="a@x", allowed=True):
        return {"kind": kind, "token": token, "ts": at(seconds), "recipient": to, "allowed": allowed}

    seq = []
    for n in range(5):
        seq += [e("attempt", n, n * 100), e("error", n, n * 100 + 1)]
    state, got = run(st.welcome_step, seq + [e("attempt", 9, 600)])
    assert state["status"] == "failed" and got[-1] == "skipped"
    state, _ = run(st.welcome_step, [e("attempt", 1, 0, allowed=False)])
    assert state["status"] == "skipped"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("events") / "rows")
    rows = [(i, u, at(i * 1800), T0, ["queued", "reading", "failed", "retry", "complete"][(i + u) % 5], 1 + i % 3)
            for i in range(200) for u in range(3) if (i * 7 + u) % 4]
    df = spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, created_at timestamp, kind string, generation int")
    df.withColumn("document_id", F.col("user_id").cast("string")).coalesce(1).write.parquet(folder)
    return folder, df.withColumn("document_id", F.col("user_id").cast("string"))


@pytest.mark.parametrize("rule", [st.upload_quota(3), st.job_state()], ids=["quota", "jobs"])
def test_stream_equals_batch(spark, events, rule, tmp_path, request):
    folder, df = events
    batch = {(r[0], r.event_id): (r.outcome, r.state) for r in st.fold(df, rule).collect()}
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    name = "out_" + request.node.callspec.id
    q = (fold_stream(stream, rule).writeStream.format("memory").queryName(name).outputMode("append")
         .option("checkpointLocation", str(tmp_path)).trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    got = {(r[0], r.event_id): (r.outcome, r.state) for r in spark.table(name).collect()}
    assert got == batch and len(batch) == df.count()
