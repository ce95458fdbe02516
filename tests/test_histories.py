"""Histories read in parallel against the step, one event after another."""

import random
from collections import Counter
from datetime import datetime, timedelta, timezone
from functools import reduce

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import histories as hs
from ledgerlane.operators import state as st

T0 = datetime(2026, 1, 1, tzinfo=timezone.utc)
RULES = {"pages": st.page_claims(), "jobs": st.job_state()}


def history(seed, n, dense):
    """Times with many ties, bursts and long pauses."""
    rng, now, events = random.Random(seed), T0, []
    created = T0 + timedelta(hours=rng.randrange(60) - 30)
    for i in range(n):
        now += timedelta(seconds=rng.choice([0, 0, 1, 30, 119, 120, 121] if dense else [0, 600, 3599, 3600, 3601, 30_000, 86_399, 86_400, 90_000]))
        events.append({
            "event_id": i, "ts": now, "user_id": "hot", "document_id": "hot", "page_index": 0, "created_at": created,
            "kind": rng.choice(["claim", "claim", "failed", "done", "local", "reading", "extracting", "complete", "retry", "queued"]), "generation": rng.choice([1, 1, 2, 3, 4, None])})
    return events


def kinds_for(rule, events):
    pages = {"claim", "done", "local"}
    return [e for e in events if e["kind"] == "failed" or (e["kind"] in pages) == (rule.step is st.page_step)]


@pytest.mark.parametrize("name", RULES)
@pytest.mark.parametrize("dense", [False, True])
def test_a_map_is_the_steps_in_a_row(name, dense):
    rule = RULES[name]
    events = kinds_for(rule, history(1, 160, dense))
    states, state = [{}], {}
    for event in events:
        state, _ = rule.step(state, event)
        states.append(state)
    maps = [hs.map_of_event(rule.step, rule.splitting, event) for event in events]
    for low, high in [(0, len(events)), (0, 7), (5, 60), (40, 41), (10, len(events))]:
        in_a_row = reduce(hs.then, maps[low:high])
        mid = (low + high) // 2
        in_halves = hs.then(reduce(hs.then, maps[low:mid]), reduce(hs.then, maps[mid:high])) if mid > low else in_a_row
        for table in (in_a_row, in_halves):
            got = {k: v for k, v in hs.applied(table, states[low], rule.splitting).items() if v is not None}
            assert got == {k: v for k, v in states[high].items() if v is not None}, (low, high)
            assert sum(len(steps.cuts) for steps in table.steps.values()) <= 8 * len(rule.splitting.finite)


def test_maps_of_settled_histories_are_small():
    """A long chunk leaves a state that hardly depends on the one before."""
    rule = RULES["jobs"]
    whole = reduce(hs.then, [hs.map_of_event(rule.step, rule.splitting, e) for e in kinds_for(rule, history(3, 400, False))])
    assert max(len(steps.cuts) for steps in whole.steps.values()) <= 8


@pytest.mark.parametrize("name", RULES)
def test_a_key_with_most_events(spark, monkeypatch, name):
    """Its chunks come from all partitions, and rows are as one after another."""
    monkeypatch.setattr(hs, "CHUNK", 16)
    monkeypatch.setattr(hs, "GROUP", 4)
    rule = RULES[name]
    events = history(7, 900, False)
    for i, event in enumerate(history(8, 300, True)):
        key = random.Random(i).choice(["a", "b", "c", "d", None, "zz"])
        events.append(event | {"event_id": 1000 + i, "user_id": key, "document_id": key})
    events = kinds_for(rule, events)
    schema = "event_id long, ts timestamp, user_id string, document_id string, page_index int, created_at timestamp, kind string, generation int"
    df = spark.createDataFrame(events, schema).withColumn("part", F.lit(1)).repartition(6)
    got = Counter(tuple(r) for r in st.fold(df, rule).collect())
    want, states = Counter(), {}
    for event in sorted(events, key=lambda e: (e["ts"], e["event_id"])):
        owner = tuple(event[k] for k in rule.key)
        states[owner], outcome = rule.step(states.get(owner, {}), event)
        want[(*owner, event["event_id"], outcome, st.describe(states[owner]))] += 1
    assert got == want


def test_the_work_of_one_key_is_spread(spark, monkeypatch):
    monkeypatch.setattr(hs, "CHUNK", 16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the rows are few
    rule = RULES["jobs"]
    events = [e | {"kind": "reading"} for e in history(9, 2000, False)]
    df = spark.createDataFrame(events, "event_id long, ts timestamp, document_id string, kind string, generation int")
    out = st.fold(df.repartition(3), rule)
    shares = [n for (n,) in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(shares) == 2000 and len(shares) >= 3 and max(shares) <= 1000


def test_nothing(spark):
    empty = spark.createDataFrame([], "event_id long, ts timestamp, document_id string, kind string, generation int")
    assert st.fold(empty, st.job_state()).collect() == []
