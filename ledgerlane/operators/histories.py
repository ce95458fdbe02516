"""Histories of a key that may be long, read in parallel.

A step ``(state, event) -> (state, outcome)`` makes each event a map from the
state before it to the state after it.  Maps of neighbours are put together, so
a chunk of a history is one map as well, and so is a group of chunks.  Once
every chunk knows the state it starts from, all are replayed side by side.

A state has a finite part and one parameter (a time, a generation).  A map
holds, for each finite part, a step function of the parameter: sorted cuts, and
for each stretch between them the finite part afterwards and the parameter,
which is a new value or the old one (moved by a number).  Equal neighbours are
merged, so a map stays small unless the events really tell so many old values
apart.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ledgerlane.session import cut_lineage

Step = Callable[[dict, dict], tuple[dict, str]]
# Events of a chunk, and chunks of a group.
CHUNK, GROUP = 512, 256


@dataclass(frozen=True)
class Splitting:
    """What is needed to split the histories of a rule.

    ``parameter`` is the member of the state that takes any value, ``unit`` the
    least step between values.  ``moves`` says that new values are counted from
    the old one; if not, values are times of events, and none is later than the
    next event.  ``finite`` are all other parts of states but the empty one.
    ``cuts`` gives the values an event compares with, at least one: the step
    takes all values below alike, and all from there on to the next.
    """

    parameter: str
    unit: Any
    finite: tuple[dict, ...]
    cuts: Callable[[dict], list]
    moves: bool = False


# --- maps -------------------------------------------------------------------
class Kept(NamedTuple):
    """The old value of the parameter, moved by ``by``."""

    by: Any


class Set(NamedTuple):
    """A new value of the parameter, or None where the state has none."""

    value: Any


class End(NamedTuple):
    finite: tuple
    parameter: Kept | Set


class Steps(NamedTuple):
    """``ends[i]`` holds below ``cuts[i]``, the last one from the last cut on."""

    cuts: tuple
    ends: tuple


class StateMap(NamedTuple):
    """Step functions by finite part, for parameters below ``bound`` (None: all)."""

    steps: dict[tuple, Steps]
    bound: Any


def _steps(cuts: list, ends: list) -> Steps:
    """Without cuts between equal ends."""
    kept = [i for i in range(len(cuts)) if ends[i] != ends[i + 1]]
    return Steps(tuple(cuts[i] for i in kept), (*(ends[i] for i in kept), ends[-1]))


def _finite(state: dict, splitting: Splitting) -> tuple:
    return tuple(sorted((k, v) for k, v in state.items() if k != splitting.parameter and v is not None))


def _known(state: dict, splitting: Splitting) -> End:
    return End(_finite(state, splitting), Set(state.get(splitting.parameter)))


def known_state(state: dict, splitting: Splitting) -> StateMap:
    """The map of a history from its start, of which only the end is told."""
    return StateMap({(): Steps((), (_known(state, splitting),))}, None)


def map_of_event(step: Step, splitting: Splitting, event: dict) -> StateMap:
    """The map of one event, by trying the step on each side of its cuts."""
    name = splitting.parameter
    bound = None if splitting.moves else event["ts"] + splitting.unit
    cuts = sorted(set(splitting.cuts(event)))
    tried = [cuts[0] - splitting.unit, *cuts]

    def end(finite: dict, old: Any) -> End:
        after, _ = step(finite | {name: old}, event)
        new = after.get(name)
        if new is None:
            change: Kept | Set = Set(None)
        elif splitting.moves:
            change = Kept(new - old)
        else:
            change = Kept(None) if new is old else Set(new)
        return End(_finite(after, splitting), change)

    table = {(): Steps((), (_known(step({}, event)[0], splitting),))}
    for finite in splitting.finite:
        table[_finite(finite, splitting)] = _steps(cuts, [end(finite, old) for old in tried])
    return StateMap(table, bound)


def _added(value: Any, by: Any) -> Any:
    return value if by is None or value is None else value + by


def then(first: StateMap, second: StateMap) -> StateMap:
    """One map after the other."""
    def through(steps: Steps) -> Steps:
        cuts, ends = [], []
        for i, end in enumerate(steps.ends):
            low = steps.cuts[i - 1] if i else None
            high = steps.cuts[i] if i < len(steps.cuts) else first.bound
            after, change = second.steps[end.finite], end.parameter
            if isinstance(change, Set):
                own = after.ends[bisect_right(after.cuts, change.value)] if change.value is not None else after.ends[0]
                ends.append(End(own.finite, Set(_added(change.value, own.parameter.by)) if isinstance(own.parameter, Kept) else own.parameter))
            else:
                # The cuts that lie inside this stretch, as seen from before it.
                seen = [c if change.by is None else c - change.by for c in after.cuts]
                start = 0 if low is None else bisect_right(seen, low)
                stop = len(seen) if high is None else bisect_left(seen, high)
                stop = max(start, stop)
                for k in range(start, stop + 1):
                    own = after.ends[k]
                    kept = own.parameter
                    if isinstance(kept, Kept):
                        kept = Kept(kept.by if change.by is None else change.by if kept.by is None else change.by + kept.by)
                    ends.append(End(own.finite, kept))
                    if k < stop:
                        cuts.append(seen[k])
            if i < len(steps.cuts):
                cuts.append(steps.cuts[i])
        return _steps(cuts, ends)

    return StateMap({finite: through(steps) for finite, steps in first.steps.items()}, first.bound)


def applied(whole: StateMap, state: dict, splitting: Splitting) -> dict:
    """The state after a map."""
    steps, old = whole.steps[_finite(state, splitting)], state.get(splitting.parameter)
    end = steps.ends[0 if old is None else bisect_right(steps.cuts, old)]
    new = _added(old, end.parameter.by) if isinstance(end.parameter, Kept) else end.parameter.value
    return dict(end.finite) | ({} if new is None else {splitting.parameter: new})


# --- on Spark ---------------------------------------------------------------
def same(left: str, right: str, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}")) for n in names])


def fold_split(events: DataFrame, rule, describe: Callable[[dict], str]) -> DataFrame:
    """Outcome of every event in (ts, event_id) order of its key.

    Events are sorted by range, so that a key with very many of them spreads
    over partitions.  A key inside one partition is read there; of one that
    goes on in another partition, chunks are read once for their maps and once
    for their outcomes.  Null keys are a key of their own.  Events of one key,
    time and id come in any order.  An empty table gives no rows.
    """
    key, step, splitting = list(rule.key), rule.step, rule.splitting
    columns = list(dict.fromkeys([*key, "event_id", "ts", *rule.columns]))
    place = [*key, "ts", "event_id"]
    source = events.select(*columns)
    out = T.StructType([*source.select(*key, "event_id").schema.fields, T.StructField("outcome", T.StringType()), T.StructField("state", T.StringType())])
    read = T.StructType([
        *out.fields, T.StructField("part", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("map", T.BinaryType()),
        T.StructField("events", T.ArrayType(source.schema))])
    read_arrow, out_arrow = to_arrow_schema(read), to_arrow_schema(out)

    def replay(state: dict, chunk: list[dict]) -> tuple[dict, list[dict]]:
        rows = []
        for event in chunk:
            state, outcome = step(state, event)
            rows.append({k: event[k] for k in [*key, "event_id"]} | {"outcome": outcome, "state": describe(state)})
        return state, rows

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Outcomes of keys that start in this partition.  Of its first key, which
        may have started before, chunks with their maps; of its last key, which
        may go on, the state so far."""
        part, current, first, state, chunk, number = TaskContext.get().partitionId(), None, True, {}, [], 0
        rows: list[dict] = []

        def opened() -> None:
            nonlocal chunk, number
            maps = [map_of_event(step, splitting, event) for event in chunk]
            rows.append({k: v for k, v in zip(key, current)} | {"part": part, "chunk": number, "map": pickle.dumps(reduce(then, maps)), "events": chunk})
            chunk, number = [], number + 1

        for batch in batches:
            for event in batch.to_pylist():
                owner = tuple(event[k] for k in key)
                if owner != current:
                    if chunk:
                        opened()
                    first, current, state = current is None, owner, {}
                if first:
                    chunk.append(event)
                    if len(chunk) == CHUNK:
                        opened()
                else:
                    state, outcome = replay(state, [event])
                    rows.extend(outcome)
            yield from pa.Table.from_pylist(rows, schema=read_arrow).to_batches()
            rows.clear()
        if chunk:
            opened()
        elif current is not None and not first:
            rows.append({k: v for k, v in zip(key, current)} | {
                "part": part, "chunk": 0, "map": pickle.dumps(known_state(state, splitting)), "events": []})
        yield from pa.Table.from_pylist(rows, schema=read_arrow).to_batches()

    done = cut_lineage(source.repartitionByRange(*place).sortWithinPartitions(*place).mapInArrow(walk, read))
    settled = done.filter("map IS NULL").select(*out.names)

    # Only maps are brought together by key; events stay where they are.
    by_place = Window.partitionBy(*key).orderBy("part", "chunk")
    chunks = done.filter("map IS NOT NULL")
    maps = chunks.select(*key, "part", "chunk", "map").withColumn("n", F.row_number().over(by_place).cast("long") - 1)
    maps = cut_lineage(maps.withColumn("group", F.floor(F.col("n") / GROUP)))
    grouped = T.StructType([*maps.select(*key, "group", "map").schema.fields])
    entry = T.StructField("entry", T.BinaryType())
    group_starts = T.StructType([*maps.select(*key, "group").schema.fields, entry])
    chunk_starts = T.StructType([*maps.select(*key, "part", "chunk").schema.fields, entry])
    grouped_arrow = to_arrow_schema(grouped)

    def joined(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["n"])
        whole = reduce(then, [pickle.loads(r["map"]) for r in rows])
        return pa.Table.from_pylist([{k: rows[0][k] for k in [*key, "group"]} | {"map": pickle.dumps(whole)}], schema=grouped_arrow)

    def entries(order: str, schema: T.StructType):
        """Where each row of a group of maps starts from."""
        arrow = to_arrow_schema(schema)

        def run(table: pa.Table) -> pa.Table:
            rows = sorted(table.to_pylist(), key=lambda r: r[order])
            state, found = pickle.loads(rows[0]["entry"]) if "entry" in rows[0] else {}, []
            for row in rows:
                found.append({k: row[k] for k in schema.names if k != "entry"} | {"entry": pickle.dumps(state)})
                state = applied(pickle.loads(row["map"]), state, splitting)
            return pa.Table.from_pylist(found, schema=arrow)

        return run

    groups = maps.groupBy(*key, "group").applyInArrow(joined, grouped)
    firsts = groups.groupBy(*key).applyInArrow(entries("group", group_starts), group_starts)
    known = maps.alias("m").join(firsts.alias("g"), same("m", "g", [*key, "group"])).select("m.*", "g.entry")
    starts = known.groupBy(*key, "group").applyInArrow(entries("n", chunk_starts), chunk_starts)
    # By a merge, which deals the chunks of a key over all partitions.
    ready = chunks.select(*key, "part", "chunk", "events").alias("c").join(
        starts.hint("merge").alias("s"), same("c", "s", [*key, "part", "chunk"])).select("c.events", "s.entry")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from pa.Table.from_pylist(replay(pickle.loads(row["entry"]), row["events"])[1], schema=out_arrow).to_batches()

    return settled.unionByName(ready.mapInArrow(run, out))
