"""The trie of all beginnings of conversations.

Every turn has a 16-byte name (md5 of role and text), a conversation is the
row of its names, and all conversations are sorted by range of these rows, so
that copies of one conversation spread over partitions.  ``lcp`` is how many
turns a conversation shares with the one before it.  A beginning of ``d``
turns stands for the interval of neighbours whose ``lcp`` is at least ``d``;
a sparse table of range minima over ``lcp`` lets each beginning search the
left and right end of its interval by itself, all of a block at once.

Sums over a subtree are differences of running sums:

* conversation ``i`` adds to each beginning it shares with the one before, so
  saved bytes are ``sum(C[i]) - others * B[d - 1]``, where ``B`` is the bytes
  of the first turns and ``C[i]`` is ``B`` at ``lcp[i]``;
* a leaf ends where the next conversation shares less than the whole.

Blocks have a bounded size.  A beginning whose interval goes on in another
block is known by the digest of its names; its parts are added up by that.
There are at most as many of them as a block's first and last conversation
have turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ledgerlane.llm.common import saved, small_batches, small_side

NAME = 16
# Turns of a piece of a long conversation; conversations and turns of a block.
PIECE_TURNS = 4096
BLOCK_ROWS, BLOCK_TURNS = 1 << 16, 1 << 18
# Beginnings across blocks are broadcast up to so many (40 bytes each).
BROADCAST_OPEN = 500_000
EMPTY = hashlib.sha256(b"").hexdigest()


# --- rows of names --------------------------------------------------------
_PIECES = "conv_id bigint, part int, piece int, names string, sizes array<bigint>"


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to pieces of conversations."""
    part = TaskContext.get().partitionId()
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int32()), ("names", pa.string()), ("sizes", pa.list_(pa.int64()))])
    current, number, names, sizes, rows = None, 0, [], [], []

    def close() -> None:
        if names:
            rows.append({"conv_id": current, "part": part, "piece": number, "names": "".join(names), "sizes": sizes})

    for batch in batches:
        for conv, name, size in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if conv != current or len(names) == PIECE_TURNS:
                close()
                number = number + 1 if conv == current else 0
                current, names, sizes = conv, [], []
            names.append(name)
            sizes.append(size)
        yield from pa.Table.from_pylist(rows, schema=schema).to_batches()
        rows.clear()
    close()
    yield from pa.Table.from_pylist(rows, schema=schema).to_batches()


def sequences(conversations: DataFrame) -> DataFrame:
    """``conv_id, names, sizes``: names of a conversation's turns in a row, and
    the bytes of their texts."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    name = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    turns = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name.alias("name"),
        F.octet_length(text).cast("long").alias("size"))
    place = ["conv_id", "turn", "name"]
    sorted_turns = turns.repartitionByRange(*place).sortWithinPartitions(*place).select("conv_id", "name", "size")
    pieces = sorted_turns.mapInArrow(_in_pieces, _PIECES)
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "piece", "names", "sizes"))).alias("pieces"))
    return whole.select(
        "conv_id", F.unhex(F.array_join(F.transform("pieces", lambda p: p["names"]), "")).alias("names"),
        F.flatten(F.transform("pieces", lambda p: p["sizes"])).alias("sizes"))


def rebuilt(rows: DataFrame) -> DataFrame:
    """Each conversation with the first turns of another one before its own."""
    base = rows.filter("conv_id % 5 = 0").select(
        F.col("conv_id").alias("base_id"), F.substring("names", 1, 8 * NAME).alias("base_names"), F.slice("sizes", 1, 8).alias("base_sizes"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).cast("int")
    joined = rows.withColumn("h", h).withColumn("base_id", F.expr("conv_id - conv_id % 5")).join(base, "base_id", "left")
    own = F.substr("names", F.col("h") * NAME + 1, F.octet_length("names"))
    names = F.concat(F.coalesce(F.substr("base_names", F.lit(1), F.col("h") * NAME), F.lit(b"")), own)
    sizes = F.concat(
        F.coalesce(F.slice("base_sizes", F.lit(1), F.col("h")), F.array().cast("array<bigint>")),
        F.slice("sizes", F.col("h") + 1, F.size("sizes")))
    return joined.select("conv_id", names.alias("names"), sizes.alias("sizes"))


# --- blocks ---------------------------------------------------------------
def shared(a: bytes, b: bytes) -> int:
    """Names at the beginning of both."""
    n = min(len(a), len(b)) // NAME
    x = np.frombuffer(a, dtype=np.uint64, count=2 * n)
    y = np.frombuffer(b, dtype=np.uint64, count=2 * n)
    other = np.flatnonzero(x != y)
    return int(other[0]) // 2 if len(other) else n


_BLOCKS = (
    "part int, block int, conv_ids array<bigint>, lcps array<bigint>, lengths array<bigint>, sizes array<bigint>, "
    "first binary, last binary, after bigint"
)
_BLOCK_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("conv_ids", "lcps", "lengths", "sizes")],
    ("first", pa.binary()), ("last", pa.binary()), ("after", pa.int64()),
])


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted conversations to blocks.

    ``lcps`` begins with -1, and ``after`` is null, where another partition
    would have to be asked.
    """
    part = TaskContext.get().partitionId()
    number, before, rows = 0, None, {c: [] for c in ("conv_ids", "lcps", "lengths", "sizes")}
    first = b""

    def block(after: int | None) -> Iterator[pa.RecordBatch]:
        row = {"part": part, "block": number, **rows, "first": first, "last": before, "after": after}
        yield from pa.Table.from_pylist([row], schema=_BLOCK_ARROW).to_batches()

    for batch in batches:
        for conv, names, sizes in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            lcp = -1 if before is None else shared(before, names)
            if len(rows["conv_ids"]) >= BLOCK_ROWS or len(rows["sizes"]) >= BLOCK_TURNS:
                yield from block(lcp)
                number, rows = number + 1, {c: [] for c in rows}
            if not rows["conv_ids"]:
                first = names
            rows["conv_ids"].append(conv)
            rows["lcps"].append(lcp)
            rows["lengths"].append(len(names) // NAME)
            rows["sizes"].extend(sizes)
            before = names
    if rows["conv_ids"]:
        yield from block(None)


@F.pandas_udf(LongType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return a.combine(b, lambda x, y: -1 if x is None or y is None else shared(bytes(x), bytes(y)))


def _with_neighbours(blocks: DataFrame) -> DataFrame:
    """What the first and last conversation of a partition share with the
    partitions beside it (one row for each partition is compared)."""
    ends = blocks.groupBy("part").agg(F.min_by("first", "block").alias("first"), F.max_by("last", "block").alias("last"), F.max("block").alias("final"))
    ends = ends.withColumn("before", F.lag("last").over(Window.orderBy("part")))
    ends = ends.withColumn("left", _shared("before", "first"))
    ends = ends.select("part", "final", "left", F.lead("left", 1, -1).over(Window.orderBy("part")).alias("right"))
    joined = blocks.join(ends, "part")
    left = F.when(F.col("block") == 0, F.col("left")).otherwise(F.get("lcps", F.lit(0)))
    right = F.when(F.col("block") == F.col("final"), F.col("right")).otherwise(F.col("after"))
    return joined.select("part", "block", "conv_ids", "lcps", "lengths", "sizes", "first", "last", left.alias("left"), right.alias("right"))


# --- intervals ------------------------------------------------------------
class Minima:
    """A sparse table: least values of all stretches of 2 ** k."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half = 1 << (len(self.rows) - 1)
            self.rows.append(np.minimum(self.rows[-1][:-half], self.rows[-1][half:]))

    def within(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value from ``low`` to ``high``, both included."""
        power = np.frexp((high - low + 1).astype(np.float64))[1] - 1
        out = np.empty(len(low), dtype=np.int64)
        for k in np.unique(power):
            some = power == k
            out[some] = np.minimum(self.rows[k][low[some]], self.rows[k][high[some] - (1 << k) + 1])
        return out

    def last(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The last place such that all values after ``at`` up to it reach ``least``."""
        end, n = at.copy(), len(self.rows[0])
        for k in range(len(self.rows) - 1, -1, -1):
            step = 1 << k
            fits = end + step < n
            fits[fits] = self.rows[k][end[fits] + 1] >= least[fits]
            end[fits] += step
        return end

    def first(self, at: np.ndarray, least: np.ndarray) -> np.ndarray:
        """The first place such that all values after it up to ``at`` reach ``least``."""
        start = at.copy()
        for k in range(len(self.rows) - 1, -1, -1):
            step = 1 << k
            fits = start - step >= 0
            fits[fits] = self.rows[k][start[fits] - step + 1] >= least[fits]
            start[fits] -= step
        return start


def _paths(names: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` names."""
    running, out = hashlib.sha256(), [hashlib.sha256(b"").digest()[:NAME]]
    for d in range(depth):
        running.update(names[d * NAME:(d + 1) * NAME])
        out.append(running.copy().digest()[:NAME])
    return out


# ``key`` is the digest of a beginning that goes on in other blocks; ``up`` is
# its parent's, where that goes on.
_NODES = (
    "part int, block int, depth bigint, key binary, up binary, conv_id bigint, parent_conv_id bigint, n_convs bigint, "
    "n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string, ends string"
)
_NODE_ARROW = pa.schema([
    ("part", pa.int32()), ("block", pa.int32()), ("depth", pa.int64()), ("key", pa.binary()), ("up", pa.binary()),
    *[(c, pa.int64()) for c in ("conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")],
    ("ends_sha256", pa.string()), ("ends", pa.string()),
])


def block_nodes(row: dict) -> pa.Table:
    """All beginnings of a block, those that come in from the left too."""
    ids = np.array(row["conv_ids"], dtype=np.int64)
    lcps, lengths = np.array(row["lcps"], dtype=np.int64), np.array(row["lengths"], dtype=np.int64)
    left, right, n = row["left"], row["right"], len(ids)
    lcps[0] = left
    # Bytes of the first d turns of conversation i: totals[offsets[i] + d].
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)])
    steps = np.zeros(offsets[-1], dtype=np.int64)
    steps[np.delete(np.arange(offsets[-1]), offsets[:-1])] = row["sizes"]
    totals = np.cumsum(steps)
    starts = totals[offsets[:-1]]

    def bytes_to(i: np.ndarray, d: np.ndarray) -> np.ndarray:
        return totals[offsets[i] + d] - starts[i]

    # A node for each depth that its conversation does not share with the one
    # before; the first conversation has one for every depth of its own.
    own = np.maximum(lcps, -1) + 1
    own[0] = 0
    counts = lengths - own + 1
    counts[counts < 0] = 0
    base = np.concatenate([[0], np.cumsum(counts)])
    i = np.repeat(np.arange(n), counts)
    d = np.arange(base[-1]) - base[i] + own[i]

    minima = Minima(lcps)
    end = minima.last(i, d)
    members = end - i + 1
    comes_in = (i == 0) & (d <= left)
    goes_on = (end == n - 1) & (d <= right)
    leaf = np.concatenate([lcps[1:], [right]]) < lengths
    leaves = np.concatenate([[0], np.cumsum(leaf)])
    shared_bytes = np.concatenate([[0], np.cumsum(bytes_to(np.arange(n), np.maximum(lcps, 0)))])
    # Members other than the first of all.
    start = i + 1 - comes_in
    before = np.where(d > 0, bytes_to(i, np.maximum(d - 1, 0)), 0)
    saved_bytes = shared_bytes[end + 1] - shared_bytes[start] - (end + 1 - start) * before

    # The parent's interval, from the node's own place.
    inner = d > 0
    up_start = minima.first(i[inner], d[inner] - 1)
    up_end = minima.last(i[inner], d[inner] - 1)
    parent = base[up_start] + d[inner] - 1 - own[up_start]
    children = np.bincount(parent[~comes_in[inner]], minlength=len(i))
    smallest = Minima(ids)
    conv = smallest.within(i, end)
    parent_conv = np.full(len(i), -1, dtype=np.int64)
    parent_conv[inner] = smallest.within(up_start, up_end)

    crossing = comes_in | goes_on
    up_crossing = np.zeros(len(i), dtype=bool)
    up_crossing[inner] = crossing[parent]
    on_left, on_right = _paths(row["first"], max(left, 0)), _paths(row["last"], max(right, 0))

    def digest(k: int) -> bytes:
        return on_left[d[k]] if comes_in[k] else on_right[d[k]]

    keys: list[bytes | None] = [None] * len(i)
    for k in np.flatnonzero(crossing):
        keys[k] = digest(k)
    ups: list[bytes | None] = [None] * len(i)
    parents = np.zeros(len(i), dtype=np.int64)
    parents[inner] = parent
    for k in np.flatnonzero(up_crossing):
        ups[k] = digest(parents[k])

    # Conversations of exactly d turns stand at the start of their interval.
    hashes: list[str | None] = [None] * len(i)
    texts: list[str | None] = [None] * len(i)
    ended = np.flatnonzero((d == lengths[i]))
    equal = np.concatenate([[False], (lcps[1:] == lengths[1:]) & (lengths[1:] == lengths[:-1])])
    bounds = np.append(np.flatnonzero(~equal), n)
    for k in ended:
        if comes_in[k] and left != lengths[0]:
            continue
        stop = bounds[np.searchsorted(bounds, i[k], side="right")]
        text = ",".join(map(str, ids[i[k]:stop].tolist()))
        if crossing[k]:
            texts[k] = text
        else:
            hashes[k] = hashlib.sha256(text.encode()).hexdigest()

    return pa.table([
        pa.array(np.full(len(i), row["part"], dtype=np.int32)), pa.array(np.full(len(i), row["block"], dtype=np.int32)), pa.array(d),
        pa.array(keys, pa.binary()), pa.array(ups, pa.binary()), pa.array(conv), pa.array(parent_conv, mask=~inner), pa.array(members), pa.array(children),
        pa.array(leaves[end + 1] - leaves[i]), pa.array(saved_bytes), pa.array(hashes, pa.string()), pa.array(texts, pa.string()),
    ], schema=_NODE_ARROW)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield from block_nodes(batch.slice(k, 1).to_pylist()[0]).to_batches(max_chunksize=1 << 14)


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of ids in several blocks, which come in order."""
    schema = pa.schema([("key", pa.binary()), ("depth", pa.int64()), ("ends_sha256", pa.string())])
    current, running = None, None

    def closed() -> Iterator[pa.RecordBatch]:
        if running is not None:
            yield from pa.Table.from_pylist([{"key": current[0], "depth": current[1], "ends_sha256": running.hexdigest()}], schema=schema).to_batches()

    for batch in batches:
        for key, depth, text in zip(*[batch.column(i).to_pylist() for i in range(3)]):
            if (key, depth) != current:
                yield from closed()
                current, running = (key, depth), hashlib.sha256()
            else:
                running.update(b",")
            running.update(text.encode())
    yield from closed()


def trie(rows: DataFrame) -> DataFrame:
    """All beginnings of the sequences ``rows`` (conv_id, names, sizes).

    Returns per beginning ``conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256``.  An empty table has none, not even
    the empty beginning.
    """
    spark = rows.sparkSession
    small_batches(spark)
    order = ["names", "conv_id"]
    ordered = rows.select("conv_id", "names", "sizes").repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = saved(ordered.mapInArrow(_in_blocks, _BLOCKS), "blocks")
    nodes = saved(_with_neighbours(blocks).mapInArrow(_nodes, _NODES), "nodes")

    open_nodes = nodes.filter("key IS NOT NULL")
    added = open_nodes.groupBy("depth", "key").agg(
        F.first("up", ignorenulls=True).alias("up"), F.min("conv_id").alias("conv_id"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    pieces = open_nodes.filter("ends IS NOT NULL").select("key", "depth", "ends", "part", "block")
    ends = pieces.repartition("key", "depth").sortWithinPartitions("key", "depth", "part", "block").select("key", "depth", "ends")
    ends = ends.mapInArrow(_ends, "key binary, depth bigint, ends_sha256 string")
    added = saved(added.join(ends, ["key", "depth"], "left"), "open-nodes")

    columns = ["depth", "up", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    parents = added.select((F.col("depth") + 1).alias("depth"), F.col("key").alias("up"), F.col("conv_id").alias("parent_conv_id"))
    asking = nodes.filter("key IS NULL AND up IS NOT NULL").select(*columns).unionByName(added.select(*columns))
    found = asking.join(small_side(parents, F.lit(1), BROADCAST_OPEN), ["depth", "up"], "left")
    settled = nodes.filter("key IS NULL AND up IS NULL")
    result = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    return settled.select(*result).unionByName(found.select(*result))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt ``conversations`` (conv_id, turn, role, text;
    more columns are ignored).

    Turns are taken by number, nulls first, turns of one number by the digest
    of role and text; repeated rows are turns of their own.  A null role or
    text is empty.  Rows without a conv_id belong to no conversation.  A text
    of any length is one 16-byte name; the names of one conversation stand in
    one row.  An empty table gives no rows.
    """
    return trie(rebuilt(saved(sequences(conversations), "sequences")))
