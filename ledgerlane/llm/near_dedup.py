"""Near duplicates by min-max hashing.

Each permutation of the shingles gives two values of a text's signature, its
minimum and its maximum, so a signature of 128 values takes 64 evaluations per
shingle.  Both agree between two texts with probability J, the Jaccard
similarity of their shingle sets.  A band is the two minima and two maxima of
two permutations; with 32 bands a pair at J = 0.75 shares no band with a
probability of (1 - 0.75^4)^32, about 5 in a million.

Texts that share a band are candidates.  Their links are confirmed on the full
shingle sets in two steps:

1. Every member of a band is compared with one hub only: the member that
   shares bands with the most texts, which of the edited copies of a text is
   likely the text itself.  That settles copies, however many there are.
2. Where a band still holds more than one component, its members are dealt in
   blocks; each pair of blocks is one small unit of a task.  Pairs of different
   components are passed on if their signatures agree well enough and if they
   can be similar at all: what two texts have in common is at most the smaller
   of their overlaps with the hub, and what they share outside the hub.  Edited
   copies that are too far from the hub fall to that bound, so a group of them
   is not compared pair by pair on its sets.  No size is capped, no pair that
   may be a link is skipped.

Short sets (up to ``SHORT`` shingles) leave a band too little to agree on, so
among them no link is left to chance: each also stands in a band for each of its
rarest shingles, as many as two linked sets must have one of in common, and in
step 2 their overlap is counted instead of estimated.  A text linked to one of
up to 20 shingles has at most 26.

Texts with equal shingle sets are one node throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut, small_batches, small_side
from ledgerlane.llm.components import components
from ledgerlane.llm.words import distinct, mixed, pieces, runs, words_of

WORDS = 5
SIMILARITY = 75  # percent
PERMUTATIONS = 64
BANDS = 32
# Pairs of sets of up to this many shingles are found without chance.
SHORT = 26
# Members of a block that is compared with another one in one step.
BLOCK = 256
# Part of the 128 one-byte values that must agree before a pair of step 2 is
# confirmed on its sets: at J = 0.75, five deviations below the mean.  Pairs of
# short sets do not pass through it.
SIGN = 0.55
# Similarity to the hub from which on what lies outside the hub is noted.
NOTED = 35
# Ids that may be broadcast to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000

_FACTORS = mixed(np.arange(1000, 1000 + PERMUTATIONS, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mixed(np.arange(5000, 5000 + PERMUTATIONS, dtype=np.uint64))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation, one row per (non-empty) set."""
    starts = bounds[:-1]
    out = np.empty((len(starts), 2 * PERMUTATIONS), dtype=np.uint64)
    for p in range(PERMUTATIONS):
        permuted = values * _FACTORS[p] + _SHIFTS[p]
        out[:, 2 * p] = np.minimum.reduceat(permuted, starts)
        out[:, 2 * p + 1] = np.maximum.reduceat(permuted, starts)
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; equal keys mean the same band and values."""
    width = signature.shape[1] // BANDS
    keys = np.tile(mixed(np.arange(77, 77 + BANDS, dtype=np.uint64)), (len(signature), 1))
    for k in range(width):
        keys = mixed((keys ^ signature[:, k::width]) * np.uint64(0x9E3779B97F4A7C15))
    return keys


def _shingles(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    return distinct(*runs(*words_of(texts), words))


def _sign(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                values, bounds = _shingles(piece.column(1), words)
                sizes = np.diff(bounds)
                some = np.flatnonzero(sizes)
                n = piece.num_rows
                sums = np.zeros((2, n), dtype=np.uint64)
                keys, signs, short_sets = [None] * n, [None] * n, [None] * n
                if len(some):
                    starts = bounds[:-1][some]
                    for k, seed in enumerate((1, 2)):
                        sums[k, some] = np.add.reduceat(mixed(values + np.uint64(seed)), starts)
                    signature = signatures(values, np.append(starts, bounds[-1]))
                    short = (mixed(signature) >> np.uint64(56)).astype(np.uint8)
                    for i, row, sign in zip(some, bands(signature).view(np.int64), short):
                        keys[i], signs[i] = row, sign.tobytes()
                    for i in np.flatnonzero((sizes > 0) & (sizes <= SHORT)):
                        short_sets[i] = values[bounds[i]:bounds[i + 1]].view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(sizes), *[pa.array(s.view(np.int64)) for s in sums],
                     pa.array(keys, type=pa.list_(pa.int64())), pa.array(signs, type=pa.binary()),
                     pa.array(short_sets, type=pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "sum_a", "sum_b", "bands", "sign", "small"],
                )

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                values, bounds = _shingles(piece.column(1), words)
                data = [values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(data, type=pa.binary())], names=["id", "shingles"])

    return run


def _measure(percent: int):
    """Overlap of the sets of ``a`` and ``b``, whether they are linked, and (at
    ``NOTED`` percent or more) the values of ``b`` that ``a`` lacks, in 32 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ones, twos = batch.column(2), batch.column(3)
            common, linked, outside = [], [], []
            for i in range(batch.num_rows):
                one, two = (np.frombuffer(c[i].as_buffer(), dtype=np.uint64) for c in (ones, twos))
                at = np.searchsorted(one, two)
                at[at == len(one)] = 0
                inside = one[at] == two
                n = int(inside.sum())
                union = len(one) + len(two) - n
                common.append(n)
                linked.append(100 * n >= percent * union)
                outside.append((two[~inside] >> np.uint64(32)).astype("<u4").tobytes() if 100 * n >= NOTED * union else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(common, type=pa.int64()), pa.array(linked, type=pa.bool_()),
                                              pa.array(outside, type=pa.binary())], names=["a", "b", "common", "linked", "outside"])

    return run


def _measured(docs: DataFrame, pairs: DataFrame, words: int, percent: int) -> DataFrame:
    """``a, b, common, linked, outside`` of the pairs, from full shingle sets."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = small_side(wanted, F.lit(1), BROADCAST_IDS)
    texts = docs.join(wanted, docs["doc_id"] == wanted["id"], "left_semi").select("doc_id", "text")
    sets = cut(texts.mapInArrow(_sets(words), "id long, shingles binary")).dropDuplicates(["id"])
    one = sets.select(F.col("id").alias("a"), F.col("shingles").alias("one"))
    two = sets.select(F.col("id").alias("b"), F.col("shingles").alias("two"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "one", "two")
    return both.mapInArrow(_measure(percent), "a long, b long, common long, linked boolean, outside binary")


def _compare_blocks(percent: int):
    """Rows sorted by unit: pairs of members whose signatures are close.

    A unit is one block of a band, or two; it has at most 2 * BLOCK members.
    """

    def compared(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        side, node, size, component = (rows.column(k).to_numpy() for k in range(3, 7))
        # Overlap with the hub and what lies outside it, where noted.
        common = rows.column(7).fill_null(-1).to_numpy()
        outs = [np.frombuffer(o or b"", dtype="<u4") for o in rows.column(8).to_pylist()]
        sign = np.frombuffer(b"".join(rows.column(9).to_pylist()), dtype=np.uint8).reshape(len(node), -1)
        flat = np.concatenate(outs)
        owner = np.repeat(np.arange(len(outs)), [len(o) for o in outs])
        left = np.flatnonzero(side != 1)
        right = np.flatnonzero(side != 0)
        need = SIGN * sign.shape[1]
        small = rows.column(10).combine_chunks()
        owners = np.repeat(np.arange(len(node)), small.value_lengths().fill_null(0).to_numpy())
        codes = np.unique(small.flatten().to_numpy(), return_inverse=True)[1]
        starts = np.searchsorted(owners, np.arange(len(node) + 1))
        mark = np.zeros(len(codes) + 1, dtype=bool)
        a, b = [node[:0]], [node[:0]]
        for i in left:
            other = right[right > i] if side[i] == 2 else right
            fits = (component[other] != component[i]) & (100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i]))
            other = other[fits]
            if size[i] <= SHORT and len(other):
                own = codes[starts[i]:starts[i + 1]]
                mark[own] = True
                overlap = np.bincount(owners[mark[codes]], minlength=len(node))
                mark[own] = False
                short = other[size[other] <= SHORT]
                short = short[100 * overlap[short] >= percent * (size[short] + size[i] - overlap[short])]
                a.append(np.minimum(node[i], node[short]))
                b.append(np.maximum(node[i], node[short]))
                other = other[size[other] > SHORT]
            other = other[(sign[other] == sign[i]).sum(axis=1) >= need]
            if len(other) and common[i] >= 0:
                shared = np.bincount(owner[np.isin(flat, outs[i])], minlength=len(node))[other]
                most = np.minimum(common[other], common[i]) + shared
                possible = (common[other] < 0) | (100 * most >= percent * (size[other] + size[i] - most))
                other = other[possible]
            a.append(np.minimum(node[i], node[other]))
            b.append(np.maximum(node[i], node[other]))
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            rest = yield from units(table, last=False)
        if rest is not None:
            yield from units(rest, last=True)

    def units(table: pa.Table, last: bool):
        table = table.combine_chunks()
        keys = [table.column(k).to_numpy() for k in range(3)]
        if not len(table):
            return table
        change = np.zeros(len(table) - 1, dtype=bool)
        for k in keys:
            change |= k[1:] != k[:-1]
        bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [len(table)]])
        stop = len(bounds) - 1 if last else len(bounds) - 2
        a, b = [], []
        for s, e in zip(bounds[:stop], bounds[1:stop + 1]):
            x, y = compared(table.slice(s, e - s))
            a.append(x)
            b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], names=["a", "b"])
        return table.slice(bounds[stop])

    return run


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                percent: int = SIMILARITY) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    ``component_id`` is the smallest id that links reach, itself included;
    ``kept`` holds for that id.  A null text, or one without words, has no
    shingles and is linked with nothing.  Rows that repeat an id are one
    document and share its fate.  A row with a null id is returned with a null
    component, kept, and linked with nothing.  An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = cut(texts.mapInArrow(_sign(words), "doc_id long, n_shingles long, sum_a long, sum_b long, bands array<long>, sign binary, small array<long>"))
    identity = ["n_shingles", "sum_a", "sum_b"]
    nodes = cut(
        signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy(*identity)
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sign").alias("sign"), F.first("small").alias("small"))
    )
    members = nodes.select("node", F.col("n_shingles").alias("size"), F.explode("bands").alias("band")).unionByName(_rare(nodes, percent))
    shared = members.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    in_shared = cut(members.join(shared, "band").select("band", "node", "size", "members"))
    degrees = in_shared.groupBy("node").agg(F.sum("members").alias("degree"))
    hubs = cut(
        in_shared.join(degrees, "node").groupBy("band")
        .agg(F.max(F.struct("degree", (-F.col("node")).alias("minus"), F.col("size").alias("hub_size"))).alias("hub"))
        .select("band", (-F.col("hub.minus")).alias("hub"), "hub.hub_size")
    )
    starred = cut(in_shared.join(hubs, "band"))
    near_size = 100 * F.least("size", "hub_size") >= percent * F.greatest("size", "hub_size")
    stars = cut(starred.filter((F.col("node") != F.col("hub")) & near_size).select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct())
    measured = cut(_measured(texts, stars, words, percent))
    links = measured.filter("linked").select("a", "b")
    labels = cut(components(links))

    # What shares a band and is not yet one component.
    labelled = starred.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed_bands = labelled.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    noted = measured.filter("outside IS NOT NULL").select(F.col("a").alias("hub"), F.col("b").alias("node"), F.col("common"), "outside")
    own = F.col("node") == F.col("hub")
    open_members = labelled.join(mixed_bands, "band").join(noted, ["hub", "node"], "left").select(
        "band", "members", "node", "size", "component", F.when(own, F.col("size")).otherwise(F.col("common")).alias("common"), "outside")
    rest = cut(_close_pairs(open_members, nodes.select("node", "sign", "small"), percent).distinct())
    more = _measured(texts, rest, words, percent).filter("linked").select("a", "b")
    all_labels = _joined(labels, cut(more))

    parts = signed.select("doc_id", *identity).join(nodes.select("node", *identity), identity, "left")
    found = parts.join(all_labels, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node", "doc_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _rare(nodes: DataFrame, percent: int) -> DataFrame:
    """``node, size, band``: a band for each of the rarest shingles of short sets.

    Of ``n`` shingles, linked sets share at least ``percent``; whichever those
    are, one is among the first ``n - least + 1`` of both sets, in one order of
    all shingles.  Rare ones come first, so that few sets meet in a band.  What
    is grouped by set has at most ``SHORT`` rows.
    """
    values = nodes.filter("small IS NOT NULL").select("node", F.col("n_shingles").alias("size"), F.explode("small").alias("value"))
    repeated = values.groupBy("value").agg(F.count("*").alias("times")).filter("times > 1")
    ranked = values.join(repeated, "value", "left").withColumn(
        "place", F.row_number().over(Window.partitionBy("node").orderBy(F.coalesce("times", F.lit(1)), "value")))
    first = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1
    return ranked.filter((F.col("place") <= first) & F.col("times").isNotNull()).select("node", "size", F.xxhash64(F.lit("short"), "value").alias("band"))


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after further links: only components are linked anew."""
    ends = links
    for end in ("a", "b"):
        known = labels.select(F.col("node").alias(end), F.col("component").alias(f"top_{end}"))
        ends = ends.join(known, end, "left").withColumn(end, F.coalesce(f"top_{end}", end)).drop(f"top_{end}")
    tops = cut(components(ends))
    moved = labels.join(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left").select(
        "node", F.coalesce("top", "component").alias("component"))
    return moved.unionByName(tops.join(labels.select("node"), "node", "left_anti"))


def _close_pairs(members: DataFrame, signs: DataFrame, percent: int) -> DataFrame:
    """Deal the members of each band in blocks, and compare blocks with blocks."""
    blocks = F.ceil(F.col("members") / BLOCK).cast("int")
    dealt = members.select("band", "node", "size", "component", "common", "outside", blocks.alias("blocks"),
                           F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    units = dealt.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select(
        "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"),
        "node", "size", "component", "common", "outside")
    return (
        units.join(signs, "node").select("band", "low", "high", "side", "node", "size", "component", "common", "outside", "sign", "small")
        .repartition("band", "low", "high").sortWithinPartitions("band", "low", "high")
        .mapInArrow(_compare_blocks(percent), "a long, b long")
    )
