"""SpotSigs fingerprints.

A spot is a common word (the anchor) with the chain of content words that
follow it.  Text that says the same thing keeps its spots when navigation,
boilerplate or a part of it changes.  A stretch without common words (another
language, a list) would have no spots; there every word is an anchor.

A fingerprint is the sorted set of a text's spots, 32 bits each, as hex.
Likeness of fingerprints is the Jaccard similarity of the sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut, small_batches
from ledgerlane.llm.words import bytes_of, distinct, hash_words, mixed, pieces, words_of

# Common words of the languages at hand; a parameter of every operator here.
ANCHORS = tuple(
    "the of and to in a is that for it as was with be by on not are this or from at have an they which you were "
    "der die das und ist zu den von mit ein eine für auf nicht sich des dem im auch es an als "
    "le la les de des et un une est que qui dans pour pas au par sur du en avec ce il "
    "el los las y que se del con una por para su al lo como o".split()
)
# Content words of a chain.
CHAIN = 3
# So many words without a common one make anchors of the words that follow.
STRETCH = 8
# Sets are similar from this Jaccard similarity on.
SIMILAR = 0.5
# Sets that share a spot and a partition are compared in cells of so many a side.
CELL = 500

_GAPS = np.array([not (chr(b).isalnum() or b >= 0x80) for b in range(256)])
_PLACES = mixed(np.arange(301, 310, dtype=np.uint64)) | np.uint64(1)


def spots(texts: pa.Array, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct spots of every text, with bounds."""
    data, text_bounds = bytes_of(texts)
    words, bounds = hash_words(data, text_bounds, _GAPS)
    places = np.arange(len(words))
    at = np.searchsorted(anchors, words)
    common = anchors[np.minimum(at, len(anchors) - 1)] == words
    start = np.repeat(bounds[:-1], np.diff(bounds))
    last = np.maximum.accumulate(np.where(common, places, -1)) if len(words) else places
    spot = np.flatnonzero(common | (last < start) | (places - last > STRETCH))
    content = np.flatnonzero(~common)
    following = np.searchsorted(content, spot, side="right")
    content_end = np.searchsorted(content, bounds)[1:]
    of_text = np.searchsorted(bounds, spot, side="right") - 1
    sums = words[spot] * _PLACES[0]
    for k in range(CHAIN):
        inside = following + k < content_end[of_text]
        sums[inside] += words[content[following[inside] + k]] * _PLACES[k + 1]
    values = (mixed(sums) >> np.uint64(32)).astype(np.uint32)
    counts = np.bincount(of_text, minlength=len(texts)).astype(np.int64)
    values, bounds = distinct(values, np.concatenate([[0], np.cumsum(counts)]))
    empty = np.flatnonzero((np.diff(bounds) == 0) & (np.diff(text_bounds) > 0))
    if len(empty):  # no word at all: the text itself is the spot
        whole = [int.from_bytes(hashlib.blake2b(data[text_bounds[i]:text_bounds[i + 1]].tobytes(), digest_size=4).digest(), "little") for i in empty]
        values = np.insert(values, bounds[empty], whole)
        bounds = bounds + np.concatenate([[0], np.cumsum(np.isin(np.arange(len(texts)), empty))])
    return values, bounds


def anchor_hashes(anchors: tuple[str, ...]) -> np.ndarray:
    return np.sort(words_of(pa.array([" ".join(anchors)]))[0])


def _hex(values: np.ndarray) -> str:
    return values.astype(">u4").tobytes().hex()


def likeness(one: np.ndarray, two: np.ndarray) -> float:
    """Jaccard similarity; 1 for two empty sets."""
    if not len(one) or not len(two):
        return float(len(one) == len(two))
    if len(one) > len(two):
        one, two = two, one
    at = np.searchsorted(two, one)
    at[at == len(two)] = 0
    common = int((two[at] == one).sum())
    return common / (len(one) + len(two) - common)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """``doc_id, spots`` (sorted array of longs) of every row.

    A null or empty text has no spots; any other text has at least one.
    """
    small_batches(docs.sparkSession)
    known = anchor_hashes(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                values, bounds = spots(piece.column(1), known)
                lists = pa.ListArray.from_arrays(pa.array(bounds, type=pa.int32()), pa.array(values.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([piece.column(0), lists], names=["doc_id", "spots"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, spots array<long>")


def partition_starts(least: float, largest: int) -> list[int]:
    """The smallest set size of each partition.  Two sets can reach ``least``
    only if they are in the same partition or in neighbours."""
    starts = [1]
    while least < 1 and starts[-1] <= largest:
        starts.append(math.floor(starts[-1] / least + 1e-9) + 1)
    return starts


def similar(prints: DataFrame, least: float = SIMILAR) -> DataFrame:
    """``one, other, jaccard``: similar documents of ``fingerprints()``.

    A set of spots stands for all rows that have it, under their smallest id.
    Different sets with a Jaccard similarity of at least ``least`` (above 0, at
    most 1) are paired with each other, ``one`` the smaller id; a further row of
    a set is paired with the smallest id only (1.0), not with every copy.  No
    pair is dropped: a large group of different, similar sets gives all of its
    pairs.  Rows without an id or without spots have no pair.

    Sets are dealt to partitions by their sizes, and joined with sets of their
    own and the next partition on the rarest spots (as many as must hold a
    common one); what sizes or places of the spot rule out goes before the full
    sets are compared.  A frequent spot is split into cells.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be above 0 and at most 1")
    # Equal sets are told by 128 bits and their size.
    mark = F.struct(F.xxhash64("spots").alias("a"), F.xxhash64(F.lit(17), "spots").alias("b"), F.size("spots").alias("size"))
    rows = cut(prints.filter("doc_id IS NOT NULL AND size(spots) > 0").select("doc_id", "spots", mark.alias("mark")))
    sets = cut(rows.groupBy("mark").agg(F.min("doc_id").alias("doc_id"), F.first("spots").alias("spots")))
    size = F.col("mark.size")
    starts = partition_starts(least, sets.agg(F.max("mark.size")).first()[0] or 0)
    part = F.size(F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: s <= size)) - 1

    spots_ = sets.select("mark", F.explode("spots").alias("spot"))
    times = spots_.groupBy("spot").agg(F.count("*").alias("n")).filter("n > 1")
    # Spots of one set match nothing; they come first, as the rarest ones.
    shared = spots_.join(times, "spot").groupBy("mark").agg(F.sort_array(F.collect_list(F.struct("n", "spot"))).alias("ranked"))
    alone = size - F.size("ranked")
    prefix = size - F.ceil(size * F.lit(least) - F.lit(1e-9)).cast("int") + 1
    keys = cut(shared.select("mark", part.alias("part"), alone.alias("alone"), F.slice("ranked", F.lit(1), F.greatest(prefix - alone, F.lit(0))).alias("first"))
               .select("mark", "part", "alone", F.posexplode("first").alias("k", "s"))
               .select("mark", "part", (F.col("alone") + F.col("k")).alias("place"), F.col("s.spot").alias("spot"), F.col("s.n").alias("n")))

    # A spot of n sets has a square of cells: one side goes to a row of it, the other to a column.
    side = F.ceil(F.col("n") / F.lit(CELL)).cast("int")
    own = F.pmod(F.xxhash64("mark"), side).cast("int")
    every = F.explode(F.sequence(F.lit(0), side - 1))
    ones = keys.select(F.col("mark").alias("m1"), F.col("place").alias("p1"), "spot", F.col("part").alias("at"), "part", own.alias("i"), every.alias("j"))
    others = keys.select("mark", "place", "spot", "part", own.alias("j"), side.alias("side")).select(
        F.col("mark").alias("m2"), F.col("place").alias("p2"), "spot", F.col("part").alias("of"), "j", "side", F.explode(F.array(F.col("part"), F.col("part") - 1)).alias("at"),
    ).select("m2", "p2", "spot", "of", "j", "at", F.explode(F.sequence(F.lit(0), F.col("side") - 1)).alias("i"))
    # Within a partition each pair once; the next partition only as the other.
    a, b = F.col("m1.size"), F.col("m2.size")
    needed = F.lit(least / (1 + least)) * (a + b) - F.lit(1e-6)
    candidates = (
        ones.join(others, ["spot", "at", "i", "j"])
        .filter((F.col("part") < F.col("of")) | (F.col("m1") < F.col("m2")))
        .filter(F.least(a, b) >= F.lit(least) * F.greatest(a, b) - F.lit(1e-6))
        .filter(F.least(a - F.col("p1"), b - F.col("p2")) >= needed)
        .select("m1", "m2").distinct()
    )
    left = sets.select(F.col("mark").alias("m1"), F.col("doc_id").alias("id1"), F.col("spots").alias("s1"))
    right = sets.select(F.col("mark").alias("m2"), F.col("doc_id").alias("id2"), F.col("spots").alias("s2"))
    common = F.size(F.array_intersect("s1", "s2"))
    pairs = candidates.join(left, "m1").join(right, "m2").select(
        F.least("id1", "id2").alias("one"), F.greatest("id1", "id2").alias("other"), (common / (F.size("s1") + F.size("s2") - common)).alias("jaccard"),
    ).filter(F.col("jaccard") >= F.lit(least))
    copies = rows.select("mark", "doc_id").join(sets.select("mark", F.col("doc_id").alias("one")), "mark").filter("doc_id != one")
    return pairs.unionByName(copies.select("one", F.col("doc_id").alias("other"), F.lit(1.0).alias("jaccard")))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt to ranges of ids, so that each range also has the first row
    of the next one: ``part, guest, doc_id, text``, sorted by all of them.

    Texts move once.  Ranges start at ids that exist (quantiles of the ids),
    and the row that starts a range is sent to the range before it as well, the
    first of all to the last range.  A row with a null id has no place in the
    order and may be in any range.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ranges = 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # At most ``ranges + 1`` numbers come to the driver.
    quantiles = rows.agg(F.percentile_approx("doc_id", [k / ranges for k in range(ranges)], 100_000)).first()[0]
    heads = sorted(set(quantiles or [0]))
    starts = F.array(*[F.lit(h).cast("long") for h in heads])
    part = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text"), F.lit(len(heads))).cast("int")).otherwise(
        F.size(F.filter(starts, lambda h: h <= F.col("doc_id"))) - 1)
    own = rows.withColumn("part", part)
    # A range's row and, for a row that starts a range, its guest copy.
    homes = F.when(F.array_contains(starts, F.col("doc_id")), F.array(
        F.struct(F.col("part").alias("part"), F.lit(False).alias("guest")),
        F.struct(F.pmod(F.col("part") - 1, F.lit(len(heads))).alias("part"), F.lit(True).alias("guest")),
    )).otherwise(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("guest"))))
    placed = own.withColumn("home", F.explode(homes)).select("home.part", "home.guest", "doc_id", "text")
    return placed.repartition("part").sortWithinPartitions("part", "guest", "doc_id", "text")


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", anchors: tuple[str, ...] = ANCHORS) -> DataFrame:
    """Every text beside an edited copy and the next text (ascending id).

    The edited copy has its last quarter (floor of a quarter of the code
    points) replaced by as many of the next text's first; after the last text
    comes the first.  Returns ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  Null texts count as empty.
    Rows that repeat an id follow each other by their texts.  A row with a null
    id has no next text: its edited copy is itself and ``near_next`` is 0.
    """
    small_batches(docs.sparkSession)
    known = anchor_hashes(anchors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried = None
        for batch in batches:
            for piece in pieces(batch, text_col=3):
                table = piece if carried is None else pa.Table.from_batches([carried, piece]).combine_chunks().to_batches()[0]
                done, carried = compared(table)
                if done is not None:
                    yield done

    def compared(rows: pa.RecordBatch):
        """Results of all rows whose next row is at hand, and the one that waits."""
        part, guest, ids = rows.column(0).to_pylist(), rows.column(1).to_pylist(), rows.column(2).to_pylist()
        texts = rows.column(3).to_pylist()
        values, bounds = spots(rows.column(3), known)
        own = [i for i in range(len(texts)) if not guest[i]]
        waits = None
        if own and own[-1] == len(texts) - 1 and ids[own[-1]] is not None:
            waits = rows.slice(own.pop(), 1)
        if not own:
            return None, waits
        edited = []
        for i in own:
            keep = len(texts[i]) - len(texts[i]) // 4
            # The row behind a row of a range is its next, or the guest.
            edited.append(texts[i] if ids[i] is None else texts[i][:keep] + texts[i + 1][:len(texts[i]) - keep])
        edited_values, edited_bounds = spots(pa.array(edited, type=pa.string()), known)
        columns: list[list] = [[] for _ in range(7)]
        for k, i in enumerate(own):
            mine, other = values[bounds[i]:bounds[i + 1]], edited_values[edited_bounds[k]:edited_bounds[k + 1]]
            after = 0.0 if ids[i] is None else likeness(mine, values[bounds[i + 1]:bounds[i + 2]])
            row = (ids[i], len(texts[i]), hashlib.sha256(edited[k].encode()).hexdigest(), _hex(mine), _hex(other), likeness(mine, other), after)
            for column, value in zip(columns, row):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds)], names=names), waits

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [field.split(" ")[0] for field in schema.split(", ")]
    return with_next(docs, id_col, text_col).mapInArrow(run, schema)
