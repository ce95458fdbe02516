"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes.  Equal blocks get the
same integer name (their place among the blocks, sorted by hash and bytes), then adjacent names
are paired and every distinct pair is named in the same way, until a text has
one name.  Two texts have the same name after the same number of rounds if and
only if their bytes are equal: names stand for bytes, not for hashes.

A text holding a block, or a pair of names, that occurs only once can have no
equal, so it is settled and leaves the later rounds.  For the first round the
occurrences of a block are counted by its 64-bit hash: a hash that occurs once
proves the block unique, any other block is named from its bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut, saved

# Bytes of a block.
BLOCK = 4096


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Of equal texts the row with the largest id stays; of rows that repeat that
    id too, one.  A null text is an empty text; a null id is smaller than any
    other.  Only the two named columns are read, so other columns may have any
    name.  An empty table gives no rows.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    last = F.greatest(F.ceil(F.octet_length("text") / block).cast("int"), F.lit(1)) - 1
    data = F.col("text").cast("binary")
    rows = saved(
        texts.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2(data, 256).alias("text_sha256"),
            F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(data, i * block + 1, F.lit(block))).alias("blocks"),
        ).withColumn("marks", F.transform("blocks", lambda b: F.xxhash64(b))),
        "blocks",
    )
    ends = _name_texts(rows)
    groups = (
        ends.groupBy("rounds", "name")
        .agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("group_size"))
        .filter("group_size > 1")
    )
    equals = ends.join(groups, ["rounds", "name"]).select("row", "keep", "group_size")
    alone = F.col("keep").isNull()
    return rows.select("row", "doc_id", "text_sha256").join(equals, "row", "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        "text_sha256",
    )


def _name_texts(rows: DataFrame) -> DataFrame:
    """``row, doc_id, rounds, name`` of every text that may have an equal."""
    marks = rows.select("row", F.explode("marks").alias("mark"))
    repeated = marks.groupBy("mark").agg(F.count("*").alias("times")).filter("times > 1").select("mark")
    full = marks.join(repeated, "mark").groupBy("row").agg(F.count("*").alias("known"))
    # Texts all of whose blocks may occur elsewhere.
    sizes = rows.select("row", F.size("marks").alias("n"))
    open_rows = cut(sizes.join(full, "row").filter("known = n").select("row", "n"))
    parts = cut(rows.select("row", "doc_id", "blocks").join(open_rows, "row")
                .select("row", "doc_id", "n", F.posexplode("blocks").alias("pos", "key")))
    ends = None
    rounds = 0
    while True:
        named = cut(_named(parts))
        done = named.filter("n = 1").select("row", "doc_id", F.lit(rounds).alias("rounds"), "name")
        ends = done if ends is None else ends.unionByName(done)
        rest = named.filter("n > 1")
        if rest.isEmpty():
            return ends
        even = F.col("pos") % 2 == 0
        parts = (
            rest.groupBy("row", "doc_id", F.floor(F.col("pos") / 2).cast("int").alias("pos"), "n")
            .agg(F.struct(F.max(F.when(even, F.col("name"))).alias("left"),
                          F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("right")).alias("key"))
            .withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        )
        rounds += 1


def _named(parts: DataFrame) -> DataFrame:
    """Replace ``key`` by its name, for texts without a key that occurs once.

    Keys are counted before they are sorted, so a key that a third of all rows
    share is one row of the sort; the join back can split it.
    """
    keys = parts.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1").select("key")
    # Ordered by hash, then bytes: the ranges of the sort are even, and what is
    # sampled for their bounds is small whatever the size of a block.
    ordered = keys.withColumn("mark", F.xxhash64("key")).repartitionByRange("mark").sortWithinPartitions("mark", "key")
    names = cut(ordered.select("key", F.monotonically_increasing_id().alias("name")))
    found = parts.join(names, "key").select("row", "doc_id", "n", "pos", "name")
    full = found.groupBy("row").agg(F.count("*").alias("known"))
    return found.join(full, "row").filter("known = n").drop("known")
