"""Mixing sources to target weights by Poisson replication.

Every document draws how often it appears from a Poisson distribution whose
mean is the rate its source needs to reach its target weight.  The draw inverts
the distribution at a number that a hash of seed and id gives, so it needs no
state, is the same in every run, and does not depend on the other documents.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import small_side, unit_hash

SEED = 17
# Points (of 8 bytes each) of all sources' distributions that may be broadcast.
BROADCAST_POINTS = 500_000


def rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str, float] | None = None,
          total: int | None = None) -> DataFrame:
    """``source, documents, rate, cdf``: one row per source.

    ``rate`` is total * (weight / sum of weights) / documents.  Without weights
    every source weighs the same; with them, a source not named weighs nothing.
    ``total`` is the wanted number of documents, by default as many as there
    are.  ``cdf`` holds the distribution function at 0, 1, ... until what is
    left is far below the step of the hash (the mean and twelve deviations).
    """
    counts = docs.groupBy(F.col(source_col).alias("source")).agg(F.count("*").alias("documents"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), float(value)).otherwise(weight)
    weighed = counts.withColumn("weight", weight)
    sums = weighed.agg(F.sum("weight").alias("all_weights"), F.sum("documents").alias("all_documents"))
    wanted = F.col("all_documents") if total is None else F.lit(total)
    share = F.when(F.col("all_weights") > 0, F.col("weight") / F.col("all_weights")).otherwise(0.0)
    # ``sums`` is one row, so this is no product of tables.
    rated = weighed.join(F.broadcast(sums)).withColumn("rate", wanted * share / F.col("documents"))
    return rated.select("source", "documents", "rate", cdf("rate").alias("cdf"))


def cdf(rate: str) -> Column:
    """Poisson distribution function of ``rate`` at 0, 1, 2, ..., in logarithms
    so that a large rate does not underflow."""
    mean = F.col(rate)
    steps = F.sequence(F.lit(1), F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int"))
    start = F.struct((-mean).alias("log_p"), F.exp(-mean).alias("sum"), F.array(F.exp(-mean)).alias("points"))

    def step(state: Column, k: Column) -> Column:
        log_p = state["log_p"] + F.log(mean / k)
        point = state["sum"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), point.alias("sum"),
                        F.array_append(state["points"], point).alias("points"))

    points = F.aggregate(steps, start, step, lambda state: state["points"])
    return F.when(mean > 0, points).otherwise(F.array(F.lit(1.0)))


def mix(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id",
        weights: Mapping[str, float] | None = None, total: int | None = None, seed: int = SEED) -> DataFrame:
    """Every document as often as its draw says, in a global random order.

    Returns all columns of ``docs`` and a struct ``mix``: ``copy`` (1, 2, ...),
    ``copies``, ``rate``, ``place`` (the random number that orders the rows), in
    place of a column of that name, if there is one.  Rows are dealt to
    partitions by ``place`` and sorted by it there.

    A null source is a source of its own; rows that repeat an id draw the same
    count.  A null id draws by its source alone.  An empty table gives no rows.
    """
    table = small_side(rates(docs, source_col, weights, total).select(F.col("source").alias("of_source"), "rate", "cdf"), F.size("cdf"), BROADCAST_POINTS)
    # Whole rows in one column, so that no name of theirs clashes with ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), F.col(id_col).alias("id"))
    identity = [F.lit(seed), F.col("source"), F.col("id")]
    drawn = rows.join(table, F.col("source").eqNullSafe(F.col("of_source"))).withColumn("u", unit_hash(*identity)).withColumn(
        "copies", F.size(F.filter("cdf", lambda point: point <= F.col("u"))))
    copies = drawn.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    place = unit_hash(*identity, F.col("copy")).alias("place")
    drawn_as = F.struct(F.col("copy").cast("long").alias("copy"), F.col("copies").cast("long").alias("copies"), "rate", place).alias("drawn")
    placed = copies.select("row", drawn_as).repartition("drawn.place").sortWithinPartitions("drawn.place", "drawn.copy")
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "mix"], F.col("drawn").alias("mix"))
