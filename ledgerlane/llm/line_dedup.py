"""Boilerplate lines by their frequency within a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import small_side

# A line is boilerplate on a site if more than this part of its pages hold it
# (in the middle of the measured gap: boilerplate is on 8.7 % of the pages of a
# site of hundreds of pages at least, any other line on 4.7 % at most),
RATIO = 0.065
# and at least so many pages do (below that a small site proves nothing).
MIN_PAGES = 3
# Boilerplate lines (of 16 bytes each) of all sites that may be broadcast.
BROADCAST_LINES = 200_000


def _mark(line: Column) -> Column:
    """128 bits that stand for a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(11), line).alias("b"))


def boilerplate(docs: DataFrame, host: Column, text: Column, ratio: float, min_pages: int) -> DataFrame:
    """``host, marks``: the boilerplate lines of each site that has any.

    Pages of one site with equal texts count once, so copies of a page do not
    turn its lines into boilerplate.  A site has at most (lines of its mean
    page) / ratio such lines, so its list is small however large the site is.
    Counts combine before the shuffle, so a hot site or line is spread.
    """
    pages = (
        docs.select(host.alias("host"), F.struct(_mark(text).alias("mark"), F.length(text)).alias("page"),
                    F.transform(F.array_distinct(F.split(text, "\n", -1)), _mark).alias("lines"))
    )
    # One of the equal pages, without bringing texts together: pages are equal
    # by 128 bits and length, and then their lists of lines are too.
    once = pages.groupBy("host", "page").agg(F.first("lines").alias("lines"))
    totals = once.groupBy(F.col("host").alias("site")).agg(F.count("*").alias("pages"))
    counts = once.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    frequent = counts.filter(F.col("n") >= min_pages).join(totals, F.col("host").eqNullSafe(F.col("site")))
    return (
        frequent.filter(F.col("n") > F.lit(ratio) * F.col("pages"))
        .groupBy("host").agg(F.collect_list("line").alias("marks"))
    )


def drop_site_lines(docs: DataFrame, host: str | Column = "source", text_col: str = "text",
                    ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the text column, and two
    further columns in a struct ``lines``: ``total`` and ``dropped`` (in place of
    a column of that name, if there is one).

    Lines are what stands between line feeds; an empty line counts as a line.
    A null text stays null (0 lines), an empty one has one empty line.  A null
    host is a site of its own.  All rows and all other columns stay; a text
    that was nothing but boilerplate becomes empty.  Rows that repeat each
    other are copies of a page.  An empty table gives no rows.
    """
    site = (F.col(host) if isinstance(host, str) else host).cast("string")
    # Whole rows in one column, so that no name of theirs clashes with ours.
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), site.alias("host"), F.col(text_col).alias("text"))
    marked = boilerplate(rows, F.col("host"), F.col("text"), ratio, min_pages)
    lines = small_side(marked.select(F.col("host").alias("of_host"), "marks"), F.size("marks"), BROADCAST_LINES)
    joined = rows.join(lines, F.col("host").eqNullSafe(F.col("of_host")), "left")
    text = F.col("text")
    parts = F.split(text, "\n", -1)
    known = F.coalesce(F.col("marks"), F.array().cast(lines.schema["marks"].dataType))
    kept = F.filter(parts, lambda line: ~F.array_contains(known, _mark(line)))
    touched = F.col("marks").isNotNull() & text.isNotNull()
    done = joined.select(
        "row", F.when(touched, F.array_join(kept, "\n")).otherwise(text).alias("cleaned"),
        F.struct(
            F.when(text.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("total"),
            F.when(touched, F.size(parts) - F.size(kept)).otherwise(0).cast("long").alias("dropped"),
        ).alias("counts"),
    )
    return done.select(
        *[(F.col("cleaned") if c.lower() == text_col.lower() else F.col("row")[c]).alias(c) for c in docs.columns if c.lower() != "lines"],
        F.col("counts").alias("lines"),
    )
