"""Printed money cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.fixed import (
    AMOUNT_CODES, CUE_STEMS, DOT_DECIMAL_CUE, DOT_GROUP_CUE, EURO_CUE, ITEM_COUNT, ITEM_COUNT_PREFIX, TENDER_LABELS,
)
from ledgerlane.functions.text import ascii_only, between, blank, let, narrow, rx, trim_all


def separator_cues(text: Column) -> Column:
    """What ``text`` says about decimal and grouping marks."""
    def cues(b: Column) -> Column:
        # Plain ASCII text without the letters of a cue cannot match its pattern.
        def found(name: str, pattern: str) -> Column:
            may_show = reduce(lambda one, other: one | other, [F.contains(b["upper"], F.lit(s)) for s in CUE_STEMS[name]], ~b["ascii"])
            return (may_show & b["text"].rlike(rx(pattern))).alias(name)

        return F.struct(found("euro", EURO_CUE), found("dot_decimal", DOT_DECIMAL_CUE), found("dot_group", DOT_GROUP_CUE))

    return let(F.struct(text.alias("text"), F.upper(text).alias("upper"), ascii_only(text).alias("ascii")), cues)


def parse_amount(raw: Column, cues: Column) -> Column:
    """Value of one whole printed cell, or null.

    A dot followed by three digits groups thousands only where the text says
    so; a list of columns or a part of a number is no amount.
    """
    return let(raw, lambda bound: _parsed(bound, cues))


def _parsed(raw: Column, cues: Column) -> Column:
    euro = cues["euro"] | raw.rlike(rx(EURO_CUE))
    dot_decimal = raw.rlike(rx(DOT_DECIMAL_CUE)) | cues["dot_decimal"]
    dot_group = raw.rlike(rx(DOT_GROUP_CUE)) | cues["dot_group"]
    codes = AMOUNT_CODES
    # the table of wide characters is compared anew for each value, and plain text has none
    plain_raw = F.when(ascii_only(raw), raw).otherwise(narrow(raw))
    cell = F.regexp_replace(trim_all(plain_raw), rx(r"\A[=:]\s*"), "")
    cell = F.regexp_replace(cell, rx(rf"\A\(({codes}|RM)\)\s*"), "$1 ")
    cell = F.regexp_replace(cell, rx(rf"\A(?:(?:{codes}|Rs\.?|Rp\.?|RM|US\$)\s*|[₹$€£]\s*)"), "")
    cell = trim_all(F.regexp_replace(cell, rx(rf"\s*(?:{codes}|[₹$€£])\z"), ""))
    # a euro sign read as the letter e, only next to a printed euro cue
    cell = F.when(euro, F.regexp_replace(cell, r"(?i)(\d[.,]\d{2})e\z", "$1")).otherwise(cell)

    def number(c: Column) -> Column:
        plain = (
            F.when(c.rlike(r"\A\d+(?:\.\d{1,2})?\z"), c)
            .when(c.rlike(r"\A\d+,\d{1,2}\z"), F.replace(c, F.lit(","), F.lit(".")))
            .when(
                c.rlike(r"\A(?:\d{1,3}(?:,\d{3})+|\d{1,2}(?:,\d{2})+,\d{3})(?:\.\d{1,2})?\z"),
                F.replace(c, F.lit(","), F.lit("")),
            )
            .when(
                c.rlike(r"\A\d{1,3}(?:\.\d{3})+,\d{1,2}\z"),
                F.replace(F.replace(c, F.lit("."), F.lit("")), F.lit(","), F.lit(".")),
            )
            .when(
                c.rlike(r"\A\d{1,3}(?:\.\d{3})+\z") & ~dot_decimal & (dot_group | c.rlike(r"\..*\.")),
                F.replace(c, F.lit("."), F.lit("")),
            )
        )
        return F.when(plain.rlike(r"\A\d{1,10}(?:\.\d{1,2})?\z"), plain.try_cast("decimal(12,2)"))

    return let(cell, number)


def without_item_count(raw: Column) -> Column:
    return trim_all(F.regexp_replace(raw, rx(ITEM_COUNT), " "))


def _money_role(line: Column, label: Column) -> Column:
    printed = trim_all(between(line, label["start"], label["end"]))
    role = F.when(label["role"] == "purchasePrice", "purchasePrice")
    for name, pattern in TENDER_LABELS:
        role = role.when((label["role"] == "other") & printed.rlike(rx(pattern)), name)
    return role


def amount_cells(lines: Column) -> Column:
    """Money cells of annotated lines: role, raw, priority, quote, and where
    the quote stands: its first line ``at`` and how many lines ``below`` it."""

    def of_line(x: Column, i: Column) -> Column:
        def below(k: int) -> Column:
            return F.get(lines, i + k)

        def filled(k: int) -> Column:
            return F.coalesce(~blank(below(k)["line"]), F.lit(False))

        step = F.when(filled(1), 1).when(filled(2), 2).when(filled(3), 3)

        def of_label(lab: Column, j: Column) -> Column:
            # most labels are of no money row, and nothing else is asked about them
            return let(_money_role(x["line"], lab), lambda role: F.when(role.isNotNull(), cell(lab, j, role)))

        def cell(lab: Column, j: Column, role: Column) -> Column:
            prefix = F.substr(x["line"], F.lit(1), lab["start"])
            in_cell = (
                (lab["start"] == 0) | (j > 0)
                | prefix.rlike(rx(r"(?:\t|\|| {2,})\s*\z"))
                | prefix.rlike(rx(ITEM_COUNT_PREFIX))
            )
            stop = F.coalesce(F.get(x["labels"], j + 1)["start"], F.length(x["line"]))
            inline = trim_all(between(x["line"], lab["end"], stop))
            source = F.get(lines, i + step)
            borrowed = (inline == "") & (F.size(x["labels"]) == 1) & step.isNotNull() & (F.size(source["labels"]) == 0)
            borrowed = F.coalesce(borrowed, F.lit(False))
            extra = F.array_join(F.transform(F.slice(lines, i + 2, F.coalesce(step, F.lit(0))), lambda y: y["line"]), "\n")
            quote = trim_all(x["line"])
            return F.when(
                in_cell,
                F.struct(
                    role.alias("role"),
                    F.when(borrowed, trim_all(source["line"])).otherwise(inline).alias("raw"),
                    lab["priority"].alias("priority"),
                    F.when(borrowed, F.concat(quote, F.lit("\n"), extra)).otherwise(quote).alias("quote"),
                    i.alias("at"),
                    F.when(borrowed, step).otherwise(0).alias("below"),
                ),
            )

        money = F.exists(x["labels"], lambda lab: lab["role"].isin("purchasePrice", "other"))
        return F.when(money, F.transform(x["labels"], of_label)).otherwise(
            F.array().cast("array<struct<role:string,raw:string,priority:int,quote:string,at:int,below:int>>")
        )

    return F.filter(F.flatten(F.transform(lines, of_line)), lambda c: c["role"].isNotNull())


def total_cells(cells: Column) -> Column:
    """Total cells of the highest priority present."""
    totals = F.filter(cells, lambda c: c["role"] == "purchasePrice")
    return let(
        totals,
        lambda t: F.filter(t, lambda c: c["priority"] == F.array_max(F.transform(t, lambda d: d["priority"]))),
    )


def preferred_total(cells: Column, cues: Column) -> Column:
    """The one amount all best total cells agree on, or null."""
    amounts = F.transform(total_cells(cells), lambda c: parse_amount(without_item_count(c["raw"]), cues))
    return let(
        amounts,
        lambda a: F.when(
            (F.size(a) > 0) & F.forall(a, lambda v: v.isNotNull()) & (F.size(F.array_distinct(a)) == 1),
            F.get(a, F.lit(0)),
        ),
    )


def tender_check(cells: Column, cues: Column, total: Column) -> Column:
    """Cash handed over covers the total and the change adds up.

    True where the cells say nothing about it.
    """
    def amounts(role: str) -> Column:
        rows = F.transform(F.filter(cells, lambda c: c["role"] == role), lambda c: parse_amount(c["raw"], cues))
        return F.array_distinct(F.filter(rows, lambda a: a.isNotNull()))

    def decide(t: Column) -> Column:
        cash, change = F.get(t["cash"], F.lit(0)), F.get(t["change"], F.lit(0))
        applies = (F.size(t["cash"]) == 1) & ~F.exists(t["other"], lambda a: a > 0)
        return (
            F.when(~applies, True)
            .when(cash < total, False)
            .when((F.size(t["change"]) == 1) & (cash - change != total), False)
            .otherwise(True)
        )

    return let(
        F.struct(amounts("cash").alias("cash"), amounts("change").alias("change"), amounts("otherTender").alias("other")),
        decide,
    )
