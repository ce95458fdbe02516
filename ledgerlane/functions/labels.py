"""Printed labels on lines of text.

A line's labels are chosen leftmost first, the longest at each place, and
never overlap.  Everything works inside one row, so a document of any number
of lines needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.fixed import FIELD_LABELS, ITEM_COUNT_PREFIX, ROLE_LABELS, VALUE_HEADER
from ledgerlane.functions.text import (
    CLOSE, OPEN, WS, bare_rx, between, blank, let, rx, split_lines, tail, trim_all,
)
from ledgerlane.functions.line_labels import fields_of_lines, labels_of_lines
from ledgerlane.functions.words import rule_of_words, trie_pattern

_SPANS = "array<struct<start:int,end:int,rule:int,fits:boolean>>"
# Spans are put together in groups, so that a line of many labels is not copied
# once for each of them.
_GROUP = 64


def _split_at(line: Column, pattern: str, groups: int) -> Column:
    """What precedes the first match, then for each match its groups and the
    text that follows, with marks between them."""
    marks = OPEN + "".join(f"${i}{CLOSE}" for i in range(1, groups + 1))
    return F.split(F.regexp_replace(line, pattern, marks), OPEN, -1)


def _folded(pieces: Column, begin: Column, step) -> Column:
    """``step(state, piece)`` over all pieces but the first, left to right.

    ``state.found`` collects spans.  Those of each group are collected apart.
    """
    none = F.array().cast(_SPANS)

    def group(state: Column, number: Column) -> Column:
        own = F.aggregate(F.slice(pieces, number * _GROUP + 2, F.lit(_GROUP)), state["own"].withField("found", none), step)
        return let(own, lambda done: F.struct(done.alias("own"), F.array_append(state["all"], done["found"]).alias("all")))

    groups = F.sequence(F.lit(0), F.floor((F.size(pieces) - 2) / _GROUP).cast("int"))
    return F.aggregate(
        groups, F.struct(begin.alias("own"), F.array().cast(f"array<{_SPANS}>").alias("all")), group,
        lambda state: state["own"].withField("found", F.flatten(state["all"])))


def _span(start: Column, end: Column, rule: Column, fits: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), rule.alias("rule"), fits.alias("fits"))


def _chosen(line: Column, patterns: list[str], gap: str, after: str, rest: str, fits) -> Column:
    """Selected spans (start, end, rule, fits) of the rules on ``line``.

    ``after`` has to follow a label, and ``rest`` is taken with it.
    ``fits(before, first, taken, rule)`` looks at the text from the label before
    (or from the line's start, if the label is the first); where it is null the
    rule gives no label, else its answer stays with the span.

    One pass over the line stops where the trie of all rules matches, and
    writes there the longest label.  Spans are chosen from left to right; the
    longest is the right one unless an earlier label that was not chosen
    reaches into it (a rule does not match again inside its own match).  Only
    a line with such a place is read with all rules side by side.
    """
    trie = trie_pattern(tuple(patterns), gap, after)
    rules = rule_of_words(tuple(patterns))
    # Two constants, each a small expression until the plan is optimized.
    words = F.split(F.lit(CLOSE.join(rules)), CLOSE, -1)
    numbers = F.split(F.lit(CLOSE.join(map(str, rules.values()))), CLOSE, -1).cast("array<int>")
    none = F.array().cast(_SPANS)
    longest = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?=({trie})({rest}))"

    def begin(pieces: Column, **more: Column) -> Column:
        first = F.get(pieces, F.lit(0))
        return F.struct(
            F.length(first).alias("at"), first.alias("before"), F.lit(True).alias("first"), F.lit(0).alias("last"), none.alias("found"),
            *[value.alias(name) for name, value in more.items()])

    def ruled(own: Column, before: Column, first: Column) -> Column:
        """Length, rule and fit of the longest label at a start."""
        word = F.get(own, F.lit(0))
        taken = F.concat(word, F.get(own, F.lit(1)))
        spelling = F.lower(F.when(word.rlike(gap), F.regexp_replace(word, gap, " ")).otherwise(word))
        rule = F.get(numbers, F.array_position(words, spelling).cast("int") - 1)
        return let(rule, lambda r: F.struct(F.length(taken).alias("n"), r.alias("rule"), fits(before, first, taken, r).alias("fits")))

    def alone(pieces: Column) -> Column:
        """The label of a line with one start (``mixed`` as below)."""
        before = F.get(pieces, F.lit(0))
        start = F.length(before)

        def chosen(x: Column) -> Column:
            one = F.array(_span(start, start + x["n"], x["rule"], x["fits"]))
            return F.struct((x["rule"].isNull() | x["fits"].isNull()).alias("mixed"), one.alias("found"))

        return let(ruled(F.split(F.get(pieces, F.lit(1)), CLOSE, -1), before, F.lit(True)), chosen)

    def step(state: Column, piece: Column) -> Column:
        def told(own: Column) -> Column:
            start, text = state["at"], F.get(own, F.lit(2))

            def placed(x: Column) -> Column:
                end, free = start + x["n"], state["reach"] <= start
                new = free & x["fits"].isNotNull()
                return F.struct(
                    (start + F.length(text)).alias("at"), text.alias("before"), F.lit(False).alias("first"),
                    F.when(new, end).otherwise(state["last"]).alias("last"),
                    F.when(new, F.array_append(state["found"], _span(start, end, x["rule"], x["fits"]))).otherwise(state["found"]).alias("found"),
                    F.greatest(state["reach"], end).alias("reach"),
                    (state["mixed"] | x["rule"].isNull() | (free & x["fits"].isNull()) | (~free & (state["last"] <= start))).alias("mixed"),
                )

            return let(ruled(own, state["before"], state["first"]), placed)

        return F.when(state["mixed"], state).otherwise(let(F.split(piece, CLOSE, -1), told))

    def read(pieces: Column) -> Column:
        several = _folded(pieces, begin(pieces, reach=F.lit(0), mixed=F.lit(False)), step)
        several = let(several, lambda done: F.struct(done["mixed"].alias("mixed"), done["found"].alias("found")))
        return F.when(F.size(pieces) == 1, none).otherwise(
            let(F.when(F.size(pieces) == 2, alone(pieces)).otherwise(several), lambda d: F.when(d["mixed"], _side_by_side(line, patterns, trie, after, rest, fits, begin)).otherwise(d["found"])))

    return let(_split_at(line, longest, 2), read)


def _side_by_side(line: Column, patterns: list[str], trie: str, after: str, rest: str, fits, begin) -> Column:
    """``_chosen`` with what every rule takes at every start."""
    rules = [f"(?:{bare_rx(p)}){after}{rest}" for p in patterns]
    somewhere = rf"(?iu)(?<![\p{{L}}\p{{N}}])(?={trie})" + "".join(f"(?=({r})?)" for r in rules)
    count = len(rules)

    def step(state: Column, piece: Column) -> Column:
        def told(taken: Column) -> Column:
            start = state["at"]
            lengths = F.transform(
                F.slice(taken, 1, count),
                lambda m, rule: F.when((m != "") & (F.get(state["ends"], rule) <= start), F.length(m)).otherwise(0))

            def placed(sizes: Column) -> Column:
                options = F.transform(
                    sizes,
                    lambda n, rule: F.when(n > 0, F.struct((-n).alias("back"), rule.alias("rule"), fits(state["before"], state["first"], F.get(taken, rule), rule).alias("fits"))))
                best = F.array_min(F.filter(options, lambda o: o.isNotNull() & o["fits"].isNotNull()))
                return let(best, lambda top: let(top.isNotNull() & (state["last"] <= start), lambda new: F.struct(
                    (start + F.length(F.get(taken, F.lit(count)))).alias("at"),
                    F.get(taken, F.lit(count)).alias("before"),
                    F.lit(False).alias("first"),
                    F.when(new, start - top["back"]).otherwise(state["last"]).alias("last"),
                    F.when(new, F.array_append(state["found"], _span(start, start - top["back"], top["rule"], top["fits"]))).otherwise(state["found"]).alias("found"),
                    F.zip_with(state["ends"], sizes, lambda e, n: F.when(n > 0, start + n).otherwise(e)).alias("ends"),
                )))

            return let(lengths, placed)

        return let(F.split(piece, CLOSE, -1), told)

    return let(
        _split_at(line, somewhere, count),
        lambda pieces: _folded(pieces, begin(pieces, ends=F.array_repeat(F.lit(0), count)), step)["found"])


def _lookup(values: list, rule: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), rule)


# --- roles ----------------------------------------------------------------
_BRAND_RULES = [i for i, (role, _, _) in enumerate(ROLE_LABELS) if role == "brand"]


def _brand_cell(before: Column, first: Column, taken: Column, rule: Column) -> Column:
    """Maker words inside product prose are no labels."""
    stands = (
        ~rule.isin(_BRAND_RULES)
        | (first & blank(before))
        | before.rlike(r"(?:\t[ \t]*|\|[ \t]*| {2,})\z")
        | taken.rlike("[:#]")
    )
    return F.when(stands, True)


def role_labels(line: Column) -> Column:
    """Labels of a line: role, priority, start, end."""
    spans = _chosen(line, [p for _, _, p in ROLE_LABELS], f"{WS}+", r"(?![\p{L}\p{N}])", r"[ \t:#.]*", _brand_cell)
    return F.transform(
        spans,
        lambda s: F.struct(
            _lookup([r for r, _, _ in ROLE_LABELS], s["rule"]).alias("role"),
            _lookup([p for _, p, _ in ROLE_LABELS], s["rule"]).alias("priority"),
            s["start"].alias("start"),
            s["end"].alias("end"),
        ),
    )


def _lone(line: Column, labels: Column) -> Column:
    """The label of a line that carries nothing else, as (role, priority)."""
    only = F.get(labels, F.lit(0))
    money = only["role"] == "purchasePrice"
    stands_alone = (
        (only["start"] == 0)
        | line.rlike(f"[:#]{WS}*\\z")
        | (money & F.substr(line, F.lit(1), only["start"]).rlike(rx(ITEM_COUNT_PREFIX)))
    )
    return F.when(
        (F.size(labels) == 1) & blank(tail(line, only["end"])) & stands_alone,
        F.struct(only["role"].alias("role"), only["priority"].alias("priority")),
    )


def annotate(text: Column) -> Column:
    """Lines of ``text`` with their labels and the label carried over from a
    line above that holds only a label.  An expression of the JVM, for short
    texts inside lambdas; whole texts are read by ``annotate_texts``."""
    return _carried(F.transform(split_lines(text), lambda line: let(role_labels(line), lambda labels: _line(line, labels))))


def annotate_texts(text: Column) -> Column:
    """``annotate`` for a column of whole texts: a tenth of the time."""
    return _carried(F.zip_with(split_lines(text), labels_of_lines(text), _line))


def _line(line: Column, labels: Column) -> Column:
    return F.struct(line.alias("line"), labels.alias("labels"), _lone(line, labels).alias("lone"))


def _carried(lines: Column) -> Column:
    """Lines with the label of a line above that holds only a label."""

    def carry(all_lines: Column) -> Column:
        def one(x: Column, i: Column) -> Column:
            def above(k: int) -> Column:
                return F.get(all_lines, i - k)

            def filled(k: int) -> Column:
                return F.coalesce(~blank(above(k)["line"]), F.lit(False))

            def money(k: int) -> Column:
                lone = above(k)["lone"]
                return F.when(lone["role"] == "purchasePrice", lone)

            carried = (
                F.when(filled(1), above(1)["lone"])
                .when(filled(2), money(2))
                .when(filled(3), money(3))
                .when(i >= 4, money(4))
            )
            return F.struct(x["line"].alias("line"), x["labels"].alias("labels"), carried.alias("carried"))

        return F.transform(all_lines, one)

    return let(lines, carry)


def best_priority(lines: Column, role: str | Column) -> Column:
    """Highest priority of a role's labels, at least 1."""
    per_line = F.transform(
        lines,
        lambda x: F.aggregate(
            x["labels"], F.lit(1), lambda best, lab: F.when(lab["role"] == role, F.greatest(best, lab["priority"])).otherwise(best)
        ),
    )
    return F.coalesce(F.array_max(per_line), F.lit(1))


def has_date_label(lines: Column) -> Column:
    """Does any line name a date, of the purchase or of something else?"""
    def dated(x: Column) -> Column:
        return F.exists(
            x["labels"],
            lambda lab: (lab["role"] == "purchaseDate")
            | ((lab["role"] == "other") & between(x["line"], lab["start"], lab["end"]).rlike(rx(r"\b(?:date|dob)\b"))),
        )

    return F.exists(lines, dated)


# --- label-only reader ----------------------------------------------------
def _field_cell(before: Column, first: Column, taken: Column, rule: Column) -> Column:
    """Does a label stand at the start of a cell, or before a separator?"""
    return (first & (before == "")) | taken.rlike(rx(r"[:#]|\s-\s")) | before.rlike(rx(r"(?:\t|[|;]| {2,})\s*\z"))


def field_labels(line: Column) -> Column:
    """Labels of a line for the label-only reader: field, priority, start,
    end of the separator, and whether the separator is explicit."""
    separator = bare_rx(r"(?:\s*[:#]\s*|\s+-\s+|\s+|\z)")
    spans = _chosen(line, [p for _, _, p in FIELD_LABELS], f"{WS}+", bare_rx(r"(?=\z|[\s:#])"), separator, _field_cell)
    return F.transform(
        F.filter(spans, lambda s: s["fits"]),
        lambda s: F.struct(
            _lookup([f for f, _, _ in FIELD_LABELS], s["rule"]).alias("field"),
            _lookup([p for _, p, _ in FIELD_LABELS], s["rule"]).alias("priority"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            between(line, s["start"], s["end"]).rlike(rx(r"[:#]|\s-\s")).alias("explicit"),
        ),
    )


def label_values(text: Column) -> Column:
    """Labelled values of ``text``: field, priority, value."""
    lines = F.zip_with(split_lines(text), fields_of_lines(text), lambda raw, labels: F.struct(trim_all(raw).alias("line"), labels.alias("labels")))

    def read(all_lines: Column) -> Column:
        def of_line(x: Column, i: Column) -> Column:
            below = F.get(all_lines, i + 1)

            def of_label(lab: Column, j: Column) -> Column:
                stop = F.coalesce(F.get(x["labels"], j + 1)["start"], F.length(x["line"]))
                inline = trim_all(F.regexp_replace(between(x["line"], lab["end"], stop), rx(r"[\s|;]+\z"), ""))
                borrowed = (
                    (inline == "") & (F.size(x["labels"]) == 1) & lab["explicit"]
                    & F.coalesce((below["line"] != "") & (F.size(below["labels"]) == 0), F.lit(False))
                )
                return F.struct(
                    lab["field"].alias("field"),
                    lab["priority"].alias("priority"),
                    F.when(borrowed, below["line"]).otherwise(inline).alias("value"),
                )

            return F.transform(x["labels"], of_label)

        values = F.flatten(F.transform(all_lines, of_line))
        return F.filter(values, lambda v: (v["field"] != "") & ~v["value"].rlike(rx(VALUE_HEADER)))

    return let(lines, read)
