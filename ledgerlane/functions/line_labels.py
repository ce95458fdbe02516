"""Role labels of all lines of whole texts, for an Arrow batch at a time.

The same trie and the same choice as in ``functions.labels``, which reads short
texts inside expressions.  Interpreted expressions take about ten times as long
on whole texts.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlane.fixed import FIELD_LABELS, ROLE_LABELS
from ledgerlane.functions.text import BLANKS, WS, bare_rx
from ledgerlane.functions.words import rule_of_words, trie_pattern

_PATTERNS = tuple(p for _, _, p in ROLE_LABELS)
_FIELDS = tuple(p for _, _, p in FIELD_LABELS)
_FIELD_NAMES = [(field, priority) for field, priority, _ in FIELD_LABELS]
# No letter or digit stands here.
_OPEN, _SHUT = r"(?<![^\W_])", r"(?![^\W_])"
_REST = r"[ \t:#.]*"
_LABEL = T.StructType([
    T.StructField("role", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_FIELD_LABEL = T.StructType([
    T.StructField("field", T.StringType()), T.StructField("priority", T.IntegerType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()),
    T.StructField("explicit", T.BooleanType())])
# What follows a label of the label-only reader, and the separator taken with it.
_FIELD_SHUT = rf"(?=\Z|{WS}|[:#])"
_FIELD_REST = rf"(?:{WS}*[:#]{WS}*|{WS}+-{WS}+|{WS}+|\Z)"
_EXPLICIT = re.compile(rf"[:#]|{WS}-{WS}")
_FIELD_CELL = re.compile(rf"(?:\t|[|;]| {{2,}}){WS}*\Z")
_CELL = re.compile(r"(?:\t[ \t]*|\|[ \t]*| {2,})\Z")
_LINES = re.compile("\r?\n")
_GAP = re.compile(f"{WS}+")

Span = tuple[int, int, int]


@lru_cache
def _longest(patterns: tuple[str, ...], shut: str, rest: str) -> re.Pattern:
    return re.compile(rf"(?i){_OPEN}(?=({trie_pattern(patterns, WS + '+', shut)})({rest}))")


@lru_cache
def _longest_plain(patterns: tuple[str, ...], shut: str, rest: str) -> re.Pattern:
    """``_longest`` for lines of plain ASCII in lower case: goes from one first
    letter of a label to the next, and need not ignore case."""
    firsts = "".join(sorted({re.escape(word[0]) for word in rule_of_words(patterns)}))
    return re.compile(rf"[{firsts}](?<![a-z0-9].)(?<=(?=({trie_pattern(patterns, WS + '+', shut)})({rest})).)")


@lru_cache
def _each(patterns: tuple[str, ...], shut: str, rest: str) -> list[re.Pattern]:
    return [re.compile(rf"(?i){_OPEN}(?:{bare_rx(p)}){shut}{rest}") for p in patterns]


def _fits(line: str, start: int, taken: str, rule: int) -> bool:
    """Maker words inside product prose are no labels."""
    if ROLE_LABELS[rule][0] != "brand" or ":" in taken or "#" in taken:
        return True
    before = line[:start]
    return not before.strip(BLANKS) or _CELL.search(before) is not None


def _any_place(line: str, start: int, taken: str, rule: int) -> bool:
    return True


_ROLES = (_PATTERNS, _SHUT, _REST), _fits
_READER = (_FIELDS, _FIELD_SHUT, _FIELD_REST), _any_place


@lru_cache
def _compiled(reader: bool) -> tuple[dict[str, int], re.Pattern, re.Pattern]:
    """Rules by word and both patterns; looked up without hashing all label patterns for each line."""
    rules = (_READER if reader else _ROLES)[0]
    return rule_of_words(rules[0]), _longest_plain(*rules), _longest(*rules)


def spans_of_line(line: str, how=_ROLES) -> list[Span]:
    """Chosen labels (start, end, rule), leftmost first, the longest at each place."""
    fits = how[1]
    rules, plain, strange = _compiled(how is _READER)
    found, last, reach = [], 0, 0
    places = plain.finditer(line.lower()) if line.isascii() else strange.finditer(line)
    for m in places:
        start, end = m.start(), m.end(2)
        if start >= reach:
            word = m[1].lower()
            rule = rules.get(word)
            if rule is None:
                rule = rules.get(_GAP.sub(" ", word))
            if rule is None or not fits(line, start, line[start:end], rule):
                return _rule_by_rule(line, how)
            found.append((start, end, rule))
            last = reach = end
        elif start >= last:
            # A label that was not chosen reaches into this one.
            return _rule_by_rule(line, how)
        elif end > reach:
            reach = end
    return found


def _rule_by_rule(line: str, how) -> list[Span]:
    rules, fits = how
    spans = sorted(
        (m.start(), -m.end(), rule) for rule, pattern in enumerate(_each(*rules)) for m in pattern.finditer(line) if fits(line, m.start(), m[0], rule))
    found, last = [], 0
    for start, end, rule in spans:
        if start >= last:
            found.append((start, -end, rule))
            last = -end
    return found


def _offsets(sizes: list[int]) -> pa.Array:
    total, out = 0, [0]
    for size in sizes:
        total += size
        out.append(total)
    return pa.array(out, pa.int32())


def label_arrays(texts: list[str | None]) -> pa.Array:
    spans: list[Span] = []
    lines_of, labels_of = [], []
    for text in texts:
        lines = [] if text is None else _LINES.split(text)
        lines_of.append(len(lines))
        for line in lines:
            own = spans_of_line(line)
            labels_of.append(len(own))
            spans += own
    roles, priorities = [r for r, _, _ in ROLE_LABELS], [p for _, p, _ in ROLE_LABELS]
    labels = pa.StructArray.from_arrays([
        pa.array([roles[s[2]] for s in spans], pa.string()), pa.array([priorities[s[2]] for s in spans], pa.int32()),
        pa.array([s[0] for s in spans], pa.int32()), pa.array([s[1] for s in spans], pa.int32())], names=_LABEL.names)
    lines = pa.ListArray.from_arrays(_offsets(labels_of), labels)
    return pa.ListArray.from_arrays(_offsets(lines_of), lines, mask=pa.array([t is None for t in texts]))


@F.arrow_udf(T.ArrayType(T.ArrayType(_LABEL)))
def labels_of_lines(texts: pa.Array) -> pa.Array:
    """Role labels (role, priority, start, end) of every line of every text."""
    return label_arrays(texts.to_pylist())


def fields_of_line(line: str) -> list[tuple[str, int, int, int, bool]]:
    """Labels of the label-only reader on a trimmed line."""
    found = []
    for start, end, rule in spans_of_line(line, _READER):
        explicit = _EXPLICIT.search(line, start, end) is not None
        if start == 0 or explicit or _FIELD_CELL.search(line[:start]):
            found.append((*_FIELD_NAMES[rule], start, end, explicit))
    return found


def field_arrays(texts: list[str | None]) -> pa.Array:
    spans: list[tuple] = []
    lines_of, labels_of = [], []
    for text in texts:
        lines = [] if text is None else _LINES.split(text)
        lines_of.append(len(lines))
        for line in lines:
            own = fields_of_line(line.strip(BLANKS))
            labels_of.append(len(own))
            spans += own
    labels = pa.StructArray.from_arrays([
        pa.array([s[0] for s in spans], pa.string()), pa.array([s[1] for s in spans], pa.int32()),
        pa.array([s[2] for s in spans], pa.int32()), pa.array([s[3] for s in spans], pa.int32()), pa.array([s[4] for s in spans], pa.bool_())], names=_FIELD_LABEL.names)
    lines = pa.ListArray.from_arrays(_offsets(labels_of), labels)
    return pa.ListArray.from_arrays(_offsets(lines_of), lines, mask=pa.array([t is None for t in texts]))


@F.arrow_udf(T.ArrayType(T.ArrayType(_FIELD_LABEL)))
def fields_of_lines(texts: pa.Array) -> pa.Array:
    """Labels of the label-only reader (field, priority, start, end, explicit)
    of every trimmed line of every text: ``labels.field_labels`` of each."""
    return field_arrays(texts.to_pylist())
