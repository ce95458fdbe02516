"""Text normalization as column expressions.

Patterns spell out the white-space and word classes they mean, so they do not
depend on how the regular-expression engine reads the short classes.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: white space as printed text uses it (characters, without back-slashes)
SPACES = " \t\n\x0b\f\r\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS = f"[{SPACES}]"
#: each of them written out
BLANKS = SPACES.replace("\u2000-\u200a", "".join(map(chr, range(0x2000, 0x200B))))
# runs that are not a single space already; the one range ahead turns most
# characters away without asking the long class
_RUNS = f"(?![!-~])(?: {WS}+|[{SPACES[1:]}]{WS}*)"
NOT_ALNUM = r"[^\p{L}\p{N}]"
#: no ASCII word character on the left / right
LEFT = "(?<![A-Za-z0-9_])"
RIGHT = "(?![A-Za-z0-9_])"

# Text made of these characters only is its own NFKC form.
_STABLE = "^[\u0000-\u007f\u00a1-\u00a7\u00a9\u00ab-\u00ae\u00b0\u00b1\u00b6\u00b7\u00bb\u00bf-\u00ff\u20ac\u20b9]*$"


@F.pandas_udf(T.StringType())
def _nfkc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFKC", v), na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StringType()))
def _nfkc_each(values: pd.Series) -> pd.Series:
    return values.map(
        lambda vs: [v if v is None else unicodedata.normalize("NFKC", v) for v in vs], na_action="ignore"
    )


def nfkc_each(values: Column) -> Column:
    """``nfkc`` of every member of an array of text."""
    changes = F.exists(values, lambda v: ~v.rlike(_STABLE))
    return F.coalesce(_nfkc_each(F.when(changes, values)), values)


def nfkc(value: Column) -> Column:
    """Compatibility-composed text.  Only rows that can change leave the JVM."""
    return F.coalesce(_nfkc(F.when(~value.rlike(_STABLE), value)), value)


def trim_all(value: Column) -> Column:
    """Trim every kind of white space on both ends."""
    return F.trim(value, F.lit(BLANKS))


def fold(value: Column) -> Column:
    """Single spaces, trimmed, lower case (input already composed)."""
    # only plain spaces are left to trim
    return F.lower(F.trim(F.regexp_replace(value, _RUNS, " ")))


def fold_compact(value: Column) -> Column:
    """Letters and digits only, lower case (input already composed)."""
    return F.regexp_replace(fold(value), NOT_ALNUM, "")


def normalize_text(value: Column) -> Column:
    return fold(nfkc(value))


def compact_text(value: Column) -> Column:
    return fold_compact(nfkc(value))


def split_lines(value: Column) -> Column:
    return F.split(value, "\r?\n", -1)


def ascii_only(value: Column) -> Column:
    return F.octet_length(value) == F.char_length(value)


def blank(value: Column) -> Column:
    return ~value.rlike(f"[^{SPACES}]")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BOUNDARY = "(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


def bare_rx(pattern: str) -> str:
    """A pattern with explicit white-space and word classes."""
    # where an alternative starts with a word, only its left side matters
    pattern = re.sub(r"(^|\||\()\\b", lambda m: m.group(1) + LEFT, pattern)
    return pattern.replace(r"[\s", "[" + SPACES).replace(r"\s", WS).replace(r"\b", _BOUNDARY)


def rx(pattern: str) -> str:
    """``bare_rx`` ignoring case."""
    return "(?iu)" + bare_rx(pattern)


#: marks put around matches; they cannot occur in exchanged text
OPEN, CLOSE = "\ufdd0", "\ufdd1"


def mark_matches(value: Column, pattern: str | Column) -> Column:
    """Pieces of ``value``: what precedes the first match, then one piece per
    match, each holding the match, a closing mark and what follows it."""
    return F.split(F.regexp_replace(value, pattern, f"{OPEN}$0{CLOSE}"), OPEN, -1)


def match_spans(pieces: Column, make) -> Column:
    """``make(start, end, matched)`` for every match in marked pieces."""
    def span(piece: Column, k: Column) -> Column:
        start = F.length(F.array_join(F.slice(pieces, F.lit(1), k + 1), "")) - k
        matched = F.substring_index(piece, CLOSE, 1)
        return make(start, start + F.length(matched), matched)

    return F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), span)


def between(value: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end`` (0-based, end excluded)."""
    return F.substr(value, start + 1, F.greatest(end - start, F.lit(0)))


def tail(value: Column, start: Column) -> Column:
    return F.substr(value, start + 1)


def _composing() -> dict[str, str]:
    """Characters that composition turns into one plain character."""
    found = {}
    for first, last in ((0x80, 0x33FF), (0xF900, 0xFFFF), (0x1D400, 0x1D7FF), (0x1F100, 0x1F2FF)):
        for code in range(first, last + 1):
            plain = unicodedata.normalize("NFKC", chr(code))
            if len(plain) == 1 and plain != chr(code) and (ord(plain) < 0x80 or plain in "\u00a3\u20ac\u20b9"):
                found[chr(code)] = plain
    return found


_PLAIN = _composing()
_WIDE, _NARROW = "".join(_PLAIN), "".join(_PLAIN.values())


def narrow(value: Column) -> Column:
    """Letters, digits, marks and money signs as composition writes them
    (usable inside lambdas)."""
    return F.replace(F.translate(value, _WIDE, _NARROW), F.lit("\u20a8"), F.lit("Rs"))
