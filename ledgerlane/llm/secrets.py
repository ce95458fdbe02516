"""Secrets in texts: named patterns, and random strings by token efficiency.

Ordinary words, names and paths take few tokens of a byte-pair vocabulary; a
random string falls apart into about one token per one or two characters.  A
run of key-like characters is reported as ``random`` if it has fewer characters
per token than a limit, unless it is a known digest (a hexadecimal run of a
digest's length), a UUID, a number, or an identifier made of two or more words
that are each efficient in tokens.  A run of letters of one case is no such
identifier: its tokens decide.

The patterns named ``assign``, ``access`` and ``hex`` are found leftmost and
without overlap, each by itself; what they find stays, whatever its tokens.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import small_batches
from ledgerlane.llm.words import pieces

# The pattern that splits text for the vocabulary, and kinds in their order.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

# A run shorter than this is never tested, and
MIN_RUN = 16
# one is random below so many characters per token.
MAX_RATIO = 2.3
_RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
# A text that this does not match has none of the spans.
_ANY = (r"""(?i:password|passwd|secret|token|api_?key)["']? *[:=] *["']?[A-Za-z0-9+/_.=-]{12}|AKIA[A-Z0-9]{14}"""
        rf"|[0-9a-f]{{16}}|[A-Za-z0-9+/_=-]{{{MIN_RUN}}}")

_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_DIGEST_SIZES = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}\Z")
_NUMBER = re.compile(r"[0-9+/_=-]+\Z")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
# Letters that a word of an identifier has on average, at least.
_WORD = 4


def is_fixed(run: str) -> bool:
    """A digest, a UUID or a number."""
    return bool(len(run) in _DIGEST_SIZES and _DIGEST.match(run) or _UUID.match(run) or _NUMBER.match(run))


def words_in(run: str) -> list[str]:
    """The words of a run with the shape of an identifier, else none."""
    parts = _PART.findall(run)
    words = [p for p in parts if not p[0].isdigit()]
    # Two words at least, with a few numbers between or behind them.
    shaped = len(words) > 1 and sum(map(len, words)) >= _WORD * len(words) and len(parts) - len(words) <= len(words) / 2
    return words if shaped else []


def is_known(run: str) -> bool:
    """A digest, a UUID, a number, or the shape of an identifier."""
    return is_fixed(run) or bool(words_in(run))


class Scanner:
    def __init__(self, vocabulary: str):
        import tiktoken

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in file if line.strip())}
        self.encoding = tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def ratio(self, run: str) -> float:
        return len(run) / len(self.encoding.encode_ordinary(run))

    def is_known(self, run: str) -> bool:
        """As above, and the words of an identifier are each one token, or efficient."""
        words = [] if is_fixed(run) else words_in(run)
        return is_known(run) and all(len(t := self.encoding.encode_ordinary(w)) == 1 or len(w) >= MAX_RATIO * len(t) for w in words)

    def spans(self, text: str) -> list[tuple[int, int, int, float | None]]:
        """Start, place of the kind, end, characters per token."""
        found = [(m.start(), 0, m.end(), None) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
        found += [(m.start(), 1, m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end(), None) for m in _HEX.finditer(text)]
        for m in _RUN.finditer(text):
            start, end = m.span()
            if any(s < end and start < e for s, _, e, _ in found) or self.is_known(m[0]):
                continue
            ratio = self.ratio(m[0])
            if ratio < MAX_RATIO:
                found.append((start, 3, end, ratio))
        return sorted(found, key=lambda s: s[:2])


@lru_cache(maxsize=2)
def scanner(vocabulary: str) -> Scanner:
    return Scanner(vocabulary)


def find_secrets(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans`` of every row; spans are ``kind, start, end, ratio``.

    Starts and ends count code points, the end is exclusive; spans are ordered
    by start, then kind.  ``ratio`` (characters per token) is set for kind
    ``random``, which is only reported outside the other spans.  A null text
    counts as empty and has no spans.  ``vocabulary`` is a rank file that every
    worker can read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = scanner(vocabulary)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("ratio", pa.float64())]))
        for batch in batches:
            for piece in pieces(batch):
                maybe = pc.match_substring_regex(piece.column(1), _ANY).to_pylist()
                spans = [[{"kind": KINDS[k], "start": s, "end": e, "ratio": r} for s, k, e, r in loaded.spans(piece.column(1)[i].as_py())] if hit else []
                         for i, hit in enumerate(maybe)]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(spans, type=kind)], names=["doc_id", "spans"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return texts.mapInArrow(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,ratio:double>>")
