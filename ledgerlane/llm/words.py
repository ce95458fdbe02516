"""Words of whole texts as 64-bit numbers, for an Arrow batch at a time.

A word is a run of bytes other than space and 0x09-0x0D, with A-Z lower-cased.
Words are told apart by 64-bit hashes of all their bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_M1, _M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
# Bytes of text worked on at once, whole texts at least.
PIECE = 2 << 20
# A longer word is hashed by itself.
LONG_WORD = 512


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each one ends."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    bounds = np.frombuffer(offsets, dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and len(texts) else np.zeros(0, dtype=np.uint8)
    if not len(bounds):
        return whole[:0], np.zeros(1, dtype=np.int64)
    return whole[bounds[0]:bounds[-1]], bounds - bounds[0]


def pieces(batch: pa.RecordBatch, text_col: int = 1, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes of text each."""
    if not batch.num_rows:
        return
    _, bounds = bytes_of(batch.column(text_col))
    start = 0
    while start < batch.num_rows:
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + size, side="right")) - 1)
        yield batch.slice(start, stop - start)
        start = stop


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and bounds: the words of text ``i`` are
    ``hashes[bounds[i]:bounds[i + 1]]``."""
    data, bounds = bytes_of(texts)
    return hash_words(data, bounds)


def hash_words(data: np.ndarray, bounds: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """``gaps`` says which of the 256 bytes are no part of a word."""
    data = _LOWER[data]
    inside = ~gaps[data]
    first = np.zeros(len(data) + 1, dtype=bool)
    first[bounds] = True  # a text starts here, or the last one ends
    opens = inside.copy()
    opens[1:] &= ~inside[:-1] | first[1:-1]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | first[1:-1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    return _hash_spans(data, starts, ends), np.searchsorted(starts, bounds)


def _hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    hashes = mixed(lengths.astype(np.uint64) * _M3 + np.uint64(1))
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded[:8].view(np.uint64), shape=(len(data) + 1,), strides=(1,))
    active = np.flatnonzero(lengths <= LONG_WORD)
    at, left = starts[active], lengths[active]
    while len(active):
        lane = lanes[at] & _MASKS[np.minimum(left, 8)]
        hashes[active] = mixed((hashes[active] ^ lane) * _M3)
        more = left > 8
        active, at, left = active[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(lengths > LONG_WORD):
        digest = hashlib.blake2b(data[starts[i]:ends[i]].tobytes(), digest_size=8).digest()
        hashes[i] = np.frombuffer(digest, dtype=np.uint64)[0]
    return hashes


# Odd multipliers, one for each place in a sequence of words.
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def runs(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words within a text, in order, with bounds.

    A text of fewer words (but at least one) is one run.
    """
    counts = np.diff(bounds)
    whole = max(0, len(hashes) - n + 1)
    sums = np.zeros(whole, dtype=np.uint64)
    for k in range(n):
        sums += hashes[k:k + whole] * _PLACES[k]
    inside = np.ones(whole, dtype=bool)
    # A run that starts among the last n - 1 words of a text crosses its end;
    # in a short text every run does.
    for k in range(1, n):
        crossing = bounds[1:] - k
        inside[crossing[(crossing >= 0) & (crossing < whole)]] = False
    out_counts = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out_bounds = np.concatenate([[0], np.cumsum(out_counts)])
    short = np.flatnonzero((counts > 0) & (counts < n))
    out = np.empty(out_bounds[-1], dtype=np.uint64)
    place = np.ones(len(out), dtype=bool)
    place[out_bounds[short]] = False
    out[place] = mixed(sums[inside])
    for i in short:
        some = hashes[bounds[i]:bounds[i + 1]]
        total = (some * _PLACES[:len(some)]).sum(dtype=np.uint64, keepdims=True)
        out[out_bounds[i]] = mixed(total + np.uint64(len(some)))[0]
    return out, out_bounds


def distinct(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values of every slice, with their bounds."""
    sets = [np.unique(values[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    sizes = [len(s) for s in sets]
    return (np.concatenate(sets) if sets else values[:0]), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
