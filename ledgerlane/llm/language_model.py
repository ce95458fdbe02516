"""Interpolated modified Kneser-Ney model of two or three words.

Counting is two Spark jobs over the training texts.  The first counts words, by
64-bit hash; a word's number is the place of its hash among all hashes in
ascending order.  The second counts pairs of numbers.  Both add up within a
task, send compact sorted blocks, a block for each range of keys, and merge the
blocks of a range in one task that writes the range's arrays:

* ``words-*``: ascending hashes, counts, and how many different words each one
  follows (its continuation count);
* ``pairs-*``: for each first word, where its followers start; the followers in
  ascending order; their counts; and the first word's total and its numbers of
  followers seen once, twice and more often.

At order three a third job counts words behind pairs, by the place of the pair
among all pairs:

* ``triples-*``: for each pair, where its followers start; the followers and
  their counts; and the sums of pairs that have many followers;
* ``adjusted-*``: for each pair, how many different words it follows (its count,
  if it starts a text), and the sums of these for its first word.  They take the
  place of the counts of pairs.

Workers memory-map these files and look words and pairs up in them.  A text is
one sentence: its first word follows a start mark, and an end mark follows its
last word.  Counts are whole at any size: those beyond 32 bits stand at the end of
their file.  Numbers of words and places within a range have 32 bits; training
raises where they do not suffice.  A word outside the training texts has the share that is left over
for it in the distribution of continuations.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import cut, fresh_folder, remainder, small_batches
from ledgerlane.llm.counted import blocks_by_bucket, by_bucket, mapped, mapped_counts, merged, read_json, with_large, write_arrays, write_json
from ledgerlane.llm.words import mixed, pieces, words_of

# Bytes of text whose words make one range of keys, about.
RANGE_BYTES = 32 << 20
# Keys that a task holds before it adds them up.
HELD = 3_000_000
# The end mark, as a hash no different from those of words.
END = mixed(np.array([0xE0D], dtype=np.uint64))[0]
_LOW = np.uint64(0xFFFFFFFF)
# The sums of a pair with more followers than this are stored; others are added up when asked for.
FEW = 8


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of every text and its end mark, with bounds."""
    hashes, bounds = words_of(texts)
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def _counted(batches: Iterator[pa.RecordBatch], keys_of, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Blocks of the keys of all texts of a task."""
    held, size = [], 0
    total = None

    def added():
        found = np.unique(np.concatenate(held), return_counts=True)
        found = found[0], found[1].astype(np.uint64)
        return found if total is None else merged([total, found])

    for batch in batches:
        for piece in pieces(batch, text_col=0):
            held.append(keys_of(piece.column(0)))
            size += len(held[-1])
            if size > HELD:
                total, held, size = added(), [], 0
                if len(total[0]) > 4 * HELD:
                    yield blocks_by_bucket(*total, edges)
                    total = None
    if held:
        total = added()
    if total is not None and len(total[0]):
        yield blocks_by_bucket(*total, edges)


def train(texts: DataFrame, text_col: str = "text", folder: str | None = None, order: int = 2) -> str:
    """Learn from all rows of ``texts``; returns the folder of the model.

    ``order`` is 2 or 3: a word behind one word, or behind two.
    Null texts count as empty: an end mark alone.
    """
    if order not in (2, 3):
        raise ValueError("order must be 2 or 3")
    spark = texts.sparkSession
    small_batches(spark)
    folder = folder or fresh_folder(spark, "model")
    texts = texts.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = 1 << max(2, int(size / RANGE_BYTES).bit_length())
    words = _count_words(texts, folder, ranges)
    index = {"order": order, "ranges": ranges, "words": words, "tokens": sum(w["tokens"] for w in words), "vocabulary": sum(w["size"] for w in words)}
    write_json(folder, "words.json", index)
    _count_pairs(texts, folder, index)
    if order == 3:
        _count_triples(texts, folder, index)
    return folder


def _count_words(texts: DataFrame, folder: str, ranges: int) -> list[dict]:
    shift = np.uint64(64 - (ranges.bit_length() - 1))
    edges = np.append(np.arange(ranges, dtype=np.uint64) << shift, np.uint64(2**64 - 1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _counted(batches, lambda column: tokens_of(column)[0], edges)

    def finish(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        name = f"words-{bucket:06d}-{TaskContext.get().taskAttemptId()}"
        write_arrays(folder, name, hashes=keys.astype("<u8"), counts=counts.astype("<u8"))
        yield pa.RecordBatch.from_pydict({"bucket": [bucket], "name": [name], "size": [len(keys)], "tokens": [int(counts.sum())]})

    blocks = texts.mapInArrow(count, "bucket long, block binary")
    rows = cut(by_bucket(blocks, finish, "bucket long, name string, size long, tokens long", ranges)).collect()  # a row per range
    found = {r.bucket: r for r in rows}
    return [{"name": found[b].name, "size": found[b].size, "tokens": found[b].tokens} if b in found else {"name": None, "size": 0, "tokens": 0}
            for b in range(ranges)]


def _discounts(n: list[int]) -> list[float]:
    """Discounts of counts 1, 2, and 3 or more, from how many keys were
    counted once, twice, three and four times."""
    if min(n) == 0:
        return [0.5, 1.0, 1.5]  # too few counts to estimate from
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3)]


def _by_count(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def _count_pairs(texts: DataFrame, folder: str, index: dict) -> None:
    ranges, size = index["ranges"], index["vocabulary"]
    if size + 2 > 2**32:
        raise ValueError("the numbers of words do not fit 32 bits")
    # Ranges of first words; the start mark comes behind the last word.
    firsts = np.array([b * (size + 1) // ranges for b in range(ranges + 1)], dtype=np.uint64)
    edges = firsts << np.uint64(32)
    seconds = firsts  # the same ranges for the words that follow

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(folder)

        def pairs(column: pa.Array) -> np.ndarray:
            hashes, bounds = tokens_of(column)
            return pairs_of(vocabulary.numbers(hashes), bounds, size)

        return _counted(batches, pairs, edges)

    def finish(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        name = f"pairs-{bucket:06d}-{TaskContext.get().taskAttemptId()}"
        low, high = int(firsts[bucket]), int(firsts[bucket + 1])
        first = (keys >> np.uint64(32)).astype(np.int64) - low
        starts = np.concatenate([[0], np.cumsum(np.bincount(first, minlength=high - low))])
        kinds = np.stack([np.bincount(first, weights=w, minlength=high - low)
                          for w in (counts.astype(np.float64), counts == 1, counts == 2, counts >= 3)], axis=1)
        follower = (keys & _LOW).astype("<u4")
        write_arrays(folder, name, starts=starts.astype("<i8"), kinds=kinds.astype("<f8"), followers=follower, counts=with_large(counts))
        words, times = np.unique(follower.astype(np.uint64), return_counts=True)
        continued = blocks_by_bucket(words, times.astype(np.uint64), seconds)
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([name]), pa.array([_by_count(counts)], type=pa.list_(pa.int64())),
                                          pa.array([len(keys)]), pa.array([None], type=pa.int64()), pa.array([None], type=pa.binary())], names=names)
        n = continued.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * n), pa.array([None] * n, type=pa.string()), pa.array([None] * n, type=pa.list_(pa.int64())),
                                          pa.array([None] * n, type=pa.int64()), continued.column(0), continued.column(1)], names=names)

    names = ["range", "name", "by_count", "size", "bucket", "block"]
    blocks = texts.mapInArrow(count, "bucket long, block binary")
    merged_pairs = cut(by_bucket(blocks, finish, "range long, name string, by_count array<long>, size long, bucket long, block binary", ranges))

    def continuations(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        name = f"follows-{bucket:06d}-{TaskContext.get().taskAttemptId()}"
        low, high = int(firsts[bucket]), int(firsts[bucket + 1])
        out = np.zeros(high - low, dtype="<u4")
        out[keys.astype(np.int64) - low] = counts
        write_arrays(folder, name, counts=out)
        kinds = [*_by_count(counts), int(counts.sum()), int((counts >= 3).sum())]
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([name]), pa.array([kinds], type=pa.list_(pa.int64()))], names=["range", "name", "by_count"])

    follows = cut(by_bucket(merged_pairs.filter("bucket IS NOT NULL").select("bucket", "block"), continuations,
                            "range long, name string, by_count array<long>", ranges)).collect()  # a row per range
    pairs = merged_pairs.filter("name IS NOT NULL").select("range", "name", "by_count", "size").collect()
    pair_kinds = [sum(p.by_count[k] for p in pairs) for k in range(4)]
    word_kinds = [sum(f.by_count[k] for f in follows) for k in range(6)]
    sizes = {p.range: p.size for p in pairs}
    write_json(folder, "pairs.json", {
        "bases": [sum(sizes.get(b, 0) for b in range(k)) for k in range(ranges + 1)], "by_count": {p.range: p.by_count for p in pairs},
        "firsts": firsts.tolist(), "pairs": {p.range: p.name for p in pairs}, "follows": {f.range: f.name for f in follows},
        "pair_discounts": _discounts(pair_kinds), "word_discounts": _discounts(word_kinds[:4]),
        "types": word_kinds[4], "words_by_follows": [word_kinds[0], word_kinds[1], word_kinds[5]],
    })


def _count_triples(texts: DataFrame, folder: str, index: dict) -> None:
    ranges, size = index["ranges"], index["vocabulary"]
    known = read_json(folder, "pairs.json")
    bases, bits = np.array(known["bases"], dtype=np.uint64), max(1, size.bit_length())
    if int(bases[-1]).bit_length() + bits > 64:
        raise ValueError("the number of a pair and that of a word do not fit 64 bits")
    contexts = [b * int(bases[-1]) // ranges for b in range(ranges + 1)]
    edges, shift = np.array(contexts, dtype=np.uint64) << np.uint64(bits), np.uint64(bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs = _vocabulary(folder), _pair_model(folder)

        def triples(column: pa.Array) -> np.ndarray:
            hashes, bounds = tokens_of(column)
            numbers = vocabulary.numbers(hashes)
            distinct, inverse = np.unique(pairs_of(numbers, bounds, size), return_inverse=True)
            place = pairs.places((distinct >> np.uint64(32)).astype(np.int64), (distinct & _LOW).astype(np.int64))[inverse]
            later = np.ones(len(numbers), dtype=bool)
            later[bounds[:-1]] = False  # the first word of a text is behind the start mark alone
            at = np.flatnonzero(later)
            return place[at - 1].astype(np.uint64) << shift | numbers[at].astype(np.uint64)

        return _counted(batches, triples, edges)

    def finish(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        name = f"triples-{bucket:06d}-{TaskContext.get().taskAttemptId()}"
        low, high = contexts[bucket], contexts[bucket + 1]
        context = (keys >> shift).astype(np.int64) - low
        followers = np.bincount(context, minlength=high - low)
        starts = np.concatenate([[0], np.cumsum(followers)])
        if max(len(keys), high - low) >= 2**32:
            raise ValueError("the places of a range do not fit 32 bits")
        many = np.flatnonzero(followers > FEW)
        kinds = np.stack([np.bincount(context, weights=w, minlength=high - low)[many]
                          for w in (counts.astype(np.float64), counts == 1, counts == 2, counts >= 3)], axis=1)
        word = (keys & np.uint64((1 << bits) - 1)).astype(np.int64)
        write_arrays(folder, name, starts=starts.astype("<u4"), followers=word.astype("<u4"), counts=with_large(counts),
                     many=many.astype("<u4"), kinds=kinds.astype("<f8"))
        pairs = _pair_model(folder)
        places, times = np.unique(pairs.places(pairs.seconds(context + low), word).astype(np.uint64), return_counts=True)
        continued = blocks_by_bucket(places, times.astype(np.uint64), bases)
        n = continued.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array([bucket] + [None] * n, type=pa.int64()), pa.array([name] + [None] * n, type=pa.string()),
             pa.array([_by_count(counts)] + [None] * n, type=pa.list_(pa.int64())),
             pa.array([None, *continued.column(0).to_pylist()], type=pa.int64()), pa.array([None, *continued.column(1).to_pylist()], type=pa.binary())],
            names=["range", "name", "by_count", "bucket", "block"])

    blocks = texts.mapInArrow(count, "bucket long, block binary")
    merged_triples = cut(by_bucket(blocks, finish, "range long, name string, by_count array<long>, bucket long, block binary", ranges))

    def adjust(bucket: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        name = f"adjusted-{bucket:06d}-{TaskContext.get().taskAttemptId()}"
        starts, _, _, seen = _pair_model(folder).files[bucket]
        times = seen.all()  # a pair behind no word starts a text, and keeps its count
        times[keys.astype(np.int64) - int(bases[bucket])] = counts
        first = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        kinds = np.stack([np.bincount(first, weights=w, minlength=len(starts) - 1)
                          for w in (times.astype(np.float64), times == 1, times == 2, times >= 3)], axis=1)
        write_arrays(folder, name, counts=with_large(times), kinds=kinds.astype("<f8"))
        yield pa.RecordBatch.from_arrays([pa.array([bucket]), pa.array([name]), pa.array([_by_count(times)], type=pa.list_(pa.int64()))], names=["range", "name", "by_count"])

    adjusted = cut(by_bucket(merged_triples.filter("bucket IS NOT NULL").select("bucket", "block"), adjust,
                             "range long, name string, by_count array<long>", ranges)).collect()  # a row per range
    triples = merged_triples.filter("name IS NOT NULL").select("range", "name", "by_count").collect()
    pair_kinds = {int(b): n for b, n in known["by_count"].items()} | {a.range: a.by_count for a in adjusted}
    write_json(folder, "triples.json", {
        "contexts": contexts, "triples": {t.range: t.name for t in triples}, "adjusted": {a.range: a.name for a in adjusted},
        "triple_discounts": _discounts([sum(t.by_count[k] for t in triples) for k in range(4)]),
        "pair_discounts": _discounts([sum(n[k] for n in pair_kinds.values()) for k in range(4)]),
    })


def pairs_of(numbers: np.ndarray, bounds: np.ndarray, start: int) -> np.ndarray:
    """Each token behind the one before it; the first of a text behind ``start``."""
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[bounds[:-1]] = start
    return before.astype(np.uint64) << np.uint64(32) | numbers.astype(np.uint64)


class _Words:
    """The mapped arrays of words."""

    def __init__(self, folder: str):
        index = read_json(folder, "words.json")
        self.size, self.tokens = index["vocabulary"], index["tokens"]
        self.shift = np.uint64(64 - (index["ranges"].bit_length() - 1))
        self.files = [(mapped(folder, f"{w['name']}.hashes", "<u8"), mapped(folder, f"{w['name']}.counts", "<u8")) if w["name"] else
                      (np.zeros(0, dtype="<u8"),) * 2 for w in index["words"]]
        self.bases = np.concatenate([[0], np.cumsum([w["size"] for w in index["words"]])])

    def numbers(self, hashes: np.ndarray, counts: bool = False):
        """The number of every word, -1 for one that is not known (and its count)."""
        distinct, inverse = np.unique(hashes, return_inverse=True)
        out = np.full(len(distinct), -1, dtype=np.int64)
        times = np.zeros(len(distinct), dtype=np.int64)
        ranges = (distinct >> self.shift).astype(np.int64)
        for b in np.unique(ranges):
            known, seen = self.files[b]
            if not len(known):
                continue
            here = slice(*np.searchsorted(ranges, [b, b + 1]))
            at = np.minimum(np.searchsorted(known, distinct[here]), len(known) - 1)
            hit = known[at] == distinct[here]
            out[here] = np.where(hit, at + self.bases[b], -1)
            times[here] = np.where(hit, seen[at], 0)
        return (out[inverse], times[inverse]) if counts else out[inverse]


class _Pairs:
    """The mapped arrays of pairs; ``adjusted`` for the model of order three."""

    def __init__(self, folder: str, size: int, adjusted: bool = False):
        index = read_json(folder, "pairs.json")
        self.size, self.firsts = size, np.array(index["firsts"])
        self.files = {int(b): (mapped(folder, f"{n}.starts", "<i8"), mapped(folder, f"{n}.kinds", "<f8").reshape(-1, 4),
                               mapped(folder, f"{n}.followers", "<u4"), mapped_counts(folder, f"{n}.counts")) for b, n in index["pairs"].items()}
        self.follows = {int(b): mapped(folder, f"{n}.counts", "<u4") for b, n in index["follows"].items()}
        self.pair_discounts = np.array([0.0, *index["pair_discounts"]])
        self.word_discounts = np.array([0.0, *index["word_discounts"]])
        self.bases = np.array(index["bases"])
        if adjusted:
            changed = read_json(folder, "triples.json")
            self.pair_discounts = np.array([0.0, *changed["pair_discounts"]])
            for b, n in changed["adjusted"].items():
                starts, _, followers, _ = self.files[int(b)]
                self.files[int(b)] = starts, mapped(folder, f"{n}.kinds", "<f8").reshape(-1, 4), followers, mapped_counts(folder, f"{n}.counts")
        self.types = index["types"]
        left = float(np.dot(self.word_discounts[1:], index["words_by_follows"]))
        self.unknown = left / self.types / (size + 1) if self.types else 1.0 / (size + 1)

    def words(self, numbers: np.ndarray) -> np.ndarray:
        """Probability of words by the contexts they follow."""
        seen = np.zeros(len(numbers))
        ranges = np.searchsorted(self.firsts, numbers, side="right") - 1
        for b in np.unique(ranges[numbers >= 0]):
            if b in self.follows:
                here = np.flatnonzero((ranges == b) & (numbers >= 0))
                seen[here] = self.follows[b][numbers[here] - self.firsts[b]]
        if not self.types:
            return np.full(len(numbers), self.unknown)
        return np.maximum(seen - self.word_discounts[np.minimum(seen, 3).astype(int)], 0) / self.types + self.unknown

    def places(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The place of each pair among all, -1 for one that is not known."""
        out = np.full(len(first), -1, dtype=np.int64)
        ranges = np.searchsorted(self.firsts, first, side="right") - 1
        for b in np.unique(ranges[first >= 0]):
            if b in self.files:
                starts, _, followers, _ = self.files[b]
                here = np.flatnonzero((ranges == b) & (first >= 0))
                own = first[here] - self.firsts[b]
                at, hit = found_in(followers, starts[own], starts[own + 1], second[here])
                out[here] = np.where(hit, at + self.bases[b], -1)
        return out

    def seconds(self, places: np.ndarray) -> np.ndarray:
        """The second word of the pair at each place."""
        out = np.empty(len(places), dtype=np.int64)
        ranges = np.searchsorted(self.bases, places, side="right") - 1
        for b in np.unique(ranges):
            here = np.flatnonzero(ranges == b)
            out[here] = self.files[b][2][places[here] - self.bases[b]]
        return out

    def probabilities(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Of ``second`` behind ``first``, given by number, ascending by first."""
        out = self.words(second)
        ranges = np.searchsorted(self.firsts, first, side="right") - 1
        for b in np.unique(ranges[first >= 0]):
            if b not in self.files:
                continue
            starts, kinds, followers, counts = self.files[b]
            here = np.flatnonzero((ranges == b) & (first >= 0))
            own, word = first[here] - self.firsts[b], second[here]
            at, hit = found_in(followers, starts[own], starts[own + 1], word)
            seen = np.where(hit, counts[at], 0)
            of = kinds[own]
            total = of[:, 0]
            known = total > 0
            safe = np.maximum(total, 1)
            found = np.maximum(seen - self.pair_discounts[np.minimum(seen, 3)], 0) / safe
            left = of[:, 1:] @ self.pair_discounts[1:] / safe
            out[here] = np.where(known, found + left * out[here], out[here])
        return out


class _Triples:
    """The mapped arrays of words behind pairs."""

    def __init__(self, folder: str):
        index = read_json(folder, "triples.json")
        self.contexts = np.array(index["contexts"])
        self.files = {int(b): (mapped(folder, f"{n}.starts", "<u4"), mapped(folder, f"{n}.followers", "<u4"),
                               mapped_counts(folder, f"{n}.counts"), mapped(folder, f"{n}.many", "<u4"), mapped(folder, f"{n}.kinds", "<f8").reshape(-1, 4)) for b, n in index["triples"].items()}
        self.discounts = np.array([0.0, *index["triple_discounts"]])

    def probabilities(self, pair: np.ndarray, word: np.ndarray, out: np.ndarray) -> np.ndarray:
        """Of ``word`` behind the pair at a place (-1: none), where ``out`` is that behind its second word."""
        out = out.copy()
        ranges = np.searchsorted(self.contexts, pair, side="right") - 1
        for b in np.unique(ranges[pair >= 0]):
            if b not in self.files:
                continue
            starts, followers, counts, many, sums = self.files[b]
            here = np.flatnonzero((ranges == b) & (pair >= 0))
            own = pair[here] - self.contexts[b]
            low, stop = starts[own].astype(np.int64), starts[own + 1].astype(np.int64)
            at, hit = found_in(followers, low, stop, word[here])
            seen = np.where(hit, counts[at], 0)
            kinds = np.zeros((len(here), 4))
            few = stop - low <= FEW
            for k in range(FEW):
                some = np.flatnonzero(few & (low + k < stop))
                n = counts[low[some] + k]
                kinds[some, 0] += n
                kinds[some, np.minimum(n, 3)] += 1
            kinds[~few] = sums[np.searchsorted(many, own[~few])]
            total = np.maximum(kinds[:, 0], 1)
            found = np.maximum(seen - self.discounts[np.minimum(seen, 3)], 0) / total
            left = kinds[:, 1:] @ self.discounts[1:] / total
            out[here] = np.where(kinds[:, 0] > 0, found + left * out[here], out[here])
        return out


def found_in(values: np.ndarray, low: np.ndarray, stop: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted value is in its ascending slice, and whether it is."""
    high = stop.copy()
    while (open_ := low < high).any():
        middle = (low + high) >> 1
        less = open_ & (values[np.minimum(middle, len(values) - 1)] < wanted)
        low = np.where(less, middle + 1, low)
        high = np.where(open_ & ~less, middle, high)
    at = np.minimum(low, len(values) - 1)
    return at, (low < stop) & (values[at] == wanted)


@lru_cache(maxsize=1)
def _vocabulary(folder: str) -> _Words:
    return _Words(folder)


@lru_cache(maxsize=1)
def _pair_model(folder: str, adjusted: bool = False) -> _Pairs:
    return _Pairs(folder, _vocabulary(folder).size, adjusted)


@lru_cache(maxsize=1)
def _triple_model(folder: str) -> _Triples:
    return _Triples(folder)


def score(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity``.

    Tokens are the words and the end mark.  ``score`` is the model's log10
    probability of the text, ``base_score`` that of words by their frequencies
    (add one half).  A null text counts as empty: an end mark alone.
    """
    small_batches(docs.sparkSession)
    order = read_json(folder, "words.json")["order"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, pairs = _vocabulary(folder), _pair_model(folder, order == 3)
        for batch in batches:
            for piece in pieces(batch):
                hashes, bounds = tokens_of(piece.column(1))
                numbers, counts = vocabulary.numbers(hashes, counts=True)
                # An unknown first word keeps -1, so pairs are held apart as two arrays.
                before = np.concatenate([[0], numbers[:-1]])
                before[bounds[:-1]] = vocabulary.size
                keys = (before + 1).astype(np.uint64) << np.uint64(32) | (numbers + 1).astype(np.uint64)
                distinct, inverse = np.unique(keys, return_inverse=True)
                first, second = (distinct >> np.uint64(32)).astype(np.int64) - 1, (distinct & _LOW).astype(np.int64) - 1
                chances = pairs.probabilities(first, second)[inverse]
                if order == 3:
                    pair = np.concatenate([[-1], pairs.places(first, second)[inverse][:-1]])
                    pair[bounds[:-1]] = -1  # behind the start mark alone
                    chances = _triple_model(folder).probabilities(pair, numbers, chances)
                logs = np.log10(chances)
                base = np.log10((counts + 0.5) / (vocabulary.tokens + 0.5 * (vocabulary.size + 1)))
                starts, n = bounds[:-1], np.diff(bounds)
                scores = np.add.reduceat(logs, starts)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(n), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts)),
                     pa.array(np.full(len(n), vocabulary.tokens)), pa.array(np.add.reduceat(base, starts)), pa.array(scores), pa.array(10 ** (-scores / n))],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(id_col: str = "doc_id") -> Column:
    """A fifth of all documents, by the crc32 of their ids."""
    return remainder(F.col(id_col), 5) == 1
