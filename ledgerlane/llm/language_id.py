"""Language identification by prediction by partial matching.

For every language a tree of byte contexts is counted, from the empty one to
``order`` bytes.  The next byte is coded in the longest context: with n
occurrences of the context and d different bytes seen after it, a byte seen c
times has probability c / (n + d); the escape to the context one byte shorter
has d / (n + d) (method C).  Behind the empty context all 256 bytes are equal.
A context that a language never saw costs nothing to leave.  The statistics are
frozen, so the code length of a text is the exact sum over its bytes, and the
language with the shortest code wins.

Contexts and bytes of all languages are kept together in one table per order:
for each run of context and byte its code length in every language, escapes
included, and for each context the cost of its escape.  Looking up the longest
run therefore answers for all languages at once; only a run that no language
knows goes down to the next order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.llm.common import remainder, small_batches, small_side
from ledgerlane.llm.words import bytes_of, mixed, pieces

UNKNOWN = "und"
# Bytes of the longest context (at most 6).
ORDER = 4
# Bytes of text that a language is learned from, about: the bound that keeps
# the model small.  Pieces of texts are sampled by a hash of their ids.
SAMPLE_BYTES = 1_500_000
# Bytes of text coded at once, whole texts at least: coding takes about a hundred
# bytes of memory for each of them.
CODED_BYTES = 1 << 18
# Languages (a row each) that may be broadcast.
BROADCAST_LANGUAGES = 100_000
# Characters that are drawn into the sample at once, at most.
PIECE = 4096
# Bits of a byte beyond which no language is said to fit: half as many again as
# plain bytes take, so that a few rare letters in a short text do not reach it.
MAX_BITS = 12.0


@dataclass
class Model:
    """``keys[k]``: sorted runs of k context bytes and one more; ``costs[k]``:
    their code lengths, a column per language; ``contexts[k]``, ``escapes[k]``:
    contexts of k bytes and what leaving them costs."""

    languages: list[str]
    order: int
    keys: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def __post_init__(self):
        self.indexes = [_Index(k) for k in self.keys]
        self.context_indexes = [_Index(k) for k in self.contexts]

    def code_lengths(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Bits of every text (a row) in every language (a column)."""
        texts, k = len(bounds) - 1, self.order
        # Each text is preceded by ``order`` line feeds: its first context.
        padded = np.full(len(data) + k * texts, 10, dtype=np.uint8)
        starts = bounds[:-1] + k * np.arange(1, texts + 1)
        sizes = np.diff(bounds)
        at = np.repeat(starts - bounds[:-1], sizes) + np.arange(len(data))
        padded[at] = data
        out = np.zeros((texts, len(self.languages)))
        if not len(data):
            return out
        run = np.zeros(len(data), dtype=np.uint64)
        for back in range(k, -1, -1):
            run = run << np.uint64(8) | padded[at - back]
        bits = np.zeros((len(data), len(self.languages)), dtype=np.float32)
        todo = np.arange(len(data))
        for order in range(k, -1, -1):
            mask = np.uint64((1 << 8 * (order + 1)) - 1)
            keys = run[todo] & mask
            place, known = self.indexes[order].find(keys)
            bits[todo[known]] += self.costs[order][place[known]]
            todo, keys = todo[~known], keys[~known]
            if not len(todo):
                break
            place, known = self.context_indexes[order].find(keys >> np.uint64(8))
            bits[todo[known]] += self.escapes[order][place[known]]
        bits[todo] += 8.0
        some = np.flatnonzero(sizes)
        out[some] = np.add.reduceat(bits, bounds[:-1][some], axis=0, dtype=np.float64)
        return out


class _Index:
    """Places of 64-bit keys by open addressing, for many keys at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 3))))
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.longest = 0
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]  # of several, the last one stays
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & (len(self.slots) - 1)
            self.longest += 1

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (mixed(keys) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.zeros(len(keys), dtype=np.int64)
        known = np.zeros(len(keys), dtype=bool)
        if not len(self.keys):
            return place, known
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            slot = self.slots[at]
            hit = (slot >= 0) & (self.keys[slot] == keys[left])
            place[left[hit]] = slot[hit]
            known[left[hit]] = True
            on = ~hit & (slot >= 0)
            left, at = left[on], (at[on] + 1) & (len(self.slots) - 1)
        return place, known


def sample(docs: DataFrame, lang: Column, text: Column, key: Column, sample_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``lang, text`` of about ``sample_bytes`` bytes of every language.

    What is drawn are pieces of at most ``PIECE`` characters, so one very long
    text neither exceeds the bound nor is missed whole; the piece with the
    smallest hash of a language is always taken.  A null language or text is
    left out; an empty table gives no rows.
    """
    whole = docs.filter(lang.isNotNull() & text.isNotNull()).select(lang.alias("lang"), text.alias("text"), F.xxhash64(F.lit(5), key).alias("hash"))
    cut_up = F.when(F.char_length("text") > PIECE, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array("text"))
    parts = whole.select("lang", "hash", F.posexplode(cut_up).alias("part", "text"))
    hashed = F.when(F.col("part") == 0, F.col("hash")).otherwise(F.xxhash64("hash", "part"))
    parts = parts.select("lang", "text", (F.pmod(hashed, F.lit(1 << 30)) / F.lit(float(1 << 30))).alias("unit"))
    sizes = parts.groupBy("lang").agg(F.sum(F.octet_length("text")).alias("bytes"), F.min("unit").alias("first")).withColumnRenamed("lang", "of")
    sizes = small_side(sizes, F.lit(1), BROADCAST_LANGUAGES)
    share = F.least(F.lit(1.0), F.lit(float(sample_bytes)) / F.greatest(F.col("bytes"), F.lit(1)))
    drawn = (F.col("unit") < share) | (F.col("unit") == F.col("first"))
    return parts.join(sizes, F.col("lang") == F.col("of")).filter(drawn).select("lang", "text")


def count_runs(texts: DataFrame, order: int = ORDER) -> DataFrame:
    """``lang, run, times`` of all runs of ``order`` context bytes and one more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                langs = piece.column(0).to_pylist()
                for lang in sorted(set(langs)):
                    rows = piece.filter(pc.equal(piece.column(0), lang))
                    data, bounds = bytes_of(rows.column(1))
                    keys = [_runs_of(data[a:b], order) for a, b in zip(bounds[:-1], bounds[1:])]
                    found, times = np.unique(np.concatenate(keys), return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(found), type=pa.string()), pa.array(found.view(np.int64)), pa.array(times.astype(np.int64))],
                        names=["lang", "run", "times"])

    small_batches(texts.sparkSession)
    return texts.select("lang", "text").mapInArrow(run, "lang string, run long, times long").groupBy("lang", "run").agg(F.sum("times").alias("times"))


def _runs_of(data: np.ndarray, order: int) -> np.ndarray:
    padded = np.concatenate([np.full(order, 10, dtype=np.uint8), data])
    run = np.zeros(len(data), dtype=np.uint64)
    for k in range(order + 1):
        run = run << np.uint64(8) | padded[k:k + len(data)]
    return run


def fit(counts: pa.Table, order: int = ORDER) -> Model:
    """The frozen model of ``lang, run, times``; shorter runs follow from them."""
    languages = sorted(counts["lang"].unique().to_pylist())
    runs_all, times_all = counts["run"].to_numpy().view(np.uint64), counts["times"].to_numpy()
    by_language = [(runs_all[own], times_all[own].astype(np.float64))
                   for own in (pc.equal(counts["lang"], lang).to_numpy() for lang in languages)]
    keys, costs, contexts, escapes = [], [], [], []
    for k in range(order + 1):
        mask = np.uint64((1 << 8 * (k + 1)) - 1)
        tables = []
        for own_runs, own_times in by_language:
            runs, inverse = np.unique(own_runs & mask, return_inverse=True)
            tables.append((runs, np.bincount(inverse, weights=own_times)))
        all_runs = np.unique(np.concatenate([t[0] for t in tables])) if tables else np.zeros(0, dtype=np.uint64)
        all_contexts = np.unique(all_runs >> np.uint64(8))
        cost = np.zeros((len(all_runs), len(languages)), dtype=np.float32)
        escape = np.zeros((len(all_contexts), len(languages)), dtype=np.float32)
        for column, (runs, times) in enumerate(tables):
            own, inverse = np.unique(runs >> np.uint64(8), return_inverse=True)
            n, d = np.bincount(inverse, weights=times), np.bincount(inverse)
            escape[np.searchsorted(all_contexts, own), column] = np.log2((n + d) / d)
            # First what a run costs where the language has not seen it ...
            place = np.searchsorted(all_contexts, all_runs >> np.uint64(8))
            if k:
                shorter = np.searchsorted(keys[k - 1], all_runs & np.uint64((1 << 8 * k) - 1))
                cost[:, column] = escape[place, column] + costs[k - 1][shorter, column]
            else:
                cost[:, column] = escape[place, column] + 8.0
            # ... then where it has.
            cost[np.searchsorted(all_runs, runs), column] = np.log2((n + d)[inverse] / times)
        keys.append(all_runs)
        costs.append(cost)
        contexts.append(all_contexts)
        escapes.append(escape)
    return Model(languages, order, keys, costs, contexts, escapes)


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = ORDER,
          sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model of all labelled rows of ``docs`` (the caller leaves out what is
    held out).  The runs that come to the driver are bounded by the sample."""
    texts = sample(docs, F.col(lang_col), F.col(text_col), F.col(id_col), sample_bytes)
    return fit(count_runs(texts, order).toArrow(), order)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, lang_pred, score, bits_per_byte`` of every row, and the columns
    named in ``keep`` (which must not clash with these).

    ``score`` is the probability of the language given equal chances before:
    2^-bits of its code over the sum for all languages.  A text that is null or
    has no letter is ``und`` with score 0 and null bits; so is every text of a
    model without languages.  Ties go to the first language by name.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = shared.value
        for batch in batches:
            for piece in pieces(batch, text_col=at, size=CODED_BYTES):
                texts = piece.column(at)
                lettered = pc.fill_null(pc.match_substring_regex(texts, r"\pL"), False).to_numpy(zero_copy_only=False)
                names, scores, rates = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
                if loaded.languages:
                    data, bounds = bytes_of(texts)
                    bits = loaded.code_lengths(data, bounds)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(texts)), best]
                    scores = np.where(lettered, 1 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1), 0.0)
                    names = [loaded.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
                    rates = np.where(lettered, least / np.maximum(np.diff(bounds), 1), np.nan)
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns[:width], pa.array(names, type=pa.string()), pa.array(scores), pa.array(rates, mask=np.isnan(rates))],
                    names=[*piece.schema.names[:width], "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).alias("doc_id"), *keep)
    schema = ", ".join(f"`{n}` {kind}" for n, kind in rows.dtypes) + ", lang_pred string, score double, bits_per_byte double"
    width = len(rows.columns)
    at = 1 + keep.index(text_col) if text_col in keep else width
    inputs = rows if at < width else docs.select(F.col(id_col).alias("doc_id"), *keep, F.col(text_col).alias("__text"))
    return inputs.mapInArrow(run, schema)


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of all documents, by the crc32 of their ids."""
    return remainder(F.col(id_col), 4) == 2


