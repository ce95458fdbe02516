"""Language identification, language model and fingerprints against plain versions."""

import hashlib
import math
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from plain import Bigrams, ByteTrees, prose, table

from ledgerlane.llm import language_id, language_model, spots
from ledgerlane.llm.counted import Counts, merged, pack, unpack, with_large
from ledgerlane.llm.words import bytes_of, pieces

GREEK = ["καλημέρα κόσμε", "ο κόσμος είναι μικρός", "η θάλασσα"]
LATIN = ["good morning world", "the world is small", "the sea", "world sea"]


def test_coding_many_texts_takes_little_memory(spark):
    docs = table(spark, [(i, t, "el", "s") for i, t in enumerate(GREEK)] + [(10 + i, t, "en", "s") for i, t in enumerate(LATIN)])
    model = language_id.fit(language_id.count_runs(docs.select("lang", "text")).toArrow())
    batch = pa.RecordBatch.from_arrays([pa.array(range(400)), pa.array([f"the sea {i} " * 500 for i in range(400)])], names=["doc_id", "text"])
    whole = model.code_lengths(*bytes_of(batch.column(1)))
    tracemalloc.start()
    parts = [model.code_lengths(*bytes_of(p.column(1))) for p in pieces(batch, size=language_id.CODED_BYTES)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(parts) > 4 and np.array_equal(np.concatenate(parts), whole)
    assert peak < 64 << 20


def test_code_lengths_are_those_of_byte_trees(spark):
    docs = table(spark, [(i, t, "el", "s") for i, t in enumerate(GREEK)] + [(10 + i, t, "en", "s") for i, t in enumerate(LATIN)])
    for order in (0, 2, 4):
        counts = language_id.count_runs(docs.select("lang", "text"), order).toArrow()
        model = language_id.fit(counts, order)
        assert model.languages == ["el", "en"]
        texts = ["the world", "κόσμος", "", "x", "tha sea κ\n\n", "\x00ÿ", "good " * 50]
        bits = model.code_lengths(*bytes_of(pa.array(texts)))
        trees = [ByteTrees(t, order) for t in (GREEK, LATIN)]
        assert np.allclose(bits, [[t.bits(x) for t in trees] for x in texts], rtol=1e-5, atol=1e-4)


def test_identify_odd_rows(spark):
    docs = table(spark, [(i, t, "el", "s") for i, t in enumerate(GREEK)] + [(10 + i, t, "en", "s") for i, t in enumerate(LATIN)] + [(99, "no label", None, "s"), (98, None, "fr", "s")])
    model = language_id.learn(docs)
    rows = [(1, "the sea is good"), (2, "ο κόσμος"), (3, None), (4, ""), (5, "123 !?"), (None, "small world"), (1, "the sea is good"), (6, "sea " * 40000)]
    got = sorted(((r.doc_id, r.lang_pred, r.bits_per_byte is None) for r in language_id.identify(table(spark, rows), model, keep=("source",)).collect()), key=str)
    assert got == sorted([(1, "en", False), (2, "el", False), (3, "und", True), (4, "und", True), (5, "und", True), (None, "en", False), (1, "en", False), (6, "en", False)], key=str)
    assert all(0 <= r.score <= 1 for r in language_id.identify(table(spark, rows), model).collect())
    nothing = language_id.fit(pa.table({"lang": pa.array([], pa.string()), "run": pa.array([], pa.int64()), "times": pa.array([], pa.int64())}))
    assert {r.lang_pred for r in language_id.identify(table(spark, rows), nothing).collect()} == {"und"}
    assert language_id.identify(table(spark, []), model).collect() == []


def test_sample_is_bounded_by_bytes(spark):
    docs = table(spark, [(i, "x" * 100, "a" if i % 10 else "b", "s") for i in range(3000)])
    from pyspark.sql import functions as F

    got = {r.lang: r.n for r in language_id.sample(docs, F.col("lang"), F.col("text"), F.col("doc_id"), 50_000).groupBy("lang").agg(F.count("*").alias("n")).collect()}
    assert got["b"] == 300 and 350 < got["a"] < 650


def test_languages_of_few_long_texts_are_in_the_sample(spark):
    from pyspark.sql import functions as F

    rows = [(i, "ab\n" * 400_000, f"one text {i}", "s") for i in range(20)] + [(100 + i, "x" * 100, "many", "s") for i in range(3000)]
    columns = F.col("lang"), F.col("text"), F.col("doc_id")
    got = {r.lang: r.n for r in language_id.sample(table(spark, rows), *columns, 50_000).groupBy("lang").agg(F.sum(F.octet_length("text")).alias("n")).collect()}
    assert set(got) == {"many", *(f"one text {i}" for i in range(20))} and all(4_000 <= n < 120_000 for n in got.values())
    least = language_id.sample(table(spark, rows), *columns, 1).groupBy("lang").agg(F.count("*").alias("n")).collect()
    assert len(least) == 21 and all(r.n >= 1 for r in least)
    assert language_id.sample(table(spark, rows[:3]), *columns, 10**9).agg(F.sum(F.octet_length("text"))).first()[0] == 3 * 1_200_000


def test_held_out_accuracy(spark):
    from ledgerlane.llm.queries import op1_language_id

    folder = "/root/testdata/sf0.01"
    got = op1_language_id(spark, folder).filter("held_out").join(spark.read.parquet(f"{folder}/documents.parquet"), "doc_id").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) >= 0.98 * len(got)


def test_scores_are_kneser_ney(spark):
    learn = [prose(i, 60, 30) for i in range(30)] + ["", None, "a", "a b a b a b", "The THE the"]
    plain = Bigrams(learn)
    folder = language_model.train(table(spark, list(enumerate(learn))))
    rows = list(enumerate([*learn[:5], "", None, "w1 w2 unseen w3", "unseen unseen", "a b", prose(99, 2000, 40)])) + [(None, "w1"), (0, learn[0])]
    got = {(r.doc_id, r.n_tokens): r for r in language_model.score(table(spark, rows), folder).collect()}
    for i, t in rows:
        r = got[i, len(plain.tokens(t))]
        assert r.train_tokens == plain.total and r.n_known == sum(plain.counts[w] > 0 for w in plain.tokens(t))
        assert np.isclose(r.score, plain.score(t), rtol=1e-9) and np.isclose(r.base_score, plain.base(t), rtol=1e-9)
        assert np.isclose(r.perplexity, 10 ** (-plain.score(t) / len(plain.tokens(t))))
    # The probabilities behind a context add up to one, the unknown word included.
    for context in ("w1", "<s>", "a"):
        total = sum(plain.probability(context, w) for w in plain.counts) + plain.probability(context, "no such word")
        assert abs(total - 1) < 1e-9


class Trigrams(Bigrams):
    """Order three; pairs behind the start mark keep their counts."""

    def __init__(self, texts):
        super().__init__(texts)
        tokens = [["<s>", *self.tokens(t)] for t in texts]
        self.triples = Counter(x for t in tokens for x in zip(t, t[1:], t[2:]))
        times = Counter((b, c) for _, b, c in self.triples)
        self.pairs = Counter({p: c if p[0] == "<s>" else times[p] for p, c in self.pairs.items()})
        self.contexts, self.wide = defaultdict(lambda: [0, 0, 0, 0]), defaultdict(lambda: [0, 0, 0, 0])
        for counter, contexts in ((self.pairs, self.contexts), (self.triples, self.wide)):
            for gram, c in counter.items():
                key = gram[0] if len(gram) == 2 else gram[:2]
                contexts[key][0] += c
                contexts[key][min(c, 3)] += 1
        self.d_pair, self.d_triple = self.discounts(self.pairs), self.discounts(self.triples)

    def third(self, a, b, c):
        if (a, b) not in self.wide:
            return self.probability(b, c)
        total, *kinds = self.wide[a, b]
        left = sum(d * k for d, k in zip(self.d_triple[1:], kinds)) / total
        return max(self.triples[a, b, c] - self.d_triple[min(self.triples[a, b, c], 3)], 0) / total + left * self.probability(b, c)

    def score(self, text):
        t = ["<s>", *self.tokens(text)]
        return math.log10(self.probability(*t[:2])) + sum(math.log10(self.third(*x)) for x in zip(t, t[1:], t[2:]))


def test_scores_of_order_three(spark):
    learn = [prose(i, 60, 8 + i) for i in range(30)] + ["", None, "a", "a b a b a b", "The THE the", "a b c a b d"]
    plain = Trigrams(learn)
    folder = language_model.train(table(spark, list(enumerate(learn))), order=3)
    rows = list(enumerate([*learn[:5], "", None, "w1 w2 unseen w3 w1", "unseen unseen", "a b", "a b c", prose(99, 2000, 40)]))
    got = {r.doc_id: r for r in language_model.score(table(spark, rows), folder).collect()}
    for i, t in rows:
        assert np.isclose(got[i].score, plain.score(t), rtol=1e-9), t
    for context in (("w1", "w2"), ("<s>", "a"), ("a", "b")):
        assert abs(sum(plain.third(*context, w) for w in [*plain.counts, "no such word"]) - 1) < 1e-9
    # What stands two words before tells the next word.
    turns = ["x m p", "y m q"] * 50
    two, three = (language_model.score(table(spark, [(1, "x m p")]), language_model.train(table(spark, list(enumerate(turns))), order=k)).first().score for k in (2, 3))
    assert three > two + 0.1
    empty = language_model.train(table(spark, []), order=3)
    assert language_model.score(table(spark, [(1, "any word")]), empty).first().score == 0.0


def test_counts_beyond_32_bits_stay_whole(spark, monkeypatch):
    wanted = np.array([1, 2**32 - 2, 2**32 - 1, 2**32, 5, 2**60 + 1], dtype=np.uint64)
    assert Counts(with_large(wanted)).all().tolist() == wanted.tolist()
    assert Counts(with_large(wanted))[np.array([5, 0, 3, 3])].tolist() == [2**60 + 1, 1, 2**32, 2**32]
    assert Counts(with_large(wanted[:0])).all().tolist() == []

    # A corpus in which everything occurs 2^33 times as often.
    plain, times = language_model._counted, np.uint64(2**33)

    def often(batches, keys_of, edges):
        for blocks in plain(batches, keys_of, edges):
            data = [pack(keys, counts * times) for keys, counts in map(unpack, blocks.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([blocks.column(0), pa.array(data, type=pa.binary())], names=["bucket", "block"])

    monkeypatch.setattr(language_model, "_counted", often)
    folder = language_model.train(table(spark, [(1, "a b a b c"), (2, "a b")]), order=3)
    pairs, triples = language_model._pair_model(folder), language_model._triple_model(folder)
    assert sorted(n for f in pairs.files.values() for n in f[3].all()) == sorted(k * 2**33 for k in (2, 3, 1, 1, 1, 1))
    assert sorted(n for f in triples.files.values() for n in f[2].all()) == [2**33] * 5 + [2**34]
    rows = {r.doc_id: r for r in language_model.score(table(spark, [(1, "a b")]), folder).collect()}
    assert rows[1].train_tokens == 9 * 2**33 and -1 < rows[1].score < 0


def test_model_of_nothing(spark):
    folder = language_model.train(table(spark, []))
    r = language_model.score(table(spark, [(1, "any word")]), folder).first()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and r.score == 0.0 and r.base_score == 0.0
    assert language_model.score(table(spark, []), folder).collect() == []


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**64 - 1, 1000, dtype=np.uint64))
    counts = rng.integers(1, 2**40, len(keys), dtype=np.uint64)
    for n in (0, 1, len(keys)):
        k, c = unpack(pack(keys[:n], counts[:n]))
        assert (k == keys[:n]).all() and (c == counts[:n]).all()
    k, c = merged([(keys, counts), (keys[::2], counts[::2])])
    assert (k == keys).all() and (c[::2] == 2 * counts[::2]).all() and (c[1::2] == counts[1::2]).all()


def test_edited_texts_follow_the_order_of_ids(spark):
    rows = [(3 * i, prose(i, 5 + i % 90) + " the end of it") for i in range(120)] + [(1000, ""), (1001, None), (1002, "é"), (1003, "!!!!"), (1003, "????")]
    docs = table(spark, rows + [(None, "no place the order")]).repartition(7)
    result = spots.edited_fingerprints(docs).collect()
    assert len(result) == len(rows) + 1
    got = {(r.doc_id, r.fingerprint): r for r in result}
    own = {(r.doc_id, "".join(f"{s:08x}" for s in r.spots)) for r in spots.fingerprints(docs).collect()}
    assert set(got) == own
    ordered = sorted(((i, t or "") for i, t in rows))
    edited = {}
    for k, (i, t) in enumerate(ordered):
        after, cut = ordered[(k + 1) % len(ordered)][1], len(t) // 4
        edited[i, t] = hashlib.sha256((t[:len(t) - cut] + after[:cut]).encode()).hexdigest()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256) for r in result if r.doc_id is not None) == sorted((i, len(t), e) for (i, t), e in edited.items())
    assert all((r.fingerprint == "") == (r.n_chars == 0) for r in result)
    lone = next(r for r in result if r.doc_id is None)
    assert lone.near_edited == 1 and lone.near_next == 0
    sets = {r.doc_id: {r.fingerprint[k:k + 8] for k in range(0, len(r.fingerprint), 8)} for r in result}
    for (i, _), (j, _) in zip(ordered[:100], ordered[1:101]):
        r = next(x for x in result if x.doc_id == i)
        assert abs(r.near_next - (len(sets[i] & sets[j]) / len(sets[i] | sets[j]))) < 1e-12
    assert np.median([r.near_edited for r in result if r.n_chars > 150]) > 0.5 and np.median([r.near_next for r in result]) < 0.1
    assert spots.edited_fingerprints(table(spark, [])).collect() == []
    only = spots.edited_fingerprints(table(spark, [(5, "just one text of the lot")])).first()
    assert only.near_next == 1.0


def test_spots_are_anchors_and_chains():
    known = spots.anchor_hashes(("the", "of"))

    def of(text):
        values, bounds = spots.spots(pa.array([text]), known)
        return set(values.tolist())

    assert len(of("The cat sat down, the dog ran far of.")) == 3
    assert of("the cat sat down") & of("THE cat sat down! more words") and not of("the cat sat down") & of("of cat sat down")
    assert of("one two three four") and not of("")
    assert spots.likeness(np.array([1, 2, 3]), np.array([2, 3, 4])) == 0.5 and spots.likeness(np.array([]), np.array([])) == 1.0


def test_similar_sets_of_a_table_are_all_found(spark, monkeypatch):
    rng = np.random.default_rng(5)
    sets = []
    for group in range(25):  # near copies with a common core, in all sizes
        core = rng.choice(2**20, size=int(rng.integers(1, 60)), replace=False)
        for _ in range(6):
            some = rng.choice(core, size=max(1, int(len(core) * rng.uniform(0.4, 1))), replace=False)
            sets.append(sorted({7, *some.tolist(), *rng.choice(2**20, size=int(rng.integers(0, 12))).tolist()}))  # 7 is in all
    sets += [sets[0], sets[0], sets[9], [], [3]]
    rows = [(int(i), s) for i, s in zip(rng.permutation(len(sets)), sets)] + [(None, sets[0])]
    prints = spark.createDataFrame(rows, "doc_id long, spots array<long>").repartition(5)
    distinct = {}
    for i, s in rows:
        if i is not None and s:
            distinct.setdefault(tuple(s), []).append(i)
    for least, cell in ((0.3, 500), (0.5, 3), (0.55, 500), (0.8, 500), (1.0, 500)):
        monkeypatch.setattr(spots, "CELL", cell)
        want = {(min(ids), i): 1.0 for ids in distinct.values() for i in ids if i != min(ids)}
        for s in distinct:
            for t in distinct:
                jaccard = len(set(s) & set(t)) / len(set(s) | set(t))
                if s < t and jaccard >= least:
                    want[tuple(sorted((min(distinct[s]), min(distinct[t]))))] = jaccard
        got = spots.similar(prints, least).collect()
        assert len(got) == len(want) and {(r.one, r.other): r.jaccard for r in got} == want
    assert spots.similar(spark.createDataFrame([], "doc_id long, spots array<long>")).collect() == []


def test_similar_documents_need_not_be_neighbours(spark):
    text = prose(3, 80) + " the end of it"
    docs = table(spark, [(1, text), (2, prose(4, 80)), (3, prose(5, 80)), (90, text + " and more words")])
    assert [(r.one, r.other) for r in spots.similar(spots.fingerprints(docs)).collect()] == [(1, 90)]
