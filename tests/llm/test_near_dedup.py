"""Near duplicates and components against plain versions."""

import random

import numpy as np
import pyarrow as pa
import pytest
from plain import near_groups, prose, shingles, table, words

from ledgerlane.llm import near_dedup
from ledgerlane.llm.components import components
from ledgerlane.llm.words import hash_words, runs, words_of


def edited(text, share, seed):
    rng, out = random.Random(seed), text.split(" ")
    for i in rng.sample(range(len(out)), int(share * len(out))):
        out[i] = f"e{rng.randrange(10**6)}"
    return " ".join(out)


def corpus():
    rows = [(i, prose(i, 150)) for i in range(40)]
    rows += [(100 + i, edited(rows[i % 4][1], 0.01 * (i % 6), i)) for i in range(60)]
    chain = prose(77, 200).split(" ")  # each is near the next, the ends are far apart
    rows += [(300 + k, " ".join(chain[k * 6:k * 6 + 120])) for k in range(13)]
    common = prose(78, 60)  # a long passage in many texts that are otherwise different
    rows += [(400 + k, common + " " + prose(500 + k, 70)) for k in range(40)]
    rows += [(600, ""), (601, "one two"), (602, "One  two"), (603, "two one"), (604, " \n"), (605, "a b c d e"), (606, "a b c d e f"),
             (607, "x" * 3000), (608, "X" * 3000), (609, "é É é")]
    return rows


@pytest.mark.parametrize("block", [256, 3])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(table(spark, rows)).collect()}
    assert got == near_groups(rows)


def short_corpus():
    """Texts of 5 to 26 words, each beside edited ones, and a passage that many begin with."""
    rng, rows = random.Random(11), []
    for i in range(300):
        text = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 27))]
        rows.append((10 * i, " ".join(text)))
        rows.append((10 * i + 1, " ".join(text + ["more"])))
        rows.append((10 * i + 2, " ".join(["front", *text])))
        rows.append((10 * i + 3, " ".join(text[:-1])))
        rows.append((10 * i + 4, " ".join(["the same first words of many short texts", *text[:4]])))
    return rows


@pytest.mark.parametrize("blind", [False, True])
def test_short_texts_without_chance(spark, monkeypatch, blind):
    """Also where no minimum or maximum agrees and every pair is below the limit of signs."""
    if blind:
        monkeypatch.setattr(near_dedup, "SIGN", 1.1)
        monkeypatch.setattr(near_dedup, "bands", lambda signature: near_dedup.mixed(
            np.random.default_rng().integers(0, 2**63, (len(signature), near_dedup.BANDS)).astype(np.uint64)))
    rows = short_corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(table(spark, rows)).collect()}
    assert got == near_groups(rows)


def test_odd_rows(spark):
    text = prose(5, 80)
    df = table(spark, [(5, text), (5, text), (None, text), (2, text), (7, None)]).selectExpr("*", "1 AS node", "2 AS band", "3 AS component_id")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_groups(df).collect()), key=str)
    n = len(shingles(text))
    assert got == sorted([(5, n, 2, False), (5, n, 2, False), (None, n, None, True), (2, n, 2, True), (7, 0, 7, True)], key=str)
    assert near_dedup.near_groups(table(spark, [])).collect() == []


def test_min_and_max_estimate_similarity():
    rng = np.random.default_rng(3)
    errors = []
    for _ in range(60):
        both, one, two = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (300, 50, 50))
        a, b = (np.unique(np.concatenate([both, x])) for x in (one, two))
        sign = near_dedup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        errors.append((sign[0] == sign[1]).mean() - 0.75)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.05


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1002), (2000, 2000)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(301)}, 1000: 1000, 1001: 1000, 1002: 1000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_words_and_runs():
    texts = ["", "A b\tc", None, "  x ", "one two three four five six", "a", "Ä \x00", "y" * 600 + " z", "p q r s t", "The the THE"]
    hashes, bounds = words_of(pa.array(texts))
    names = {}
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert b - a == len(words(text))
        for w, h in zip(words(text), hashes[a:b]):
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    values, ends = runs(hashes, bounds, 5)
    seen = {}
    for text, a, b in zip(texts, ends[:-1], ends[1:]):
        w = words(text)
        want = [tuple(w[i:i + 5]) for i in range(len(w) - 4)] if len(w) >= 5 else [tuple(w)] if w else []
        assert b - a == len(want) and all(seen.setdefault(r, v) == v for r, v in zip(want, values[a:b]))
    assert len(set(seen.values())) == len(seen)
    assert len(hash_words(np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64))[0]) == 0
