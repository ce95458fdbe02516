"""The stages one after another against their plain versions."""

import os
import random
from collections import Counter

import pytest
import sentencepiece
from plain import COLUMNS, fitting, mixed, one_of_each_group, prose, without_site_lines

import corpus_pipeline as pipeline
from ledgerlane.llm import language_id

pytestmark = pytest.mark.skipif(not os.path.exists(pipeline.PIECE_MODEL), reason="no vocabulary files")


def corpus():
    rng = random.Random(4)
    words = {"en": ["the", "house", "stands", "by", "river", "and", "shines"], "de": ["das", "haus", "steht", "bei", "dem", "fluß", "und"]}
    rows = []
    for i in range(90):
        lang = "en" if i % 3 else "de"
        body = "\n".join(" ".join(rng.choice(words[lang]) + str(rng.randrange(60)) for _ in range(12)) for _ in range(3))
        rows.append([i, ("Site menu\n" if i % 2 else "") + body, lang if i % 5 else None, f"s{min(i % 4, 2)}"])
    for i in range(90, 110):  # copies and near copies
        text = rows[i % 7][1]
        rows.append([i, text if i % 2 else text + " tail", "en", f"s{i % 3}"])
    rows += [[200, "12345 -- 678", "en", "s0"], [201, None, "en", "s0"], [202, "", None, "s1"], [203, "ქართული ენა და ტექსტი", None, "s1"], [204, prose(9, 40), None, None]]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def test_each_stage_on_what_the_one_before_kept(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, COLUMNS)
    plain = [lambda r: fitting(r, language_id.ORDER, language_id.MAX_BITS), without_site_lines, one_of_each_group, mixed]
    for (name, stage), version in zip(pipeline.STAGES, plain):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns, name
        kept = [tuple(r) for r in got.collect()]
        want = version(rows)
        assert Counter(kept) == Counter(want), name
        assert 0 < len(want) and Counter(want) != Counter(rows), name
        rows, docs = kept, spark.createDataFrame(kept, COLUMNS)
    library = sentencepiece.SentencePieceProcessor(model_file=pipeline.PIECE_MODEL)
    last = pipeline.STAGES[-1][1](spark, docs, "").collect()
    assert Counter((r.doc_id, tuple(r.ids)) for r in last) == Counter((r[0], tuple(library.encode(r[1] or "", add_eos=True))) for r in rows)


def test_run_is_all_stages(spark, tmp_path):
    docs = spark.createDataFrame(corpus(), COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        want = stage(spark, want, str(tmp_path))
    assert Counter((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, str(tmp_path)).collect()) == Counter((r.doc_id, tuple(r.ids)) for r in want.collect())


def test_repeated_rows_null_ids_and_nothing(spark):
    text = prose(1, 30)
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (1, text, "en", "s", 1), (None, text, "en", "s", 1), (2, text, "en", "s", 1), (3, prose(2, 30), None, None, None)], COLUMNS)
    got = dict(pipeline.STAGES)["near_dedup"](spark, docs, "").collect()
    assert sorted((r.doc_id for r in got), key=str) == [1, 3, None]
    empty = spark.createDataFrame([], COLUMNS)
    for name, stage in pipeline.STAGES:
        assert stage(spark, empty, "").collect() == [], name
