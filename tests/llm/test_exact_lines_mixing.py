"""Exact dedup, line dedup and mixing on small tables."""

import hashlib
import math

from plain import prose, table, without_site_lines

from ledgerlane.llm.exact_dedup import exact_groups
from ledgerlane.llm.line_dedup import drop_site_lines
from ledgerlane.llm.mixing import mix, rates


def test_blocks_name_whole_texts(spark):
    long = prose(1, 3000)
    rows = [(1, "same"), (9, "same"), (4, "same"), (2, long), (3, long), (5, long + "x"), (6, "x" + long[1:]), (7, None), (8, ""), (10, "é" * 9),
            (11, "é" * 9), (12, "abcdabcd"), (13, "abcdabcdabcd"), (14, "abcdefgh"), (15, "efghabcd"), (None, "lone"), (None, "same")]
    for block in (4, 7, 4096):
        got = exact_groups(table(spark, rows), block=block).collect()
        assert len(got) == len(rows)
        for r in got:
            assert r.text_sha256 in {hashlib.sha256((t or "").encode()).hexdigest() for i, t in rows if i == r.doc_id}
        by_id = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is not None}
        assert by_id[1] == by_id[4] == (9, 4, False) and by_id[9] == (9, 4, True)
        assert by_id[2] == (3, 2, False) and by_id[3] == (3, 2, True)
        assert by_id[7] == (8, 2, False) and by_id[8] == (8, 2, True) and by_id[10] == (11, 2, False)
        assert all(by_id[i] == (i, 1, True) for i in (5, 6, 12, 13, 14, 15))
        nulls = sorted(((r.keep_id, r.group_size, r.kept) for r in got if r.doc_id is None), key=str)
        assert nulls == [(9, 4, False), (None, 1, True)]


def test_exact_repeated_rows_and_other_columns(spark):
    df = spark.createDataFrame([(1, "a", 5, "k"), (1, "a", 5, "k"), (2, "b", 6, "k")], "doc_id long, text string, row int, kept string")
    got = exact_groups(df).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 2, False), (1, 1, 2, True), (2, 2, 1, True)]
    assert exact_groups(table(spark, [])).collect() == []


def test_lines_by_site(spark):
    pages = [(i, f"menu\nbody {i}\n{'rare' if i < 2 else i}", None, "big") for i in range(30)]
    copies = [(100 + i, "copied line\nanother", None, "big") for i in range(20)]
    small = [(200, "menu\nbody", None, "small"), (201, "menu\nelse", None, "small")]
    odd = [(300, None, None, "big"), (301, "", None, "big"), (302, "menu\n", None, None), (303, "menu", None, None), (304, "menu\nz", None, None)]
    got = {r.doc_id: r for r in drop_site_lines(table(spark, pages + copies + small + odd)).collect()}
    assert len(got) == len(pages + copies + small + odd)
    assert all(got[i].text == f"body {i}\n{'rare' if i < 2 else i}" and got[i].lines.dropped == 1 and got[i].lines.total == 3 for i in range(30))
    assert all(got[100 + i].text == "copied line\nanother" for i in range(20))  # copies of one page count once
    assert got[200].text == "menu\nbody" and got[300].text is None and got[300].lines.total == 0
    assert got[301].text == "" and got[302].text == "" and got[303].text == "" and got[304].text == "z"  # the null site is a site
    assert drop_site_lines(table(spark, [])).collect() == []


def test_line_ratio_is_exceeded_not_reached(spark):
    rows = [(i, "often\n" + str(i) if i < 10 else str(i), None, "s") for i in range(20)]
    assert all(r.lines.dropped == 0 for r in drop_site_lines(table(spark, rows), ratio=0.5).collect())
    assert sum(r.lines.dropped for r in drop_site_lines(table(spark, rows), ratio=0.49).collect()) == 10


def test_default_ratio_lies_in_the_gap(spark):
    from corpus_pipeline import line_dedup

    # Boilerplate on 8.7 % of the pages of a source, another line on 4.7 %.
    pages = [(i, "\n".join([*["notice"] * (i < 87), *["saying"] * (i >= 953), f"body {i}"]), None, "s", None) for i in range(1000)]
    docs = table(spark, [p[:4] for p in pages])
    for got in (drop_site_lines(docs).collect(), line_dedup(spark, docs, "").collect()):
        lines = [line for r in got for line in r.text.split("\n")]
        assert len(got) == 1000 and lines.count("notice") == 0 and lines.count("saying") == 47
    assert {(r.doc_id, r.text) for r in drop_site_lines(docs).collect()} == {(r[0], r[1]) for r in without_site_lines(pages, ratio=0.065)}


def test_poisson_table_and_draws(spark):
    rows = [(i, f"t{i}", None, "hot" if i % 3 else "cold") for i in range(3000)] + [(5000, "n", None, None), (None, "m", None, "cold"), (0, "t0", None, "cold")]
    df = table(spark, rows)
    for r in rates(df).filter("rate < 500").collect():  # this plain sum underflows beyond
        point, p = 0.0, math.exp(-r.rate)
        for k, got in enumerate(r.cdf):
            point += p
            assert abs(got - point) < 1e-9
            p *= r.rate / (k + 1)
        assert 1 - r.cdf[-1] < 1e-9
    got = mix(df).select("doc_id", "source", "mix.*").collect()
    counts = {s: sum(r.source == s for r in got) for s in ("hot", "cold", None)}
    third = len(rows) / 3
    assert all(abs(counts[s] - third) < 6 * math.sqrt(third) for s in ("hot", "cold")) and counts[None] > 0
    assert sorted((r.doc_id or -1, r.place) for r in got) == sorted((r.doc_id or -1, r.place) for r in mix(df.repartition(5)).select("doc_id", "mix.*").collect())
    only = mix(df, weights={"cold": 1.0}, total=100).collect()
    assert {r.source for r in only} == {"cold"} and 40 < len(only) < 170
    assert mix(table(spark, [])).collect() == [] and mix(df, weights={"none": 1.0}).collect() == []


def test_columns_of_any_name(spark):
    names = ["row", "host", "of_host", "marks", "page", "lines", "mix", "copy", "copies", "rate", "place", "u", "cdf", "id", "kept", "of_source"]
    docs = table(spark, [(i, f"a\n{i}", None, "s") for i in range(20)]).selectExpr("*", *[f"{k} AS `{n}`" for k, n in enumerate(names)])
    cleaned = drop_site_lines(docs).orderBy("doc_id").collect()
    assert [r.text for r in cleaned] == [str(i) for i in range(20)] and all(r.marks == 3 and r.mix == 6 and r.lines.dropped == 1 for r in cleaned)
    mixed = mix(docs).collect()
    assert mixed and all(r.copies == 8 and r.lines == 5 and r.mix.copy >= 1 for r in mixed)
    assert exact_groups(docs).count() == 20


def test_large_rate_does_not_underflow(spark):
    got = mix(table(spark, [(i, "t", None, "s") for i in range(3)]), total=6000).collect()
    assert abs(len(got) - 6000) < 500
