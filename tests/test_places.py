"""Quotes looked up on the pages of their document."""

import pytest
from pyspark.sql import functions as F

from ledgerlane.functions import text as tx
from ledgerlane.operators import candidates as cd


@pytest.fixture(scope="module")
def found(spark):
    evidence = spark.createDataFrame(
        [("a", {"name": "Acme  Ａir", "notes": "nowhere", "brand": " "}), ("a", {"notes": "TOTAL 5"}), ("a", {"notes": "TOTAL 5"}),
         ("b", {"name": "x"}), ("c", None), ("d", {}), (None, {"name": "x"}), ("e", {"name": None})],
        "document_id string, evidence map<string,string>")
    pages = spark.createDataFrame(
        [("a", 2, "acme air"), ("a", 1, "Total 5 and ACME　air"), ("a", 0, None), ("b", None, "x"), (None, 0, "x"), ("e", 0, "x"), ("c", 0, "x")],
        "document_id string, page_index int, text string")
    return cd.locate_evidence(evidence, pages)


def test_first_page_of_every_quote(found):
    rows = sorted(map(tuple, found.collect()), key=str)
    a = [("a", "brand", " ", 1), ("a", "name", "Acme  Ａir", 1), ("a", "notes", "TOTAL 5", 1), ("a", "notes", "TOTAL 5", 1), ("a", "notes", "nowhere", 1)]
    assert rows == sorted([*a, ("b", "name", "x", None), (None, "name", "x", None), ("e", "name", None, None)], key=str)


def test_texts_are_composed_once_and_nothing_is_asked_of_the_maps(found):
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2
    assert "size(" not in plan


def test_fold_takes_every_run_of_white_space_for_one_space(spark):
    texts = [f"{a}X{b}{c}y{a}" for a in ["", *tx.BLANKS] for b in tx.BLANKS for c in ["", " ", "　", "\t"]] + [None, "", " ", "~!é ​­."]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    pattern = f"{tx.WS}+"
    plain = F.lower(tx.trim_all(F.regexp_replace("t", pattern, " ")))
    assert rows.filter(~tx.fold(F.col("t")).eqNullSafe(plain)).count() == 0
