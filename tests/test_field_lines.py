"""Labels of the label-only reader found for whole texts, and plain-text short cuts."""

import random

from pyspark.sql import functions as F

from ledgerlane.functions import amounts as am
from ledgerlane.functions import evidence as ev
from ledgerlane.functions import labels as lb
from ledgerlane.functions import line_labels as ll
from ledgerlane.functions import text as tx

WORDS = ["item name", "Product Name", "invoice no.", "Invoice  number", "date", "Due Date", "date of order", "order", "order date", "total",
         "TOTAL AMOUNT paid", "model no", "s/n", "imei 2", "brand name", "warranty expires", "return by", "tax invoice no", "bill to", "bill no",
         "billing to", "manufactured date", "abc", "Acme 12", "é", "payment method"]
MARKS = [":", "#", " : ", " - ", "-", " ", "  ", "\t", "|", ";", " |  ", "", "; ", ".", "_", " ", " "]


def test_whole_texts_give_the_labels_of_each_line(spark):
    pick = random.Random(7)
    lines = [" " + "".join(pick.choice(WORDS) + pick.choice(MARKS) for _ in range(pick.randint(0, 6))) for _ in range(600)]
    df = spark.createDataFrame([(i, line) for i, line in enumerate(lines)], "n int, t string")
    rows = df.select(lb.field_labels(tx.trim_all(F.col("t"))).alias("one"), ll.fields_of_lines(F.col("t")).alias("all")).collect()
    assert sum(len(r.one) for r in rows) > 500
    for r in rows:
        assert [tuple(x) for x in r.one] == [tuple(x) for x in r["all"][0]]
    assert ll.field_arrays([None, "", "Date: 1\r\n\n Total 2"]).to_pylist()[0] is None
    assert [len(x) for x in ll.field_arrays(["", "Date: 1\r\n\n Total 2"]).to_pylist()[1]] == [1, 0, 1]


def test_only_white_space_is_trimmed_and_folded(spark):
    df = spark.createDataFrame([("  a \t b  c ",), ("abc \u0085",), ("\n",), (None,)], "t string")
    rows = df.select(tx.trim_all(F.col("t")).alias("trimmed"), tx.fold(F.col("t")).alias("folded")).collect()
    assert [r.trimmed for r in rows] == ["a \t b  c", "abc \u0085", "", None]  # a line end that is no white space stays, with all before it
    assert [r.folded for r in rows] == ["a b c", "abc \u0085", "", None]


def test_tokens_are_found_in_any_case_and_spacing(spark):
    cases = [("SN-1", "Serial no: sn-1", 1), ("ab  cd", "Model: AB  cd", 1), ("ſt1", "Model: ST1", 1), ("st1", "Model: ſT1", 1), ("t1", "Model: st1", 0), (None, "x", 0)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "n int, token string, text string, want int")
    rows = ev.read_text(df).select("want", F.size(ev.on_doc(lambda d, t: ev.occurrences(t, d.plain_lines), t=F.col("token"))).alias("got")).collect()
    assert [r.got for r in rows] == [r.want for r in rows]


def test_wide_digits_and_other_rows_of_money(spark):
    text = "Seller: A Buyer: B\nOrder No: 7 Grand Total: １２.50\nUPI: 1.00\nCash: 20\nBalance: 3"
    df = spark.createDataFrame([(text,)], "text string")
    row = ev.read_text(df).select(
        F.transform("doc.cells", lambda c: F.concat_ws("|", c["role"], c["raw"])).alias("cells"),
        ev.on_doc(lambda d: am.preferred_total(d.cells, d.cues)).cast("string").alias("total")).first()
    assert row.cells == ["purchasePrice|１２.50", "otherTender|1.00", "cash|20", "otherTender|3"]
    assert row.total == "12.50"
