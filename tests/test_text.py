"""Printed tokens: amounts, dates, labels, roles and recovery."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.functions import amounts as am
from ledgerlane.functions import dates as dt
from ledgerlane.functions import evidence as ev
from ledgerlane.functions import labels as lb
from ledgerlane.functions import text as tx

AMOUNTS = [
    ("₹ 1,18,000.00", "INR", "118000.00"), ("Rs. 12,999", "", "12999.00"), ("(RM) 118.00", "", "118.00"),
    ("20,000", "Cash 100,000", "20000.00"), ("EUR 12,50", "", "12.50"),
    ("12.50e", "CB EMV SANS CONTACT EUR 12.50e", "12.50"), ("12.50e", "", None), ("12.50e3", "EUR", None),
    ("1.234,56 €", "", "1234.56"), ("48.000", "GRAND TOTAL 48.000\nTUNAI 50.000\nKEMBALI 2.000", "48000.00"),
    ("Rp. 48.000", "", "48000.00"), ("48.000", "IDR", "48000.00"), ("48.000", "USD", None), ("48.000", "INR", None),
    ("48.000", "", None), ("48.000", "IDR USD", None), ("118.00 3", "", None), ("3 118.00", "", None),
    ("INV-118.00", "", None), ("118.0000", "", None), ("-118.00", "", None), ("1,23,45", "", None),
    ("12345678901", "", None),
]

DATES = [
    ("25/07/2021", "2021-07-25"), ("11/12/2022", "2022-12-11"), ("06/02/18", "2018-02-06"), ("2018/02/06", "2018-02-06"),
    ("06-Feb-2018", "2018-02-06"), ("6 Feb 18", "2018-02-06"), ("02/10/2026", "2026-10-02"), ("31.12.99", "1999-12-31"),
    ("29/02/2024", "2024-02-29"), ("Oct 2, 2026", "2026-10-02"), ("2nd October 2026", "2026-10-02"),
    ("12/13/2020", "2020-12-13"), ("October 2, 2026", "2026-10-02"),
    ("31/02/2021", None), ("00/00/00", None), ("29/02/2023", None), ("unreadable", None), ("20211020", None),
    ("20/20/2026", None), ("12/10/2300", None), ("October 2 2026", None), ("6  Feb 2018", None),
]

RECEIPT = """Invoice No: INV-00123 Order ID: ORDER-00999
GSTIN: 12345ABC
Serial Number: 0000123
Model: L-20
EAN: 00998877
MRP: INR 2000.00
Subtotal: INR 1000.00
Tax: INR 180.00
Total: INR 1000.00
Grand Total: INR 1180.00
Order Date: 01/10/2026
Delivery Date: 06/10/2026
Invoice Date: 02/10/2026
Warranty: 1 year
Return window: 30 days"""

PAID = "Grand Total INR 1180.00\nCash INR 1180.00\nAmount Due INR 0.00\nBalance Due INR 0.00"
MRP = "MRP INR 1180.00\nGrand Total INR 1180.00"

# role, token, text, quote, supported
ROLES = [
    *[(r, t, RECEIPT, None, True) for r, t in [
        ("invoiceNumber", "INV-00123"), ("serialNumber", "0000123"), ("modelNumber", "L-20"), ("barcode", "00998877"),
        ("purchasePrice", "1180.00"), ("purchaseDate", "02/10/2026"), ("warrantyMonths", "1 year"), ("returnWindowDays", "30 days")]],
    *[(r, t, RECEIPT, None, False) for r, t in [
        ("invoiceNumber", "ORDER-00999"), ("modelNumber", "ORDER-00999"), ("barcode", "0000123"), ("invoiceNumber", "12345ABC"),
        ("purchasePrice", "2000.00"), ("purchasePrice", "1000.00"), ("purchasePrice", "180.00"), ("purchaseDate", "01/10/2026"),
        ("purchaseDate", "06/10/2026"), ("warrantyMonths", "30 days"), ("returnWindowDays", "1 year")]],
    ("invoiceNumber", "000123", "Invoice Number:\n000123", None, True),
    ("invoiceNumber", "Acme Lamp", "Tax Invoice\nAcme Lamp", None, False),
    ("purchasePrice", "170", "Total\n170", None, True),
    ("purchasePrice", "170", "Total 170", None, True),
    ("purchaseDate", "02/10/2026", "Date: 02/10/2026", None, True),
    ("purchasePrice", "0.00", PAID, None, False),
    ("purchasePrice", "1180.00", PAID, None, True),
    ("purchasePrice", "1180.00", MRP, "MRP INR 1180.00", False),
    ("purchasePrice", "1180.00", MRP, "1180.00", True),
    ("invoiceNumber", "123", "Invoice No: INV1234", None, False),
    *[("purchaseDate", t, x, t, True) for t, x in [
        ("25/07/2021", "25/07/2021 16:29:12"), ("11/12/2022", "11/12/2022 12h42"), ("06/02/18", "06/02/18"),
        ("25/07/2021", "0009 002 000289 25/07/2021 16:29:12"),
        ("11/12/2022", "Maison Jeanne dArc, Place de Gaulle          11/12/2022 12h42")]],
    *[("purchaseDate", "25/07/2021", x, "25/07/2021", False) for x in [
        "Date: unreadable\n25/07/2021 16:29:12", "Invoice Date: unreadable\n25/07/2021 16:29:12",
        "Date of birth: 25/07/2021", "DOB: 25/07/2021", "Order date: 25/07/2021", "Payment date: 25/07/2021",
        "Manufacturing date: 25/07/2021", "Manufacture date: 25/07/2021", "Manufactured date: 25/07/2021",
        "Date of Manufacture: 25/07/2021", "Mfg Date: 25/07/2021", "Mfg. Date: 25/07/2021", "Date of Order: 25/07/2021",
        "Date Due: 25/07/2021", "Order date: 25/07/2021\n25/07/2021 16:29:12", "Delivery 25/07/2021 16:29:12",
        "https://example.test/bills/25/07/2021", "Returns valid from 25/07/2021", "0009 002 000289 25/07/2021",
        "Birthday promotion on 25/07/2021 16:29:12", "Customer references 25/07/2021 16:29:12",
        "25/07/2021 16:29:12\n26/07/2021 12:00"]],
]

SHIFTED = "20,000 20,000\n1 S-0valt ine\n50%\n1,818\nPB1:\n18,181\nSubtotal: 20,000\nTotal: 100,000\nCash:\n80,000\nCHANGE:\n10% Tax Inc luded"
ALIGNED = "Subtotal: 18,181\nTotal: 20,000\nCash: 100,000\nCHANGE: 80,000"
DOTS = "TOTAL 43.636\nTAX 10.00 % 4.364\nGRAND TOTAL 48.000\nTUNAI 50.000\nKEMBALI 2.000"
FRENCH = "5 ARTICLE(S) TOTAL À PAYER 12.50e\nCB EMV SANS CONTACT EUR 12.50e\nTotaux: 0.64 11.86"
ITEMS = "TOTAL (2 item) 120,000\nCC.Visa.BCA 120,000\nTotal Kembalian 0"

# value, quote, source, accepted
VERIFIED = [
    ("12.50", "5 ARTICLE(S) TOTAL À PAYER 12.50e", FRENCH, True),
    ("11.86", "Totaux: 0.64 11.86", FRENCH, False),
    ("120000.00", "TOTAL (2 item) 120,000", ITEMS, True),
    ("2.00", "TOTAL (2 item) 120,000", ITEMS, False),
    ("0.00", "Total Kembalian 0", ITEMS, False),
    ("100000.00", "Total: 100,000", SHIFTED, False),
    ("20000.00", "20,000", SHIFTED, False),
    ("20000.00", "Total: 20,000", ALIGNED, True),
    ("100000.00", "Cash: 100,000", ALIGNED, False),
    ("80000.00", "CHANGE: 80,000", ALIGNED, False),
    ("48000.00", "GRAND TOTAL 48.000", DOTS, True),
    ("48.00", "GRAND TOTAL 48.000", DOTS, False),
    ("43636.00", "TOTAL 43.636", DOTS, False),
    *[("118.00", s, s, False) for s in ["TOTAL 3 118.00", "TOTAL 118.00 3", "TOTAL 118.00\nTOTAL 120.00", "TOTAL 118.00\nGrand Total unreadable"]],
    ("150.00", "Grand Total 150.00", "Grand Total 150.00\nCash 50.00\nCredit Card 100.00", True),
    ("1180.00", "1180.00", "Grand Total 1180.00\nCash 1180.00\nAmount Due 0.00", True),
    *[("100.00", f"{x} 100.00", f"{x} 100.00\nCash 100.00\nChange 80.00", False) for x in ["Total", "Grand Total", "Net Payable", "Amount Paid"]],
    ("1180.00", "MRP INR 1180.00", MRP, False),
    ("1180.00", "Grand Total INR 1180.00", MRP, True),
]

RECOVERED = [
    (FRENCH, "12.50", "5 ARTICLE(S) TOTAL À PAYER 12.50e"),
    ("Payé 9,50€", "9.50", "Payé 9,50€"),
    ("5 ARTICLE(S)      TOTAL A PAYER\n\n12.50€", "12.50", "5 ARTICLE(S)      TOTAL A PAYER\n\n12.50€"),
    ("TOTAL À PAYER illisible\nPayé 12,50€", None, None),
    ("Total 100.00\nCash 100.00\nChange 80.00", None, None),
]

BRANDS = [
    ("Store: Local Shop\nBrand: Acme Model: X1", "Acme", "Brand: Acme Model: X1"),
    ("Manufacturer:\nAcme Electronics", "Acme Electronics", "Manufacturer:\nAcme Electronics"),
    *[(t, None, None) for t in [
        "Product name: Brand New Shoes", "Item: Manufacturer recommended adapter",
        "Description: Lightweight brand name printed sleeve", "Brand: Acme\nBrand: Other", "Brand: Unknown",
        "Brand:\nModel: A1", "Brand: 12345", "Retailer: Acme", "Brand: Acme\nBrand: Other\nManufacturer: OEM Factory"]],
    *[(t, "Acme", t) for t in ["Brand Acme", "Item | Brand Acme", "Item\tBrand Acme", "Item  Brand Acme", "Product Brand: Acme", "Product Manufacturer# Acme"]],
    ("Brand: Acme\nManufacturer: OEM Factory", "Acme", "Brand: Acme"),
    ("Brand: Acme\nManufacturer: First Factory\nManufacturer: Second Factory", "Acme", "Brand: Acme"),
]


def numbered(spark, rows, columns):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n int, " + columns)


def test_amounts(spark):
    df = numbered(spark, AMOUNTS, "raw string, context string, expected string")
    got = df.select("n", am.parse_amount(F.col("raw"), am.separator_cues(F.col("context"))).cast("string").alias("v")).collect()
    assert {r.n: r.v for r in got} == {i: a[2] for i, a in enumerate(AMOUNTS)}


def test_dates(spark):
    df = numbered(spark, DATES, "token string, expected string")
    got = df.select("n", dt.parse_receipt_date(F.col("token")).cast("string").alias("v")).collect()
    assert {r.n: r.v for r in got} == {i: d[1] for i, d in enumerate(DATES)}


def test_find_dates(spark):
    rows = [("0009 002 000289 25/07/2021 16:29:12",), ("11/12/2022 12h42",), ("SN2018/02/06X 12/10/20261",)]
    got = numbered(spark, rows, "t string").select("n", dt.find_dates(F.col("t")).alias("d")).orderBy("n").collect()
    assert [[(d.token, str(d.value)) for d in r.d] for r in got] == [
        [("25/07/2021", "2021-07-25")], [("11/12/2022", "2022-12-11")], []
    ]


def test_roles(spark):
    df = numbered(spark, ROLES, "role string, token string, text string, quote string, supported boolean")
    df = ev.read_text(df).withColumn("q", F.when(F.col("quote").isNotNull(), lb.annotate(tx.nfkc(F.col("quote")))))
    wrong = []
    for role in sorted({r[0] for r in ROLES}):
        part = df.filter(F.col("role") == role)
        verdict = F.when(
            F.col("quote").isNull(), ev.on_doc(lambda d, t: ev.supports_role(role, t, d), t=F.col("token"))
        ).otherwise(ev.on_doc(lambda d, t, q: ev.supports_role(role, t, d, q), t=F.col("token"), q=F.col("q")))
        for r in part.select("n", "supported", verdict.alias("v")).collect():
            if r.v != r.supported:
                wrong.append(ROLES[r.n])
    assert not wrong


def test_verified_amounts(spark):
    df = numbered(spark, VERIFIED, "value string, quote string, text string, accepted boolean")
    df = ev.read_text(df).withColumn("q", lb.annotate(tx.nfkc(F.col("quote"))))
    verdict = ev.on_doc(
        lambda d, v, t, q: ev.verify_amount(v, t, q, d),
        v=F.col("value").cast("decimal(12,2)"), t=F.col("quote"), q=F.col("q"),
    )
    got = df.select("n", "accepted", verdict.alias("v")).collect()
    assert [VERIFIED[r.n] for r in got if r.v != r.accepted] == []


def test_recovered_amounts(spark):
    df = numbered(spark, RECOVERED, "text string, value string, quote string")
    got = ev.read_text(df).select("n", ev.on_doc(ev.recover_amount).alias("recovered_amount")).orderBy("n").collect()
    for r, (_, value, quote) in zip(got, RECOVERED):
        if value is None:
            assert r.recovered_amount is None
        else:
            assert (r.recovered_amount.value, r.recovered_amount.quote) == (Decimal(value), quote)


def test_recovered_brands(spark):
    df = numbered(spark, BRANDS, "text string, value string, quote string")
    got = ev.read_text(df).select("n", ev.on_doc(ev.recover_brand).alias("b")).orderBy("n").collect()
    assert [(r.b.value, r.b.quote) if r.b else (None, None) for r in got] == [(v, q) for _, v, q in BRANDS]


@pytest.mark.parametrize("phrase", ["for", "fits", "compatible with", "suitable for", "designed for", "works with"])
def test_compatible_device_is_no_maker(spark, phrase):
    name = f"Acme Cover {phrase} Apple"
    df = ev.read_text(numbered(spark, [(name, "Apple"), (name, "Acme")], "text string, brand string"))
    got = df.select("n", ev.on_doc(lambda d, b, n: ev.supports_brand(b, n, d), b=F.col("brand"), n=F.col("text")).alias("v")).orderBy("n").collect()
    assert [r.v for r in got] == [False, True]


def test_retailer_roles(spark):
    rows = [("Test Buyer", "Buyer: Test Buyer", False), ("Acme", "Manufacturer: Acme", False),
            ("Acme Store", "Acme Store\nInvoice No: 000123", True), ("Acme Store", "Sold by: Acme Store", True)]
    df = ev.read_text(numbered(spark, rows, "value string, text string, ok boolean"))
    got = df.select("ok", ev.on_doc(lambda d, v: ev.supports_retailer(v, d), v=F.col("value")).alias("v")).collect()
    assert all(r.ok == r.v for r in got)


def test_normalization_composes_only_what_needs_it(spark):
    rows = [("ＡＣＭＥ  №１",), ("Plain\tText",), (None,), ("ﬁne é",)]
    got = numbered(spark, rows, "t string").select("n", tx.normalize_text(F.col("t")).alias("a"), tx.compact_text(F.col("t")).alias("b")).orderBy("n").collect()
    assert [r.a for r in got] == ["acme no1", "plain text", None, "fine é"]
    assert got[0].b == "acmeno1"


def test_currency_signs_in_any_spelling(spark):
    shown = {"INR": ["inr 5", "Rs.5", "rS 5", "₹5", "ınr 5", "Rſ 5"], "USD": ["uSd 5", "us$5"], "EUR": ["eur 5", "5 €"], "GBP": ["gbP", "£5"], "IDR": ["idr 5", "rp 5", "RP.5"]}
    none = ["offers", "harp", "in r", "xINR", "eurs", ""]
    # every sign in plain ASCII has letters that the text is searched for first
    assert all(any(stem in text.upper() for stem in fixed.CURRENCY_STEMS[code]) for code, texts in shown.items() for text in texts if text.isascii())
    cases = [(text, code) for code, texts in shown.items() for text in texts] + [(text, None) for text in none] + [("inr 5\nusd 5", None)]
    df = spark.createDataFrame([(f"Total\n{t}\n{t} again", c) for t, c in cases], "text string, code string")
    got = df.select("text", "code", ev.currency_from_text(F.col("text")).alias("r")).collect()
    assert [r["r"] and r["r"]["value"] for r in got] == [r["code"] for r in got]
    assert all(r["r"] is None or r["r"]["quote"] == r["text"].split("\n")[1].strip() for r in got)


def test_cues_of_plain_and_strange_text(spark):
    from ledgerlane.fixed import DOT_DECIMAL_CUE, DOT_GROUP_CUE, EURO_CUE
    from ledgerlane.functions import amounts as am
    from ledgerlane.functions.text import rx

    texts = ["", None, "eur 5", "neuro", "5 €", "uſd", "usd", "Inr.", "$3", "£3", "Rp 5", "rp.5", "rupiah", "arpa", "Kembalian", "tunai!", "cad", "decade"]
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    t = F.col("t")
    plain = F.struct(*[t.rlike(rx(p)).alias(n) for n, p in (("euro", EURO_CUE), ("dot_decimal", DOT_DECIMAL_CUE), ("dot_group", DOT_GROUP_CUE))])
    rows = df.select("t", am.separator_cues(t).alias("a"), plain.alias("b")).collect()
    assert [(r.t, tuple(r.a)) for r in rows] == [(r.t, tuple(r.b)) for r in rows]


def test_rules_read_only_the_parts_of_a_text_that_they_need(spark):
    from ledgerlane.operators import receipts as rc

    docs = spark.createDataFrame([("a", "Brand: Acme\nDate: 02/03/2024\nGrand Total: INR 5.00", "Acme")], "document_id string, text string, brand string")
    rows = rc.recovered_brands(docs)
    plan = rows._jdf.queryExecution().analyzed().toString()
    assert rows.collect()[0].value == "Acme"
    assert "regexp_extract_all" not in plan and "dot_group" not in plan
