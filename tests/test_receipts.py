"""Label-only extraction on small printed receipts."""

import pytest
from pyspark.sql import functions as F

from ledgerlane.operators import receipts as rc

EMPTY = dict(name="", retailer=None, brand=None, invoice_number=None, serial_number=None, model_number=None,
             barcode=None, purchase_date=None, purchase_price=None, currency="INR", warranty_months=None,
             return_window_days=None, warranty_expires_at=None, return_expires_at=None)

CASES = [
    ("Total: 100.00\nGrand Total: INR 118.00", dict(purchase_price="118.00")),
    ("Grand Total: INR 118.00\nTotal: 100.00", dict(purchase_price="118.00")),
    ("Total: 100.00\nAmount due: 0.00\nAmount paid: 118.00", dict(purchase_price="118.00")),
    ("Product name: Reading Lamp Model: L-20\nBrand: Acme Manufacturer: Example Manufacturing Ltd\n"
     "Seller: Local Shop Buyer: Test Customer\nInvoice No: INV-00012 Order No: ORDER-999\n"
     "Serial number: 000001 Barcode: 00012345\nPurchase date: 02/10/2026 Delivery date: 04/10/2026\n"
     "Warranty: 1 year Return window: 30 days",
     dict(name="Reading Lamp", model_number="L-20", brand="Acme", retailer="Local Shop", invoice_number="INV-00012",
          serial_number="000001", barcode="00012345", purchase_date="2026-10-02", warranty_months=12,
          return_window_days=30, warranty_expires_at="2027-10-02", return_expires_at="2026-11-01")),
    ("ACME ELECTRONICS\nCustomer name: Apple Store\nOrder date: 01/10/2026\nDue date: 10/10/2026\n"
     "Expiry date: 02/10/2027\nProduct name: Model Home Light\nOrder Number: 000999",
     dict(name="Model Home Light", retailer=None, brand=None, model_number=None, purchase_date=None, invoice_number=None)),
    ("Date: 01/10/2026\nInvoice date: 02/10/2026", dict(purchase_date="2026-10-02")),
    ("Acme Store\nProduct name: Acme Reading Lamp", dict(brand=None)),
    ("Manufacturer: Example Manufacturing Ltd", dict(brand="Example Manufacturing Ltd")),
    ("Brand:\nAcme\nModel: L-20", dict(brand="Acme", model_number="L-20")),
    ("Brand:\n\nAcme", dict(brand=None)),
    ("Product name: Reading Lamp\nBrand: Acme\nProduct name: USB Cable\nBrand: Example\nGrand Total: 200.00\nGrand Total: 210.00",
     dict(name="", brand=None, purchase_price=None)),
    ("Brand: Acme\nBrand: Acme", dict(brand="Acme")),
    ("Invoice No: SHIPPING001\nSeller: Courier\nTotal: 50.00\n\nInvoice No: GOODS00001\nProduct name: Reading Lamp\nGrand Total: 1180.00", EMPTY),
    ("Invoice No: 00001\nProduct name: Reading Lamp\n\nInvoice No: 00001\nGrand Total: 1180.00",
     dict(invoice_number="00001", name="Reading Lamp", purchase_price="1180.00")),
    ("Subtotal: 1000.00\nTotal: 1000.00\nGrand Total: INR 1180.00\nAmount due: 0.00\nBalance: 0.00", dict(purchase_price="1180.00")),
    ("Total: 100.00\nGrand Total: unreadable", dict(purchase_price=None)),
    ("Total: 100.00\nGrand Total:", dict(purchase_price=None)),
    ("Product Description Qty Price Discount Total\nSubtotal: 100.00", dict(name="", purchase_price=None)),
    ("Serial No: 0000 Model No: 001\nInvoice No: 00001\nWarranty: 0 months Return period: 0 days\nDate: 01/10/2026",
     dict(serial_number="0000", model_number="001", invoice_number="00001", warranty_months=0, return_window_days=0,
          warranty_expires_at="2026-10-01", return_expires_at="2026-10-01")),
    ("1 S-0valt ine\nSubtotal: 20,000\nTotal: 100,000\nCash:\n80,000\nCHANGE:", dict(brand=None, purchase_price=None, purchase_date=None)),
    ("1 S-Ovaltine\nSubtotal: 18,181\nTotal: 20,000\nCash: 100,000\nCHANGE: 80,000", dict(purchase_price="20000.00")),
    ("5 ARTICLE(S) TOTAL À PAYER 12.50e\nCB EMV SANS CONTACT EUR 12.50e\nTotaux: 0.64 11.86\n0009 002 000289 25/07/2021 16:29:12",
     dict(brand=None, purchase_price="12.50", purchase_date="2021-07-25", currency="EUR")),
    ("Payé 9,50€\n11/12/2022 12h42", dict(purchase_price="9.50", purchase_date="2022-12-11", currency="EUR")),
    ("Date: unreadable\n25/07/2021 16:29:12", dict(purchase_date=None)),
    ("GRAND TOTAL 48.000\nTunai 50.000\nKembalian Rp 2.000", dict(purchase_price="48000.00", currency="IDR")),
    ("TOTAL (2 item) 120,000\nTotal Kembalian 0", dict(purchase_price="120000.00")),
    ("Product name: Desk lamp\nStore: Local shop\nInvoice No: INV-002\nSerial number: 001234\nBarcode: 0099887766\nModel: L-20\n"
     "Invoice date: 01/10/2026\nSubtotal: 1,000.00\nGrand Total: INR 1,180.50\nWarranty: 1 year\nReturn window: 30 days",
     dict(name="Desk lamp", retailer="Local shop", invoice_number="INV-002", serial_number="001234", barcode="0099887766",
          model_number="L-20", purchase_date="2026-10-01", purchase_price="1180.50", currency="INR", warranty_months=12,
          warranty_expires_at="2027-10-01", return_expires_at="2026-10-31")),
    ("Total: One hundred only\nDate: 31/02/2026", dict(purchase_price=None, purchase_date=None)),
    ("Brand: Acme\tModel: L-20\nGrand Total: 118.00", dict(brand="Acme", model_number="L-20", purchase_price="118.00")),
]


def test_extract_by_labels(spark):
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "document_id int, text string")
    rows = {r.document_id: r.asDict() for r in rc.extract_by_labels(docs).collect()}
    wrong = []
    for i, (text, expected) in enumerate(CASES):
        got = {k: (str(v) if v is not None and not isinstance(v, (int, str)) else v) for k, v in rows[i].items()}
        for field, value in expected.items():
            if got[field] != value:
                wrong.append((text, field, got[field], value))
    assert not wrong


def test_invoice_scope(spark):
    pages = [(1, "Invoice Number: SHIPPING0001\nTotal 50.00"), (2, "Invoice Number: GOODS0002\nStore Acme"), (3, "Invoice Number: FEE0003")]
    raw = "\n\n".join(f"[Page {n}]\n{t}" for n, t in pages)
    selections = [[2], None, [], [1, 2], [9], [2, 2]]
    df = spark.createDataFrame(
        [(i, raw, pages, s) for i, s in enumerate(selections)],
        "i int, text string, pages array<struct<page int, text string>>, s array<int>",
    )
    got = df.select("i", rc.invoice_scope(F.col("text"), F.col("pages"), F.col("s")).alias("x")).orderBy("i").select("x.*").collect()
    assert [r.ambiguous for r in got] == [False, True, True, True, True, True]
    assert got[0].text == pages[1][1] and list(got[0].pages) == [2]


@pytest.mark.parametrize("parts, ok", [
    (["Acme Back Cover for Apple", "iPhone 11 Blue"], True),
    (["Acme Back Cover for Apple", "iPhone 12 Blue"], False),
    (["iPhone 11 Blue", "Acme Back Cover for Apple"], False),
    (["Acme Back Cover for Apple", "iPhone 11 Blue", "iPhone 11 Blue"], False),
])
def test_name_parts(spark, parts, ok):
    quote = "Acme Back Cover for Apple\nHSN 3926 Qty 1 Total 170.00\niPhone 11 Blue"
    df = spark.createDataFrame([(" ".join(parts), quote, parts)], "v string, q string, p array<string>")
    got = df.select(rc.name_parts(F.col("v"), F.col("q"), F.col("p")).alias("r")).first().r
    assert (list(got) if got else None) == (parts if ok else None)
