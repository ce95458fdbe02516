"""Registered queries over printed receipts, suggestions and recognition."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.functions import amounts as am
from ledgerlane.functions import dates as dt
from ledgerlane.functions import evidence as ev
from ledgerlane.functions import text as tx
from ledgerlane.operators import candidates as cd
from ledgerlane.operators import ocr
from ledgerlane.operators import receipts as rc
from ledgerlane.operators import scoring as sc
from ledgerlane.plans import sql
from ledgerlane.plans.registry import query
from ledgerlane.plans.sql import with_
from ledgerlane.session import checkpoint_folder
from ledgerlane.sources import derive
from ledgerlane.sources import originals as og
from ledgerlane.sources import payloads as pl
from ledgerlane.sources.tables import read_star

# What each printed receipt holds, from the damage rules alone.
PRINTED = sql.BILLS + """,
r AS (SELECT id AS document_id, o, user_id, name, replace(brand, 'Brand#', 'House ') AS brand, retailer, invoice_number, model_number, barcode, serial_number,
  purchase_price AS price, currency, purchase_date, warranty_months, return_window_days, o % 11 = 3 AS several,
  CASE WHEN o % 5 <> 4 THEN purchase_date END AS seen_date,
  CASE WHEN o % 7 NOT IN (0, 1) THEN purchase_price END AS seen_price FROM bills)"""


def plain_docs(spark, folder):
    return derive.receipts(spark, folder).select("document_id", "text")


def corpus(spark, folder):
    return read_star(spark, folder, "documents").select(F.col("doc_id").alias("document_id"), "text")


# --- scalar rules ---------------------------------------------------------
@query("x01_normalize_text", r"""
WITH n AS (SELECT doc_id AS document_id, lower(trim(regexp_replace(nfc_normalize(text), '[\s\x{a0}]+', ' ', 'g'))) AS folded FROM documents)
SELECT document_id, folded, regexp_replace(folded, '[^\p{L}\p{N}]', '', 'g') AS compact FROM n""")
def normalize(spark, folder):
    plain = corpus(spark, folder).withColumn("plain", tx.nfkc(F.col("text")))
    return plain.select("document_id", tx.fold(F.col("plain")).alias("folded"), tx.fold_compact(F.col("plain")).alias("compact"))


@query("x02_parse_receipt_date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 < 8 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS value FROM orders""")
def parse_dates(spark, folder):
    o, d = F.col("o_orderkey"), F.col("o_orderdate")
    shapes = ["dd/MM/yyyy", "d-MMM-yyyy", "yyyy-MM-dd", "MMM d, yyyy", "d MMMM yyyy", "dd.MM.yy", "yyyy/M/d", "d MMM yy"]
    token = F.lit("31/02/2021")
    for i, shape in enumerate(shapes):
        token = F.when(o % 9 == i, F.date_format(d, shape)).otherwise(token)
    return read_star(spark, folder, "orders").select("o_orderkey", dt.parse_receipt_date(token).alias("value"))


@query("x06_parse_amount", """
SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS VARCHAR) AS value, count(*) AS copies FROM lineitem GROUP BY ALL""")
def parse_amounts(spark, folder):
    price, n = F.col("l_extendedprice").cast("decimal(12,2)"), F.col("l_linenumber") % 4
    commas = F.format_number(price, 2)
    raw = (
        F.when(n == 0, F.concat(F.lit("INR "), commas))
        .when(n == 1, F.concat(F.translate(commas, ",.", ".,"), F.lit(" €")))
        .when(n == 2, price.cast("string"))
        .otherwise(F.concat(F.lit("("), F.lit("RM"), F.lit(") "), commas))
    )
    rows = read_star(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", am.parse_amount(raw, am.separator_cues(raw)).alias("value")
    )
    return rows.groupBy("l_orderkey", "l_linenumber", "value").agg(F.count("*").alias("copies"))


@query("x03_find_dates", with_(PRINTED, """
SELECT document_id, count(*) AS dates, string_agg(CAST(d AS VARCHAR), ',' ORDER BY d) AS found FROM (
 SELECT document_id, purchase_date AS d FROM r WHERE o % 5 IN (0, 1, 2, 3) UNION ALL SELECT document_id, purchase_date + 4 FROM r WHERE o % 5 = 0
 UNION ALL SELECT document_id, purchase_date - 2 FROM r WHERE o % 5 = 2) GROUP BY document_id"""))
def find_dates(spark, folder):
    rows = rc.date_tokens(plain_docs(spark, folder)).groupBy("document_id").agg(
        F.count("*").alias("dates"), F.array_join(F.array_sort(F.collect_list(F.col("value").cast("string"))), ",").alias("found")
    )
    return rows


@query("x04_label_spans", with_(PRINTED, """
SELECT document_id, 1 + CAST(several AS INTEGER) AS invoices, CAST(serial_number IS NOT NULL AS INTEGER) AS serials, 1 AS models,
 1 + CAST(o % 9 = 5 AS INTEGER) AS makers, CASE WHEN price IS NULL THEN 0 WHEN o % 7 IN (0, 5) THEN 2 ELSE 1 END AS totals,
 CASE WHEN o % 5 = 3 THEN 0 ELSE 1 END AS sale_dates, CAST(warranty_months IS NOT NULL AS INTEGER) AS warranties FROM r"""))
def label_spans(spark, folder):
    def n(role):
        return F.count_if(F.col("role") == role).cast("int")

    return rc.label_spans(plain_docs(spark, folder)).groupBy("document_id").agg(
        n("invoiceNumber").alias("invoices"), n("serialNumber").alias("serials"), n("modelNumber").alias("models"), n("brand").alias("makers"),
        n("purchasePrice").alias("totals"), n("purchaseDate").alias("sale_dates"), n("warrantyMonths").alias("warranties"),
    )


@query("x05_amount_cells", with_(PRINTED, """
SELECT document_id, CASE WHEN o % 7 IN (0, 5) THEN 2 ELSE 1 END AS totals, CAST(o % 7 IN (1, 2) AS INTEGER) AS cash, CAST(o % 7 = 2 AS INTEGER) AS change,
 CASE WHEN o % 7 NOT IN (3, 4) THEN currency || ' ' || CAST(price AS VARCHAR) END AS first_best FROM r WHERE price IS NOT NULL"""))
def amount_cells(spark, folder):
    cells = rc.amount_cells(plain_docs(spark, folder))

    def n(role):
        return F.count_if(F.col("role") == role).cast("int")

    o = derive.order_of(F.col("document_id"))
    best = F.min(
        F.when(F.col("role") == "purchasePrice", F.struct((-F.col("priority")).alias("p"), "ord", "raw"))
    )
    rows = cells.groupBy("document_id").agg(n("purchasePrice").alias("totals"), n("cash").alias("cash"), n("change").alias("change"), best.alias("b"))
    return rows.select("document_id", "totals", "cash", "change", F.when(~(o % 7).isin(3, 4), F.col("b.raw")).alias("first_best"))


@query("x07_x08_totals", with_(PRINTED, """
SELECT document_id, CASE WHEN o % 7 <> 0 THEN CAST(price AS VARCHAR) END AS total,
 CASE WHEN price IS NOT NULL AND o % 7 <> 0 THEN o % 7 <> 1 END AS tender_ok FROM r"""))
def totals(spark, folder):
    return rc.totals(plain_docs(spark, folder))


@query("x09_verify_amount", with_(PRINTED, """
SELECT document_id, seen_price IS NOT NULL AND o % 3 <> 0 AND o % 7 NOT IN (3, 4) AS verified FROM r"""))
def verify(spark, folder):
    o, price = F.col("o"), F.col("purchase_price")
    # every third suggestion is off by one; the quote is the plain total line
    docs = derive.receipts(spark, folder).select(
        "document_id", "text",
        F.coalesce(F.when(o % 3 == 0, price + 1).otherwise(price), F.lit(1)).alias("value"),
        F.coalesce(F.concat(F.lit("Grand Total: "), F.col("currency"), F.lit(" "), F.when((o % 7).isin(3, 4), "0.00").otherwise(price.cast("string"))), F.lit("Subtotal: 1.00")).alias("quote"),
    )
    return rc.verified_amounts(docs)


@query("x10_recover_amount", with_(PRINTED, "SELECT document_id, CAST(seen_price AS VARCHAR) AS value FROM r"))
def recover_amount(spark, folder):
    return rc.recovered_amounts(plain_docs(spark, folder)).select("document_id", "value")


@query("x11_supports_role", with_(PRINTED, """
SELECT document_id, role, token, supported FROM (
 SELECT document_id, 'invoiceNumber' AS role, invoice_number AS token, true AS supported FROM r
 UNION ALL SELECT document_id, 'invoiceNumber', 'ORDER-' || lpad(CAST(o AS VARCHAR), 8, '0'), false FROM r
 UNION ALL SELECT document_id, 'modelNumber', model_number, true FROM r
 UNION ALL SELECT document_id, 'barcode', barcode, true FROM r
 UNION ALL SELECT document_id, 'barcode', model_number, false FROM r)"""))
def supports_role(spark, folder):
    r = derive.receipts(spark, folder)
    order = F.concat(F.lit("ORDER-"), F.lpad(F.col("o").cast("string"), 8, "0"))
    claims = [("invoiceNumber", F.col("invoice_number")), ("invoiceNumber", order), ("modelNumber", F.col("model_number")),
              ("barcode", F.col("barcode")), ("barcode", F.col("model_number"))]
    pairs = F.array(*[F.struct(F.lit(role).alias("role"), token.alias("token")) for role, token in claims])
    return rc.supported_roles(r.select("document_id", "text", pairs.alias("claims")))


@query("x12_unlabelled_date", with_(PRINTED, "SELECT document_id, CASE WHEN o % 5 = 3 THEN CAST(purchase_date AS VARCHAR) END AS value FROM r"))
def unlabelled(spark, folder):
    return rc.unlabelled_dates(plain_docs(spark, folder))


@query("x13_x14_x16_x17_party_checks", with_(PRINTED, """
SELECT document_id, o % 3 <> 0 AS retailer_ok, o % 2 = 0 AS brand_ok, coalesce(serial_number IS NOT NULL AND o % 4 <> 0, false) AS serial_ok, o % 6 <> 5 AS name_ok FROM r"""))
def parties(spark, folder):
    o = F.col("o")
    docs = derive.receipts(spark, folder).select(
        "document_id", "text",
        F.when(o % 3 == 0, F.concat(F.lit("Customer "), F.col("user_id"))).otherwise(F.col("retailer")).alias("retailer"),
        F.when(o % 2 == 0, F.col("brand")).otherwise(F.col("retailer")).alias("brand"),
        F.when(o % 6 == 5, "Product Qty Total").otherwise(F.col("name")).alias("name"),
        F.coalesce(F.when(o % 4 == 0, F.col("barcode")).otherwise(F.col("serial_number")), F.lit("none")).alias("serial"),
    )
    return rc.party_checks(docs)


@query("x15_recover_brand", with_(PRINTED, "SELECT document_id, CASE WHEN o % 9 <> 5 THEN brand END AS value FROM r"))
def recover_brand(spark, folder):
    return rc.recovered_brands(plain_docs(spark, folder)).select("document_id", "value")


@query("x18_name_parts", with_(PRINTED, """
SELECT document_id, CASE WHEN o % 2 = 0 THEN name || '|' || brand END AS parts FROM r"""))
def name_parts(spark, folder):
    r = derive.receipts(spark, folder)
    pair = F.when(F.col("o") % 2 == 0, F.array("name", "brand")).otherwise(F.array("brand", "name"))
    quote = F.concat_ws("\nQty 1\n", "name", "brand")
    checked = rc.name_parts(F.array_join(pair, " "), quote, pair)
    return r.select("document_id", F.array_join(checked, "|").alias("parts"))


@query("x19_invoice_ids", with_(PRINTED, """
SELECT document_id, invoice_number AS invoice_id FROM r UNION ALL SELECT document_id, 'SERVICE000123' FROM r WHERE several"""))
def invoice_ids(spark, folder):
    return rc.document_invoices(plain_docs(spark, folder))


@query("x20_invoice_scope", with_(PRINTED, """
SELECT document_id, several, several AND o % 2 = 0 AS ambiguous, CASE WHEN NOT several THEN '1,2' WHEN o % 2 = 1 THEN '1' ELSE '' END AS pages FROM r"""))
def invoice_scope(spark, folder):
    first = F.regexp_replace("text", "\nInvoice No: SERVICE000123$", "")
    pages = F.array(
        F.struct(F.lit(1).alias("page"), first.alias("text")),
        F.struct(F.lit(2).alias("page"), F.when(F.col("o") % 11 == 3, "Invoice No: SERVICE000123").otherwise("").alias("text")),
    )
    picked = F.when(F.col("o") % 2 == 1, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2)))
    rows = derive.receipts(spark, folder).withColumn("s", rc.invoice_scope(F.col("text"), pages, picked))
    return rows.select("document_id", "s.several", "s.ambiguous", F.array_join("s.pages", ",").alias("pages"))


@query("x21_repair_window", """
SELECT doc_id AS document_id, CASE WHEN length(text) <= 12000 THEN text ELSE
 substr(text, greatest(1, strpos(text, substr(text, 5001, 40)) - 1000), strpos(text, substr(text, 5001, 40)) - 1 + 11000 - greatest(0, strpos(text, substr(text, 5001, 40)) - 1001)) END AS part FROM documents""")
def repair_window(spark, folder):
    return corpus(spark, folder).select(
        "document_id", ev.repair_window(F.col("text"), F.substring("text", 5001, 40), 12_000, 1_000, 11_000).alias("part")
    )


@query("x22_currency_from_text", with_(PRINTED, "SELECT document_id, CASE WHEN price IS NOT NULL THEN currency END AS value FROM r"))
def currency(spark, folder):
    return rc.printed_currency(plain_docs(spark, folder)).select("document_id", "value")


@query("x23_label_values", with_(PRINTED, """
SELECT document_id, 'name' AS field, name AS value FROM r UNION ALL SELECT document_id, 'retailer', retailer FROM r
UNION ALL SELECT document_id, 'modelNumber', model_number FROM r UNION ALL SELECT document_id, 'barcode', barcode FROM r
UNION ALL SELECT document_id, 'serialNumber', serial_number FROM r WHERE serial_number IS NOT NULL
UNION ALL SELECT document_id, 'brand', brand FROM r UNION ALL SELECT document_id, 'brand', 'Other House' FROM r WHERE o % 9 = 5
UNION ALL SELECT document_id, 'invoiceNumber', invoice_number FROM r UNION ALL SELECT document_id, 'invoiceNumber', 'SERVICE000123' FROM r WHERE several"""))
def label_values(spark, folder):
    kept = ["name", "retailer", "modelNumber", "barcode", "serialNumber", "brand", "invoiceNumber"]
    return rc.label_values(plain_docs(spark, folder)).filter(F.col("field").isin(kept)).select("document_id", "field", "value")


EXTRACTED = """SELECT document_id, CASE WHEN several THEN '' ELSE name END AS name, CASE WHEN NOT several THEN retailer END AS retailer,
 CASE WHEN NOT several AND o % 9 <> 5 THEN brand END AS brand, CASE WHEN NOT several THEN invoice_number END AS invoice_number,
 CASE WHEN NOT several THEN serial_number END AS serial_number, CASE WHEN NOT several THEN model_number END AS model_number,
 CASE WHEN NOT several THEN barcode END AS barcode, CASE WHEN NOT several THEN CAST(seen_date AS VARCHAR) END AS purchase_date,
 CASE WHEN NOT several THEN CAST(seen_price AS VARCHAR) END AS purchase_price,
 CASE WHEN NOT several AND price IS NOT NULL THEN currency ELSE 'INR' END AS currency, CASE WHEN NOT several THEN warranty_months END AS warranty_months,
 CASE WHEN NOT several THEN return_window_days END AS return_window_days,
 CASE WHEN NOT several THEN CAST(CAST(seen_date + to_months(warranty_months) AS DATE) AS VARCHAR) END AS warranty_expires_at,
 CASE WHEN NOT several THEN CAST(seen_date + return_window_days AS VARCHAR) END AS return_expires_at FROM r"""


@query("x24_extract_by_labels", with_(PRINTED, EXTRACTED))
def extract(spark, folder):
    return rc.extract_by_labels(plain_docs(spark, folder))


@query("x24_nothing_invented", """
SELECT doc_id AS document_id, CAST(NULL AS VARCHAR) AS invoice_number, CAST(NULL AS VARCHAR) AS purchase_price, CAST(NULL AS INTEGER) AS warranty_months FROM documents""")
def nothing_invented(spark, folder):
    return rc.extract_by_labels(corpus(spark, folder)).select("document_id", "invoice_number", "purchase_price", "warranty_months")


# --- suggestions ----------------------------------------------------------
def suggestions(spark, folder):
    """A suggestion set per receipt: most fields right, some from the wrong
    column, some never printed.

    By order key: 0 mod 4 a price off by one, 1 mod 4 the order number as
    invoice number, 2 mod 4 the seller as maker, 3 mod 4 the barcode as serial
    number; 0 mod 3 an invented name, 1 mod 3 no date.
    """
    r, o = derive.receipts(spark, folder), F.col("o")
    order = F.concat(F.lit("ORDER-"), F.lpad(o.cast("string"), 8, "0"))
    fields = F.struct(
        F.when(o % 3 == 0, "Invented laptop").otherwise(F.col("name")).alias("name"),
        F.col("retailer").alias("retailer"),
        F.when(o % 4 == 2, F.col("retailer")).otherwise(F.col("brand")).alias("brand"),
        F.when(o % 4 == 1, order).otherwise(F.col("invoice_number")).alias("invoiceNumber"),
        F.when(o % 4 == 3, F.col("barcode")).otherwise(F.col("serial_number")).alias("serialNumber"),
        F.col("model_number").alias("modelNumber"),
        F.col("barcode").alias("barcode"),
        F.when(o % 4 == 0, F.col("purchase_price") + 1).otherwise(F.col("purchase_price")).cast("string").alias("purchasePrice"),
        F.when(o % 3 != 1, F.col("purchase_date").cast("string")).alias("purchaseDate"),
        F.col("warranty_months").alias("warrantyMonths"),
        F.col("return_window_days").alias("returnWindowDays"),
    )
    quotes = F.struct(
        F.when(o % 3 == 0, "Invented laptop").otherwise(F.concat(F.lit("Product name: "), F.col("name"))).alias("name"),
        F.concat(F.lit("Seller: "), F.col("retailer")).alias("retailer"),
        F.when(o % 4 == 2, F.col("retailer")).otherwise(F.col("brand")).alias("brand"),
        F.when(o % 4 == 1, order).otherwise(F.concat(F.lit("Invoice No: "), F.col("invoice_number"))).alias("invoiceNumber"),
        F.when(o % 4 == 3, F.col("barcode")).otherwise(F.col("serial_number")).alias("serialNumber"),
        F.concat(F.lit("Model: "), F.col("model_number")).alias("modelNumber"),
        F.concat(F.lit("Barcode: "), F.col("barcode")).alias("barcode"),
        F.concat(F.lit("Grand Total: "), F.col("currency"), F.lit(" "), F.col("purchase_price")).alias("purchasePrice"),
        F.when(o % 5 == 0, F.date_format("purchase_date", "'Invoice date:' dd/MM/yyyy"))
        .when(o % 5 == 1, F.date_format("purchase_date", "'Date:' d-MMM-yyyy"))
        .when(o % 5 == 2, F.date_format("purchase_date", "'Purchase date:' yyyy-MM-dd"))
        .otherwise(F.date_format("purchase_date", "dd/MM/yyyy")).alias("purchaseDate"),
        F.concat(F.lit("Warranty: "), F.col("warranty_months"), F.lit(" months")).alias("warrantyMonths"),
        F.concat(F.lit("Return window: "), F.col("return_window_days"), F.lit(" days")).alias("returnWindowDays"),
    )
    payload = F.to_json(F.struct(fields.alias("fields"), quotes.alias("evidence")))
    pages = F.array(F.struct(F.lit(1).alias("page"), F.col("text").alias("text")))
    return r.select("document_id", "text", pages.alias("pages"), payload.alias("payload"))


@query("s05_read_candidates", with_(PRINTED, """
SELECT document_id, true AS usable, 10 - CAST(o % 3 = 1 AS INTEGER) - CAST(o % 4 <> 3 AND serial_number IS NULL AS INTEGER) - CAST(price IS NULL AS INTEGER)
 - CAST(warranty_months IS NULL AS INTEGER) - CAST(return_window_days IS NULL AS INTEGER) + 1 AS suggested FROM r"""))
def read_candidates(spark, folder):
    rows = cd.read_candidates(suggestions(spark, folder))
    return rows.select("document_id", "usable", F.size(F.filter("members", lambda m: m["kind"] != "VOID")).alias("suggested"))


@query("v01_quote_grounded", with_(PRINTED, """
SELECT document_id, o % 3 <> 0 AS name_grounded, NOT (price IS NULL OR (o % 7 = 3 AND price >= 1000) OR o % 7 = 4) AS price_grounded FROM r"""))
def grounded(spark, folder):
    rows = cd.read_candidates(suggestions(spark, folder)).withColumn("source", tx.nfkc(F.col("text")))
    rows = rows.withColumn("folded", tx.fold(F.col("source")))

    def of(field):
        quote = F.get(F.filter("members", lambda m: m["field"] == field), F.lit(0))["quote"]
        return F.coalesce(cd.quote_grounded(quote, quote, F.col("folded")), F.lit(False))

    return rows.select("document_id", of("name").alias("name_grounded"), of("purchasePrice").alias("price_grounded"))


VALIDATED = """SELECT document_id, CASE WHEN several OR o % 3 = 0 THEN '' ELSE name END AS name, CASE WHEN NOT several THEN retailer END AS retailer,
 CASE WHEN several THEN NULL WHEN o % 9 = 5 AND o % 4 = 2 THEN NULL ELSE brand END AS brand,
 CASE WHEN NOT several AND o % 4 <> 1 THEN invoice_number END AS invoice_number,
 CASE WHEN NOT several AND o % 4 <> 3 THEN serial_number END AS serial_number,
 CASE WHEN NOT several THEN model_number END AS model_number, CASE WHEN NOT several THEN barcode END AS barcode,
 CASE WHEN NOT several THEN CAST(seen_price AS VARCHAR) END AS purchase_price, CASE WHEN NOT several AND price IS NOT NULL THEN currency ELSE 'INR' END AS currency,
 CASE WHEN NOT several THEN CAST(seen_date AS VARCHAR) END AS purchase_date,
 CASE WHEN NOT several THEN warranty_months END AS warranty_months, CASE WHEN NOT several THEN return_window_days END AS return_window_days,
 CASE WHEN NOT several THEN CAST(CAST(seen_date + to_months(warranty_months) AS DATE) AS VARCHAR) END AS warranty_expires_at,
 CASE WHEN NOT several THEN CAST(seen_date + return_window_days AS VARCHAR) END AS return_expires_at,
 CASE WHEN several THEN 'ambiguous' WHEN o % 3 = 0 THEN 'rejected' END AS name_issue,
 CASE WHEN several THEN 'ambiguous' WHEN o % 4 = 1 THEN 'rejected' END AS invoice_issue,
 CASE WHEN several THEN 'ambiguous' WHEN o % 4 = 3 THEN 'rejected' WHEN serial_number IS NULL THEN 'missing' END AS serial_issue,
 CASE WHEN several THEN 'ambiguous' ELSE 'missing' END AS category_issue FROM r"""
BILL_COLUMNS = ["name", "retailer", "brand", "invoice_number", "serial_number", "model_number", "barcode", "purchase_price", "currency",
                "purchase_date", "warranty_months", "return_window_days", "warranty_expires_at", "return_expires_at"]


@query("v02_v11_validate_candidates", with_(PRINTED, VALIDATED))
def validate(spark, folder):
    rows = cd.validate_candidates(suggestions(spark, folder))

    def issue(field):
        return F.try_element_at("issues", F.lit(field))

    return rows.select(
        "document_id", *BILL_COLUMNS, issue("name").alias("name_issue"), issue("invoiceNumber").alias("invoice_issue"),
        issue("serialNumber").alias("serial_issue"), issue("category").alias("category_issue"),
    )


@query("v12_merge_name_repair", with_(PRINTED, """
SELECT document_id, CASE WHEN several THEN '' WHEN o % 3 = 0 AND o % 2 = 1 THEN '' ELSE name END AS name,
 NOT several AND o % 3 = 0 AND o % 2 = 0 AS name_repaired FROM r"""))
def name_repair(spark, folder):
    checked = cd.validate_candidates(suggestions(spark, folder)).withColumn("draft_named", F.lit(False))
    shown = F.when(F.col("o") % 2 == 0, F.col("name")).otherwise("Invented tablet")
    pair = F.struct(shown.alias("name"))
    repairs = derive.receipts(spark, folder).select("document_id", F.to_json(F.struct(pair.alias("fields"), pair.alias("evidence"))).alias("payload"))
    return cd.merge_name_repair(checked, repairs).select("document_id", "name", "name_repaired")


MODEL_WARNINGS = f"""
SELECT document_id, 'model' AS method, CASE WHEN several THEN '{cd.WARNINGS['ambiguous']}' WHEN o % 3 = 0 OR o % 4 IN (1, 3) THEN '{cd.WARNINGS['rejected']}'
 WHEN o % 4 = 2 AND o % 9 = 5 THEN '{cd.WARNINGS['rejected']}' WHEN price IS NOT NULL AND seen_price IS NULL THEN '{cd.WARNINGS['rejected']}'
 WHEN o % 3 <> 1 AND o % 5 = 4 THEN '{cd.WARNINGS['rejected']}' END AS warning FROM r"""


@query("v13_extraction_warnings", with_(PRINTED, MODEL_WARNINGS))
def warnings(spark, folder):
    return cd.extraction_warnings(cd.validate_candidates(suggestions(spark, folder))).select("document_id", "method", "warning")


def _shown(column):
    return f"CASE WHEN r.o % 13 = 6 THEN CAST(x.{column} AS VARCHAR) ELSE CAST(v.{column} AS VARCHAR) END AS {column}"


@query("v13_label_fallback", with_(PRINTED, f"""
, v AS ({VALIDATED}), x AS ({EXTRACTED}), w AS ({MODEL_WARNINGS})
SELECT r.document_id, CASE WHEN r.o % 13 = 6 THEN 'labels' ELSE 'model' END AS method,
 CASE WHEN r.o % 13 = 6 THEN '{cd.WARNINGS['invalid']}' || CASE WHEN r.several THEN ' {cd.WARNINGS['separate']}' ELSE '' END ELSE w.warning END AS warning,
 {', '.join(_shown(c) for c in BILL_COLUMNS)}
FROM r JOIN v USING (document_id) JOIN x USING (document_id) JOIN w USING (document_id)"""))
def label_fallback(spark, folder):
    """Every thirteenth payload ends too early; its fields come from labels."""
    o = derive.order_of(F.col("document_id"))
    cut = suggestions(spark, folder).withColumn("payload", F.when(o % 13 == 6, F.substring("payload", 1, 40)).otherwise(F.col("payload")))
    found = cd.with_label_fields(cd.extraction_warnings(cd.validate_candidates(cut)))
    return found.select("document_id", "method", "warning", *[F.col(c).cast("string").alias(c) for c in BILL_COLUMNS])


@query("v14_clean_issues", with_(sql.BILLS, """
SELECT user_id, id, CASE WHEN o % 4 = 0 THEN 'brand=ambiguous' WHEN o % 4 = 1 THEN 'name=missing' ELSE '' END AS issues FROM bills"""))
def clean_issues(spark, folder):
    o = derive.order_of(F.col("id"))
    raw = (
        F.when(o % 4 == 0, F.lit('{"brand":"ambiguous","ownerId":"rejected","invoiceNumber":false}'))
        .when(o % 4 == 1, F.lit('{"name":"missing","retailer":"odd"}'))
        .when(o % 4 == 2, F.lit("[1]"))
    )
    pairs = F.transform(F.map_entries(cd.clean_issues(raw)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return derive.bills(spark, folder).select("user_id", "id", F.array_join(F.array_sort(pairs), ",").alias("issues"))


@query("v15_locate_evidence", with_(PRINTED, """
SELECT document_id, 'invoiceNumber' AS field, CAST(0 AS INTEGER) AS page FROM r UNION ALL SELECT document_id, 'barcode', 1 FROM r UNION ALL SELECT document_id, 'notes', NULL FROM r"""))
def locate(spark, folder):
    r = derive.receipts(spark, folder)
    pages = r.select("document_id", F.posexplode(F.array(
        F.concat(F.lit("Invoice no:  "), F.col("invoice_number")), F.concat(F.lit("Barcode:\n"), F.col("barcode"))
    )).alias("page_index", "text"))
    evidence = r.select("document_id", F.create_map(
        F.lit("invoiceNumber"), F.concat(F.lit("INVOICE NO: "), F.col("invoice_number")),
        F.lit("barcode"), F.concat(F.lit("Barcode: "), F.col("barcode")), F.lit("notes"), F.lit("never printed"),
    ).alias("evidence"))
    return cd.locate_evidence(evidence, pages).select("document_id", "field", "page")


@query("v16_assemble_review", with_(PRINTED, """
SELECT document_id, user_id, o % 2 = 0 AS has_result, CASE WHEN o % 5 = 0 THEN 'Typed name' WHEN o % 2 = 0 THEN name ELSE 'label ' || name END AS name,
 CASE WHEN o % 5 = 1 THEN NULL WHEN o % 2 = 0 THEN brand ELSE 'label ' || brand END AS brand FROM r"""))
def review(spark, folder):
    r, o = derive.receipts(spark, folder), F.col("o")
    typed = F.when(o % 5 == 0, F.create_map(F.lit("name"), F.lit("Typed name"))).when(
        o % 5 == 1, F.create_map(F.lit("brand"), F.lit(None).cast("string"))
    )
    documents = r.select("document_id", "user_id", typed.alias("draft_fields"), F.lit(0).alias("draft_revision"))
    extracted = r.filter(o % 2 == 0).select("document_id", "name", "brand")
    labels = r.select("document_id", F.concat(F.lit("label "), F.col("name")).alias("name"), F.concat(F.lit("label "), F.col("brand")).alias("brand"))
    return cd.assemble_review(documents, extracted, labels).select("document_id", "user_id", "has_result", "name", "brand")


def stored_documents(spark, folder):
    """Documents with results as they are stored, their pages and jobs.

    By order key: 0 mod 2 with fields, 1 mod 4 a result without fields, 3 mod 4
    none; 0 mod 5 a typed name, 1 mod 5 a cleared maker; 2 mod 7 a page that is
    still read; 0 mod 8 with issues.
    """
    r, o = derive.receipts(spark, folder), F.col("o")
    fields = F.struct(*[F.col(c).cast("string").alias(f) for f, c in fixed.FIELDS.items() if c in r.columns], F.lit("Other").alias("category"), F.lit("kept").alias("notes"))
    quotes = F.struct(F.concat(F.lit("INVOICE no:  "), F.col("invoice_number")).alias("invoiceNumber"), F.concat(F.lit("Barcode: "), F.col("barcode")).alias("barcode"), F.lit("never printed").alias("notes"))
    issues = F.struct(F.when(o % 8 == 0, "ambiguous").alias("name"), F.lit("odd").alias("retailer"))
    result = F.struct(
        F.when(o % 2 == 0, fields).alias("fields"), F.when(o % 2 == 0, quotes).alias("evidence"),
        F.struct(F.when(o % 2 == 0, "model").otherwise("labels").alias("method")).alias("extraction"), F.struct(issues.alias("fieldIssues")).alias("extractionDiagnostics"))
    typed = F.when(o % 5 == 0, F.create_map(F.lit("name"), F.lit("Typed name"))).when(
        o % 5 == 1, F.create_map(F.lit("brand"), F.lit(None).cast("string")))
    documents = r.select(
        "document_id", "user_id", F.when(o % 3 != 0, F.col("document_id")).alias("item_id"), F.concat(F.col("invoice_number"), F.lit(".pdf")).alias("original_filename"),
        F.lit("application/pdf").alias("content_type"), F.lit("review").alias("ocr_status"), F.lit(2).alias("page_count"), typed.alias("draft_fields"),
        (o % 4).cast("int").alias("draft_revision"), F.when(o % 4 != 3, F.to_json(result)).alias("extracted_data"))
    lines = F.split("text", "\n")
    page = F.struct(F.lit(0).alias("page_index"), F.array_join(F.slice(lines, 1, 2), "\n").alias("text"), F.lit("complete").alias("status"))
    rest = F.struct(F.lit(1).alias("page_index"), F.array_join(F.slice(lines, F.lit(3), F.size(lines)), "\n").alias("text"), F.lit("complete").alias("status"))
    unread = F.struct(F.lit(2).alias("page_index"), F.lit("Invoice No: OTHER000999").alias("text"), F.lit("processing").alias("status"))
    pages = r.select("document_id", F.explode(F.when(o % 7 == 2, F.array(page, rest, unread)).otherwise(F.array(page, rest))).alias("p")).select(
        "document_id", "p.*", F.lit(0.9).alias("confidence"))
    jobs = r.select("document_id", F.explode(F.array(F.lit(1), F.lit(2))).alias("generation"), o).filter((o % 3 == 0) | (F.col("generation") == 1)).select(
        "document_id", "generation", F.when(F.col("generation") == 2, "complete").otherwise("failed").alias("status"), (o % 3).cast("int").alias("completed_pages"))
    return documents, pages, jobs


_REVIEW_FIELDS = [c for c in fixed.FIELDS.values()]
_FROM_LABELS = [c for c in _REVIEW_FIELDS if c not in ("category", "notes")]


def _review_field(column):
    fields = {"category": "'Other'", "notes": "'kept'", "purchase_price": "CAST(r.price AS VARCHAR)", "warranty_expires_at": "NULL", "return_expires_at": "NULL"}
    stored = fields.get(column, f"CAST(r.{column} AS VARCHAR)")
    read = f"CAST(x.{column} AS VARCHAR)" if column in _FROM_LABELS else "NULL"
    shown = f"CASE WHEN r.o % 2 = 0 THEN {stored} ELSE {read} END"
    if column == "name":
        shown = f"CASE WHEN r.o % 5 = 0 THEN 'Typed name' ELSE {shown} END"
    if column == "brand":
        shown = f"CASE WHEN r.o % 5 = 1 THEN NULL ELSE {shown} END"
    return f"{shown} AS {column}"


@query("v16_load_review", with_(PRINTED, f"""
, x AS ({EXTRACTED})
SELECT r.document_id, r.user_id, CASE WHEN r.o % 3 <> 0 THEN r.document_id END AS item_id, r.invoice_number || '.pdf' AS filename, 'application/pdf' AS content_type,
 'review' AS status, CAST(2 AS INTEGER) AS page_count, CASE WHEN r.o % 2 = 0 THEN 'model' WHEN r.o % 4 = 1 THEN 'labels' END AS extraction_method,
 CASE WHEN r.o % 8 = 0 THEN 'name=ambiguous' ELSE '' END AS issues, CASE WHEN r.o % 8 = 0 THEN 'ambiguous' END AS name_issue,
 CASE WHEN r.o % 2 = 0 THEN 'barcode@' || '1,invoiceNumber@0,notes@-' ELSE '' END AS evidence,
 CAST(CASE WHEN r.o % 7 = 2 THEN 3 ELSE 2 END AS INTEGER) AS pages, CASE WHEN r.o % 3 = 0 THEN 'complete' ELSE 'failed' END AS job_status,
 CAST(r.o % 3 AS INTEGER) AS completed_pages, CAST(r.o % 4 AS INTEGER) AS draft_revision, r.o % 2 = 0 AS has_result, {', '.join(_review_field(c) for c in _REVIEW_FIELDS)}
FROM r JOIN x USING (document_id)"""))
def load_review(spark, folder):
    found = cd.load_review(*stored_documents(spark, folder))
    issues = F.array_sort(F.transform(F.map_entries("field_issues"), lambda e: F.concat_ws("=", e["key"], e["value"])))
    places = F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("@"), F.coalesce(e["value"]["page"].cast("string"), F.lit("-")))))
    return found.select(
        "document_id", "user_id", "item_id", "filename", "content_type", "status", "page_count", "extraction_method", F.array_join(issues, ",").alias("issues"), "name_issue",
        F.coalesce(F.array_join(places, ","), F.lit("")).alias("evidence"), F.size("pages").alias("pages"), F.col("job.status").alias("job_status"),
        F.col("job.completed_pages").alias("completed_pages"), "draft_revision", "has_result", *_REVIEW_FIELDS)


# --- recognition ----------------------------------------------------------
def detections(spark, folder):
    """Word boxes of every chat turn, laid out line by line.

    A conversation stands for a document and a turn for a page.  Odd pages
    lean a little and give four corners; even pages give two.
    """
    turns = read_star(spark, folder, "conversations").select(
        F.col("conv_id").cast("string").alias("document_id"), F.col("turn").cast("int").alias("page"), "text"
    )
    lines = turns.select("document_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    words = F.filter(F.split("line", " "), lambda w: w != "")
    placed = lines.select("document_id", "page", "line_no", F.posexplode(words).alias("word_no", "word"), words.alias("all"))
    before = F.length(F.array_join(F.slice("all", F.lit(1), F.col("word_no")), " "))
    left = (before + F.when(F.col("word_no") > 0, 1).otherwise(0)) * 10.0
    right, top = left + F.length("word") * 10.0, F.col("line_no") * 40.0

    def corner(x, y):
        lean = F.when(F.col("page") % 2 == 1, 0.01).otherwise(0.0)
        return F.struct(x.alias("x"), (y + lean * x).alias("y"))

    four = F.array(corner(left, top), corner(right, top), corner(right, top + 18), corner(left, top + 18))
    two = F.array(corner(left, top), corner(right, top + 18))
    return placed.select(
        "document_id", "page", (F.col("line_no") * 10_000 + F.col("word_no")).alias("ord"), F.col("word").alias("text"),
        F.lit(0.9).alias("confidence"), F.when(F.col("page") % 2 == 1, four).otherwise(two).alias("points"),
    )


LINES = r"""WITH t AS (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
w AS (SELECT document_id, turn, n, trim(regexp_replace(line, ' +', ' ', 'g'), ' ') AS line FROM t)"""


@query("o01_position_words", LINES + """
SELECT document_id, turn AS page, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS words, CAST(sum(length(replace(line, ' ', ''))) * 10 AS BIGINT) AS width FROM w WHERE line <> '' GROUP BY ALL""")
def position_words(spark, folder):
    rows = ocr.position_words(detections(spark, folder))
    return rows.groupBy("document_id", "page").agg(
        F.count("*").alias("words"), F.round(F.sum(F.col("right") - F.col("left"))).cast("long").alias("width")
    )


@query("o02_o08_read_layout", LINES + """, p AS (SELECT document_id, turn, string_agg(line, chr(10) ORDER BY n) AS page FROM w WHERE line <> '' GROUP BY ALL)
SELECT document_id, string_agg(page, chr(10) || chr(10) ORDER BY turn) AS text FROM p GROUP BY document_id""")
def read_layout(spark, folder):
    return ocr.read_layout(detections(spark, folder))


@query("o03_o06_block_slopes")
def slopes(spark, folder):
    words = ocr.split_sections(ocr.position_words(detections(spark, folder)))
    return ocr.block_slopes(words).withColumn("slope", F.round("slope", 6))


@query("o04_j05_neighbour_slopes")
def neighbours(spark, folder):
    words = ocr.split_sections(ocr.position_words(detections(spark, folder)))
    return ocr.neighbour_slopes(words).withColumn("value", F.round("value", 6))


@query("s03_s04_read_ocr_payloads", LINES + """
SELECT document_id, CAST(sum(len(string_split(line, ' '))) AS BIGINT) AS words, CAST(0.9 AS DOUBLE) AS confidence FROM w WHERE line <> '' GROUP BY document_id""")
def payloads(spark, folder):
    d = detections(spark, folder)
    one = F.struct(F.struct("text", "confidence").alias("text_prediction"), F.struct("points").alias("bounding_box"))
    pages = d.groupBy("document_id", "page").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", one.alias("d")))), lambda x: x["d"]).alias("ds"))
    docs = pages.groupBy("document_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "ds"))), lambda p: F.struct(p["ds"].alias("text_detections"))).alias("data"))
    found, _ = pl.read_ocr_payloads(docs.select("document_id", F.to_json(F.struct("data")).alias("payload")))
    return found.groupBy("document_id").agg(F.count("*").alias("words")).join(pl.page_confidence(found), "document_id").withColumn("confidence", F.round("confidence", 6))


@query("s02_check_originals", with_(sql.DOCUMENTS, """
SELECT id AS document_id, o % 10 > 3 AS ok, CASE o % 10 WHEN 0 THEN 'empty' WHEN 1 THEN 'too large' WHEN 2 THEN 'size differs' WHEN 3 THEN 'content is another type' END AS reason FROM documents_d"""))
def originals(spark, folder):
    d = derive.documents(spark, folder).withColumn("o", derive.order_of(F.col("id")))
    o, size = F.col("o"), F.col("byte_size").cast("long")
    head = F.when(o % 10 == 3, F.lit("3C736372697074")).when(F.col("content_type") == "application/pdf", "255044462D312E37").otherwise("FFD8FFE000104A46")
    files = d.select(
        F.col("id").alias("document_id"),
        F.when(o % 10 == 0, 0).when(o % 10 == 1, fixed.MAX_FILE_BYTES + 1).when(o % 10 == 2, size + 1).otherwise(size).cast("long").alias("length"),
        F.unhex(head).alias("content"),
    )
    manifest = d.select(F.col("id").alias("document_id"), "content_type", F.when(o % 10 == 1, fixed.MAX_FILE_BYTES + 1).otherwise(size).cast("long").alias("byte_size"))
    return pl.check_originals(files, manifest)


# A file for each document: the head of one of the types, then its text.  Some are
# empty, some of another type or size than declared, some are missing.
HEADS = {"application/pdf": "255044462D312E37", "image/jpeg": "FFD8FFE0", "image/png": "89504E470D0A1A0A", "image/webp": "524946460102030457454250"}
FILES = """f AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/webp' ELSE 'image/gif' END AS content_type,
 CASE WHEN doc_id % 17 = 0 OR doc_id % 11 = 0 THEN 0
      ELSE CASE doc_id % 5 WHEN 0 THEN 8 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 12 ELSE 0 END + strlen(coalesce(text, '')) END AS length FROM documents)"""


@query("s02_scan_folder", f"""WITH {FILES}, r AS (SELECT doc_id, CASE WHEN length = 0 THEN 'empty' WHEN doc_id % 13 = 0 THEN 'size differs'
  WHEN content_type = 'image/gif' THEN 'type not accepted' WHEN doc_id % 7 = 0 THEN 'content is another type' END AS reason FROM f)
SELECT CAST(doc_id AS VARCHAR) AS document_id, reason IS NULL AS ok, reason FROM r""")
def scan_folder(spark, folder):
    """Every text of the corpus written as an original, then scanned by listing and twelve bytes."""
    n = F.col("document_id")
    kinds = F.array(*[F.lit(kind) for kind in [*HEADS, "image/gif"]])
    heads = F.array(*[F.unhex(F.lit(head)) for head in [*HEADS.values(), ""]])
    docs = corpus(spark, folder).select(
        "document_id", F.element_at(kinds, (n % 5 + 1).cast("int")).alias("content_type"),
        F.when(n % 11 == 0, F.lit(b"")).otherwise(F.concat(F.element_at(heads, (n % 5 + 1).cast("int")), F.coalesce("text", F.lit("")).cast("binary"))).alias("content"))
    damaged = F.when((n % 7 == 0) & (F.length("content") > 0), F.overlay("content", F.lit(b"<"), F.lit(1), F.lit(1))).otherwise(F.col("content"))
    root = f"{checkpoint_folder(spark)}/originals-{uuid.uuid4().hex}"
    og.write_files(docs.filter(n % 17 != 0).select(F.concat_ws("/", n % 64, n).alias("path"), damaged.alias("content")), root)
    declared = F.length("content") + F.when(n % 13 == 0, 1).otherwise(0)
    manifest = docs.select(n.cast("string").alias("document_id"), "content_type", declared.cast("long").alias("byte_size"))
    return og.scan_originals(spark, root, manifest)


def page_readings(spark, folder):
    """Sources of every document of the corpus, with gaps by id."""
    n = F.col("document_id")
    return corpus(spark, folder).select(
        "document_id", F.lit(0).alias("page"),
        F.when(n % 4 == 0, F.col("text")).alias("embedded_text"),
        F.when(n % 4 == 3, "").otherwise(F.col("text")).alias("ocr_text"),
        F.when(n % 4 == 2, 0.5).otherwise(0.95).alias("ocr_confidence"),
        F.col("text").alias("local_text"), F.lit(0.8).alias("local_confidence"), (n % 5 != 0).alias("has_provider"),
    )


SOURCES = r"""p AS (SELECT doc_id, doc_id % 5 <> 0 AS has_provider,
  CASE WHEN doc_id % 4 = 0 AND length(trim(text, chr(32)||chr(9)||chr(10)||chr(13))) >= 100 AND regexp_matches(text, '\p{L}') AND NOT contains(text, chr(65533)) THEN 'pdf-text'
       WHEN doc_id % 5 <> 0 AND doc_id % 4 IN (0, 1) THEN 'provider' ELSE 'local' END AS source FROM documents)"""


@query("o09_o10_o12_page_source", f"WITH {SOURCES} SELECT doc_id AS document_id, source, source <> 'pdf-text' AND has_provider AND source <> 'provider' AS fallback FROM p")
def page_source(spark, folder):
    return ocr.page_source(page_readings(spark, folder)).select("document_id", "source", "fallback")


@query("a08_ocr_source_report", f"""WITH {SOURCES}
SELECT source, count(*) AS pages, CAST(sum(CASE WHEN source <> 'pdf-text' AND has_provider THEN 1 ELSE 0 END) AS BIGINT) AS provider_attempts,
 CAST(sum(CASE WHEN source = 'local' THEN 1 ELSE 0 END) AS BIGINT) AS local_attempts, count(*) FILTER (source = 'local' AND has_provider) AS fallbacks FROM p GROUP BY source""")
def source_report(spark, folder):
    return sc.ocr_source_report(ocr.page_source(page_readings(spark, folder)))


@query("o11_best_reading", r"""
WITH c AS (SELECT doc_id, length(regexp_replace(text, '[\s\x{a0}]', '', 'g')) AS n, length(trim(text, chr(32)||chr(9)||chr(10)||chr(13))) AS len FROM documents)
SELECT doc_id AS document_id, CASE WHEN doc_id % 3 = 0 AND len >= 40 THEN 1 WHEN least(n, 600) * (CASE WHEN doc_id % 3 = 0 THEN 0.81 ELSE 0.25 END) >= least(n, 600) * 0.49 THEN 1 ELSE 2 END AS pass FROM c""")
def best_reading(spark, folder):
    n = F.col("document_id")
    passes = F.array(
        F.struct(F.lit(1).alias("pass"), F.when(n % 3 == 0, 0.9).otherwise(0.5).alias("confidence")),
        F.struct(F.lit(2).alias("pass"), F.lit(0.7).alias("confidence")),
    )
    readings = corpus(spark, folder).select("document_id", F.lit(0).alias("page"), "text", F.explode(passes).alias("p")).select("document_id", "page", "text", "p.*")
    return ocr.best_reading(readings).select("document_id", "pass")


@query("o13_assemble_document", with_(sql.PAGES, """
SELECT document_id, string_agg('[Page ' || (page_index + 1) || ']' || chr(10) || 'page ' || (page_index + 1) || ' of ' || document_id, chr(10) || chr(10) ORDER BY page_index) AS text
FROM pages_d WHERE o % 4 <> 3 GROUP BY document_id"""))
def assemble(spark, folder):
    documents = derive.documents(spark, folder).select(F.col("id").alias("document_id"), "page_count")
    return ocr.assemble_document(documents, derive.document_pages(spark, folder))


@query("w07_page_order", with_(sql.PAGES, "SELECT document_id, page_index, status FROM pages_d ORDER BY document_id, page_index"))
def page_order(spark, folder):
    return derive.document_pages(spark, folder).orderBy("document_id", "page_index").select("document_id", "page_index", "status")
