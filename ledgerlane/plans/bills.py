"""Registered queries over bills."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlane.functions import deadlines as dl
from ledgerlane.functions.money import format_money
from ledgerlane.operators import bills as ops
from ledgerlane.plans import sql
from ledgerlane.plans.registry import query
from ledgerlane.plans.sql import with_
from ledgerlane.sources import derive

def today():
    return F.lit("1999-01-01").cast("date")


GROUPED = """CASE WHEN length(w) <= 3 THEN w WHEN length(w) <= 5 THEN substr(w, 1, length(w)-3) || ',' || right(w, 3)
  WHEN length(w) <= 7 THEN substr(w, 1, length(w)-5) || ',' || substr(w, length(w)-4, 2) || ',' || right(w, 3)
  ELSE substr(w, 1, length(w)-7) || ',' || substr(w, length(w)-6, 2) || ',' || substr(w, length(w)-4, 2) || ',' || right(w, 3) END"""


def sql_money(price: str, currency: str) -> str:
    whole = f"split_part(CAST({price} AS VARCHAR), '.', 1)"
    grouped = GROUPED.replace("length(w)", f"length({whole})").replace("(w,", f"({whole},").replace("THEN w ", f"THEN {whole} ")
    sign = f"CASE {currency} WHEN 'INR' THEN '₹' WHEN 'USD' THEN '$' WHEN 'EUR' THEN '€' WHEN 'GBP' THEN '£' ELSE {currency} || chr(160) END"
    return f"CASE WHEN {price} IS NULL THEN 'Amount not recorded' ELSE {sign} || ({grouped}) || '.' || split_part(CAST({price} AS VARCHAR), '.', 2) END"


def sql_date(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'Not recorded' ELSE strftime({value}, '%-d %b %Y') END"


# A draft table with rule violations spread over the bills.
def damaged(spark, folder):
    o = derive.order_of(F.col("id"))
    b = derive.bills(spark, folder)
    return b.withColumns(
        {
            "name": F.when(o % 19 == 0, F.lit("  ")).when(o % 23 == 0, F.repeat(F.lit("x"), 161)).otherwise(F.col("name")),
            "currency": F.when(o % 29 == 0, F.lower("currency")).otherwise(F.col("currency")),
            "warranty_months": F.when(o % 31 == 0, 1201).otherwise(F.col("warranty_months")),
            "return_expires_at": F.when(o % 37 == 0, F.date_sub("purchase_date", 1)).otherwise(F.col("return_expires_at")),
            "reminder_days": F.when(o % 41 == 0, F.array(F.lit(400))).otherwise(F.col("reminder_days")),
            "category": F.when(o % 43 == 0, F.lit("Toys")).otherwise(F.col("category")),
            "purchase_price": F.when(o % 47 == 0, -F.col("purchase_price")).otherwise(F.col("purchase_price")),
        }
    )


@query("b01_validate_bills", with_(sql.BILLS, """
SELECT user_id, id, concat_ws(',',
  CASE WHEN o % 19 <> 0 AND o % 23 = 0 THEN 'name_too_long' END,
  CASE WHEN o % 43 = 0 THEN 'category_unknown' END,
  CASE WHEN o % 47 = 0 AND purchase_price IS NOT NULL THEN 'price_invalid' END,
  CASE WHEN o % 29 = 0 THEN 'currency_invalid' END,
  CASE WHEN o % 31 = 0 THEN 'months_out_of_range' END,
  CASE WHEN o % 41 = 0 THEN 'reminder_day_out_of_range' END,
  CASE WHEN o % 19 = 0 THEN 'name_empty' END,
  CASE WHEN o % 37 = 0 THEN 'return_before_purchase' END) AS errors FROM bills"""))
def validate(spark, folder):
    return damaged(spark, folder).select("user_id", "id", F.array_join(ops.bill_errors(), ",").alias("errors"))


@query("b02_derive_deadlines", with_(sql.BILLS, """
SELECT user_id, id, CAST(warranty_expires_at AS VARCHAR) AS warranty_expires_at, CAST(return_expires_at AS VARCHAR) AS return_expires_at FROM bills"""))
def derive_deadlines(spark, folder):
    plain = derive.bills(spark, folder).drop("warranty_expires_at", "return_expires_at")
    return ops.derive_deadlines(plain).select("user_id", "id", "warranty_expires_at", "return_expires_at")


def edited(spark, folder):
    """The same bills after an edit of durations or dates."""
    o = derive.order_of(F.col("id"))
    return derive.bills(spark, folder).withColumns(
        {
            "purchase_date": F.when(o % 4 == 1, F.date_add("purchase_date", 10)).otherwise(F.col("purchase_date")),
            "warranty_months": F.when(o % 4 == 2, F.coalesce("warranty_months", F.lit(0)) + 6).otherwise(F.col("warranty_months")),
        }
    )


def before_edit(spark, folder):
    """Bills where every eighth deadline was typed in by hand."""
    o = derive.order_of(F.col("id"))
    return derive.bills(spark, folder).withColumn(
        "warranty_expires_at", F.when(o % 8 == 1, F.lit("2005-05-05").cast("date")).otherwise(F.col("warranty_expires_at"))
    )


@query("b03_recompute_deadlines", with_(sql.BILLS, """
SELECT user_id, id,
  CAST(CASE WHEN o % 4 = 1 THEN purchase_date + 10 ELSE purchase_date END AS VARCHAR) AS purchase_date,
  CAST(CASE WHEN o % 8 = 1 THEN warranty_expires_at
       WHEN o % 4 = 1 THEN CAST((purchase_date + 10) + to_months(warranty_months) AS DATE)
       WHEN o % 4 = 2 THEN CAST(purchase_date + to_months(coalesce(warranty_months, 0) + 6) AS DATE)
       ELSE warranty_expires_at END AS VARCHAR) AS warranty_expires_at,
  CAST(CASE WHEN o % 4 = 1 THEN (purchase_date + 10) + return_window_days ELSE return_expires_at END AS VARCHAR) AS return_expires_at
FROM bills"""))
def recompute(spark, folder):
    return ops.recompute_deadlines(before_edit(spark, folder), edited(spark, folder))


@query("b04_deadline_provenance", with_(sql.BILLS, """
SELECT user_id, id,
  CASE WHEN warranty_months IS NOT NULL AND NOT (o % 3 = 0 AND o % 5 <> 0) THEN 'Calculated from purchase date and duration'
       WHEN o % 5 = 0 THEN 'Your correction' WHEN o % 3 = 0 THEN 'Warranty expires: printed' END AS warranty_source,
  CASE WHEN return_window_days IS NOT NULL THEN 'Calculated from purchase date and duration' END AS return_source
FROM bills"""))
def provenance(spark, folder):
    o = derive.order_of(F.col("id"))
    touched = F.when(o % 5 == 0, F.array(F.lit("warranty_expires_at"))).otherwise(F.array().cast("array<string>"))
    quotes = F.when(
        o % 3 == 0, F.create_map(F.lit("warranty_expires_at"), F.lit("Warranty expires: printed"))
    ).otherwise(F.create_map().cast("map<string,string>"))
    return ops.deadline_provenance(derive.bills(spark, folder), touched, quotes)


@query("b05_warranty_state", with_(sql.STATE, """
SELECT user_id, id, status, days_left,
  CASE WHEN days_left IS NULL THEN 'No cover date' WHEN days_left < 0 THEN 'Cover ended' WHEN days_left = 0 THEN 'Ends today'
       ELSE days_left || ' days left' END AS label,
  CAST(floor(CASE WHEN warranty_expires_at > purchase_date
       THEN greatest(0, least(100, CAST(days_left AS DOUBLE) / date_diff('day', purchase_date, warranty_expires_at) * 100)) ELSE 0 END * 10) AS BIGINT) AS permille
FROM state"""))
def warranty_state(spark, folder):
    rows = ops.warranty_state(derive.bills(spark, folder), today())
    return rows.select("user_id", "id", "status", "days_left", "label", F.floor(F.col("percent") * 10).alias("permille"))


@query("b06_return_state", with_(sql.BILLS, f"""
SELECT user_id, id, date_diff('day', DATE '1999-01-01', return_expires_at) AS return_days,
  CASE WHEN return_expires_at = DATE '1999-01-01' THEN 'Return deadline today'
       WHEN return_expires_at > DATE '1999-01-01' THEN 'Return by ' || {sql_date('return_expires_at')} END AS return_note,
  coalesce(return_expires_at BETWEEN DATE '1999-01-01' AND DATE '1999-01-08', false) AS return_urgent FROM bills"""))
def return_state(spark, folder):
    return ops.return_state(derive.bills(spark, folder), today()).select("user_id", "id", "return_days", "return_note", "return_urgent")


@query("b07_format_money_date", with_(sql.BILLS, f"""
SELECT user_id, id, {sql_money('purchase_price', 'currency')} AS price, {sql_date('warranty_expires_at')} AS expires FROM bills"""))
def formats(spark, folder):
    return derive.bills(spark, folder).select(
        "user_id", "id",
        format_money(F.col("purchase_price"), F.col("currency")).alias("price"),
        dl.display_date(F.col("warranty_expires_at")).alias("expires"),
    )


SEARCH = "lower(concat_ws(' ', name, retailer, brand, category, serial_number, model_number, barcode, invoice_number))"


@query("b08_search_bills", with_(sql.BILLS, f"SELECT user_id, id, name FROM bills WHERE contains({SEARCH}, 'brand#1')"))
def search(spark, folder):
    return ops.search_bills(derive.bills(spark, folder), " Brand#1 ").select("user_id", "id", "name")


@query("b09_filter_bills", with_(sql.STATE, "SELECT user_id, id, name FROM state WHERE category = 'Electronics' AND status = 'active'"))
def filter_bills(spark, folder):
    return ops.filter_bills(derive.bills(spark, folder), today(), "Electronics", "active").select("user_id", "id", "name")


@query("b10_support_drafts", with_(sql.BILLS, f"""
SELECT user_id, id, 'Subject: Support request - ' || name || chr(10) || chr(10) || 'Hello,' || chr(10) || chr(10) ||
 'I am requesting assistance with the following item.' || chr(10) || chr(10) ||
 concat_ws(chr(10), 'Item: ' || name, 'Retailer: ' || retailer, 'Invoice: ' || invoice_number, 'Serial number: ' || serial_number,
  'Model: ' || model_number, 'Purchased: ' || {sql_date('purchase_date')},
  CASE WHEN purchase_price IS NOT NULL THEN 'Amount paid: ' || {sql_money('purchase_price', 'currency')} END,
  CASE WHEN warranty_expires_at IS NOT NULL THEN 'Recorded warranty end: ' || {sql_date('warranty_expires_at')} END) ||
 chr(10) || chr(10) || 'Issue:' || chr(10) || 'No power' || chr(10) || chr(10) ||
 'Please confirm the available support options and next steps. I can provide the purchase document if required.' ||
 chr(10) || chr(10) || 'Thank you.' AS letter FROM bills"""))
def support(spark, folder):
    return ops.support_drafts(derive.bills(spark, folder), F.lit("  No power\n"))


FACTS = """json_object('id', id, 'name', name, 'retailer', retailer, 'brand', brand, 'invoiceNumber', invoice_number,
 'serialNumber', serial_number, 'modelNumber', model_number, 'barcode', barcode, 'category', category,
 'purchasePrice', CAST(purchase_price AS VARCHAR), 'currency', currency, 'purchaseDate', CAST(purchase_date AS VARCHAR),
 'warrantyMonths', warranty_months, 'warrantyExpiresAt', CAST(warranty_expires_at AS VARCHAR),
 'returnWindowDays', return_window_days, 'returnExpiresAt', CAST(return_expires_at AS VARCHAR))"""


@query("b11_assistant_facts", with_(sql.BILLS, f"""
, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM bills),
facts AS (SELECT user_id, count(*) FILTER (position <= 50) AS bills, max(position) > 50 AS truncated,
  '[' || string_agg(CAST({FACTS} AS VARCHAR), ',' ORDER BY position) FILTER (position <= 50) || ']' AS facts
  FROM ranked WHERE position <= 51 GROUP BY user_id)
SELECT *, length(facts) > 60000 AS too_long FROM facts"""))
def assistant_facts(spark, folder):
    return ops.assistant_facts(derive.bills(spark, folder), bills=50, chars=60_000)


@query("b12_check_citations", with_(sql.BILLS, """
, ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM bills),
top AS (SELECT * FROM ranked WHERE position <= 50)
SELECT user_id, 'a' || user_id AS answer_id, CAST(user_id AS BIGINT) % 5 <> 0 AS accepted,
  CASE WHEN CAST(user_id AS BIGINT) % 5 <> 0 THEN string_agg(id, ',' ORDER BY position) FILTER (position <= 3) END AS sources
FROM top GROUP BY user_id"""))
def citations(spark, folder):
    supplied = ops.recent_bills(derive.bills(spark, folder), 50)
    # An answer per account citing its three newest bills; every fifth account
    # is also given a bill that was not supplied.
    cited = F.collect_list(F.when(F.col("position") <= 3, F.col("id")))
    answers = supplied.groupBy("user_id").agg(cited.alias("ids")).select(
        "user_id",
        F.concat(F.lit("a"), F.col("user_id")).alias("answer_id"),
        F.when(F.col("user_id").cast("long") % 5 == 0, F.array_append("ids", F.lit("unknown"))).otherwise(F.col("ids")).alias("bill_ids"),
    )
    return ops.check_citations(answers, supplied).withColumn("sources", F.array_join("sources", ","))


@query("b13_check_conversations", """
SELECT conv_id, count(*) AS messages, CAST(sum(length(trim(text, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)))) AS BIGINT) AS chars,
 count(*) BETWEEN 1 AND 10 AND bool_and(role IN ('user','assistant'))
 AND bool_and(length(trim(text, chr(32)||chr(9)||chr(10)||chr(13)||chr(160))) BETWEEN 1 AND 4000)
 AND sum(length(trim(text, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)))) <= 20000 AND arg_max(role, turn) = 'user' AS valid
FROM conversations GROUP BY conv_id""")
def conversations(spark, folder):
    return ops.check_conversations(spark.read.parquet(f"{folder}/conversations.parquet"))


@query("b14_bill_detail", with_(sql.DOCUMENTS, """
SELECT b.user_id, b.id, b.name, string_agg(d.id || ' ' || d.original_filename || ' ' || d.ocr_status, ';' ORDER BY d.id) AS files
FROM bills b LEFT JOIN documents_d d ON d.user_id = b.user_id AND d.item_id = b.id GROUP BY b.user_id, b.id, b.name"""))
def bill_detail(spark, folder):
    rows = ops.bill_detail(derive.bills(spark, folder), derive.documents(spark, folder))
    files = F.transform("files", lambda f: F.concat_ws(" ", f["id"], f["filename"], f["ocr_status"]))
    return rows.select("user_id", "id", "name", F.array_join(files, ";").alias("files"))


@query("b15_draft_status", with_(sql.DOCUMENTS, """
SELECT user_id, id, original_filename, CASE ocr_status WHEN 'pending' THEN 'Upload incomplete' WHEN 'failed' THEN 'Reading incomplete'
  WHEN 'processing' THEN 'Reading in background' ELSE 'Ready to review' END AS state FROM documents_d WHERE item_id IS NULL"""))
def draft_status(spark, folder):
    return ops.draft_status(derive.documents(spark, folder))


@query("a01_totals_by_currency", with_(sql.BILLS, """
SELECT user_id, currency, CAST(sum(purchase_price) AS VARCHAR) AS total, count(*) AS priced_bills
FROM bills WHERE purchase_price IS NOT NULL GROUP BY user_id, currency"""))
def totals(spark, folder):
    return ops.totals_by_currency(derive.bills(spark, folder))


@query("a02_vault_stats", with_(sql.STATE, """
SELECT user_id, count(*) AS saved, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'ending') AS ending
FROM state GROUP BY user_id"""))
def stats(spark, folder):
    return ops.vault_stats(derive.bills(spark, folder), today())


FACETS = """count(*) AS all_bills, count(*) FILTER (status = 'active') AS active, count(*) FILTER (status = 'ending') AS ending,
 count(*) FILTER (status = 'expired') AS expired, count(*) FILTER (status = 'unknown') AS unknown"""


@query("a03_status_facets", with_(sql.STATE, f"SELECT user_id, {FACETS} FROM state GROUP BY user_id"))
def facets(spark, folder):
    return ops.status_facets(derive.bills(spark, folder), today())


@query("a03_status_facets_searched", with_(sql.STATE, f"SELECT user_id, {FACETS} FROM state WHERE contains({SEARCH}, 'ring') AND category = 'Electronics' GROUP BY user_id"))
def facets_searched(spark, folder):
    return ops.status_facets(derive.bills(spark, folder), today(), "RING", "Electronics")


@query("a05_page_progress", with_(sql.PAGES, """
SELECT user_id, document_id, page_count, count(*) FILTER (status = 'complete') AS complete_pages,
 count(*) FILTER (status = 'complete') = page_count AS finished FROM pages_d GROUP BY user_id, document_id, page_count"""))
def progress(spark, folder):
    return ops.page_progress(derive.documents(spark, folder), derive.document_pages(spark, folder))


@query("w02_upcoming_deadlines", with_(sql.BILLS, """
SELECT * FROM (SELECT user_id, id, name, type, CAST(date AS VARCHAR) AS date, row_number() OVER (PARTITION BY user_id ORDER BY date, id, type) AS position
 FROM (SELECT user_id, id, name, 'Warranty' AS type, warranty_expires_at AS date FROM bills UNION ALL
       SELECT user_id, id, name, 'Return', return_expires_at FROM bills) WHERE date >= DATE '1999-01-01') WHERE position <= 5"""))
def upcoming(spark, folder):
    return ops.upcoming_deadlines(derive.bills(spark, folder), today())


@query("w03_recent_drafts", with_(sql.DOCUMENTS, """
SELECT * FROM (SELECT user_id, id, original_filename, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position
 FROM documents_d WHERE item_id IS NULL) WHERE position <= 30"""))
def drafts(spark, folder):
    return ops.recent_drafts(derive.documents(spark, folder)).select("user_id", "id", "original_filename", "position")


def sorted_rows(mode: str):
    def run(spark, folder):
        return ops.sort_bills(derive.bills(spark, folder), mode, today()).select("user_id", "id", "name", "warranty_expires_at")

    return run


SORTED = "SELECT user_id, id, name, CAST(warranty_expires_at AS VARCHAR) AS warranty_expires_at FROM state ORDER BY user_id, "
query("w04_sort_bills_newest", with_(sql.STATE, SORTED + "created_at DESC, id"))(sorted_rows("newest"))
query("w04_sort_bills_name", with_(sql.STATE, SORTED + "name, id"))(sorted_rows("name"))
query("w04_sort_bills_expiry", with_(sql.STATE, SORTED + """
 CASE status WHEN 'unknown' THEN 2 WHEN 'expired' THEN 1 ELSE 0 END, state.warranty_expires_at NULLS LAST, name, id"""))(sorted_rows("expiry"))


@query("w06_recent_bills", with_(sql.BILLS, """
SELECT * FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS position FROM bills) WHERE position <= 4"""))
def recent(spark, folder):
    return ops.recent_bills(derive.bills(spark, folder)).select("user_id", "id", "position")


@query("r16_owner_scope", with_(sql.BILLS, "SELECT user_id, id FROM bills WHERE CAST(user_id AS BIGINT) % 2 = 0"))
def owner_scope(spark, folder):
    owners = derive.users(spark, folder).filter("email_reminders")
    return ops.owner_scope(derive.bills(spark, folder), owners).select("user_id", "id")
