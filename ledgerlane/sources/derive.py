"""Domain tables derived from the supplied star-schema tables.

Every row of the supplied tables takes part; nothing is sampled.  The rules
are plain functions of the columns, so the same tables can be written in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlane.fixed import CATEGORIES
from ledgerlane.functions.deadlines import deadline
from ledgerlane.operators.reminders import schedule
from ledgerlane.session import spread
from ledgerlane.sources.tables import read_star

AS_OF = "1999-01-01 00:00:00"
#: the instant the derived reminders were scheduled at
SCHEDULED_AT = "1996-01-01 00:00:00"

ZONES = ["Asia/Kolkata", "America/New_York", "Europe/Paris", "Europe/London", "Asia/Jakarta"]
CURRENCIES = ["INR", "USD", "EUR", "GBP", "IDR"]


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def as_of(text: str = AS_OF) -> Column:
    return F.lit(text).cast("timestamp")


def _regions(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_star(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey")
    nation = read_star(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    return customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))


def users(spark: SparkSession, folder: str) -> DataFrame:
    """Accounts.  Reminder hours stay between 6 and 23, off the hour that a
    clock change repeats."""
    c = F.col("c_custkey")
    return _regions(spark, folder).select(
        c.cast("string").alias("id"),
        F.concat(F.lower(F.replace("c_name", F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        (c % 2 == 0).alias("email_reminders"),
        _pick(ZONES, F.col("n_regionkey")).alias("timezone"),
        (c % 18 + 6).cast("int").alias("reminder_hour"),
        F.when(c % 4 == 0, "sent").when(c % 4 == 1, "failed").otherwise("pending").alias("welcome_status"),
        (c % 7).cast("int").alias("welcome_attempts"),
        F.when(c % 3 == 0, as_of() + F.expr("interval 60 seconds"))
        .when(c % 3 == 1, as_of() - F.expr("interval 60 seconds"))
        .alias("welcome_lease_until"),
        F.date_add(F.lit("1994-01-01").cast("date"), (c % 365).cast("int")).cast("timestamp").alias("created_at"),
    )


def line_items(spark: SparkSession, folder: str) -> DataFrame:
    """One row per (order, line): the smallest row wins.

    Rows are dealt by order, so that a join with orders moves them no more."""
    # what orders rows ahead of the last column that is kept; the line status behind it changes nothing
    rest = ["l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax", "l_shipdate", "l_returnflag"]
    return (
        read_star(spark, folder, "lineitem")
        .select("l_orderkey", "l_linenumber", *rest)
        .repartition("l_orderkey")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.min(F.struct(*rest)).alias("r"))
        .select("l_orderkey", "l_linenumber", "r.l_partkey", "r.l_suppkey", "r.l_extendedprice", "r.l_returnflag")
    )


def bills(spark: SparkSession, folder: str) -> DataFrame:
    """Saved bills, one per order line.

    Lines are shuffled by order, then while they are still narrow by supplier,
    then by part; the region goes with the orders, of which there are fewer.
    """
    orders = read_star(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    part = read_star(spark, folder, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    supplier = read_star(spark, folder, "supplier").select("s_suppkey", "s_name")
    region = _regions(spark, folder).select("c_custkey", "n_regionkey")
    o, ln = F.col("l_orderkey"), F.col("l_linenumber")
    purchase = F.to_date("o_orderdate")
    months = F.when(F.col("p_size") % 7 != 0, F.col("p_size")).cast("int")
    days = F.when(F.col("l_returnflag") == "R", 30).when(F.col("l_returnflag") == "A", 7).cast("int")
    return (
        line_items(spark, folder)
        .join(orders.join(region, F.col("o_custkey") == F.col("c_custkey")), o == F.col("o_orderkey"))
        .join(supplier, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            F.concat_ws("-", o, ln).alias("id"),
            F.col("o_custkey").cast("string").alias("user_id"),
            F.col("p_name").alias("name"),
            F.col("p_brand").alias("brand"),
            F.col("s_name").alias("retailer"),
            F.concat(F.lit("INV-"), F.lpad(o.cast("string"), 8, "0")).alias("invoice_number"),
            F.concat(F.lit("MD-"), F.col("l_partkey")).alias("model_number"),
            F.lpad(F.col("l_partkey").cast("string"), 12, "0").alias("barcode"),
            F.when(F.col("l_suppkey") % 5 != 0, F.concat(F.lit("SN"), F.lpad(o.cast("string"), 8, "0"), ln))
            .alias("serial_number"),
            _pick(CATEGORIES, F.col("l_partkey") % 6).alias("category"),
            purchase.alias("purchase_date"),
            deadline(purchase, months, "months").alias("warranty_expires_at"),
            months.alias("warranty_months"),
            days.alias("return_window_days"),
            deadline(purchase, days, "days").alias("return_expires_at"),
            F.array(F.lit(30), F.lit(7), F.lit(1)).alias("reminder_days"),
            F.when((o + ln) % 11 != 0, F.col("l_extendedprice").cast("decimal(12,2)")).alias("purchase_price"),
            _pick(CURRENCIES, F.col("n_regionkey")).alias("currency"),
            F.lit(None).cast("string").alias("notes"),
            F.col("o_orderdate").cast("timestamp").alias("created_at"),
            F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        )
    )


def order_of(item: Column) -> Column:
    """Order key inside a derived item id."""
    return F.split(item, "-")[0].cast("long")


def reminders(spark: SparkSession, folder: str, scheduled_at: str = SCHEDULED_AT) -> DataFrame:
    """Scheduled notices over all bills, with some already sent, cancelled,
    snoozed, started or leased."""
    rows = schedule(bills(spark, folder), users(spark, folder), as_of(scheduled_at))
    o = order_of(F.col("item_id"))
    email = F.col("channel") == "email"
    sent = email & (o % 13 == 0)
    started = email & (o % 5 == 0)
    return rows.select(
        F.concat_ws("/", "item_id", "deadline_type", F.unix_seconds("remind_at"), "channel").alias("id"),
        "user_id",
        "item_id",
        "remind_at",
        "channel",
        "deadline_type",
        F.when(sent, "sent").when(o % 17 == 0, "cancelled").otherwise("scheduled").alias("status"),
        F.when(sent, F.col("remind_at")).alias("sent_at"),
        F.when(o % 7 == 0, F.col("remind_at") + F.expr("interval 72 hours")).alias("snoozed_until"),
        F.when(sent | started, F.col("remind_at")).alias("delivery_started_at"),
        F.when(started & (o % 10 == 0), as_of() + F.expr("interval 60 seconds"))
        .when(started, as_of() - F.expr("interval 60 seconds"))
        .alias("delivery_lease_until"),
        F.when(started, (o % 6).cast("int")).otherwise(0).alias("delivery_attempts"),
    )


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """One original per bill; every third one is still a draft."""
    o = order_of(F.col("b.id"))
    draft = o % 3 == 0
    return bills(spark, folder).alias("b").select(
        F.col("b.id").alias("id"),
        "user_id",
        F.when(~draft, F.col("b.id")).alias("item_id"),
        F.concat(F.col("b.invoice_number"), F.when(o % 2 == 0, ".pdf").otherwise(".jpg")).alias("original_filename"),
        F.when(o % 2 == 0, "application/pdf").otherwise("image/jpeg").alias("content_type"),
        (o * 37 + 1000).cast("decimal(14,0)").alias("byte_size"),
        F.when(~draft, "complete")
        .otherwise(_pick(["pending", "processing", "review", "failed"], o % 4))
        .alias("ocr_status"),
        (o % 4 + 1).cast("int").alias("page_count"),
        F.lit(None).cast("map<string,string>").alias("draft_fields"),
        F.lit(0).alias("draft_revision"),
        F.lit(None).cast("string").alias("extracted_data"),
        F.concat(F.lit("users/"), F.col("user_id"), F.lit("/documents/"), F.col("b.id")).alias("storage_key"),
        "created_at",
        "updated_at",
    )


def document_pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages of every original.  The last page is unfinished on some."""
    o = order_of(F.col("id"))
    return (
        documents(spark, folder)
        .select("user_id", "id", "page_count", "updated_at", F.explode(F.sequence(F.lit(0), F.col("page_count") - 1)).alias("page_index"))
        .select(
            "user_id",
            F.col("id").alias("document_id"),
            "page_index",
            F.concat(F.lit("page "), F.col("page_index") + 1, F.lit(" of "), F.col("id")).alias("text"),
            ((o % 100) / 100).cast("decimal(5,4)").alias("confidence"),
            F.when((o % 4 == 3) & (F.col("page_index") == F.col("page_count") - 1), "processing")
            .otherwise("complete")
            .alias("status"),
            F.lit(1).alias("attempts"),
            "updated_at",
        )
    )


def document_jobs(spark: SparkSession, folder: str) -> DataFrame:
    """One job per original, at every state and age around ``AS_OF``."""
    o = order_of(F.col("id"))
    return documents(spark, folder).select(
        F.col("id").alias("document_id"),
        "user_id",
        (o % 4 + 1).cast("int").alias("generation"),
        _pick(["queued", "reading", "extracting", "complete", "failed"], o % 5).alias("status"),
        (o % 3).cast("int").alias("completed_pages"),
        F.when(o % 3 != 0, F.timestamp_add("MINUTE", -(o % 23).cast("int"), as_of())).alias("dispatched_at"),
        F.timestamp_add("SECOND", -(o % 2000).cast("int"), as_of()).alias("updated_at"),
    )


def domain_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All six derived tables by name."""
    return {
        "users": users(spark, folder),
        "bills": bills(spark, folder),
        "documents": documents(spark, folder),
        "document_pages": document_pages(spark, folder),
        "reminders": reminders(spark, folder),
        "document_jobs": document_jobs(spark, folder),
    }


# --- receipts -------------------------------------------------------------
def _grouped(amount: Column, style: Column) -> Column:
    """Amount text: plain, with commas, or with dots and a decimal comma."""
    commas = F.format_number(amount, 2)
    return (
        F.when(style == "commas", commas)
        .when(style == "dots", F.translate(commas, ",.", ".,"))
        .otherwise(amount.cast("string"))
    )


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    """Receipt text printed from every bill, with known damage.

    By order key: 0 mod 7 conflicting totals, 1 mod 7 cash below the total,
    2 mod 7 cash and change, 3 mod 7 digit groups, 4 mod 7 dots and a decimal
    comma, 5 mod 7 an earlier lower total, 6 mod 7 the amount on the next
    line; 3 mod 11 a second invoice id; 4 mod 5 an unreadable date, 3 mod 5 a
    date without a label; 4 mod 9 the maker on the next line, 5 mod 9 two
    makers.
    """
    printed = spread(bills(spark, folder), "id")
    c, o = F.col, order_of(F.col("id"))
    brand = F.replace(c("brand"), F.lit("Brand#"), F.lit("House "))
    price = c("purchase_price")
    style = F.when(o % 7 == 3, "commas").when(o % 7 == 4, "dots").otherwise("plain")

    def money(amount: Column) -> Column:
        return F.concat(c("currency"), F.lit(" "), _grouped(amount.cast("decimal(12,2)"), style))

    def date(pattern: str, shift: int = 0) -> Column:
        return F.date_format(F.date_add(c("purchase_date"), shift), pattern)

    when = (
        F.when(o % 5 == 0, F.concat(F.lit("Invoice date: "), date("dd/MM/yyyy"), F.lit(" Delivery date: "), date("dd/MM/yyyy", 4)))
        .when(o % 5 == 1, F.concat(F.lit("Date: "), date("d-MMM-yyyy")))
        .when(o % 5 == 2, F.concat(F.lit("Order date: "), date("yyyy-MM-dd", -2), F.lit("\nPurchase date: "), date("yyyy-MM-dd")))
        .when(o % 5 == 3, F.concat(F.lit("0009 002 "), date("dd/MM/yyyy"), F.lit(" 16:29:12")))
        .otherwise("Date: unreadable")
    )
    maker = (
        F.when(o % 9 == 4, F.concat(F.lit("Brand:\n"), brand))
        .when(o % 9 == 5, F.concat(F.lit("Brand: "), brand, F.lit("\nBrand: Other House")))
        .otherwise(F.concat(F.lit("Brand: "), brand))
    )
    total = F.concat(F.lit("Grand Total: "), money(price))
    sums = F.when(
        price.isNotNull(),
        F.when(o % 7 == 0, F.concat(total, F.lit("\nGrand Total: "), money(price + 1)))
        .when(o % 7 == 1, F.concat(total, F.lit("\nCash: "), money(price - 1)))
        .when(o % 7 == 2, F.concat(total, F.lit("\nCash: "), money(price + 100), F.lit("\nChange: "), money(F.lit(100))))
        .when(o % 7 == 5, F.concat(F.lit("Total: "), money(price - 10), F.lit("\n"), total))
        .when(o % 7 == 6, F.concat(F.lit("Grand Total:\n"), money(price)))
        .otherwise(total),
    )
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Seller: "), c("retailer"), F.lit(" Buyer: Customer "), c("user_id")),
        F.concat(F.lit("Invoice No: "), c("invoice_number"), F.lit(" Order No: ORDER-"), F.lpad(o.cast("string"), 8, "0")),
        when,
        F.concat(F.lit("Product name: "), c("name"), F.lit(" Model: "), c("model_number")),
        maker,
        F.concat_ws(" ", F.concat(F.lit("Serial number: "), c("serial_number")), F.concat(F.lit("Barcode: "), c("barcode"))),
        F.lit("Subtotal: 1.00"),
        sums,
        F.concat(F.lit("Warranty: "), c("warranty_months"), F.lit(" months")),
        F.concat(F.lit("Return window: "), c("return_window_days"), F.lit(" days")),
        F.when(o % 11 == 3, F.lit("Invoice No: SERVICE000123")),
    )
    return printed.select(
        c("id").alias("document_id"), "user_id", text.alias("text"), o.alias("o"), "name", brand.alias("brand"),
        "retailer", "invoice_number", "model_number", "serial_number", "barcode", "purchase_price", "currency",
        "purchase_date", "warranty_months", "return_window_days",
    )
