"""Operators over saved bills: validation, deadlines, cover, search, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlane import fixed
from ledgerlane.functions import deadlines as dl
from ledgerlane.functions.money import format_money
from ledgerlane.functions.text import trim_all


# --- validation -----------------------------------------------------------
def bill_errors(saving: bool = True) -> Column:
    """Codes of the broken rules, in rule order.

    ``saving`` adds what a stored bill needs beyond a draft.
    """
    c = F.col
    rules: list[tuple[str, Column]] = [
        (f"{n}_too_long", F.length(trim_all(c(n))) > limit) for n, limit in fixed.TEXT_LIMITS.items()
    ]
    rules += [
        ("category_unknown", c("category").isNotNull() & ~c("category").isin(fixed.CATEGORIES)),
        ("price_invalid", c("purchase_price").isNotNull()
         & ~c("purchase_price").cast("string").rlike(r"^\d{1,10}(\.\d{1,2})?$")),
        ("currency_invalid", ~F.coalesce(c("currency").rlike("^[A-Z]{3}$"), F.lit(False))),
        ("months_out_of_range", ~c("warranty_months").between(0, fixed.MAX_MONTHS)),
        ("return_days_out_of_range", ~c("return_window_days").between(0, fixed.MAX_RETURN_DAYS)),
        ("reminder_days_too_many", F.size("reminder_days") > fixed.MAX_REMINDERS),
        ("reminder_day_out_of_range",
         F.exists("reminder_days", lambda d: ~d.between(0, fixed.MAX_REMINDER_DAY))),
    ]
    if saving:
        rules += [
            ("name_empty", F.length(trim_all(F.coalesce(c("name"), F.lit("")))) == 0),
            ("warranty_before_purchase", c("warranty_expires_at") < c("purchase_date")),
            ("return_before_purchase", c("return_expires_at") < c("purchase_date")),
        ]
    return F.array_compact(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]))


def validate_bills(df: DataFrame, saving: bool = True) -> tuple[DataFrame, DataFrame]:
    """Split into accepted bills and rejected ones with their error codes."""
    checked = df.withColumn("errors", bill_errors(saving))
    return (
        checked.filter(F.size("errors") == 0).drop("errors"),
        checked.filter(F.size("errors") > 0),
    )


# --- deadlines ------------------------------------------------------------
def derive_deadlines(df: DataFrame) -> DataFrame:
    """Fill deadlines from durations."""
    return df.withColumn(
        "warranty_expires_at", dl.deadline(F.col("purchase_date"), F.col("warranty_months"), "months")
    ).withColumn("return_expires_at", dl.deadline(F.col("purchase_date"), F.col("return_window_days"), "days"))


def recompute_deadlines(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deadlines after an edit of durations or purchase dates.

    An edited duration always recalculates its deadline.  An edited purchase
    date does so only where the deadline was blank or itself calculated.
    """
    o, n = F.col, F.col
    joined = old.alias("o").join(new.alias("n"), ["user_id", "id"])

    def next_deadline(amount: str, expires: str, unit: str) -> Column:
        calculated = dl.deadline(o("o.purchase_date"), o(f"o.{amount}"), unit)
        amount_edited = ~n(f"n.{amount}").eqNullSafe(o(f"o.{amount}"))
        date_edited = ~n("n.purchase_date").eqNullSafe(o("o.purchase_date"))
        was_open = o(f"o.{expires}").isNull() | o(f"o.{expires}").eqNullSafe(calculated)
        return F.when(
            amount_edited | (date_edited & was_open),
            dl.deadline(n("n.purchase_date"), n(f"n.{amount}"), unit),
        ).otherwise(n(f"n.{expires}"))

    return joined.select(
        "user_id",
        "id",
        n("n.purchase_date").alias("purchase_date"),
        next_deadline("warranty_months", "warranty_expires_at", "months").alias("warranty_expires_at"),
        next_deadline("return_window_days", "return_expires_at", "days").alias("return_expires_at"),
    )


def deadline_provenance(df: DataFrame, edited: Column, quoted: Column) -> DataFrame:
    """Where each deadline shown on a form comes from.

    ``edited``: array of column names the user changed.  ``quoted``: map from
    column name to the printed quote.
    """
    def source(expires: str, amount: str, unit: str) -> Column:
        calculated = F.col(expires).isNotNull() & F.coalesce(
            F.col(expires) == dl.deadline(F.col("purchase_date"), F.col(amount), unit), F.lit(False)
        )
        touched = F.array_contains(edited, expires)
        quote = F.try_element_at(quoted, F.lit(expires))
        return (
            F.when(calculated & (quote.isNull() | touched), "Calculated from purchase date and duration")
            .when(touched, "Your correction")
            .when(quote.isNotNull(), quote)
        )

    return df.select(
        "user_id",
        "id",
        source("warranty_expires_at", "warranty_months", "months").alias("warranty_source"),
        source("return_expires_at", "return_window_days", "days").alias("return_source"),
    )


# --- cover and return state -----------------------------------------------
def warranty_state(df: DataFrame, today: Column) -> DataFrame:
    expires = F.col("warranty_expires_at")
    return df.withColumns(
        {
            "status": dl.cover_status(expires, today),
            "days_left": dl.days_left(expires, today),
            "label": dl.cover_label(expires, today),
            "percent": dl.cover_percent(F.col("purchase_date"), expires, today),
        }
    )


def return_state(df: DataFrame, today: Column) -> DataFrame:
    expires = F.col("return_expires_at")
    return df.withColumns(
        {
            "return_days": dl.days_left(expires, today),
            "return_note": dl.return_note(expires, today),
            "return_urgent": F.coalesce(dl.return_urgent(expires, today), F.lit(False)),
        }
    )


# --- search, filters, orders ----------------------------------------------
SEARCHED = ["name", "retailer", "brand", "category", "serial_number", "model_number", "barcode", "invoice_number"]


def search_bills(df: DataFrame, query: str) -> DataFrame:
    """Case-insensitive substring over the searched fields."""
    text = F.lower(F.concat_ws(" ", *[F.when(F.col(c) != "", F.col(c)) for c in SEARCHED]))
    return df.filter(F.contains(text, F.lower(trim_all(F.lit(query)))))


def filter_bills(df: DataFrame, today: Column, category: str | None = None, status: str | None = None) -> DataFrame:
    if category:
        df = df.filter(F.col("category") == category)
    if status:
        df = df.filter(dl.cover_status(F.col("warranty_expires_at"), today) == status)
    return df


def order_keys(mode: str, today: Column) -> list[Column]:
    """Sort keys of one of the list orders; the id is always the last key."""
    if mode == "name":
        return [F.col("name").asc(), F.col("id").asc()]
    if mode == "expiry":
        status = dl.cover_status(F.col("warranty_expires_at"), today)
        rank = F.when(status == "unknown", 2).when(status == "expired", 1).otherwise(0)
        return [rank.asc(), F.col("warranty_expires_at").asc_nulls_last(), F.col("name").asc(), F.col("id").asc()]
    return [F.col("created_at").desc(), F.col("id").asc()]


def sort_bills(df: DataFrame, mode: str, today: Column) -> DataFrame:
    """All bills in list order, account by account.

    A range-partitioned sort: a very large account is spread over many tasks.
    """
    return df.orderBy(F.col("user_id"), *order_keys(mode, today))


def recent_bills(df: DataFrame, k: int = 4) -> DataFrame:
    """Newest ``k`` bills of each account, with their position."""
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").asc())
    return df.withColumn("position", F.row_number().over(newest)).filter(F.col("position") <= k)


def upcoming_deadlines(df: DataFrame, today: Column, k: int = 5) -> DataFrame:
    """Earliest ``k`` open deadlines of each account."""
    rows = df.select(
        "user_id",
        "id",
        "name",
        F.explode(
            F.array(
                F.struct(F.lit("Warranty").alias("type"), F.col("warranty_expires_at").alias("date")),
                F.struct(F.lit("Return").alias("type"), F.col("return_expires_at").alias("date")),
            )
        ).alias("deadline"),
    ).select("user_id", "id", "name", "deadline.*")
    first = Window.partitionBy("user_id").orderBy("date", "id", "type")
    return (
        rows.filter(F.col("date") >= today)
        .withColumn("position", F.row_number().over(first))
        .filter(F.col("position") <= k)
    )


# --- totals ---------------------------------------------------------------
def totals_by_currency(df: DataFrame) -> DataFrame:
    """Exact sum of the known prices of each account and currency."""
    return (
        df.filter(F.col("purchase_price").isNotNull())
        .groupBy("user_id", "currency")
        .agg(F.sum("purchase_price").alias("total"), F.count("*").alias("priced_bills"))
    )


def vault_stats(df: DataFrame, today: Column) -> DataFrame:
    status = dl.cover_status(F.col("warranty_expires_at"), today)
    return df.groupBy("user_id").agg(
        F.count("*").alias("saved"),
        F.count_if(status == "active").alias("active"),
        F.count_if(status == "ending").alias("ending"),
    )


def status_facets(df: DataFrame, today: Column, query: str = "", category: str | None = None) -> DataFrame:
    """Counts per cover state after search and category, before status."""
    matching = filter_bills(search_bills(df, query) if query else df, today, category)
    status = dl.cover_status(F.col("warranty_expires_at"), today)
    return matching.groupBy("user_id").agg(
        F.count("*").alias("all_bills"),
        *[F.count_if(status == s).alias(s) for s in ("active", "ending", "expired", "unknown")],
    )


# --- letters, assistant facts ---------------------------------------------
def support_drafts(df: DataFrame, issue: Column) -> DataFrame:
    """Letter text holding only recorded facts."""
    def line(label: str, value: Column, present: Column) -> Column:
        return F.when(present, F.concat(F.lit(label + ": "), value))

    def text(name: str) -> tuple[Column, Column]:
        return F.col(name), F.col(name).isNotNull() & (F.col(name) != "")

    facts = F.concat_ws(
        "\n",
        line("Item", F.col("name"), F.lit(True)),
        line("Retailer", *text("retailer")),
        line("Invoice", *text("invoice_number")),
        line("Serial number", *text("serial_number")),
        line("Model", *text("model_number")),
        line("Purchased", dl.display_date(F.col("purchase_date")), F.col("purchase_date").isNotNull()),
        line("Amount paid", format_money(F.col("purchase_price"), F.col("currency")), F.col("purchase_price").isNotNull()),
        line("Recorded warranty end", dl.display_date(F.col("warranty_expires_at")), F.col("warranty_expires_at").isNotNull()),
    )
    letter = F.concat(
        F.lit("Subject: Support request - "), F.col("name"),
        F.lit("\n\nHello,\n\nI am requesting assistance with the following item.\n\n"), facts,
        F.lit("\n\nIssue:\n"), trim_all(issue),
        F.lit("\n\nPlease confirm the available support options and next steps. "
              "I can provide the purchase document if required.\n\nThank you."),
    )
    return df.select("user_id", "id", letter.alias("letter"))


#: fields an assistant may see, in the order they are written
FACTS = [
    ("id", "id"), ("name", "name"), ("retailer", "retailer"), ("brand", "brand"),
    ("invoiceNumber", "invoice_number"), ("serialNumber", "serial_number"), ("modelNumber", "model_number"),
    ("barcode", "barcode"), ("category", "category"), ("purchasePrice", "purchase_price"),
    ("currency", "currency"), ("purchaseDate", "purchase_date"), ("warrantyMonths", "warranty_months"),
    ("warrantyExpiresAt", "warranty_expires_at"), ("returnWindowDays", "return_window_days"),
    ("returnExpiresAt", "return_expires_at"),
]


def assistant_facts(df: DataFrame, bills: int | None = None, chars: int | None = None) -> DataFrame:
    """Bills of each account, newest first, as one JSON list of the allowed fields.

    With ``bills``, only the newest so many: at most one row more per account
    reaches the aggregation and shows that the list was cut.  With ``chars``,
    a longer list is marked ``too_long``.
    """
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").asc())
    values = {
        "purchase_price": F.col("purchase_price").cast("string"),
        "purchase_date": F.col("purchase_date").cast("string"),
        "warranty_expires_at": F.col("warranty_expires_at").cast("string"),
        "return_expires_at": F.col("return_expires_at").cast("string"),
    }
    fact = F.struct(*[values.get(c, F.col(c)).alias(n) for n, c in FACTS])
    kept = F.lit(True) if bills is None else F.col("position") <= bills
    ranked = df.withColumn("position", F.row_number().over(newest))
    rows = F.array_sort(F.collect_list(F.when(kept, F.struct("position", fact.alias("fact")))))
    return (
        (ranked if bills is None else ranked.filter(F.col("position") <= bills + 1))
        .groupBy("user_id")
        .agg(rows.alias("rows"), F.count_if(kept).alias("bills"), F.bool_or(~kept).alias("truncated"))
        .select(
            "user_id", "bills", "truncated",
            F.to_json(F.transform("rows", lambda r: r["fact"]), {"ignoreNullFields": "false"}).alias("facts"),
        )
        .withColumn("too_long", F.lit(False) if chars is None else F.length("facts") > chars)
    )


def check_citations(answers: DataFrame, bills: DataFrame) -> DataFrame:
    """Sources of each answer; an answer citing an unsupplied bill is rejected.

    ``answers``: user_id, answer_id, bill_ids.  ``bills``: user_id, id, name,
    position.
    """
    cited = answers.select(
        "user_id", "answer_id", F.explode_outer(F.array_distinct("bill_ids")).alias("id")
    )
    matched = cited.join(bills.select("user_id", "id", "name", "position"), ["user_id", "id"], "left")
    return (
        matched.groupBy("user_id", "answer_id")
        .agg(
            F.count_if(F.col("id").isNotNull() & F.col("position").isNull()).alias("unknown"),
            F.array_sort(
                F.collect_list(F.when(F.col("position").isNotNull(), F.struct("position", "id", "name")))
            ).alias("sources"),
        )
        .select(
            "user_id",
            "answer_id",
            (F.col("unknown") == 0).alias("accepted"),
            F.when(F.col("unknown") == 0, F.transform("sources", lambda s: s["id"])).alias("sources"),
        )
    )


def check_conversations(turns: DataFrame) -> DataFrame:
    """Which chat requests keep the message rules, from (conv_id, turn, role, text)."""
    size = F.length(trim_all(F.col("text")))
    return turns.groupBy("conv_id").agg(
        F.count("*").alias("messages"),
        F.sum(size).alias("chars"),
        (
            F.count("*").between(1, 10)
            & F.bool_and(F.col("role").isin("user", "assistant"))
            & F.bool_and(size.between(1, 4000))
            & (F.sum(size) <= 20_000)
            & (F.max_by("role", F.col("turn")) == "user")
        ).alias("valid"),
    )


# --- bills with their documents -------------------------------------------
def bill_detail(bills: DataFrame, documents: DataFrame) -> DataFrame:
    """Each bill with the files linked to it."""
    files = (
        documents.filter(F.col("item_id").isNotNull())
        .groupBy("user_id", "item_id")
        .agg(
            F.array_sort(
                F.collect_list(F.struct(F.col("id"), F.col("original_filename").alias("filename"), "content_type", "ocr_status"))
            ).alias("files")
        )
        .withColumnRenamed("item_id", "id")
    )
    return bills.join(files, ["user_id", "id"], "left")


def draft_status(documents: DataFrame) -> DataFrame:
    """Readable state of every document not yet saved as a bill."""
    s = F.col("ocr_status")
    return documents.filter(F.col("item_id").isNull()).select(
        "user_id",
        "id",
        "original_filename",
        F.when(s == "pending", "Upload incomplete")
        .when(s == "failed", "Reading incomplete")
        .when(s == "processing", "Reading in background")
        .otherwise("Ready to review")
        .alias("state"),
    )


def recent_drafts(documents: DataFrame, k: int = 30) -> DataFrame:
    newest = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").asc())
    return (
        documents.filter(F.col("item_id").isNull())
        .withColumn("position", F.row_number().over(newest))
        .filter(F.col("position") <= k)
    )


def page_progress(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """Complete pages of each document against its page count."""
    done = pages.groupBy("user_id", "document_id").agg(
        F.count("*").alias("read_pages"), F.count_if(F.col("status") == "complete").alias("complete_pages")
    )
    return (
        documents.select("user_id", F.col("id").alias("document_id"), "page_count")
        .join(done, ["user_id", "document_id"], "left")
        .select(
            "user_id",
            "document_id",
            "page_count",
            F.coalesce("complete_pages", F.lit(0)).alias("complete_pages"),
            F.coalesce((F.col("read_pages") == F.col("page_count")) & (F.col("complete_pages") == F.col("page_count")), F.lit(False)).alias("finished"),
        )
    )


def owner_scope(df: DataFrame, users: DataFrame) -> DataFrame:
    """Rows whose owner exists, and nothing else."""
    return df.join(users.select(F.col("id").alias("user_id")), "user_id", "left_semi")
