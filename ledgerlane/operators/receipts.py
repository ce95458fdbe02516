"""Receipt text mining over (document_id, text).

All label work happens inside the document's own row (see
``functions.labels`` and ``functions.reading``): a document is bounded by its
ten pages, so these operators neither shuffle nor collect anything across
documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlane.functions import arrow_rules as ar
from ledgerlane.functions import dates as dt
from ledgerlane.functions import evidence as ev
from ledgerlane.functions import labels as lb
from ledgerlane.functions.deadlines import deadline
from ledgerlane.functions.text import fold, fold_compact, let, trim_all

ID = "document_id"


def label_spans(docs: DataFrame) -> DataFrame:
    """One row per printed label: line, role, priority, start, end."""
    return (
        docs.select(ID, F.posexplode(lb.labels_of_lines(F.col("text"))).alias("line_no", "labels"))
        .select(ID, "line_no", F.explode("labels").alias("label"))
        .select(ID, "line_no", "label.*")
    )


def date_tokens(docs: DataFrame) -> DataFrame:
    """One row per date printed in a text."""
    return docs.select(ID, F.posexplode(dt.find_dates(F.col("text"))).alias("ord", "d")).select(ID, "ord", "d.token", "d.value")


def amount_cells(docs: DataFrame) -> DataFrame:
    """One row per money cell: role, raw text, priority, quote."""
    return docs.select(ID, F.posexplode(ar.amount_cells(F.col("text"))).alias("ord", "c")).select(ID, "ord", "c.*")


def totals(docs: DataFrame) -> DataFrame:
    """The agreed total of each document and whether tender rows confirm it."""
    return docs.select(ID, ar.totals(F.col("text")).alias("t")).select(ID, "t.*")


def verified_amounts(docs: DataFrame) -> DataFrame:
    """Check suggested (value, quote) amounts against each document."""
    verified = ar.verified_amounts(F.col("text"), F.col("value").cast("decimal(12,2)"), F.col("quote"))
    return docs.select(ID, verified.alias("verified"))


def recovered(docs: DataFrame) -> DataFrame:
    """Amount, sale date, maker and currency recovered from the text alone."""
    return docs.select(
        ID, ar.recovered_amounts(F.col("text")).alias("amount"), ar.recovered_brands(F.col("text")).alias("brand"),
        ev.currency_from_text(F.coalesce("text", F.lit(""))).alias("currency"))


def recovered_amounts(docs: DataFrame) -> DataFrame:
    return docs.select(ID, ar.recovered_amounts(F.col("text")).alias("r")).select(ID, "r.value", "r.quote")


def recovered_brands(docs: DataFrame) -> DataFrame:
    return docs.select(ID, ar.recovered_brands(F.col("text")).alias("r")).select(ID, "r.value", "r.quote")


def printed_currency(docs: DataFrame) -> DataFrame:
    return docs.withColumn("r", ev.currency_from_text(F.col("text"))).select(ID, "r.value", "r.quote")


def unlabelled_dates(docs: DataFrame) -> DataFrame:
    """The sale date of documents that label no date at all."""
    return docs.select(ID, ar.unlabelled_dates(F.col("text")).alias("value"))


def supported_roles(tokens: DataFrame) -> DataFrame:
    """Is each (role, token) of a document printed with that role's label?

    Input: document_id, text, claims array<struct<role,token>>.
    """
    claims = F.transform("claims", lambda c: F.struct(c["role"].alias("role"), c["token"].alias("token")))
    return tokens.select(ID, F.explode(ar.supported_roles(F.col("text"), claims)).alias("v")).select(ID, "v.*")


def party_checks(docs: DataFrame) -> DataFrame:
    """Retailer, maker and serial suggestions of each document.

    Input: document_id, text, retailer, brand, name, serial.
    """
    return docs.select(ID, ar.party_checks(*map(F.col, ("text", "retailer", "brand", "name", "serial"))).alias("v")).select(ID, "v.*")


# --- names in fragments ---------------------------------------------------
def name_parts(value: Column, quote: Column, parts: Column) -> Column:
    """Trimmed fragments if they make up ``value`` and stand in order in the
    quote, else null."""
    trimmed = F.transform(parts, trim_all)

    def check(p: Column) -> Column:
        joined = F.array_join(p, " ")
        sizes = (F.size(p).between(1, 6)) & F.forall(p, lambda x: F.coalesce(F.length(x).between(2, 160), F.lit(False)))
        same = (F.length(joined) <= 160) & (fold_compact(joined) == fold_compact(value))

        def ordered(source: Column) -> Column:
            def follow(cursor: Column, part: Column) -> Column:
                def place(token: Column) -> Column:
                    at = _locate(token, source, cursor)
                    return F.when((cursor > 0) & (at > 0), at + F.length(token)).otherwise(F.lit(0))

                return let(fold(part), place)

            return F.aggregate(p, F.lit(1), follow) > 0

        in_order = let(fold(quote), ordered)
        return F.when(sizes & same & ~quote.rlike(r"(?i)\[Page \d+\]") & in_order, p)

    return F.when(parts.isNotNull(), let(trimmed, check))


def _locate(token: Column, source: Column, start: Column) -> Column:
    """1-based place of ``token`` at or after ``start``; 0 if there is none."""
    rest = F.instr(F.substr(source, F.greatest(start, F.lit(1))), token)
    return F.when(rest > 0, rest + F.greatest(start, F.lit(1)) - 1).otherwise(F.lit(0))


# --- invoices -------------------------------------------------------------
def document_invoices(docs: DataFrame) -> DataFrame:
    return docs.select(ID, F.explode(ev.invoice_ids(F.col("text"))).alias("invoice_id"))


def invoice_scope(text: Column, pages: Column, selection: Column) -> Column:
    """The part of a document a suggestion may quote.

    One invoice id: the whole text.  Several: only a selection of distinct
    existing pages that hold exactly one id; otherwise ambiguous and empty.
    """
    chosen = F.filter(pages, lambda p: F.array_contains(selection, p["page"]))
    picked = F.array_join(F.transform(chosen, lambda p: p["text"]), "\n\n")
    sound = (
        selection.isNotNull()
        & F.size(selection).between(1, 10)
        & F.forall(selection, lambda n: F.coalesce(n.between(1, 10), F.lit(False)))
        & (F.size(F.array_distinct(selection)) == F.size(selection))
        & (F.size(chosen) == F.size(selection))
    )

    def build(b: Column) -> Column:
        valid = F.coalesce(b["sound"] & (F.size(ev.invoice_ids(b["picked"])) == 1), F.lit(False))
        numbers = F.transform(F.when(b["several"], chosen).otherwise(pages), lambda p: p["page"])
        return F.struct(
            F.when(~b["several"], text).when(valid, b["picked"]).otherwise(F.lit("")).alias("text"),
            F.when(~b["several"] | valid, numbers).otherwise(F.array().cast("array<int>")).alias("pages"),
            b["several"].alias("several"),
            (b["several"] & ~valid).alias("ambiguous"),
        )

    return let(
        F.struct(
            (F.size(ev.invoice_ids(text)) > 1).alias("several"),
            F.coalesce(picked, F.lit("")).alias("picked"),
            F.coalesce(sound, F.lit(False)).alias("sound"),
        ),
        build,
    )


# --- label-only reader ----------------------------------------------------
def label_values(docs: DataFrame) -> DataFrame:
    """Labelled values of each document, one row each."""
    return (
        docs.select(ID, F.posexplode(lb.label_values(F.col("text"))).alias("ord", "v")).select(ID, "ord", "v.*")
    )


def extract_by_labels(docs: DataFrame) -> DataFrame:
    """Bill fields of each document read from its labels."""
    return docs.select(ID, ar.label_fields(F.col("text")).alias("fields")).select(ID, *bill_columns(F.col("fields")))


def bill_columns(read: Column) -> list[Column]:
    """Columns of ``arrow_rules.label_fields``; a deadline that is not printed follows from the purchase date."""
    def expiry(field: str, amount: str, unit: str) -> Column:
        return F.coalesce(read[field], deadline(read["purchase_date"], read[amount], unit))

    dates = {
        "warranty_expires_at": expiry("warranty_expires_at", "warranty_months", "months"),
        "return_expires_at": expiry("return_expires_at", "return_window_days", "days"),
    }
    return [dates.get(c, read[c]).alias(c) for c in ar.BILL_FIELDS]
