"""Date arithmetic and cover state as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.fixed import ENDING_DAYS, URGENT_RETURN_DAYS


def deadline(purchase: Column, amount: Column, unit: str) -> Column:
    """Purchase date plus months (clamped to the month's end) or days."""
    if unit == "months":
        return F.add_months(purchase, amount)
    return F.date_add(purchase, amount)


def local_date(instant: Column, zone: Column) -> Column:
    """Calendar date of an instant in a named zone."""
    return F.to_date(F.from_utc_timestamp(instant, zone))


def days_left(expires: Column, today: Column) -> Column:
    return F.datediff(expires, today)


def cover_status(expires: Column, today: Column) -> Column:
    left = days_left(expires, today)
    return (
        F.when(expires.isNull(), "unknown")
        .when(left < 0, "expired")
        .when(left <= ENDING_DAYS, "ending")
        .otherwise("active")
    )


def cover_label(expires: Column, today: Column) -> Column:
    left = days_left(expires, today)
    return (
        F.when(expires.isNull(), "No cover date")
        .when(left < 0, "Cover ended")
        .when(left == 0, "Ends today")
        .otherwise(F.concat(left, F.lit(" days left")))
    )


def cover_percent(purchase: Column, expires: Column, today: Column) -> Column:
    """Share of the cover that is left, between 0 and 100."""
    total = F.datediff(expires, purchase)
    share = days_left(expires, today) / total * 100
    return F.when(
        expires.isNotNull() & purchase.isNotNull() & (total > 0),
        F.greatest(F.lit(0.0), F.least(F.lit(100.0), share)),
    ).otherwise(F.lit(0.0))


def return_note(expires: Column, today: Column) -> Column:
    """Text shown for an open return window, null once it has passed."""
    left = days_left(expires, today)
    return F.when(left == 0, "Return deadline today").when(
        left > 0, F.concat(F.lit("Return by "), display_date(expires))
    )


def return_urgent(expires: Column, today: Column) -> Column:
    return days_left(expires, today).between(0, URGENT_RETURN_DAYS)


def display_date(value: Column) -> Column:
    return F.when(value.isNull(), "Not recorded").otherwise(F.date_format(value, "d MMM yyyy"))
