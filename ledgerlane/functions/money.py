"""Money text with Indian digit groups."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.fixed import CURRENCY_SYMBOLS


def format_money(amount: Column, currency: Column) -> Column:
    """Symbol (or code and a hard space), grouped whole part, two decimals."""
    text = amount.cast("decimal(12,2)").cast("string")
    whole = F.regexp_replace(F.substring_index(text, ".", 1), r"(\d)(?=(\d\d)+\d$)", "$1,")
    symbol = F.concat(currency, F.lit("\u00a0"))
    for code, mark in CURRENCY_SYMBOLS.items():
        symbol = F.when(currency == code, mark).otherwise(symbol)
    return F.when(amount.isNull(), "Amount not recorded").otherwise(
        F.concat(symbol, whole, F.lit("."), F.substring_index(text, ".", -1))
    )
