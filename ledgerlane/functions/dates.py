"""Printed dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlane.fixed import DATE_TOKEN, MONTHS
from ledgerlane.functions.text import bare_rx, let, trim_all

# Month names that may be printed: full, three letters, or one letter.
_NAMES: dict[str, int] = {}
for _number, _name in enumerate(MONTHS, start=1):
    _NAMES.setdefault(_name[0], _number)
    _NAMES[_name[:3]] = _number
    _NAMES[_name] = _number

_SHORT = r"(?:[a-z]{3}|[a-z])"


def _month(name: Column) -> Column:
    """Number of a month name, as text; null when it is none."""
    pairs = [F.lit(v) for item in _NAMES.items() for v in (item[0], str(item[1]))]
    return F.try_element_at(F.create_map(*pairs), F.lower(name))


def _date(year: Column, month: Column, day: Column) -> Column:
    value = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0")).try_cast("date")
    return F.when(month.isNotNull() & F.year(value).between(1900, 2200), value)


def _century(year: Column) -> Column:
    """Two printed digits stand for 1950 to 2049."""
    number = year.cast("int")
    return F.when(number >= 50, number + 1900).otherwise(number + 2000).cast("string")


def parse_receipt_date(value: Column) -> Column:
    """Date of one printed token, day first; null if it is not a real day.

    The accepted shapes are tried in order: year first, day first with a
    four-digit year, day and month name, month name first, two-digit years,
    and month first with slashes as the last resort.
    """
    clean = F.regexp_replace(trim_all(value), r"(?i)(\d)(?:st|nd|rd|th)(?![A-Za-z0-9_])", "$1")

    def read(c: Column) -> Column:
        def shape(pattern: str, order: str, named: bool = False, short_year: bool = False) -> Column:
            full = rf"(?i)\A{pattern}\z"
            part = {k: F.regexp_extract(c, full, i) for i, k in enumerate(order, start=1)}
            month = _month(part["m"]) if named else part["m"]
            year = _century(part["y"]) if short_year else part["y"]
            return F.when(c.rlike(full), _date(year, month, part["d"]))

        return F.coalesce(
            *[shape(rf"(\d{{1,4}}){s}(\d{{1,2}}){s}(\d{{1,2}})", "ymd") for s in ("-", "/", r"\.")],
            *[shape(rf"(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{1,4}})", "dmy") for s in ("/", "-", r"\.")],
            shape(r"(\d{1,2}) ([a-z]+) (\d{1,4})", "dmy", named=True),
            shape(rf"(\d{{1,2}})-({_SHORT})-(\d{{1,4}})", "dmy", named=True),
            shape(rf"(\d{{1,2}})/({_SHORT})/(\d{{1,4}})", "dmy", named=True),
            shape(r"([a-z]+) (\d{1,2}), (\d{1,4})", "mdy", named=True),
            shape(rf"({_SHORT}) (\d{{1,2}}) (\d{{1,4}})", "mdy", named=True),
            *[shape(rf"(\d{{1,2}}){s}(\d{{1,2}}){s}(\d{{1,2}})", "dmy", short_year=True) for s in ("/", "-", r"\.")],
            shape(rf"(\d{{1,2}})-({_SHORT})-(\d{{1,2}})", "dmy", named=True, short_year=True),
            shape(rf"(\d{{1,2}}) ({_SHORT}) (\d{{1,2}})", "dmy", named=True, short_year=True),
            shape(r"(\d{1,2})/(\d{1,2})/(\d{1,4})", "mdy"),
        )

    return let(clean, read)


def find_dates(text: Column) -> Column:
    """Date tokens that stand alone in ``text``, in order, with their values."""
    pattern = bare_rx(DATE_TOKEN)
    found = F.transform(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)),
        lambda t: F.struct(t.alias("token"), parse_receipt_date(t).alias("value")),
    )
    return F.filter(found, lambda d: d["value"].isNotNull())


def date_values(dates: Column) -> Column:
    """Distinct values of found dates."""
    return F.array_distinct(F.transform(dates, lambda d: d["value"]))
