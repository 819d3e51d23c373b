"""Month arithmetic on DATE columns. Months are keyed by their first day until
the panel is built, and by their last day from there on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from monthloom.functions.text import strip

_YEAR_MONTH = r"^(?!0000)\d{4}-(0?[1-9]|1[0-2])$"


def month_start(col: Column) -> Column:
    return F.trunc(col.cast("date"), "MM")


def month_end(col: Column) -> Column:
    return F.last_day(col)


def next_month_end(col: Column) -> Column:
    return F.last_day(F.add_months(col, 1))


def month_ordinal(col: Column) -> Column:
    return F.year(col) * 12 + F.month(col)


def month_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM")


def day_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def parse_month(col: Column) -> Column:
    """`YYYY-MM` text to the first day of the month; anything else is NULL.

    The pattern is checked first, so no cast in the branch can raise in ANSI mode.
    """
    text = strip(col)
    return F.when(
        text.rlike(_YEAR_MONTH),
        F.make_date(
            F.substring(text, 1, 4).cast("int"),
            F.regexp_extract(text, r"-(\d{1,2})$", 1).cast("int"),
            F.lit(1),
        ),
    )


def month_setting(text: str) -> Column:
    """A `YYYY-MM` setting as a month-end literal; a bad one raises when evaluated."""
    return F.last_day(F.to_date(F.lit(f"{text}-01"), "yyyy-MM-dd"))
