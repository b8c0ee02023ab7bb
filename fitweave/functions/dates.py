"""Partial CV dates to ISO dates (F11) and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fitweave import vocab
from fitweave.functions import text as T

DAYS_PER_YEAR = 365.25


def _month_number(name: Column) -> Column:
    return F.try_element_at(T.number_map(vocab.MONTHS), name)


def cv_date(value: Column, *, end_of_month: bool = False) -> Column:
    """ISO date text from full, month-year, year-month or named-month input; else NULL."""
    # month-year is turned into year-month, so that one pattern reads both
    month_first = r"^(0?[1-9]|1[0-2])[\s./-]+(\d{4})$"
    ordered = F.regexp_replace(T.strip(F.coalesce(value, F.lit(""))), month_first, "$2-$1")

    def read(text: Column) -> Column:
        def month_day(year: Column, month: Column) -> Column:
            first = F.make_date(year.try_cast("int"), month, F.lit(1))
            return F.last_day(first) if end_of_month else first

        numeric, named = r"^(\d{4})-(0?[1-9]|1[0-2])$", r"^([A-Za-zÄÖÜäöüß]+)\.?\s+(\d{4})$"
        return (
            F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
            .when(
                text.rlike(r"^\d"),
                month_day(T.capture(text, numeric), T.capture(text, numeric, 2).try_cast("int")),
            )
            .when(
                text != "",
                month_day(T.capture(text, named, 2), _month_number(F.lower(T.capture(text, named)))),
            )
            .cast("string")
        )

    return T.let(ordered, read)


def years_between(start: Column, end: Column, as_of: Column) -> Column:
    return F.datediff(F.coalesce(end.cast("date"), as_of), start.cast("date")) / DAYS_PER_YEAR
