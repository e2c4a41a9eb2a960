"""Dates of mixed precision ("2015", "2015-05", "2015-05-10"), kept as text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from trialspark.functions.text import strip


def _parts(date: Column) -> Column:
    return F.split(date, "-", -1)


def _number(part: Column) -> Column:
    return part.try_cast("int")


def ct_month(date: Column) -> Column:
    """Month, or null when the text has none or the text is not a date."""
    month = _number(F.get(_parts(date), 1))
    return F.when(month.between(1, 12) & _number(F.get(_parts(date), 0)).isNotNull(), month)


def ct_year(date: Column) -> Column:
    """Year, or null when the text is not a date.

    The day is never looked at. A second part that is not a month 1..12 makes
    the whole text unusable; any integer year is accepted.
    """
    month = _number(F.get(_parts(date), 1))
    usable = (F.size(_parts(date)) < 2) | F.coalesce(month.between(1, 12), F.lit(False))
    return F.when(usable, _number(F.get(_parts(date), 0)))


def ct_precision(date: Column) -> Column:
    """``year``, ``month`` or ``day`` by the number of parts; null for blank text."""
    parts = F.size(_parts(date))
    return F.when(
        F.length(strip(date)) > 0,
        F.when(parts == 1, "year").when(parts == 2, "month").otherwise("day"),
    )


def is_future(year: Column, current_year: int) -> Column:
    """Strictly after the given current year."""
    return year > F.lit(current_year)


def month_index(date: Column) -> Column:
    """Months since year zero; a year alone counts as its January."""
    return ct_year(date) * 12 + F.coalesce(ct_month(date), F.lit(1))


def duration_months(start: Column, end: Column) -> Column:
    """Whole months from start to end; null when either is unusable or the end is earlier."""
    months = month_index(end) - month_index(start)
    return F.when(months >= 0, months)


def bin_index(value: Column, bins: Sequence[tuple]) -> Column:
    """Position of the first half-open bin ``[lo, hi)`` holding ``value``, else null.

    A bin without an upper edge is open; one without a lower edge starts at 0.
    """
    index = F.lit(None).cast("int")
    for position in reversed(range(len(bins))):
        low, high = bins[position][0] or 0, bins[position][1]
        inside = value >= low
        if high is not None:
            inside = inside & (value < high)
        index = F.when(inside, F.lit(position)).otherwise(index)
    return index


def bin_label(low: int | None, high: int | None) -> str:
    """Label of a caller-supplied bin."""
    return f"{low or 0}+ mo" if high is None else f"{low or 0}–{high} mo"
