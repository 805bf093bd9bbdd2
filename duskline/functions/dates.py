"""Calendar expressions. A period is a DATE on the first of its month."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

PERIOD_TEXT = "ddMMMyyyy"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def month_start(c: Column | str) -> Column:
    return F.trunc(_col(c), "month")


def parse_period(c: Column | str) -> Column:
    """``01JAN2018`` as a date; null where the text is no such date."""
    return F.try_to_timestamp(_col(c), F.lit(PERIOD_TEXT)).cast("date")


def format_period(c: Column | str) -> Column:
    return F.upper(F.date_format(_col(c), PERIOD_TEXT))


def previous_month(c: Column | str) -> Column:
    return F.add_months(_col(c), -1)


def anchor_month(event: Column | str, gap: int = 3) -> Column:
    """Last month whose figures are known when an event ``gap`` months later is forecast."""
    return F.add_months(_col(event), -gap)


def known_year(event: Column | str, cutoff: int = 7) -> Column:
    """Latest year with published annual accounts, seen from the event month.

    Accounts of the previous year are out from month ``cutoff`` on; before that only
    those of the year before it.
    """
    e = _col(event)
    return F.year(e) - F.when(F.month(e) < cutoff, 2).otherwise(1)


def compose_period(year: Column | str, month: Column | int) -> Column:
    m = F.lit(month) if isinstance(month, int) else month
    return F.make_date(_col(year), m, F.lit(1))


def lag_months(event: Column | str, period: Column | str, gap: int = 3) -> Column:
    """1 for the anchor month, 2 for the month before, and so on."""
    e, p = _col(event), _col(period)
    months = (F.year(e) - F.year(p)) * 12 + F.month(e) - F.month(p)
    return months - gap + 1
