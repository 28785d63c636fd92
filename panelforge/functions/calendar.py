"""Frequencies: season lengths, steps and grids, all calendar-aware."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Frequency:
    code: str
    season: int
    step: str  # a Spark interval
    days: int
    lags: tuple[int, ...]
    min_length: int


#: The frequency profiles.
FREQUENCIES = {
    "D": Frequency("D", 7, "1 day", 1, (1, 7, 14, 28), 90),
    "W": Frequency("W", 52, "7 days", 7, (1, 2, 4, 8, 13, 26, 52), 52),
    "M": Frequency("M", 12, "1 month", 30, (1, 2, 3, 6, 12), 24),
    "Q": Frequency("Q", 4, "3 months", 91, (1, 2, 4), 8),
}


def frequency(code: str) -> Frequency:
    if code not in FREQUENCIES:
        raise ValueError(f"unknown frequency {code!r}; expected one of {sorted(FREQUENCIES)}")
    return FREQUENCIES[code]


def period_start(t: Column, code: str) -> Column:
    """The first day of the period that holds t."""
    unit = {"D": "day", "W": "week", "M": "month", "Q": "quarter"}[frequency(code).code]
    return F.date_trunc(unit, t).cast("date")


def shift(t: Column, periods: Column | int, code: str) -> Column:
    """t moved by whole periods; months and quarters by the calendar."""
    n = F.lit(periods) if isinstance(periods, int) else periods
    months = {"M": 1, "Q": 3}.get(code)
    if months:
        return F.add_months(t, (n * months).cast("int"))
    return F.date_add(t, (n * frequency(code).days).cast("int"))


def grid(start: Column, end: Column, code: str) -> Column:
    """Array of period starts from start to end."""
    return F.sequence(start, end, F.expr(f"interval {frequency(code).step}"))


def periods_between(start: Column, end: Column, code: str) -> Column:
    months = {"M": 1, "Q": 3}.get(code)
    if months:
        return F.floor(F.months_between(end, start) / months)
    return F.floor(F.datediff(end, start) / frequency(code).days)
