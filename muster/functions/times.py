"""Column expressions on wall-clock times.

All of them stay on ``timestamp_ntz`` arithmetic, so none depends on the session
time zone.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = timedelta(minutes=1)


def bucket(ts: Column, width: timedelta) -> Column:
    """Number of the ``width``-wide bucket that holds ``ts``.

    Counted from year 1, because division rounds toward zero and must not meet a
    negative time.
    """
    return F.call_function("div", ts - F.expr("TIMESTAMP_NTZ '0001-01-01 00:00:00'"), F.lit(width))


def whole_minutes(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``."""
    return F.call_function("div", end - start, F.lit(MINUTE))


def workday(ts: Column, cutoff: timedelta = timedelta(0)) -> Column:
    """Date a punch counts to; before ``cutoff`` it is still the day before.

    Without a cutoff it is a bare cast, which a filter on the day can see through
    on its way to the scan.
    """
    return (ts - F.lit(cutoff) if cutoff else ts).cast("date")


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def second_of_day(ts: Column) -> Column:
    return minute_of_day(ts) * 60 + F.second(ts)


def week_start(day: Column) -> Column:
    """Monday of the week of ``day``."""
    return F.date_sub(day, F.weekday(day))
