"""Expected days without a punch."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.cleaning import with_day
from muster.operators.daily import streaks

WEEKEND = (5, 6)  # Monday is 0


def absences(punches: DataFrame, roster: DataFrame, calendar: DataFrame) -> DataFrame:
    """Person-days of roster and calendar without a punch.

    The calendar is held once as an array of days (one per date, so bounded) and
    each person's attended days are taken out of it. Only true absences become
    rows: roster times calendar is never built.
    """
    expected = calendar.agg(F.collect_set("day").alias("days")).scalar()
    attended = (
        with_day(punches).select("person", "day").distinct().groupBy("person").agg(F.collect_list("day").alias("_days"))
    )
    missing = F.array_except(expected, F.coalesce("_days", F.array().cast("array<date>")))
    return roster.select("person").join(attended, "person", "left").select("person", F.explode(missing).alias("day"))


def absences_net(absent: DataFrame, leave: DataFrame) -> DataFrame:
    """Absences without approved leave, given as ``(person, day)``."""
    return absent.join(leave.select("person", "day").distinct(), ["person", "day"], "left_anti")


def working_calendar(
    calendar: DataFrame, weekend: Sequence[int] = WEEKEND, holidays: DataFrame | Sequence[date] = ()
) -> DataFrame:
    """Calendar without weekend days (Monday is 0) and holidays."""
    days = calendar.filter(~F.weekday("day").isin(list(weekend))) if weekend else calendar
    if isinstance(holidays, DataFrame):
        return days.join(holidays.select("day"), "day", "left_anti")
    return days.filter(~F.col("day").isin(list(holidays))) if holidays else days


def absence_streaks(absent: DataFrame) -> DataFrame:
    """Runs of consecutive absent days."""
    return streaks(absent)
