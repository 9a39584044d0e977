"""Rosters and the shifts in force."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muster.functions.times import MINUTE, minute_of_day


def classify_arrival(
    daily: DataFrame, roster: DataFrame, shifts: DataFrame, grace: timedelta = timedelta(0)
) -> DataFrame:
    """``on_time`` or ``late`` for each person-day, by the shift in force that day.

    ``shifts`` is ``(cohort, effective_from, start_min)``; a shift holds until the
    cohort's next one. Persons without a cohort or days without a shift keep a
    null status. The join has an equality on cohort, so the planner may broadcast
    the shifts (by their measured size) or sort and split the large cohorts.
    """
    upcoming = F.lead("effective_from").over(Window.partitionBy("cohort").orderBy("effective_from"))
    shifts = shifts.select("cohort", "effective_from", "start_min", upcoming.alias("until"))
    days = daily.join(roster.select("person", "cohort"), "person", "left")
    in_force = (
        (days["cohort"] == shifts["cohort"])
        & (days["day"] >= shifts["effective_from"])
        & (shifts["until"].isNull() | (days["day"] < shifts["until"]))
    )
    limit = F.col("start_min") + int(grace / MINUTE)
    status = F.when(minute_of_day(F.col("first_in")) <= limit, "on_time").when(F.col("start_min").isNotNull(), "late")
    return days.join(shifts, in_force, "left").select(
        "person", "day", "first_in", days["cohort"], "start_min", status.alias("status")
    )


def roster_change(first: DataFrame, second: DataFrame, how: str) -> DataFrame:
    """Persons who came in the first period only, the second only, both or either.

    ``how`` is ``lost``, ``gained``, ``kept`` or ``either``. Each side is made
    distinct before it is compared, which combines map-side.
    """
    a = first.select("person").distinct()
    b = second.select("person").distinct()
    if how == "lost":
        return a.subtract(b)
    if how == "gained":
        return b.subtract(a)
    if how == "kept":
        return a.intersect(b)
    if how == "either":
        return a.union(b).distinct()
    raise ValueError(f"how must be lost, gained, kept or either, not {how!r}")
