"""One row per person and day, and what follows from it.

``daily`` below is the result of :func:`daily_attendance` or a register read back:
exactly one row per person and day. Nothing here makes it distinct again, and a
window over a person is bounded by the length of the calendar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.times import week_start
from muster.functions.windows import by_person
from muster.operators.cleaning import with_day


def daily_attendance(punches: DataFrame) -> DataFrame:
    """First punch, last punch and number of punches per person-day."""
    return (
        with_day(punches)
        .groupBy("person", "day")
        .agg(F.min("ts").alias("first_in"), F.max("ts").alias("last_out"), F.count(F.lit(1)).alias("punches"))
    )


def attendance_rate(daily: DataFrame, roster: DataFrame, calendar: DataFrame) -> DataFrame:
    """Attended and expected days per person of the roster, and their ratio.

    Days outside the calendar do not count. The calendar has one row per date, so
    it is safe to broadcast.
    """
    expected = calendar.agg(F.count_distinct("day").alias("n")).scalar()
    on_calendar = daily.join(F.broadcast(calendar.select("day").distinct()), "day", "left_semi")
    attended = on_calendar.groupBy("person").agg(F.count(F.lit(1)).alias("attended"))
    counts = roster.select("person").join(attended, "person", "left").select(
        "person", F.coalesce("attended", F.lit(0).cast("long")).alias("attended"), expected.alias("expected")
    )
    ratio = F.col("attended").cast("double") / F.nullif(F.col("expected"), F.lit(0))
    return counts.withColumn("rate", F.round(ratio, 4))


def streaks(days: DataFrame) -> DataFrame:
    """Runs of consecutive dates per person; ``days`` has one row per person and day."""
    run = F.date_sub("day", F.row_number().over(by_person("day")))
    return (
        days.withColumn("_run", run)
        .groupBy("person", "_run")
        .agg(
            F.min("day").alias("streak_start"),
            F.max("day").alias("streak_end"),
            F.count(F.lit(1)).alias("days"),
        )
        .drop("_run")
    )


def attendance_streaks(daily: DataFrame) -> DataFrame:
    """Runs of consecutive attended days."""
    return streaks(daily)


def shortage(daily: DataFrame, minimum: int) -> DataFrame:
    """Persons with a punch, but on fewer than ``minimum`` days."""
    return daily.groupBy("person").agg(F.count(F.lit(1)).alias("days")).filter(F.col("days") < minimum)


def rolling_days(daily: DataFrame, n: int) -> DataFrame:
    """Days attended in the ``n`` calendar days that end with each attended day."""
    last_n = by_person(F.datediff("day", F.lit("1970-01-01").cast("date"))).rangeBetween(-(n - 1), 0)
    return daily.select("person", "day", F.count(F.lit(1)).over(last_n).alias("days"))


def week_change(daily: DataFrame) -> DataFrame:
    """Days attended per week, and the change from the person's last recorded week."""
    weeks = daily.groupBy("person", week_start(F.col("day")).alias("week")).agg(F.count(F.lit(1)).alias("days"))
    return weeks.withColumn("change", F.col("days") - F.lag("days").over(by_person("week")))
