"""Reports by organisation, cohort and time.

Punches are first counted per person (map-side combine). The joins and the
grouping sets that follow see persons, not punches.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muster.functions.times import minute_of_day
from muster.operators.cleaning import with_day


def org_rollup(punches: DataFrame, org: DataFrame) -> DataFrame:
    """Punches and people by region and nation, by region, and in total.

    ``org`` has one row per person: ``(person, region, nation)``. ``level`` is 0
    for a nation, 1 for a region, 3 for the total.
    """
    persons = punches.groupBy("person").agg(F.count(F.lit(1)).alias("n"))
    return (
        persons.join(org, "person")
        .rollup("region", "nation")
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("n").alias("punches"),
            F.count(F.lit(1)).alias("people"),
        )
    )


def org_cube(punches: DataFrame, people: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Punches and people for every combination of ``dims``.

    A dimension is a column of ``punches`` or of ``people`` (one row per person).
    ``level`` tells a subtotal from a null value.
    """
    own = [d for d in dims if d in punches.columns]
    persons = punches.groupBy("person", *own).agg(F.count(F.lit(1)).alias("n"))
    return (
        persons.join(people.select("person", *[d for d in dims if d not in own]), "person")
        .cube(*dims)
        .agg(
            F.grouping_id().cast("int").alias("level"),
            F.sum("n").alias("punches"),
            F.count_distinct("person").alias("people"),
        )
    )


def register(punches: DataFrame, days: Sequence[date]) -> DataFrame:
    """One row per person with a 0/1 column ``d_YYYY_MM_DD`` for each day.

    The days are given, so no extra job has to look for them, and punches of other
    days never enter the shuffle. Persons who came on none of them have no row.
    """
    if not days:
        return punches.select("person").filter(F.lit(False))
    wide = (
        with_day(punches)
        .select("person", "day")
        .filter(F.col("day").isin(list(days)))
        .groupBy("person")
        .pivot("day", list(days))
        .agg(F.lit(1))
    )
    present = [F.coalesce(F.col(f"`{d}`"), F.lit(0)).cast("int").alias(f"d_{d:%Y_%m_%d}") for d in days]
    return wide.select("person", *present)


def arrival_histogram(punches: DataFrame, width: timedelta) -> DataFrame:
    """Punches per time bucket."""
    seconds = f"{int(width.total_seconds())} seconds"
    return (
        punches.groupBy(F.window("ts", seconds).alias("w"))
        .agg(F.count(F.lit(1)).alias("punches"))
        .select(F.col("w.start").alias("window_start"), "punches")
    )


def top_attendance(daily: DataFrame, roster: DataFrame, k: int) -> DataFrame:
    """The ``k`` persons of each cohort with most days, ties by person id."""
    days = daily.groupBy("person").agg(F.count(F.lit(1)).alias("days"))
    best = Window.partitionBy("cohort").orderBy(F.desc("days"), "person")
    return (
        roster.select("person", "cohort")
        .join(days, "person")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= k)
        .select("cohort", "place", "person", "days")
    )


def arrival_percentile(punches: DataFrame, p: float) -> DataFrame:
    """Exact percentile of the minute of day of each person's punches.

    A day has 1 440 minutes, so a person is at most that many counted rows.
    """
    minutes = punches.groupBy("person", minute_of_day(F.col("ts")).alias("minute")).agg(F.count(F.lit(1)).alias("n"))
    return minutes.groupBy("person").agg(F.round(F.percentile("minute", p, F.col("n")), 6).alias("minute"))


def sketch_check(punches: DataFrame, error: float = 0.05) -> DataFrame:
    """Exact number of persons, and whether the sketch lies within four of its standard errors."""
    counts = punches.agg(F.count_distinct("person").alias("people"), F.approx_count_distinct("person", error).alias("sketch"))
    return counts.select("people", (F.abs(F.col("sketch") - F.col("people")) <= 4 * error * F.col("people")).alias("within"))


def distinct_people(punches: DataFrame, exact: bool = True, error: float = 0.05) -> DataFrame:
    """Number of persons: exact, or a sketch with relative standard error ``error``."""
    people = F.count_distinct("person") if exact else F.approx_count_distinct("person", error)
    return punches.agg(people.alias("people"))
