"""Temporary views for ad-hoc SQL over the given tables."""

from __future__ import annotations

from pyspark.sql import SparkSession

from muster.operators.absence import absences
from muster.operators.daily import daily_attendance
from muster.operators.intervals import pair_punches, worked_minutes
from muster.sources import tables


def create_views(spark: SparkSession, folder: str) -> list[str]:
    """Register punches, roster, organisation, calendar and the records made from them.

    Views are plans, not data: a query on ``daily`` still prunes columns and
    pushes filters down to the scan of the punches.
    """
    punches = tables.punches(spark, folder)
    roster, calendar = tables.roster(spark, folder), tables.calendar(spark, folder)
    intervals = pair_punches(punches)
    views = {
        "punches": punches,
        "roster": roster,
        "organisation": tables.organisation(spark, folder),
        "calendar": calendar,
        "daily": daily_attendance(punches),
        "intervals": intervals,
        "worked": worked_minutes(intervals),
        "absences": absences(punches, roster, calendar),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    return list(views)
