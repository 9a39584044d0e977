"""Totals that must hold on the given tables, whatever their size."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import absence, daily, intervals, occupancy, reports, timeline
from muster.plans import batch
from muster.sources import tables


def total(df, column):
    return df.agg(F.sum(column).alias("s")).first().s


def test_attended_and_absent_days_fill_the_roster(spark, folder, punches):
    roster, calendar = tables.roster(spark, folder), tables.calendar(spark, folder)
    absent = absence.absences(punches, roster, calendar).count()
    assert daily.daily_attendance(punches).count() + absent == roster.count() * calendar.count()


def test_every_punch_is_in_one_interval(punches):
    pairs = intervals.pair_punches(punches)
    still_open = intervals.open_intervals(pairs).count()
    assert 2 * (pairs.count() - still_open) + still_open == punches.count()


def test_sessions_hold_every_punch(punches):
    assert total(timeline.presence_sessions(punches, batch.SESSION_GAP), "punches") == punches.count()


def test_everybody_who_comes_leaves(punches):
    present = occupancy.occupancy(intervals.pair_punches(punches))
    assert total(present, "came") == total(present, "left")
    assert present.orderBy(F.desc("ts")).first().present == 0
    assert present.agg(F.min("present")).first()[0] >= 0


def test_streaks_hold_every_day(punches):
    record = daily.daily_attendance(punches)
    assert total(daily.attendance_streaks(record), "days") == record.count()


def test_cube_totals_agree(spark, folder, punches):
    cube = reports.org_cube(punches, tables.roster(spark, folder), ["cohort", "kind"])
    sums = {r.level: r.n for r in cube.groupBy("level").agg(F.sum("punches").alias("n")).collect()}
    assert set(sums) == {0, 1, 2, 3}
    assert set(sums.values()) == {punches.count()}


def test_pairs_of_close_punches(punches):
    a, b = punches.alias("a"), punches.alias("b")
    near = (
        (F.col("a.person") == F.col("b.person"))
        & ((F.col("a.ts") < F.col("b.ts")) | ((F.col("a.ts") == F.col("b.ts")) & (F.col("a.punch_id") < F.col("b.punch_id"))))
        & (F.col("b.ts") - F.col("a.ts") < F.lit(batch.REPEAT_GAP))
    )
    assert total(timeline.close_punches(punches, batch.REPEAT_GAP), "pairs") == a.join(b, near).count()
