"""Batch reports over the given tables, one per operator.

Each function takes ``(spark, folder)`` and returns a DataFrame (a01 and a02 write files when called). The site
rules used here (gaps, shifts, leave, corrections) are the fixed values below;
the SQL in :mod:`muster.plans.oracle` states the same ones.
"""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions.site import apply_policy, classify
from muster.model import PUNCH_SCHEMA
from muster.operators import absence, cleaning, daily, intervals, occupancy, reports, rosters, timeline
from muster.session import scratch
from muster.sources.punches import read_punches
from muster.sources.register import read_register, write_register
from muster.sources.tables import calendar, organisation, punches, roster

# Fixed values, stated alike in oracle.py.
REPEAT_GAP = timedelta(minutes=5)
SESSION_GAP = timedelta(hours=2)
CUTOFF = timedelta(hours=6)
GRACE = timedelta(minutes=15)
FULL_DAY = 480
MINIMUM_DAYS = 25
MONTH = [date(2024, 1, d) for d in range(1, 31)]
LEAVE_REGION, LEAVE_DAY = "ASIA", date(2024, 1, 6)
HOLIDAYS = [date(2024, 1, 1), date(2024, 1, 15)]
PERIOD_1, PERIOD_2 = date(2024, 1, 1), date(2024, 1, 2)
SHIFTS = [
    ("AUTOMOBILE", date(2024, 1, 1), 480),
    ("AUTOMOBILE", date(2024, 1, 16), 540),
    ("BUILDING", date(2024, 1, 1), 420),
    ("FURNITURE", date(2024, 1, 1), 540),
    ("HOUSEHOLD", date(2024, 1, 1), 600),
    ("MACHINERY", date(2024, 1, 1), 360),
]


def _daily(spark: SparkSession, folder: str) -> DataFrame:
    return daily.daily_attendance(punches(spark, folder))


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.pair_punches(punches(spark, folder))


def _worked(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.worked_minutes(_pairs(spark, folder))


def _absent(spark: SparkSession, folder: str) -> DataFrame:
    return absence.absences(punches(spark, folder), roster(spark, folder), calendar(spark, folder))


def _of_kind(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    return punches(spark, folder).filter(F.col("kind") == kind)


# --- sources, sinks, cleaning -------------------------------------------------


def read_malformed(spark: SparkSession, folder: str) -> DataFrame:
    """All punches as CSV text, the time of every error punch spoiled, read back."""
    path = scratch(spark, "punch-files")
    text = punches(spark, folder).select(
        "punch_id",
        "person",
        F.when(F.col("kind") == "error", F.concat(F.lit("at "), F.col("ts").cast("string")))
        .otherwise(F.col("ts").cast("string"))
        .alias("ts"),
    )
    text.write.csv(path)
    good, bad = read_punches(spark, path, "csv", PUNCH_SCHEMA)
    return good.select("punch_id", "person", "ts", F.lit("good").alias("outcome")).unionByName(
        bad.select("punch_id", "person", "ts", F.col("reason").alias("outcome"))
    )


def rewrite_days(spark: SparkSession, folder: str) -> DataFrame:
    """Register of all days, then all days from the second on rewritten without error punches."""
    path = scratch(spark, "register")
    write_register(_daily(spark, folder), path)
    clean = punches(spark, folder).filter((F.col("kind") != "error") & (F.to_date("ts") >= PERIOD_2))
    write_register(daily.daily_attendance(clean), path)
    return read_register(spark, path)


def drop_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.drop_repeats(punches(spark, folder).drop("props", "value"), REPEAT_GAP)


def apply_corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Error punches were corrected twice, by 5 and then by 10 minutes."""
    base = punches(spark, folder).select("punch_id", "person", "ts", "kind")
    wrong = base.filter(F.col("kind") == "error")
    fixes = [
        wrong.withColumn("ts", F.col("ts") + F.lit(timedelta(minutes=5 * v))).withColumn("version", F.lit(v))
        for v in (2, 1)
    ]
    return cleaning.apply_corrections(base, fixes[0].unionByName(fixes[1]))


def assign_workday(spark: SparkSession, folder: str) -> DataFrame:
    nights = cleaning.assign_workday(punches(spark, folder), CUTOFF)
    return nights.groupBy("person", "day").agg(F.count(F.lit(1)).alias("punches"))


def parse_attributes(spark: SparkSession, folder: str) -> DataFrame:
    return cleaning.parse_attributes(punches(spark, folder).select("punch_id", "person", "props"))


# --- day and interval level ---------------------------------------------------


def open_intervals(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.open_intervals(_pairs(spark, folder))


def presence_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.presence_sessions(punches(spark, folder), SESSION_GAP)


def overtime(spark: SparkSession, folder: str) -> DataFrame:
    return intervals.overtime(_worked(spark, folder), FULL_DAY)


def close_punches(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.close_punches(punches(spark, folder), REPEAT_GAP)


def last_before(spark: SparkSession, folder: str) -> DataFrame:
    return timeline.last_before(_of_kind(spark, folder, "error"), _of_kind(spark, folder, "purchase"))


# --- roster, shifts, absence --------------------------------------------------


def absences_net(spark: SparkSession, folder: str) -> DataFrame:
    """Persons of one region have leave on one day."""
    org = organisation(spark, folder).filter(F.col("region") == LEAVE_REGION)
    leave = roster(spark, folder).join(org, "nation_id", "left_semi").select("person", F.lit(LEAVE_DAY).alias("day"))
    return absence.absences_net(_absent(spark, folder), leave)


def working_absences(spark: SparkSession, folder: str) -> DataFrame:
    days = absence.working_calendar(calendar(spark, folder), holidays=HOLIDAYS)
    return absence.absences(punches(spark, folder), roster(spark, folder), days)


def shifts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHIFTS, "cohort string, effective_from date, start_min int")


def classify_arrival(spark: SparkSession, folder: str) -> DataFrame:
    return rosters.classify_arrival(_daily(spark, folder), roster(spark, folder), shifts(spark), GRACE)


def attendance_rate(spark: SparkSession, folder: str) -> DataFrame:
    return daily.attendance_rate(_daily(spark, folder), roster(spark, folder), calendar(spark, folder))


def attendance_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return daily.attendance_streaks(_daily(spark, folder))


def absence_streaks(spark: SparkSession, folder: str) -> DataFrame:
    return absence.absence_streaks(_absent(spark, folder))


def shortage(spark: SparkSession, folder: str) -> DataFrame:
    return daily.shortage(_daily(spark, folder), MINIMUM_DAYS)


def roster_change(how: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        rows = punches(spark, folder)
        first, second = (rows.filter(F.to_date("ts") == day) for day in (PERIOD_1, PERIOD_2))
        return rosters.roster_change(first, second, how)

    return query


# --- reporting ----------------------------------------------------------------


def org_rollup(spark: SparkSession, folder: str) -> DataFrame:
    org = roster(spark, folder).join(organisation(spark, folder), "nation_id").select("person", "region", "nation")
    return reports.org_rollup(punches(spark, folder), org)


def org_cube(spark: SparkSession, folder: str) -> DataFrame:
    return reports.org_cube(punches(spark, folder), roster(spark, folder), ["cohort", "kind"])


def register(spark: SparkSession, folder: str) -> DataFrame:
    """The days are the operator's parameter; this entry asks for January 2024."""
    return reports.register(punches(spark, folder), MONTH)


def arrival_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return reports.arrival_histogram(punches(spark, folder), timedelta(hours=1))


def occupancy_changes(spark: SparkSession, folder: str) -> DataFrame:
    return occupancy.occupancy(_pairs(spark, folder))


def occupancy_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    return occupancy.occupancy_by_hour(_daily(spark, folder))


def rolling_days(spark: SparkSession, folder: str) -> DataFrame:
    return daily.rolling_days(_daily(spark, folder), 7)


def top_attendance(spark: SparkSession, folder: str) -> DataFrame:
    return reports.top_attendance(_daily(spark, folder), roster(spark, folder), 3)


def arrival_percentile(spark: SparkSession, folder: str) -> DataFrame:
    return reports.arrival_percentile(punches(spark, folder), 0.9)


def week_change(spark: SparkSession, folder: str) -> DataFrame:
    return daily.week_change(_daily(spark, folder))


def distinct_people(spark: SparkSession, folder: str) -> DataFrame:
    return reports.distinct_people(punches(spark, folder))


def distinct_sketch(spark: SparkSession, folder: str) -> DataFrame:
    return reports.sketch_check(punches(spark, folder))


# --- user functions -----------------------------------------------------------


def time_bank(spark: SparkSession, folder: str) -> DataFrame:
    """A site rule: minutes above a full day are banked, the bank never goes below zero."""

    def bank(month: pd.DataFrame) -> pd.DataFrame:
        order = np.argsort(month["day"].to_numpy())
        day, minutes = month["day"].to_numpy()[order], month["minutes"].to_numpy()[order]
        total = np.cumsum(minutes - FULL_DAY)
        balance = total - np.minimum(np.minimum.accumulate(total), 0)
        return pd.DataFrame({"person": month["person"].iat[0], "day": day, "minutes": minutes, "balance": balance})

    records = _worked(spark, folder).withColumn("month", F.trunc("day", "month"))
    return apply_policy(records, ["person", "month"], bank, "person long, day date, minutes long, balance long")


def day_length(spark: SparkSession, folder: str) -> DataFrame:
    """A site rule on one column: name the length of a worked day."""

    def name(minutes: pd.Series) -> pd.Series:
        names = np.select([minutes < 240, minutes <= FULL_DAY], ["short", "full"], "long")
        return pd.Series(names, index=minutes.index)

    return _worked(spark, folder).select("person", "day", "minutes", classify(F.col("minutes"), name).alias("length"))


QUERIES = {
    "a01_read_punches": read_malformed,
    "a02_write_register": rewrite_days,
    "a03_drop_repeats": drop_repeats,
    "a04_apply_corrections": apply_corrections,
    "a05_assign_workday": assign_workday,
    "a06_parse_attributes": parse_attributes,
    "a07_daily_attendance": _daily,
    "a08_pair_punches": _pairs,
    "a09_open_intervals": open_intervals,
    "a10_presence_sessions": presence_sessions,
    "a11_worked_minutes": _worked,
    "a12_overtime": overtime,
    "a13_close_punches": close_punches,
    "a14_last_before": last_before,
    "a15_absences": _absent,
    "a16_absences_net": absences_net,
    "a17_working_calendar": working_absences,
    "a18_classify_arrival": classify_arrival,
    "a19_attendance_rate": attendance_rate,
    "a20_attendance_streaks": attendance_streaks,
    "a21_absence_streaks": absence_streaks,
    "a22_shortage": shortage,
    "a23_roster_lost": roster_change("lost"),
    "a23_roster_gained": roster_change("gained"),
    "a23_roster_kept": roster_change("kept"),
    "a23_roster_either": roster_change("either"),
    "a24_org_rollup": org_rollup,
    "a25_org_cube": org_cube,
    "a26_register": register,
    "a27_arrival_histogram": arrival_histogram,
    "a28_occupancy": occupancy_changes,
    "a29_occupancy_by_hour": occupancy_by_hour,
    "a30_rolling_days": rolling_days,
    "a31_top_attendance": top_attendance,
    "a32_arrival_percentile": arrival_percentile,
    "a33_week_change": week_change,
    "a34_distinct_people": distinct_people,
    "a34_distinct_people_sketch": distinct_sketch,
    "u01_apply_policy": time_bank,
    "u02_classify": day_length,
}
