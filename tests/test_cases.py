"""Small inputs with known answers."""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import at, d, make_punches, rows
from muster.functions.site import apply_policy, classify
from muster.operators import absence, cleaning, daily, intervals, occupancy, reports, rosters, timeline


def person_days(spark, data):
    return spark.createDataFrame(data, "person long, day date")


def people(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "person long")


def days(spark, *numbers):
    return spark.createDataFrame([(d(n),) for n in numbers], "day date")


def test_single_punch_stays_open(spark):
    pairs = intervals.pair_punches(make_punches(spark, [(1, at(1, 9))]))
    assert rows(pairs, "person", "in_ts", "out_ts") == [(1, at(1, 9), None)]
    assert rows(intervals.open_intervals(pairs), "person", "in_ts") == [(1, at(1, 9))]
    assert intervals.worked_minutes(pairs).count() == 0


def test_odd_count_and_equal_times(spark):
    punches = make_punches(spark, [(1, at(1, 9)), (1, at(1, 9)), (1, at(1, 17))])
    pairs = intervals.pair_punches(punches)
    assert rows(pairs, "in_ts", "out_ts") == [(at(1, 17), None), (at(1, 9), at(1, 9))]


def test_midnight_splits_unless_cutoff(spark):
    night = make_punches(spark, [(1, at(1, 22)), (1, at(2, 5, 59, 59, 999999)), (1, at(2, 6))])
    plain = intervals.pair_punches(night)
    assert rows(plain, "day", "out_ts") == [(d(1), None), (d(2), at(2, 6))]
    shifted = intervals.pair_punches(cleaning.assign_workday(night, timedelta(hours=6)))
    assert rows(shifted, "day", "in_ts", "out_ts") == [
        (d(1), at(1, 22), at(2, 5, 59, 59, 999999)),
        (d(2), at(2, 6), None),
    ]
    assert rows(intervals.worked_minutes(shifted), "person", "minutes") == [(1, 479)]


def test_overtime_threshold_is_exclusive(spark):
    worked = spark.createDataFrame([(1, d(1), 480), (1, d(2), 481)], "person long, day date, minutes long")
    assert rows(intervals.overtime(worked, 480), "day", "overtime") == [(d(2), 1)]


def test_repeat_exactly_at_the_gap_is_kept(spark):
    punches = make_punches(spark, [(1, at(1, 9)), (1, at(1, 9, 5)), (1, at(1, 9, 9, 59)), (2, at(1, 9, 1))])
    kept = cleaning.drop_repeats(punches, timedelta(minutes=5))
    assert rows(kept, "punch_id") == [(1,), (2,), (4,)]


def test_repeats_chain_on_raw_punches(spark):
    punches = make_punches(spark, [(1, at(1, 9, m)) for m in (0, 4, 8, 12)])
    assert rows(cleaning.drop_repeats(punches, timedelta(minutes=5)), "punch_id") == [(1,)]


def test_session_ends_a_gap_after_the_last_punch(spark):
    punches = make_punches(spark, [(1, at(1, 9)), (1, at(1, 10, 59, 59)), (1, at(1, 12, 59, 59))])
    got = timeline.presence_sessions(punches, timedelta(hours=2))
    assert rows(got, "session_start", "session_end", "punches") == [
        (at(1, 12, 59, 59), at(1, 14, 59, 59), 1),
        (at(1, 9), at(1, 12, 59, 59), 2),
    ]


def test_sessions_match_session_window(spark, punches):
    want = punches.groupBy("person", F.session_window("ts", "2 hours").alias("s")).agg(F.count("*").alias("n"))
    got = timeline.presence_sessions(punches, timedelta(hours=2))
    assert rows(got, "person", "session_start", "session_end", "punches") == rows(
        want.select("person", "s.start", "s.end", "n"), "person", "start", "end", "n"
    )


def test_last_before_takes_the_same_instant(spark):
    probe = make_punches(spark, [(1, at(1, 9)), (1, at(1, 8)), (2, at(1, 9))])
    other = make_punches(spark, [(1, at(1, 9)), (1, at(1, 8, 30)), (3, at(1, 1))])
    got = timeline.last_before(probe, other)
    assert rows(got, "person", "ts", "last_ts") == [(1, at(1, 8), None), (1, at(1, 9), at(1, 9)), (2, at(1, 9), None)]


def test_latest_correction_wins_and_unknown_id_is_added(spark):
    base = make_punches(spark, [(1, at(1, 9)), (2, at(1, 9))])
    fixes = spark.createDataFrame(
        [(1, 1, at(1, 10), 1), (1, 1, at(1, 12), 3), (1, 1, at(1, 11), 2), (9, 5, at(2, 7), 1)],
        "punch_id long, person long, ts timestamp_ntz, version int",
    )
    assert rows(cleaning.apply_corrections(base, fixes), "punch_id", "person", "ts") == [
        (1, 1, at(1, 12)),
        (2, 2, at(1, 9)),
        (9, 5, at(2, 7)),
    ]


def test_unreadable_attributes_are_null(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{k"), (3, None), (4, '{"x": 1}')], "punch_id long, props string")
    assert rows(cleaning.parse_attributes(df), "punch_id", "k") == [(1, 3), (2, None), (3, None), (4, None)]


def test_absences(spark):
    punches = make_punches(spark, [(1, at(1, 9)), (1, at(3, 9)), (2, at(2, 9)), (2, at(9, 9))])
    got = absence.absences(punches, people(spark, 1, 2, 3), days(spark, 1, 2, 3))
    assert rows(got, "person", "day") == sorted(
        [(1, d(2)), (2, d(1)), (2, d(3)), (3, d(1)), (3, d(2)), (3, d(3))], key=repr
    )


def test_empty_roster_and_empty_calendar(spark):
    punches = make_punches(spark, [(1, at(1, 9))])
    assert absence.absences(punches, people(spark, 7).limit(0), days(spark, 1, 2)).count() == 0
    assert absence.absences(punches, people(spark, 1), days(spark, 1).limit(0)).count() == 0
    rate = daily.attendance_rate(daily.daily_attendance(punches), people(spark, 1), days(spark, 1).limit(0))
    assert rows(rate, "attended", "expected", "rate") == [(0, 0, None)]


def test_rate_counts_calendar_days_only(spark):
    record = daily.daily_attendance(make_punches(spark, [(1, at(1, 9)), (1, at(6, 9)), (1, at(2, 9))]))
    got = daily.attendance_rate(record, people(spark, 1, 2), days(spark, 1, 2, 3))
    assert rows(got, "person", "attended", "expected", "rate") == [(1, 2, 3, 0.6667), (2, 0, 3, 0.0)]


def test_leave_on_an_attended_day_changes_nothing(spark):
    absent = person_days(spark, [(1, d(2)), (2, d(1))])
    leave = person_days(spark, [(1, d(1)), (2, d(1)), (2, d(1))])
    assert rows(absence.absences_net(absent, leave), "person", "day") == [(1, d(2))]


def test_working_calendar(spark):
    week = days(spark, *range(1, 9))  # 1 January 2024 is a Monday
    assert rows(absence.working_calendar(week), "day") == [(d(n),) for n in (1, 2, 3, 4, 5, 8)]
    assert rows(absence.working_calendar(week, (4,), [d(1)]), "day") == [(d(n),) for n in (2, 3, 4, 6, 7, 8)]
    assert rows(absence.working_calendar(week, (), days(spark, 2, 3)), "day") == [(d(n),) for n in (1, 4, 5, 6, 7, 8)]


def test_shift_change_on_its_first_day(spark):
    record = daily.daily_attendance(
        make_punches(spark, [(1, at(4, 8, 15)), (1, at(5, 8, 15)), (2, at(5, 8)), (1, at(1, 8)), (1, at(6, 9, 16))])
    )
    roster = spark.createDataFrame([(1, "A")], "person long, cohort string")
    shifts = spark.createDataFrame(
        [("A", d(2), 480), ("A", d(5), 540)], "cohort string, effective_from date, start_min int"
    )
    got = rosters.classify_arrival(record, roster, shifts, timedelta(minutes=15))
    assert rows(got, "person", "day", "start_min", "status") == [
        (1, d(1), None, None),
        (1, d(4), 480, "on_time"),
        (1, d(5), 540, "on_time"),
        (1, d(6), 540, "late"),
        (2, d(5), None, None),
    ]


def test_streaks(spark):
    got = daily.attendance_streaks(person_days(spark, [(1, d(1)), (1, d(2)), (1, d(4)), (2, d(2))]))
    assert rows(got, "person", "streak_start", "streak_end", "days") == [
        (1, d(1), d(2), 2),
        (1, d(4), d(4), 1),
        (2, d(2), d(2), 1),
    ]


def test_rolling_days_looks_back_calendar_days(spark):
    got = daily.rolling_days(person_days(spark, [(1, d(1)), (1, d(3)), (1, d(4)), (1, d(9))]), 3)
    assert rows(got, "day", "days") == [(d(1), 1), (d(3), 2), (d(4), 2), (d(9), 1)]


def test_week_change_uses_the_last_recorded_week(spark):
    record = person_days(spark, [(1, d(1)), (1, d(7)), (1, d(15)), (1, d(16)), (1, d(17))])
    got = daily.week_change(record)
    assert rows(got, "week", "days", "change") == [(d(1), 2, None), (d(15), 3, 1)]


def test_roster_change(spark):
    first, second = people(spark, 1, 1, 2), people(spark, 2, 3, 3)
    want = {"lost": [(1,)], "gained": [(3,)], "kept": [(2,)], "either": [(1,), (2,), (3,)]}
    for how, persons in want.items():
        assert rows(rosters.roster_change(first, second, how)) == persons
    with pytest.raises(ValueError):
        rosters.roster_change(first, second, "none")


def test_occupancy(spark):
    pairs = spark.createDataFrame(
        [(at(1, 9), at(1, 17)), (at(1, 10), at(1, 12)), (at(1, 12), at(2, 1)), (at(1, 11), None)],
        "in_ts timestamp_ntz, out_ts timestamp_ntz",
    )
    got = occupancy.occupancy(pairs)
    assert [tuple(r) for r in got.orderBy("ts").select("ts", "came", "left", "present").collect()] == [
        (at(1, 9), 1, 0, 1),
        (at(1, 10), 1, 0, 2),
        (at(1, 12), 1, 1, 2),
        (at(1, 17), 0, 1, 1),
        (at(2, 1), 0, 1, 0),
    ]


def test_occupancy_by_hour_follows_a_night_shift(spark):
    night = cleaning.assign_workday(make_punches(spark, [(1, at(1, 22, 30)), (1, at(2, 1))]), timedelta(hours=6))
    got = occupancy.occupancy_by_hour(daily.daily_attendance(night))
    assert rows(got, "hour_start", "people") == [(at(1, 22), 1), (at(1, 23), 1), (at(2, 0), 1), (at(2, 1), 1)]


def test_register_marks_given_days_only(spark):
    punches = make_punches(spark, [(1, at(1, 9)), (1, at(1, 10)), (2, at(3, 9)), (3, at(9, 9))])
    got = reports.register(punches, [d(1), d(2), d(3)])
    assert rows(got, "person", "d_2024_01_01", "d_2024_01_02", "d_2024_01_03") == [(1, 1, 0, 0), (2, 0, 0, 1)]


def test_top_attendance_breaks_ties_by_person(spark):
    roster = spark.createDataFrame([(p, "A") for p in (1, 2, 3)], "person long, cohort string")
    record = person_days(spark, [(3, d(1)), (2, d(1)), (1, d(1)), (3, d(2))])
    assert rows(reports.top_attendance(record, roster, 2), "place", "person", "days") == [(1, 3, 2), (2, 1, 1)]


def test_percentile_interpolates(spark):
    punches = make_punches(spark, [(1, at(1, 0, m)) for m in (0, 10, 20, 21)])
    assert rows(reports.arrival_percentile(punches, 0.5), "minute") == [(15.0,)]


def test_sketch_is_within_its_error(spark):
    punches = spark.range(20_000).select((F.col("id") % 5000).alias("person"))
    assert rows(reports.distinct_people(punches)) == [(5000,)]
    sketch = reports.distinct_people(punches, exact=False, error=0.05).first().people
    assert abs(sketch - 5000) < 3 * 0.05 * 5000


def test_policy_sees_whole_groups_of_one_person(spark):
    def longest(group: pd.DataFrame) -> pd.DataFrame:
        return group.nlargest(1, "minutes")[["person", "day", "minutes"]]

    records = spark.createDataFrame(
        [(1, d(1), 5), (1, d(2), 7), (2, d(1), 3)], "person long, day date, minutes long"
    )
    got = apply_policy(records, ["person"], longest, records.schema)
    assert rows(got, "person", "day", "minutes") == [(1, d(2), 7), (2, d(1), 3)]
    with pytest.raises(ValueError):
        apply_policy(records, ["day"], longest, records.schema)
    with pytest.raises(ValueError):
        apply_policy(records.drop("day"), ["person"], longest, records.schema)


def test_policy_groups_are_whole_across_batches(spark):
    def size(group: pd.DataFrame) -> pd.DataFrame:
        assert group["person"].nunique(dropna=False) == 1
        return pd.DataFrame({"person": group["person"].iloc[:1], "n": [len(group)], "last": [group["day"].max()]})

    person = F.when(F.col("id") < 40, F.lit(None)).otherwise((F.col("id") / 37).cast("long"))
    records = spark.range(2000).select(
        person.alias("person"), F.date_add(F.lit(d(1)), (F.col("id") % 37).cast("int")).alias("day")
    )
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.set(key, "10")
    try:
        got = apply_policy(records, ["person"], size, "person long, n long, last date")
        want = records.groupBy("person").agg(F.count("*").alias("n"), F.max("day").alias("last"))
        assert rows(got) == rows(want)
    finally:
        spark.conf.unset(key)


def test_classify_is_vectorised(spark):
    got = spark.range(4).select(classify("id", lambda s: s * 2, "long").alias("x"))
    assert rows(got) == [(0,), (2,), (4,), (6,)]


def test_operators_also_take_timestamps_with_zone(spark):
    local = make_punches(spark, [(1, at(1, 9)), (1, at(1, 9, 3)), (1, at(1, 17)), (2, at(1, 8))])
    zoned = local.withColumn("ts", F.col("ts").cast("timestamp"))
    for hot_rows in (0, 100):
        for build in (
            lambda p: intervals.worked_minutes(intervals.pair_punches(p, hot_rows)),
            lambda p: cleaning.drop_repeats(p, timedelta(minutes=5), hot_rows).select("punch_id"),
            lambda p: timeline.presence_sessions(p, timedelta(hours=2), hot_rows).select("person", "punches"),
            lambda p: timeline.close_punches(p, timedelta(minutes=5), hot_rows).select("person", "pairs"),
            lambda p: occupancy.occupancy(intervals.pair_punches(p, hot_rows)).select("came", "left", "present"),
            lambda p: occupancy.occupancy_by_hour(daily.daily_attendance(p)).select("people"),
        ):
            assert rows(build(zoned)) == rows(build(local))


def test_corrections_without_version_are_ignored_and_ties_are_ordered(spark):
    base = make_punches(spark, [(1, at(1, 9)), (2, at(1, 9))])
    fixes = spark.createDataFrame(
        [(1, 1, at(1, 10), None), (2, 2, at(1, 11), 1), (2, 2, at(1, 12), 1), (9, 9, at(1, 1), None), (None, 3, at(1, 1), 1)],
        "punch_id long, person long, ts timestamp_ntz, version int",
    )
    for order in ("ts", "punch_id"):
        got = cleaning.apply_corrections(base, fixes.orderBy(order))
        assert rows(got, "punch_id", "ts") == [(1, at(1, 9)), (2, at(1, 12))]


def test_register_takes_any_days(spark):
    punches = make_punches(spark, [(1, at(1, 9)), (2, at(2, 9)), (3, at(3, 9)), (4, at(5, 9))])
    got = reports.register(punches, [d(1), d(3)])
    assert rows(got, "person", "d_2024_01_01", "d_2024_01_03") == [(1, 1, 0), (3, 0, 1)]
    assert reports.register(punches, []).columns == ["person"] and reports.register(punches, []).count() == 0
