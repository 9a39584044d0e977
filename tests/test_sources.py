"""Reading malformed files and rewriting parts of a register."""

from __future__ import annotations

import pytest

from helpers import at, d, make_punches, rows
from muster.operators.daily import daily_attendance
from muster.session import scratch
from muster.sources.punches import read_punches
from muster.sources.register import read_register, write_register

CSV = ["1,7,2024-01-01 09:00:00", "2,x,2024-01-01 09:00:00", "3,7,yesterday", "4,,2024-01-01 09:00:00", "5,8,2024-01-02 10:30:00,extra"]
JSON = [
    '{"punch_id": 1, "person": 7, "ts": "2024-01-01T09:00:00"}',
    '{"punch_id": 2, "person": "x", "ts": "2024-01-01T09:00:00"}',
    '{"punch_id": 3, "person": 7, "ts": "yesterday"}',
    '{"punch_id": 4, "ts": "2024-01-01T09:00:00"}',
    '{"punch_id": 5, "person": 8',
]


def write_lines(spark, lines, name):
    path = scratch(spark, name)
    spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.text(path)
    return path


@pytest.mark.parametrize("format, lines", [("csv", CSV), ("json", JSON)])
def test_bad_rows_are_kept_apart(spark, format, lines):
    good, bad = read_punches(spark, write_lines(spark, lines, format), format)
    assert rows(good, "punch_id", "person", "ts") == [(1, 7, at(1, 9))]
    assert rows(bad, "reason") == [("malformed",)] * 3 + [("missing",)]
    raw = {r[0] for r in bad.filter("reason = 'malformed'").select("_corrupt_record").collect()}
    assert raw == {lines[1], lines[2], lines[4]}


@pytest.mark.parametrize("format, lines", [("csv", CSV), ("json", JSON)])
def test_counts_do_not_depend_on_the_selected_columns(spark, format, lines):
    good, bad = read_punches(spark, write_lines(spark, lines, format), format)
    assert good.count() == good.select("punch_id").count() == 1
    assert bad.count() == bad.select("punch_id").count() == 4


def test_options_reach_the_reader(spark):
    path = write_lines(spark, ["id;who;at", "1;7;2024-01-01 09:00:00"], "csv-options")
    good, bad = read_punches(spark, path, "csv", header="true", sep=";", enforceSchema="true")
    assert (good.count(), bad.count()) == (1, 0)


@pytest.mark.parametrize("format", ["parquet", "orc"])
def test_columnar_files(spark, format):
    path = scratch(spark, format)
    df = make_punches(spark, [(7, at(1, 9)), (None, at(1, 9))])
    df.write.format(format).save(path)
    good, bad = read_punches(spark, path, format)
    assert rows(good, "person", "ts") == [(7, at(1, 9))]
    assert rows(bad, "punch_id", "reason") == [(2, "missing")]


def test_only_touched_days_are_rewritten(spark):
    path = scratch(spark, "register")
    write_register(daily_attendance(make_punches(spark, [(1, at(1, 9)), (1, at(2, 9)), (2, at(2, 9))])), path)
    write_register(daily_attendance(make_punches(spark, [(3, at(2, 8))])), path)
    assert rows(read_register(spark, path), "person", "day", "punches") == [(1, d(1), 1), (3, d(2), 1)]
    pruned = read_register(spark, path).filter("day = DATE '2024-01-02'")
    assert "PartitionFilters: [isnotnull(day" in pruned._jdf.queryExecution().executedPlan().toString()
