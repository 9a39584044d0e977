"""The plans Spark chooses: what is read, what is shuffled, how joins run."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import timedelta

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

import __spark_entry__ as contract
from helpers import final_plan
from muster.functions.site import classify, group_starts
from muster.operators import absence, daily, reports
from muster.plans import batch
from muster.plans.views import create_views
from muster.sources import tables
from muster.streaming.presence import Stays


@pytest.mark.parametrize("name", [n for n in sorted(batch.QUERIES) if n[:3] not in ("a01", "a02")])
def test_no_join_compares_all_rows_with_all(spark, folder, name):
    plan = contract.queries()[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "NestedLoopJoin" not in plan


def test_only_needed_columns_are_read(spark, folder):
    plan = final_plan(daily.daily_attendance(tables.punches(spark, folder)))
    assert "ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>" in plan


def test_a_day_is_pushed_to_the_scan(spark, folder):
    plan = final_plan(batch.roster_change("kept")(spark, folder))
    assert "GreaterThanOrEqual(ts,2024-01-01T00:00)" in plan
    assert "LessThan(ts,2024-01-02T00:00)" in plan


def test_punches_are_counted_before_the_shuffle(spark, folder):
    sketch = reports.distinct_people(tables.punches(spark, folder), exact=False)
    for df in (*(contract.queries()[n](spark, folder) for n in ("a07_daily_attendance", "a27_arrival_histogram")), sketch):
        plan = final_plan(df)
        assert plan.count("Exchange ") == 1
        assert "partial_" in plan


def test_top_k_is_cut_before_the_shuffle(spark, folder):
    assert final_plan(batch.top_attendance(spark, folder)).count("WindowGroupLimit") == 2


def test_absences_never_build_roster_times_calendar(spark, folder):
    roster, calendar = tables.roster(spark, folder), tables.calendar(spark, folder)
    plan = absence.absences(tables.punches(spark, folder), roster, calendar)._jdf.queryExecution().executedPlan()
    assert "array_except" in plan.toString()


def test_percentile_sees_minutes_not_punches(spark, folder):
    plan = final_plan(reports.arrival_percentile(tables.punches(spark, folder), 0.5))
    assert plan.index("percentile") < plan.index("partial_count")


def test_rules_in_python_run_on_arrow_batches(spark):
    df = spark.range(8).select(classify(F.col("id"), lambda s: s, "long").alias("x"))
    assert "ArrowEvalPython" in df._jdf.queryExecution().executedPlan().toString()


def test_views_serve_sql_and_push_filters_down(spark, folder):
    assert "daily" in create_views(spark, folder)
    report = spark.sql(
        """SELECT cohort, count(*) AS days, sum(minutes) AS minutes
           FROM worked JOIN roster USING (person) WHERE day = DATE '2024-01-03' GROUP BY cohort"""
    )
    plan = final_plan(report)
    assert "GreaterThanOrEqual(ts,2024-01-03T00:00)" in plan and "LessThan(ts,2024-01-04T00:00)" in plan
    want = batch.QUERIES["a11_worked_minutes"](spark, folder).filter("day = DATE '2024-01-03'")
    assert sum(r.days for r in report.collect()) == want.count()


def test_workers_need_no_copy_of_the_package(tmp_path):
    shipped = tmp_path / "shipped"
    shipped.write_bytes(cloudpickle.dumps((Stays(timedelta(hours=1)), group_starts)))
    load = "import pickle, sys; print(type(pickle.load(open(sys.argv[1], 'rb'))[0]).__name__, 'muster' in sys.modules)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", load, str(shipped)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=60
    )
    assert done.stdout.split() == ["Stays", "False"], done.stderr
