"""Settlement that breaks off anywhere, streams of records without ids, a missing library."""

from __future__ import annotations

import os
import subprocess
import sys
from datetime import timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from conftest import ROOT
from helpers import at, d, make_punches, rows
from muster.operators.daily import daily_attendance
from muster.plans.oracle import SQL
from muster.plans.streams import QUERIES
from muster.session import scratch
from muster.sources.register import read_register, write_register
from muster.sources.streams import event_time
from muster.streaming import late
from oracle_check import compare, connect

LATENESS = timedelta(minutes=10)


class Lost(Exception):
    """The process ends here."""


@pytest.mark.parametrize("lost_at", ["before the copy", "after the copy", "half-way through the copy"])
def test_late_punches_count_once_wherever_a_run_ends(spark, monkeypatch, lost_at):
    store = scratch(spark, "store")
    register = f"{store}/register"
    deliver = lambda punches, batch: late.route_batch(event_time(make_punches(spark, punches)), batch, store, LATENESS)
    spark.range(0).selectExpr("cast(null as timestamp) mark").write.mode("overwrite").parquet(f"{store}/marks/batch=-1")
    deliver([(1, at(1, 9)), (1, at(2, 9)), (1, at(5, 9))], 0)
    write_register(daily_attendance(late.stored_punches(spark, store)), register)
    deliver([(1, at(1, 10)), (1, at(1, 11)), (2, at(2, 10))], 1)

    real = late.write_register

    def broken(df, path):
        if lost_at == "after the copy":
            real(df, path)
        if lost_at == "half-way through the copy":
            real(df.filter("day = DATE '2024-01-01'"), path)
        raise Lost

    monkeypatch.setattr(late, "write_register", broken)
    with pytest.raises(Lost):
        late.settle_late(spark, store, register)
    # More arrives, also for a day that was being settled; then the work goes on.
    deliver([(1, at(1, 12)), (3, at(3, 12))], 2)
    with pytest.raises(Lost):
        late.settle_late(spark, store, register)
    monkeypatch.setattr(late, "write_register", real)
    want = [(1, d(1), 4), (1, d(2), 1), (1, d(5), 1), (2, d(2), 1), (3, d(3), 1)]
    for _ in range(2):
        late.settle_late(spark, store, register)
        assert rows(read_register(spark, register), "person", "day", "punches") == want


def test_late_punches_count_once_if_merging_breaks_off(spark, monkeypatch):
    store = scratch(spark, "store")
    register = f"{store}/register"
    spark.range(0).selectExpr("cast(null as timestamp) mark").write.mode("overwrite").parquet(f"{store}/marks/batch=-1")
    first, second = (make_punches(spark, p) for p in ([(1, at(1, 9)), (1, at(5, 9))], [(1, at(1, 10))]))
    late.route_batch(event_time(first), 0, store, LATENESS)
    write_register(daily_attendance(late.stored_punches(spark, store)), register)
    late.route_batch(event_time(second), 1, store, LATENESS)
    # A folder of merged days without the mark of a finished job is not taken.
    spark.range(1).write.parquet(f"{store}/pending/batch=1")
    mark = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/pending/batch=1/_SUCCESS")
    mark.getFileSystem(spark._jsc.hadoopConfiguration()).delete(mark, False)
    late.settle_late(spark, store, register)
    assert rows(read_register(spark, register), "person", "day", "punches") == [(1, d(1), 2), (1, d(5), 1)]


@pytest.fixture(scope="module")
def without_ids(folder, tmp_path_factory):
    """The given tables, with every tenth event without an id and one whose id is that of closing records."""
    path = tmp_path_factory.mktemp("tables")
    for name in ("customer", "nation", "region"):
        os.symlink(f"{folder}/{name}.parquet", path / f"{name}.parquet")
    events = pq.read_table(f"{folder}/events.parquet")
    at_ = events.schema.get_field_index("event_id")
    ids = [None if i % 10 == 0 else -1 if i == 1 else v for i, v in enumerate(events.column("event_id").to_pylist())]
    pq.write_table(events.set_column(at_, "event_id", pa.array(ids, events.schema.field("event_id").type)), path / "events.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["s02_live_dedup", "s04_live_enrich", "s05_live_unmatched"])
def test_records_without_ids_are_kept(spark, without_ids, name):
    got = QUERIES[name](spark, without_ids).toArrow()
    assert compare(got, connect(without_ids).sql(SQL[name]).to_arrow_table()) is None
    assert name == "s05_live_unmatched" or got.column("punch_id").null_count > 0


def test_the_other_queries_stay_without_a_library():
    """Libraries of the training-data operators may be missing: all others are registered."""
    code = (
        "import sys; sys.modules['sentencepiece'] = None\n"
        "import __spark_entry__ as e; names = set(e.queries())\n"
        "assert len(names) == 48 and set(e.oracle_sql()) <= names, names\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
