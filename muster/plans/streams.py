"""Finite runs of the streaming operators over the given events.

Each function streams the whole events table through an operator, in several
batches in order of time and with a closing record that lets the watermark pass all
of them, and returns the table it was written to: the complete result. Event times
are cast back to ``timestamp_ntz``.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.daily import daily_attendance
from muster.plans.batch import SESSION_GAP
from muster.session import ROCKSDB, scratch
from muster.sources.register import read_register, write_register
from muster.sources.streams import drain_into, punch_stream
from muster.sources.tables import organisation, roster, table
from muster.streaming import live
from muster.streaming.late import late_punches, settle_late, stored_punches
from muster.streaming.presence import live_state

# Fixed values, stated alike in oracle.py.
LATENESS = timedelta(minutes=10)
BUCKET = timedelta(hours=1)
OUT_WITHIN = timedelta(hours=12)
STAY_TIMEOUT = timedelta(hours=8)
DELIVERY_DAY = date(2024, 1, 16)


WAVES = 5
# Events to each part of a stream's state.
STATE_ROWS = 250_000
# The closing record: of a person who is none (not null: a join's filter on null persons
# would keep it from the watermark), long after all others, so that the watermark passes everything.
CLOSING_ID, CLOSING_AFTER = -1, timedelta(days=60)


def _wall_clock(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def state_parts(spark: SparkSession, events: int) -> str:
    """Parts of a stream's state: one per core, or as many as the events need, within the session's number.

    Every batch opens, commits and cleans each part, whatever it holds; Spark merges no small ones here.
    """
    needed = max(spark.sparkContext.defaultParallelism, -(-events // STATE_ROWS))
    return str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), needed))


@contextmanager
def _settings(spark: SparkSession, **more: str):
    """What streams need of a session, whoever made it: wall clock in UTC, state on disk, sessions merged early."""
    needed = {
        **more,
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    }
    before = {key: spark.conf.get(key, None) for key in needed}
    for key, value in needed.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def waves(spark: SparkSession, folder: str, closings: int = 1) -> list[DataFrame]:
    """The events in order of time, in ``WAVES`` parts, and closing records.

    Events without a time come with the first part.
    """
    events = table(spark, folder, "events")
    span = events.agg(F.min("ts").alias("lo"), F.max("ts").alias("hi")).first()
    if span.lo is None:
        return [events]
    step = (span.hi - span.lo) / WAVES
    since = F.unix_micros(F.col("ts").cast("timestamp")) - _micros(span.lo)
    place = F.least(F.lit(WAVES - 1), F.coalesce(F.floor(since / (step / timedelta(microseconds=1) or 1)), F.lit(0)))
    closing = [
        spark.createDataFrame([(CLOSING_ID, span.hi + i * CLOSING_AFTER, CLOSING_ID, kind, None, None) for kind in ("signup", "purchase")], events.schema)
        for i in range(1, closings + 1)
    ]
    return [*(events.filter(place == i) for i in range(WAVES)), *closing]


def _micros(ts) -> int:
    return (ts - datetime(1970, 1, 1)) // timedelta(microseconds=1)


def stream_all(
    spark: SparkSession, folder: str, name: str, build: Callable[[Callable[[], DataFrame]], DataFrame], *times: str, closings: int = 1
) -> DataFrame:
    """All results of ``build`` over the events, delivered wave by wave, each in a run of its own.

    ``build`` gets a function that opens the events as a stream. The closing record
    opens a last window, session or stay that is never emitted; where records themselves
    are the result, it is the one that is later than all events.
    """
    newest, size = table(spark, folder, "events").agg(F.max("ts"), F.count("*")).first()
    with _settings(spark, **{"spark.sql.shuffle.partitions": state_parts(spark, size)}):
        inbox, out = scratch(spark, "inbox"), scratch(spark, name)
        for wave in waves(spark, folder, closings):
            wave.write.mode("append").parquet(inbox)
            result = drain_into(build(lambda: punch_stream(spark, inbox)), out)
        result = _wall_clock(result, *times)
        if "punch_id" not in result.columns or newest is None:
            return result
        return result.filter(F.coalesce(F.col("ts") <= F.lit(newest), F.lit(True)))


def live_counts(spark: SparkSession, folder: str) -> DataFrame:
    return stream_all(spark, folder, "live-counts", lambda events: live.live_counts(events(), BUCKET, LATENESS), "window_start")


def live_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every punch is delivered twice."""

    def build(events: Callable[[], DataFrame]) -> DataFrame:
        twice = events().unionByName(events()).select("punch_id", "person", "ts", "kind")
        return live.live_dedup(twice, LATENESS)

    return stream_all(spark, folder, "live-dedup", build, "ts")


def live_sessions(spark: SparkSession, folder: str) -> DataFrame:
    build = lambda events: live.live_sessions(events(), SESSION_GAP, LATENESS)
    return stream_all(spark, folder, "live-sessions", build, "session_start", "session_end")


def live_enrich(spark: SparkSession, folder: str) -> DataFrame:
    """The roster is written once; every batch reads that table instead of working it out."""
    path = scratch(spark, "roster")
    roster(spark, folder).join(organisation(spark, folder), "nation_id").drop("nation_id").write.parquet(path)
    people = spark.read.parquet(path)
    build = lambda events: live.live_enrich(events().select("punch_id", "person", "ts"), people)
    return stream_all(spark, folder, "live-enrich", build, "ts")


def live_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Signups that no purchase followed, taken as check-in and check-out."""

    def build(events: Callable[[], DataFrame]) -> DataFrame:
        ins = events().filter(F.col("kind") == "signup").select("punch_id", "person", "ts")
        return live.live_unmatched(ins, events().filter(F.col("kind") == "purchase"), OUT_WITHIN, LATENESS)

    # The first record closes the aggregate, the second one surely the join behind it.
    return stream_all(spark, folder, "live-unmatched", build, "ts", closings=2)


def live_stays(spark: SparkSession, folder: str) -> DataFrame:
    return stream_all(spark, folder, "live-stays", lambda events: live_state(events(), STAY_TIMEOUT, LATENESS), "in_ts", "out_ts")


def _late_delivery(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Deliver the events in three waves; error punches of the first half come last.

    The register is written after two waves and settled after the third.
    """
    store, inbox = scratch(spark, "punch-store"), scratch(spark, "inbox")
    events = table(spark, folder, "events")
    # Events without a time or a type come with the second wave.
    early = F.coalesce(F.to_date("ts") < F.lit(DELIVERY_DAY), F.lit(False))
    error = F.col("event_type") == "error"
    first, last = (F.coalesce(early & x, F.lit(False)) for x in (~error, error))
    for wave in (first, ~first & ~last, last):
        events.filter(wave).write.mode("append").parquet(inbox)
        late_punches(punch_stream(spark, inbox), store, LATENESS).awaitTermination()
    path = f"{store}/register"
    write_register(daily_attendance(stored_punches(spark, store).filter("not late")), path)
    settle_late(spark, store, path)
    return store, path


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    with _settings(spark):
        store, _ = _late_delivery(spark, folder)
        rows = stored_punches(spark, store).filter("late").select("punch_id", "person", "ts")
        return _wall_clock(rows, "ts")


def settled_register(spark: SparkSession, folder: str) -> DataFrame:
    with _settings(spark):
        _, path = _late_delivery(spark, folder)
        return _wall_clock(read_register(spark, path), "first_in", "last_out")


QUERIES = {
    "s01_live_counts": live_counts,
    "s02_live_dedup": live_dedup,
    "s03_live_sessions": live_sessions,
    "s04_live_enrich": live_enrich,
    "s05_live_unmatched": live_unmatched,
    "s06_late_punches": late_rows,
    "s06_settled_register": settled_register,
    "s07_live_state": live_stays,
}
