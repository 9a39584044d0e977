"""Continuous forms of the batch operators.

Input is a streaming DataFrame whose ``ts`` is a ``timestamp``. Each function
sets its own watermark of ``lateness`` and works in append mode: a result is
emitted once, when the watermark has passed it. A finite run therefore leaves out
what is still open at its last watermark.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def seconds(span: timedelta) -> str:
    return f"{int(span.total_seconds())} seconds"


def live_counts(stream: DataFrame, width: timedelta, lateness: timedelta) -> DataFrame:
    """Punches per time bucket."""
    return (
        stream.withWatermark("ts", seconds(lateness))
        .groupBy(F.window("ts", seconds(width)).alias("w"))
        .agg(F.count(F.lit(1)).alias("punches"))
        .select(F.col("w.start").alias("window_start"), "punches")
    )


def live_dedup(stream: DataFrame, lateness: timedelta, salts: int = 1) -> DataFrame:
    """Each punch id once, when its copies arrive within ``lateness``.

    State is kept per punch id and dropped by the watermark, so it is bounded by
    the punches of that span. All copies of an id meet in one task. Where one id
    may be sent very often, ``salts`` above 1 first drops copies in that many
    tasks, so that at most one copy per salt meets; it doubles the state. Punches without an
    id are copies of each other only where all columns are equal.
    """
    rows = stream.withWatermark("ts", seconds(lateness))
    without_id = F.when(F.col("punch_id").isNull(), F.to_json(F.struct(*stream.columns)))
    rows = rows.withColumn("_row", F.sha2(without_id, 256))
    if salts > 1:
        salted = rows.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        rows = salted.dropDuplicatesWithinWatermark(["punch_id", "_row", "_salt"]).drop("_salt")
    return rows.dropDuplicatesWithinWatermark(["punch_id", "_row"]).drop("_row")


def live_sessions(stream: DataFrame, gap: timedelta, lateness: timedelta) -> DataFrame:
    """Runs of a person's punches closer than ``gap``."""
    return (
        stream.withWatermark("ts", seconds(lateness))
        .groupBy("person", F.session_window("ts", seconds(gap)).alias("s"))
        .agg(F.count(F.lit(1)).alias("punches"))
        .select(
            "person",
            F.col("s.start").alias("session_start"),
            F.col("s.end").alias("session_end"),
            "punches",
        )
    )


def live_enrich(stream: DataFrame, roster: DataFrame) -> DataFrame:
    """Add the roster's columns; unknown persons keep nulls. Needs no state."""
    return stream.join(roster, "person", "left")


def live_unmatched(
    ins: DataFrame, outs: DataFrame, within: timedelta, lateness: timedelta, slices: int = 12
) -> DataFrame:
    """Check-ins that no check-out of the person followed within ``within``.

    ``within`` is cut into ``slices`` of whole seconds. Of the check-outs in one
    slice of time only the first and the last matter: the last one tells whether
    any follows a check-in of the same slice, the first one whether any falls in a
    later slice before the bound is over. So check-outs are reduced to one row per
    person and slice. Check-ins and slices meet by person and period of ``within``;
    a slice serves its own period and the one before, so it is held twice, and a
    check-in meets at most ``2 * slices`` rows, however many check-outs there are.
    The answer comes one slice after the bound.
    """
    width = int(within.total_seconds()) // slices
    if width * slices != within.total_seconds():
        raise ValueError("within must be a whole number of seconds per slice")
    delay = seconds(lateness)

    def slice_of(ts):
        return F.call_function("div", F.unix_seconds(ts), F.lit(width))

    def period_of(slice_):
        return F.call_function("div", slice_, F.lit(slices))

    ins = ins.withWatermark("ts", delay).withColumn("_slice", slice_of(F.col("ts"))).withColumn("_period", period_of(F.col("_slice")))
    bounds = (
        outs.withWatermark("ts", delay)
        .groupBy("person", F.window("ts", f"{width} seconds").alias("_w"))
        .agg(F.min("ts").alias("_first"), F.max("ts").alias("_last"))
        .select(
            F.col("person").alias("_person"),
            F.window_time("_w").alias("_time"),
            "_first",
            "_last",
            slice_of(F.col("_w.start")).alias("_out_slice"),
        )
        .select("*", F.explode(F.array(period_of(F.col("_out_slice")), period_of(F.col("_out_slice")) - 1)).alias("_served"))
    )
    end = F.col("ts") + F.expr(f"INTERVAL {width * slices} SECONDS")
    match = (
        (F.col("person") == F.col("_person"))
        & (F.col("_period") == F.col("_served"))
        & F.when(F.col("_slice") == F.col("_out_slice"), F.col("_last") > F.col("ts")).otherwise(
            (F.col("_slice") < F.col("_out_slice")) & (F.col("_first") <= end)
        )
        & (F.col("_time") >= F.col("ts"))
        & (F.col("_time") <= F.col("ts") + F.expr(f"INTERVAL {width * (slices + 1)} SECONDS"))
    )
    joined = ins.join(bounds, match, "leftOuter")
    return joined.filter(F.col("_person").isNull()).select([c for c in ins.columns if c not in ("_slice", "_period")])
