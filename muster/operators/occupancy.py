"""How many people are present."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions.skew import total_before

HOUR = timedelta(hours=1)


def occupancy(intervals: DataFrame) -> DataFrame:
    """Number present after each instant at which somebody came or left.

    Only closed intervals count. All changes of one instant are taken together.
    The running total over the whole table is built from seconds, days and their
    offsets, so no task sees more than a second, a day's seconds or the days.
    """
    sides = F.array(
        F.struct(F.col("in_ts").alias("ts"), F.lit(1).alias("came"), F.lit(0).alias("left")),
        F.struct(F.col("out_ts").alias("ts"), F.lit(0).alias("came"), F.lit(1).alias("left")),
    )
    changes = (
        intervals.filter(F.col("out_ts").isNotNull())
        .select(F.inline(sides))
        .groupBy("ts")
        .agg(F.sum("came").alias("came"), F.sum("left").alias("left"))
        .withColumn("change", F.col("came") - F.col("left"))
    )
    counted = total_before(changes, [], "change", "before")
    return counted.select("ts", "came", "left", (F.col("before") + F.col("change")).alias("present"))


def occupancy_by_hour(daily: DataFrame) -> DataFrame:
    """People whose day, from first to last punch, touches each hour.

    Person-days with the same first and last hour are counted before they are
    spread over their hours, so few rows are exploded. Hours are counted from the
    workday's midnight and may pass 24 when the workday ends in the night.
    """
    midnight = F.col("day").cast("timestamp_ntz")

    def hour_of(ts: str):
        return F.call_function("div", F.col(ts) - midnight, F.lit(HOUR))

    spans = daily.groupBy("day", hour_of("first_in").alias("h1"), hour_of("last_out").alias("h2")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        spans.select("day", F.explode(F.sequence("h1", "h2")).alias("hour"), "n")
        .groupBy((midnight + F.col("hour") * F.lit(HOUR)).alias("hour_start"))
        .agg(F.sum("n").alias("people"))
    )
