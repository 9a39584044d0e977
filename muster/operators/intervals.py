"""In/out intervals within a person's workday."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muster.functions.skew import repeat_rows, split_hot, total_before
from muster.functions.times import whole_minutes
from muster.model import HOT_ROWS
from muster.operators.cleaning import with_day

GROUP = ["person", "day"]


def pair_punches(punches: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Odd punches of the day are in, the next one is out; an odd tail stays open."""
    rows = with_day(punches).select("person", "day", "ts", "punch_id")
    few, many = split_hot(rows, GROUP, hot_rows)
    return _pair_rows(few).unionByName(_pair_instants(many))


def _pair_rows(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy(*GROUP).orderBy("ts", "punch_id")
    return (
        rows.withColumn("_nth", F.row_number().over(order))
        .withColumn("out_ts", F.lead("ts").over(order))
        .filter(F.col("_nth") % 2 == 1)
        .select("person", "day", F.col("ts").alias("in_ts"), "out_ts")
    )


def _pair_instants(rows: DataFrame) -> DataFrame:
    """The same for large person-days: punches are counted, not ranked.

    With ``before`` earlier punches, the ``n`` punches of one instant take the
    ranks ``before + 1 .. before + n``. An even first rank closes a pair, an odd
    last rank opens one, and whatever lies between forms pairs of no length.
    """
    instants = rows.groupBy(*GROUP, "ts").agg(F.count(F.lit(1)).alias("n"))
    ranked = total_before(instants, GROUP, "n", "before").withColumn("last", F.col("before") + F.col("n"))
    closes, opens = F.col("before") % 2, F.col("last") % 2

    def pair_of(rank):
        return F.call_function("div", rank + 1, F.lit(2))

    marks = F.array(
        F.struct(pair_of(F.col("before")).alias("pair"), (closes == 1).alias("use"), F.lit(False).alias("is_in")),
        F.struct(pair_of(F.col("last")).alias("pair"), (opens == 1).alias("use"), F.lit(True).alias("is_in")),
    )
    spanning = (
        ranked.withColumn("m", F.explode(marks))
        .filter("m.use")
        .groupBy(*GROUP, "m.pair")
        .agg(
            F.max(F.when(F.col("m.is_in"), F.col("ts"))).alias("in_ts"),
            F.max(F.when(~F.col("m.is_in"), F.col("ts"))).alias("out_ts"),
        )
        .drop("pair")
    )
    inside = F.call_function("div", F.col("n") - closes - opens, F.lit(2))
    instant = repeat_rows(
        ranked.select(*GROUP, F.col("ts").alias("in_ts"), F.col("ts").alias("out_ts"), inside.alias("copies")),
        "copies",
        [*GROUP, "in_ts"],
    )
    return spanning.unionByName(instant)


def open_intervals(intervals: DataFrame) -> DataFrame:
    """Intervals without a check-out."""
    return intervals.filter(F.col("out_ts").isNull()).drop("out_ts")


def worked_minutes(intervals: DataFrame) -> DataFrame:
    """Whole minutes of each closed interval, summed per person-day."""
    minutes = whole_minutes(F.col("in_ts"), F.col("out_ts"))
    return (
        intervals.filter(F.col("out_ts").isNotNull())
        .groupBy(*GROUP)
        .agg(F.sum(minutes).alias("minutes"), F.count(F.lit(1)).alias("intervals"))
    )


def overtime(worked: DataFrame, threshold: int) -> DataFrame:
    """Minutes above ``threshold`` of each person-day that has any."""
    over = worked.filter(F.col("minutes") > threshold)
    return over.select(*GROUP, "minutes", (F.col("minutes") - threshold).alias("overtime"))
