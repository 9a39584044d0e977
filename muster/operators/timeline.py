"""A person's punches along time, across days."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muster.functions.skew import carry_before, split_hot, total_before
from muster.functions.times import bucket
from muster.functions.windows import by_person
from muster.model import HOT_ROWS

SO_FAR = (Window.unboundedPreceding, Window.currentRow)


def presence_sessions(punches: DataFrame, gap: timedelta, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Runs of punches closer than ``gap``; a session ends ``gap`` after its last one.

    Punches in one gap-wide bucket are always in one session, so they are merged
    first. For a large person that happens map-side: what is put in order is at
    most one row per bucket. All others are shuffled once, by person.
    """
    few, many = split_hot(punches.select("person", "ts"), ["person"], hot_rows)
    return _sessions(few.repartition("person"), gap).unionByName(_sessions(many, gap))


def _sessions(rows: DataFrame, gap: timedelta) -> DataFrame:
    merged = rows.groupBy("person", bucket(F.col("ts"), gap).alias("_bucket")).agg(
        F.min("ts").alias("first"), F.max("ts").alias("last"), F.count(F.lit(1)).alias("n")
    )
    order = by_person("_bucket")
    starts = F.coalesce(F.col("first") - F.lag("last").over(order) >= F.lit(gap), F.lit(True))
    return (
        merged.withColumn("_starts", starts.cast("int"))
        .withColumn("_session", F.sum("_starts").over(order.rowsBetween(*SO_FAR)))
        .groupBy("person", "_session")
        .agg(
            F.min("first").alias("session_start"),
            (F.max("last") + F.lit(gap)).alias("session_end"),
            F.sum("n").alias("punches"),
        )
        .drop("_session")
    )


def close_punches(punches: DataFrame, within: timedelta, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Instants at which a person punched closer than ``within`` to another punch.

    ``earlier`` counts the person's punches before the instant and closer than
    ``within``; ``pairs`` the pairs that the punches of this instant form with
    those and with each other. Counting instead of listing pairs keeps the result
    no larger than the punches: arrivals add, and leave the count ``within``
    later, so one running sum answers it.
    """
    few, many = split_hot(punches.select("person", "ts"), ["person"], hot_rows)
    order = by_person("ts", "is_punch").rowsBetween(Window.unboundedPreceding, -1)
    moves = _moves(few.repartition("person"), within)
    counted = moves.withColumn("earlier", F.coalesce(F.sum("change").over(order), F.lit(0)))
    counted = counted.unionByName(total_before(_moves(many, within), ["person"], "change", "earlier", ["is_punch"]))
    n = F.col("change")
    pairs = n * F.col("earlier") + F.call_function("div", n * (n - 1), F.lit(2))
    return (
        counted.filter("is_punch")
        .select("person", "ts", n.alias("punches"), "earlier", pairs.alias("pairs"))
        .filter(F.col("pairs") > 0)
    )


def _moves(rows: DataFrame, within: timedelta) -> DataFrame:
    """+n at each instant and -n when its punches are no longer close."""
    instants = rows.groupBy("person", "ts").agg(F.count(F.lit(1)).alias("n"))
    moves = F.array(
        F.struct(F.col("ts"), F.lit(True).alias("is_punch"), F.col("n").alias("change")),
        F.struct(
            (F.col("ts") + F.lit(within)).alias("ts"), F.lit(False).alias("is_punch"), (-F.col("n")).alias("change")
        ),
    )
    return instants.select("person", F.inline(moves))


def last_before(punches: DataFrame, others: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """For each punch, the person's latest row of ``others`` at or before it.

    A row of ``others`` without a time comes before none, a punch without one has none.
    """
    cols = ["person", "ts", "punch_id"]
    rows = (
        punches.select(*cols)
        .withColumn("is_other", F.lit(False))
        .unionByName(others.select(*cols).filter(F.col("ts").isNotNull()).withColumn("is_other", F.lit(True)))
    )
    few, many = split_hot(rows, ["person"], hot_rows)
    found = F.when(F.col("is_other"), F.struct("ts", "punch_id"))

    order = by_person("ts", F.col("is_other").desc(), "punch_id").rowsBetween(*SO_FAR)
    plain = few.withColumn("_last", F.last(found, ignorenulls=True).over(order)).filter(~F.col("is_other"))

    instants = many.groupBy("person", "ts").agg(F.max(found).alias("other"))
    answers = carry_before(instants, ["person"], "other", F.max, "earlier").select(
        "person", "ts", F.greatest("other", "earlier").alias("_last")
    )
    answers = answers.select(F.col("person").alias("_p"), F.col("ts").alias("_t"), "_last")
    same = F.col("person").eqNullSafe(F.col("_p")) & (F.col("ts") == F.col("_t"))
    sliced = many.filter(~F.col("is_other")).join(answers, same, "left").drop("_p", "_t")
    return plain.unionByName(sliced).select(
        "punch_id",
        "person",
        "ts",
        F.col("_last.ts").alias("last_ts"),
        F.col("_last.punch_id").alias("last_id"),
    )
