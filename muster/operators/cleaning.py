"""From raw punches to clean ones."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.functions.skew import split_hot
from muster.functions.times import bucket, workday
from muster.functions.windows import by_person
from muster.model import ATTRIBUTES_SCHEMA, HOT_ROWS


def drop_repeats(punches: DataFrame, gap: timedelta, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Drop a punch less than ``gap`` after the same person's previous raw punch.

    A punch without a time is kept; it is before no other.
    """
    few, many = split_hot(punches, ["person"], hot_rows)
    order = by_person("ts", "punch_id")
    kept = few.withColumn("_prev", F.lag("ts").over(order)).filter(_apart("_prev", "ts", gap)).drop("_prev")

    # In a bucket as wide as the gap only the first punch can be kept, so a large
    # person shrinks map-side to one row per bucket before being put in order.
    row = F.min_by(F.struct(*punches.columns), F.struct("ts", "punch_id"))
    firsts = (
        many.filter(F.col("ts").isNotNull())
        .groupBy("person", bucket(F.col("ts"), gap).alias("_bucket"))
        .agg(row.alias("_row"), F.max("ts").alias("_last"))
        .withColumn("_prev", F.lag("_last").over(by_person("_bucket")))
        .filter(_apart("_prev", "_row.ts", gap))
        .select("_row.*")
    )
    return kept.unionByName(firsts).unionByName(many.filter(F.col("ts").isNull()))


def _apart(before: str, after: str, gap: timedelta):
    return F.col(before).isNull() | (F.col(after) - F.col(before) >= F.lit(gap))


def apply_corrections(punches: DataFrame, corrections: DataFrame) -> DataFrame:
    """Latest version of each punch id wins; unknown ids are added.

    ``corrections`` has the columns of ``punches`` and a ``version``; a punch as
    recorded is older than any correction. A correction without a version or an id
    is ignored; of two with one version the later time, then the greater person
    wins. The newest correction per id is found
    with a map-side combine, then replaces the recorded row through an anti join:
    when the corrections are small, which AQE measures, punches are not shuffled.
    """
    row = F.struct(*punches.columns)
    usable = corrections.filter(F.col("version").isNotNull() & F.col("punch_id").isNotNull())
    latest = usable.groupBy("punch_id").agg(F.max_by(row, F.struct("version", "ts", "person")).alias("_row")).select("_row.*")
    return punches.join(latest.select("punch_id"), "punch_id", "left_anti").unionByName(latest)


def assign_workday(punches: DataFrame, cutoff: timedelta = timedelta(0)) -> DataFrame:
    """Add ``day``; a punch before ``cutoff`` counts to the day before."""
    return punches.withColumn("day", workday(F.col("ts"), cutoff))


def with_day(punches: DataFrame) -> DataFrame:
    """``punches`` with a ``day``: the given one, or the calendar day."""
    return punches if "day" in punches.columns else assign_workday(punches)


def parse_attributes(punches: DataFrame, schema: T.StructType = ATTRIBUTES_SCHEMA, column: str = "props") -> DataFrame:
    """Replace the JSON text by typed columns; unreadable text gives nulls."""
    parsed = F.from_json(column, schema, {"mode": "PERMISSIVE"})
    return punches.withColumn("_json", parsed).select("*", "_json.*").drop("_json", column)
