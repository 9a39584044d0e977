"""The given tables as punches, roster, organisation and calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def as_punches(events: DataFrame) -> DataFrame:
    """Event rows under the names of :mod:`muster.model`."""
    return events.select(
        F.col("event_id").alias("punch_id"),
        F.col("user_id").alias("person"),
        "ts",
        F.col("event_type").alias("kind"),
        "value",
        "props",
    )


def punches(spark: SparkSession, folder: str) -> DataFrame:
    return as_punches(table(spark, folder, "events"))


def roster(spark: SparkSession, folder: str) -> DataFrame:
    """Persons who are expected: customers with at least one punch.

    The distinct comes first, so that the semi join shuffles one row per person
    and not every punch.
    """
    seen = punches(spark, folder).select("person").distinct()
    people = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("person"),
        F.col("c_nationkey").alias("nation_id"),
        F.col("c_mktsegment").alias("cohort"),
    )
    return people.join(seen, "person", "left_semi")


def organisation(spark: SparkSession, folder: str) -> DataFrame:
    """Nation and region names by ``nation_id``."""
    nation = table(spark, folder, "nation")
    region = table(spark, folder, "region")
    return nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("nation"), F.col("r_name").alias("region")
    )


def calendar(spark: SparkSession, folder: str) -> DataFrame:
    """Days on which anybody punched."""
    return punches(spark, folder).select(F.to_date("ts").alias("day")).distinct()
