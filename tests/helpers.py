"""Small inputs and comparisons for the tests."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession


def at(day: int, hour: int = 0, minute: int = 0, second: int = 0, us: int = 0) -> datetime:
    return datetime(2024, 1, day, hour, minute, second, us)


def d(day: int) -> date:
    return date(2024, 1, day)


def make_punches(spark: SparkSession, rows: list[tuple[int, datetime]]) -> DataFrame:
    """Punches ``(person, ts)`` numbered in the given order."""
    data = [(i, person, ts) for i, (person, ts) in enumerate(rows, 1)]
    return spark.createDataFrame(data, "punch_id long, person long, ts timestamp_ntz")


def rows(df: DataFrame, *columns: str) -> list[tuple]:
    return sorted((tuple(r) for r in df.select(*(columns or sorted(df.columns))).collect()), key=repr)


def final_plan(df: DataFrame) -> str:
    """The plan that really ran, after AQE."""
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
