"""Writing the register, one folder per day."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import DataFrame, SparkSession


def write_register(df: DataFrame, path: str, emptied: Iterable[date] = ()) -> None:
    """Replace the days found in ``df``, drop the days ``emptied``; leave all others as they are.

    ``rebalance`` gives each day few files without forcing a day into one task:
    AQE splits a large day and merges small ones. A task that is run again
    replaces its own output, so losing an executor leaves no double rows.
    """
    (
        df.hint("rebalance", "day")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("day")
        .parquet(path)
    )
    spark = df.sparkSession
    for day in emptied:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={day:%Y-%m-%d}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_register(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
