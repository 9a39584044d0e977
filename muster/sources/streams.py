"""Punches as a stream, and finite runs of a stream into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.model import EVENT_SCHEMA
from muster.session import scratch
from muster.sources.tables import as_punches


def event_time(stream: DataFrame) -> DataFrame:
    """``ts`` as ``timestamp``: a watermark is refused on ``timestamp_ntz``."""
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def punch_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Parquet event files under ``path`` as they arrive.

    Pass ``maxBytesPerTrigger`` or ``maxFilesPerTrigger`` to bound a micro-batch.
    """
    files = spark.readStream.schema(EVENT_SCHEMA).options(**options).parquet(path)
    return event_time(as_punches(files))


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all input there is now into a parquet table and return the table.

    The table and the checkpoint lie in the shared scratch folder. The file sink
    commits whole batches, so a restart from the checkpoint repeats no row.
    """
    return drain_into(stream, scratch(stream.sparkSession, name))


def drain_into(stream: DataFrame, path: str) -> DataFrame:
    """The same under a given path; called again with the same stream, it goes on where it ended."""
    spark = stream.sparkSession
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/table")
