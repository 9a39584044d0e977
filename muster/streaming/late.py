"""Late punches: kept apart, then settled into the register.

A watermark drops late rows silently, and its metric counts them only after
partial aggregation. So lateness is decided here on the raw rows, and nothing is
dropped.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.operators.cleaning import with_day
from muster.operators.daily import daily_attendance
from muster.sources.register import read_register, write_register


def late_punches(stream: DataFrame, store: str, lateness: timedelta) -> StreamingQuery:
    """Store every punch with a flag ``late`` under ``store``, all input there is now.

    A punch is late when its time is more than ``lateness`` before the latest
    time of all earlier batches.
    """
    first = stream.sparkSession.range(1).select(F.lit(None).cast("timestamp").alias("mark"))
    first.write.mode("overwrite").parquet(f"{store}/marks/batch=-1")
    return (
        stream.writeStream.foreachBatch(lambda batch, batch_id: route_batch(batch, batch_id, store, lateness))
        .option("checkpointLocation", f"{store}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def route_batch(batch: DataFrame, batch_id: int, store: str, lateness: timedelta) -> None:
    """Write one batch to folders of its own, reading only marks of earlier ones.

    A batch that is repeated after a failure therefore gives the same result.
    """
    spark = batch.sparkSession
    marks = spark.read.parquet(f"{store}/marks").filter(F.col("batch") < batch_id)
    mark = marks.agg(F.max("mark")).scalar()
    late = F.coalesce(F.col("ts") < mark - F.lit(lateness), F.lit(False))
    flagged = with_day(batch).withColumn("late", late)
    own = f"{store}/punches/batch={batch_id}"
    flagged.hint("rebalance", "late", "day").write.mode("overwrite").partitionBy("late", "day").parquet(own)
    newest = spark.read.schema(flagged.schema).parquet(own).agg(F.max("ts").alias("mark"))
    newest.write.mode("overwrite").parquet(f"{store}/marks/batch={batch_id}")


def stored_punches(spark: SparkSession, store: str) -> DataFrame:
    rows = spark.read.parquet(f"{store}/punches")
    return rows.withColumn("late", F.col("late").cast("boolean"))


def settle_late(spark: SparkSession, store: str, register: str) -> None:
    """Add the late punches of batches not settled yet to the register.

    They are merged into the register's row of their person and day; rows of other
    persons and days stay, also those of punches the store never saw.

    The merged days are first written to the store, whole, and then copied over the
    register's. A run that broke off in between leaves merged days without a mark; they
    are copied again and marked before any newer batch is merged. So every merge begins
    from a register that holds all batches before it and none after, and no punch is
    counted twice, wherever a run ends and whatever arrives meanwhile. Nobody else
    may rewrite the days of the register between a broken run and the next one.
    """
    pending, settled = f"{store}/pending", f"{store}/settled"
    last = max(_numbers(spark, settled), default=-1)
    for merged in sorted(n for n in _numbers(spark, pending, finished=True) if n > last):
        last = _copy_merged(spark, pending, settled, register, merged)
    newest = max(_numbers(spark, f"{store}/punches", finished=True), default=-1)
    if newest > last:
        late = stored_punches(spark, store).filter(F.col("late") & (F.col("batch") > last) & (F.col("batch") <= newest))
        fresh = daily_attendance(late.drop("batch", "late"))
        days = F.broadcast(fresh.select("day").distinct())  # one row per date
        rows = read_register(spark, register)
        merged = rows.join(days, "day", "left_semi").unionByName(fresh.select(*rows.columns))
        merged = merged.groupBy("person", "day").agg(
            F.min("first_in").alias("first_in"), F.max("last_out").alias("last_out"), F.sum("punches").alias("punches")
        )
        merged.write.mode("overwrite").parquet(f"{pending}/batch={newest}")
        _copy_merged(spark, pending, settled, register, newest)


def _copy_merged(spark: SparkSession, pending: str, settled: str, register: str, batch: int) -> int:
    """Replace the register's days by the merged ones, then mark all batches up to ``batch`` as settled."""
    write_register(spark.read.parquet(f"{pending}/batch={batch}"), register)
    spark.range(1).write.mode("overwrite").parquet(f"{settled}/batch={batch}")
    return batch


def _numbers(spark: SparkSession, path: str, finished: bool = False) -> list[int]:
    """The batches that have a folder under ``path``; with ``finished``, whose writing ended well."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    own = [x.getPath() for x in files.listStatus(folder) if x.getPath().getName().startswith("batch=")]
    mark = spark._jvm.org.apache.hadoop.fs.Path
    return [int(p.getName()[6:]) for p in own if not finished or files.exists(mark(p, "_SUCCESS"))]
