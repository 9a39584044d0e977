"""Ordered work on groups too large for one task.

A window over a person's punches puts the whole person into one task. When one
person holds a large part of the table that task never ends. The helpers here
keep every window group under a bound that follows from the calendar, not from
the data:

* rows of one group with the same time are merged first (map-side combine), so a
  second holds at most 10**6 rows, one per microsecond;
* a day holds at most 86 400 seconds;
* a group holds one row per day of its history.

``carry_before`` runs a running aggregate over those three levels. It costs more
shuffles than a plain window, so ``split_hot`` sends only the large groups there.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from muster.functions.times import second_of_day
from muster.model import HOT_ROWS

# Copies of one row are spread over tasks in chunks of this many.
CHUNK = 10_000


def split_hot(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """Split ``df`` into groups of at most ``hot_rows`` rows and larger ones.

    The list of large groups is broadcast: it has fewer than ``rows / hot_rows``
    entries. It is found key by key: a large person-day can only be a day of a
    large person, so days are counted for large persons alone. Counting reads the
    key columns and combines map-side. When no group is large, AQE sees the empty
    list and removes the joins and the whole second branch from the running plan.
    """
    rows = df
    for depth in range(1, len(keys) + 1):
        key = list(keys[:depth])
        counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
        # Null is a group like any other: rows without a person may be the largest one.
        hot = F.broadcast(counts.filter(F.col("_n") > hot_rows).select(*[F.col(k).alias(f"_hot_{k}") for k in key]))
        same = [F.col(k).eqNullSafe(F.col(f"_hot_{k}")) for k in key]
        rows = df.join(hot, same, "left_semi")
    return df.join(hot, same, "left_anti"), rows


def carry_before(
    rows: DataFrame,
    keys: Sequence[str],
    value: str,
    agg: Callable[[str], Column],
    name: str,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: ``agg(value)`` over all rows of the group before each row.

    ``rows`` must be unique on ``(*keys, ts, *tie)``; ``name`` is null where
    nothing comes before. Each level hands its result to the next as one more row
    in front of the group, so there is no join and only the last level shuffles
    the rows themselves.
    """
    day, second = [*keys, "_day"], [*keys, "_day", "_sec"]
    rows = rows.withColumns({"_day": F.to_date("ts"), "_sec": second_of_day(F.col("ts")), "_row": F.lit(True)})
    seconds = rows.groupBy(*second).agg(agg(value).alias(value))
    days = seconds.groupBy(*day).agg(agg(value).alias(value))

    def before(df: DataFrame, part: Sequence[str], *order: str) -> DataFrame:
        earlier = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, agg(value).over(earlier))

    past = before(days, keys, "_day").select(*day, F.lit(-1).alias("_sec"), F.col(name).alias(value))
    in_day = before(seconds.unionByName(past), day, "_sec").filter(F.col("_sec") >= 0)
    carried = in_day.select(*second, F.lit(False).alias("_row"), F.col(name).alias(value))
    return (
        before(rows.unionByName(carried, allowMissingColumns=True), second, "_row", "ts", *tie)
        .filter("_row")
        .drop("_day", "_sec", "_row")
    )


def total_before(rows: DataFrame, keys: Sequence[str], value: str, name: str, tie: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the sum of ``value`` over all earlier rows of the group."""
    summed = carry_before(rows, keys, value, F.sum, name, tie)
    return summed.withColumn(name, F.coalesce(F.col(name), F.lit(0)))


def repeat_rows(df: DataFrame, copies: str, by: Sequence[str]) -> DataFrame:
    """Each row ``copies`` times (none for 0), large counts spread over tasks."""
    last = F.call_function("div", F.col(copies) - 1, F.lit(CHUNK))
    chunks = df.filter(F.col(copies) > 0).withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    size = F.least(F.lit(CHUNK), F.col(copies) - F.col("_chunk") * CHUNK)
    return (
        chunks.repartition(*by, "_chunk")
        .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), size.cast("long"))))
        .drop("_chunk", "_copy", copies)
    )
