"""A site's own rules as vectorised Python."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def apply_policy(
    records: DataFrame,
    keys: Sequence[str],
    fn: Callable[[pd.DataFrame], pd.DataFrame],
    schema: T.StructType | str,
) -> DataFrame:
    """Run ``fn`` on each group of day records, e.g. a person's month.

    ``records`` holds one row per person and day (an operator's daily result, not
    raw punches), so with ``person`` among the keys a group is never larger than
    the number of days.

    Groups are that small, so most of a grouped map's time would go into one Arrow
    batch per group. Here the rows come sorted by key in full batches and are cut
    into groups in the task; a group that goes on in the next batch waits for it.
    The number of partitions is given, since AQE would merge them by their few
    bytes while the Python work per byte is large.
    """
    if "person" not in keys:
        raise ValueError("a policy group must be within one person")
    if not {"person", "day"} <= set(records.columns):
        raise ValueError("records must be per person and day")
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            starts = group_starts(rows, keys)
            yield from call(rows, starts)
            rest = rows.iloc[starts[-1] :]
        if rest is not None:
            yield from call(rest, [0, len(rest)])

    def call(rows: pd.DataFrame, bounds: Sequence[int]) -> Iterator[pd.DataFrame]:
        results = [fn(rows.iloc[a:b].reset_index(drop=True)) for a, b in zip(bounds, bounds[1:])]
        if results:
            yield pd.concat(results, ignore_index=True)

    partitions = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return records.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


def group_starts(rows: pd.DataFrame, keys: Sequence[str]) -> list[int]:
    """Positions at which a new group begins in rows sorted by ``keys``."""
    groups = rows.groupby(list(keys), sort=False, dropna=False).ngroup().to_numpy()
    return [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist()]


def classify(
    col: Column | str, fn: Callable[[pd.Series], pd.Series], returns: T.DataType | str = "string"
) -> Column:
    """Apply a scalar rule to a column, one Arrow batch at a time."""

    def rule(values: pd.Series) -> pd.Series:
        return fn(values)

    return F.pandas_udf(rule, returns)(col)
