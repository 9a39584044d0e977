"""Column names and schemas shared by every operator.

A *punch* is one check-in or check-out reading. Operators take and return plain
DataFrames and agree only on the column names below.

========  =============  ====================================================
column    type           meaning
========  =============  ====================================================
person    bigint         who punched
ts        timestamp_ntz  local wall-clock time (``timestamp`` in streams)
punch_id  bigint         unique; ``(ts, punch_id)`` is the punch order
day       date           workday the punch counts to
========  =============  ====================================================
"""

from __future__ import annotations

from pyspark.sql import types as T

PUNCH_SCHEMA = T.StructType(
    [
        T.StructField("punch_id", T.LongType()),
        T.StructField("person", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
    ]
)

ATTRIBUTES_SCHEMA = T.StructType([T.StructField("k", T.IntegerType())])

# Layout of the event table that punches are taken from.
EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)

# A person (or person-day) with more rows than this is worked on in time slices
# instead of in one task. See functions.skew.
HOT_ROWS = 5_000_000
