"""Reading punch files that may be malformed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.model import PUNCH_SCHEMA

CORRUPT = "_corrupt_record"
REQUIRED = ("punch_id", "person", "ts")


def read_punches(
    spark: SparkSession,
    path: str,
    format: str = "csv",
    schema: T.StructType = PUNCH_SCHEMA,
    **options: str,
) -> tuple[DataFrame, DataFrame]:
    """Read csv, json, parquet or orc into ``(good, bad)``.

    The schema is declared, never inferred, so a read is one pass. A row that
    does not parse, or lacks a required value, goes to ``bad`` with its raw text
    in ``_corrupt_record`` and the cause in ``reason``; the read never fails and
    no row is lost.
    """
    text = format in ("csv", "json")
    declared = T.StructType(list(schema.fields) + ([T.StructField(CORRUPT, T.StringType())] if text else []))
    reader = spark.read.schema(declared).options(**options)
    if text:
        # Without pruning a row is judged on all its fields, whatever is selected later.
        reader = reader.options(mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, columnPruning="false")
    rows = reader.format(format).load(path)
    if not text:
        rows = rows.withColumn(CORRUPT, F.lit(None).cast("string"))

    missing = F.lit(False)
    for name in REQUIRED:
        missing = missing | F.col(name).isNull()
    reason = F.when(F.col(CORRUPT).isNotNull(), "malformed").when(missing, "missing")
    rows = rows.withColumn("reason", reason)
    good = rows.filter(F.col("reason").isNull()).drop(CORRUPT, "reason")
    return good, rows.filter(F.col("reason").isNotNull())
