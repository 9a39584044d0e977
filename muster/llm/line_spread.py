"""Line dedup by distinct-site spread.

Each distinct line gets a HyperLogLog sketch of the sites it occurs on; sketches
merge by aggregation, map-side first. A line whose estimate is clear of the
threshold is decided by it, a line near the threshold by its exact number of
distinct sites. A line on ``min_sites`` sites or more is boilerplate and is
removed everywhere but at its first place (smallest ``doc_id``, then earliest
line), so a text that is copied across sites survives once.

Edge cases: a null text has no lines and stays null; a null site is a site of its
own; a null ``doc_id`` is kept and sorts first; lines are compared without leading
and trailing blanks, tabs and carriage returns; blank lines are never boilerplate;
repeated rows of a document are all treated alike; an empty table gives an empty
one. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_SITES = 10
SKETCH_LOG_SIZE = 12
NEAR_ERRORS = 4.0


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """96 bits of hash of the trimmed line; null for a blank one."""
    bare = F.trim(line, F.lit(" \t\r"))
    return F.when(bare != "", F.struct(F.xxhash64(bare).alias("h"), F.hash(bare).alias("g")))


def line_places(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("th"),
        F.coalesce(F.col(site_col).cast("string"), F.lit("\x00none")).alias("site"),
        F.posexplode(lines_of(F.col(text_col))).alias("pos", "line"),
    )
    return rows.select("id", "th", "site", "pos", line_key(F.col("line")).alias("key")).where("key IS NOT NULL")


def boilerplate_lines(
    places: DataFrame, min_sites: int = MIN_SITES, log_size: int = SKETCH_LOG_SIZE, near_errors: float = NEAR_ERRORS
) -> DataFrame:
    """``key`` and first place (``first.id``, ``first.pos``) of each line on ``min_sites`` sites or more."""
    spread = places.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(log_size))).alias("sites"),
        F.min(F.struct("id", "pos")).alias("first"),
    )
    margin = max(1, math.ceil(near_errors * 1.04 / math.sqrt(2**log_size) * min_sites))
    likely = spread.where(F.col("sites") >= min_sites - margin)
    sure = likely.where(F.col("sites") > min_sites + margin).select("key", "first")
    near = likely.where(F.col("sites") <= min_sites + margin)
    # Site and line pairs are made distinct map-side before the exact count.
    exact = (
        places.join(near.select("key"), "key", "left_semi")
        .select("key", "site").distinct().groupBy("key").agg(F.count("*").alias("exact")).where(F.col("exact") >= min_sites)
    )
    return sure.unionByName(near.join(exact.select("key"), "key", "left_semi").select("key", "first"))


def remove_spread_lines(
    docs: DataFrame, min_sites: int = MIN_SITES, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source"
) -> DataFrame:
    """``docs`` with the lines removed from the text, and ``n_lines`` and ``n_removed`` as ``_n_lines``, ``_n_removed``."""
    places = line_places(docs, id_col, text_col, site_col)
    hits = places.join(boilerplate_lines(places, min_sites), "key")
    # Rows that share an id are told apart by their text.
    marks = hits.groupBy(F.col("id").alias("__id"), F.col("th").alias("__th")).agg(
        F.collect_set("key").alias("__bad"),
        F.collect_set(F.when(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("pos") == F.col("first.pos")), F.col("pos"))).alias("__first"),
    )
    joined = docs.join(marks, F.col(id_col).eqNullSafe(F.col("__id")) & (F.xxhash64(text_col) == F.col("__th")), "left").drop("__id", "__th")
    lines = lines_of(F.col(text_col))
    kept = F.filter(
        lines,
        lambda line, i: ~F.coalesce(F.array_contains(F.col("__bad"), line_key(line)), F.lit(False)) | F.array_contains(F.col("__first"), i),
    )
    kept = F.when(F.col("__bad").isNull(), lines).otherwise(kept)
    out = joined.withColumn("__kept", kept)
    return (
        out.withColumn("_n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("_n_removed", F.col("_n_lines") - F.when(F.col(text_col).isNull(), 0).otherwise(F.size("__kept")))
        .withColumn(text_col, F.array_join("__kept", "\n"))
        .drop("__kept", "__bad", "__first")
    )
