"""What several operators of this subpackage share: tables, written results, ranks, words as numbers."""

from __future__ import annotations

import ctypes
import gc
import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from muster.session import scratch
from muster.sources.tables import table

__all__ = ["table", "scratch"]

# The bytes between words, as the contracts state them.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
# Bytes of text handled at a time; a longer text is a block of its own.
BLOCK_BYTES = 4 << 20
# Bytes whose words are hashed at a time: every byte takes some 40 bytes meanwhile.
HASHED_BYTES = 512 << 10

U = np.uint64


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str, per_bucket: int = 100_000) -> DataFrame:
    """Adds ``name``: the row's rank from 0 among the rows with equal ``keys``.

    No task holds a whole group: rows are dealt to buckets by a hash of their
    order columns, ranked inside a bucket, and lifted by the sizes of the buckets
    before it. The order is thus by bucket first; rows equal in all order columns
    are interchangeable. ``df`` is read three times, so hand over a written table.
    """
    buckets = max(1, -(-df.count() // per_bucket))
    spread = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = spread.groupBy(*keys, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(*order)) - 1
    lifted = spread.withColumn("_inside", inside).alias("x").join(bases.alias("y"), _same([*keys, "_bucket"]))
    return lifted.select("x.*", (F.col("y._base") + F.col("x._inside")).alias(name)).drop("_bucket", "_inside")


def _same(names: Sequence[str]) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"x.{n}").eqNullSafe(F.col(f"y.{n}"))
    return test


# ---- texts as arrays -------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the public splitmix64 finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


BYTE_CODES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
STEP = U(0xD6E8FEB86659FD93)
IS_SPACE = np.isin(np.arange(256), SPACES)


def powers(n: int) -> np.ndarray:
    out = np.full(n, STEP, U)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def texts(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and the ``n + 1`` offsets of a batch's texts; null is empty."""
    values = batch.column(column).cast(pa.large_string()).fill_null("")
    _, offsets, data = values.buffers()
    at = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about ``size`` bytes together, one text at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of some texts.

    ``start`` and ``end`` are byte positions in ``data``; the words of text ``i``
    are ``at[i]:at[i + 1]``; ``code`` is a 64-bit hash of a word's bytes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        base = int(offsets[0])
        self.data = data = data[base : int(offsets[-1])]
        offsets = offsets - base
        inside = ~IS_SPACE[data]
        before, after = np.ones(len(data), bool), np.ones(len(data), bool)
        before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
        before[offsets[:-1][offsets[:-1] < len(data)]] = True
        after[offsets[1:][offsets[1:] > 0] - 1] = True
        self.start = np.flatnonzero(inside & before)
        self.end = np.flatnonzero(inside & after) + 1
        self.at = np.searchsorted(self.start, offsets)
        self.inside = inside
        self.code = self._codes()

    def _codes(self) -> np.ndarray:
        size = self.end - self.start
        out = np.zeros(len(size), U)
        if not len(size):
            return out
        powered = powers(int(size.max()))
        filled = np.cumsum(size)
        letters = self.data[self.inside]
        lo = 0
        while lo < len(size):  # some words at a time, for memory
            done = int(filled[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(filled, done + HASHED_BYTES, "right")))
            some = size[lo:hi]
            first = np.cumsum(some) - some
            place = np.arange(int(some.sum())) - np.repeat(first, some)
            values = BYTE_CODES[letters[done : int(filled[hi - 1])]] * powered[place]
            out[lo:hi] = np.add.reduceat(values, first)
            lo = hi
        return mix(out ^ (size.astype(U) * U(0x9E3779B97F4A7C15)))


def windows(code: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive codes; the last ``width - 1`` have none."""
    n = len(code) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    total, done, part, size, left = np.zeros(n, U), 0, code, 1, width
    while left:  # by doubling: 20 words are 4 + 16
        if left & 1:
            total = total + part[done : done + n] * (STEP ** U(done))
            done += size
        left >>= 1
        if left:
            part = part[:-size] + part[size:] * (STEP ** U(size))
            size *= 2
    return mix(total ^ U(width))


def with_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, other bytes unchanged."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def as_longs(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def rebuilt(kind: type, fields: dict) -> object:
    """An object of ``kind`` from its ``vars``.

    Broadcasts carry the fields alone: a broadcast object would ask workers for its class,
    and they need not have this package.
    """
    out = object.__new__(kind)
    out.__dict__.update(fields)
    return out


def worker_state(key: tuple | None = None, make: Callable[[], object] | None = None) -> object:
    """What a Python worker keeps from task to task, made when first asked for.

    Functions travel by value, so each task has globals of its own: what is to outlive a task
    is held by the interpreter. Only one thing is kept. Asking for another one, or for
    nothing, lets the one before go, so that one operator's cache never stands beside
    the next operator's work; memory that libraries hold on to is then given back.
    """
    place = sys.modules.setdefault("_held_by_this_worker", types.ModuleType("_held_by_this_worker"))
    if key is None or getattr(place, "key", None) != key:
        place.key = place.value = None
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's: what libraries have freed goes back too
        if trim is not None:
            trim(0)
        if make is not None:
            place.key, place.value = key, make()
    return getattr(place, "value", None)


def session_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
