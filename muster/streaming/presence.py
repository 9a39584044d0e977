"""Present or absent, person by person, with a timer for forgotten check-outs."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import (
    ExpiredTimerInfo,
    StatefulProcessor,
    StatefulProcessorHandle,
    TimerValues,
)

from muster.streaming.live import seconds

STAYS = "person long, in_us long, out_us long, closed_by string"
# Punches in one entry of the state.
CHUNK = 1 << 16


def _pack(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[:, i : i + CHUNK].tobytes(),) for i in range(0, rows.shape[1], CHUNK)]


def _unpack(chunks: Iterator[tuple[bytes]]) -> np.ndarray:
    """Rows ``unknown`` (1 for a null person), ``person`` and ``at``, a column for each punch."""
    parts = [np.frombuffer(c, np.int64).reshape(3, -1) for (c,) in chunks]
    return np.concatenate(parts, axis=1) if parts else np.zeros((3, 0), np.int64)


class Stays(StatefulProcessor):
    """Punches wait until the watermark has passed them, then toggle presence.

    Waiting makes the result independent of the order of arrival and of how the
    input is cut into batches. A key is a bucket of many persons, so that a batch
    asks the state a few times per bucket and not per person. A bucket's state is the
    punches not yet passed, the starts of open stays and the time of its one timer.
    """

    def __init__(self, timeout: timedelta) -> None:
        self.timeout = timeout // timedelta(microseconds=1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "punches binary")
        self.starts = handle.getListState("starts", "punches binary")
        self.wake = handle.getValueState("wake", "ms long")

    def handleInputRows(
        self, key: Any, rows: Iterator[pd.DataFrame], timerValues: TimerValues
    ) -> Iterator[pd.DataFrame]:
        first = None
        for frame in rows:
            punches = np.stack([frame[c].to_numpy().astype(np.int64) for c in ("unknown", "known_person", "at")])
            self.waiting.appendList(_pack(punches))
            first = min([int(punches[2].min()), *([] if first is None else [first])])
        self._wake(first)
        return iter(())

    def handleExpiredTimer(
        self, key: Any, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo
    ) -> Iterator[pd.DataFrame]:
        self.wake.clear()
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = _unpack(self.waiting.get())
        due = waiting[2] <= passed
        stays, starts = self._walk(np.concatenate([_unpack(self.starts.get()), waiting[:, due]], axis=1), passed)
        waiting = waiting[:, ~due]
        for state, left in ((self.waiting, waiting), (self.starts, starts)):
            if left.shape[1]:
                state.put(_pack(left))
            else:
                state.clear()
        self._wake(min([*waiting[2].tolist(), *(starts[2] + self.timeout).tolist()], default=None))
        if len(stays):
            yield stays

    def _walk(self, punches: np.ndarray, passed: int) -> tuple[pd.DataFrame, np.ndarray]:
        """Stays of all punches and open starts of a bucket, and the starts that stay open.

        A person's punches go in order: a gap over the timeout begins a run, in which in and out alternate.
        """
        punches = punches[:, np.lexsort(punches[::-1])]
        times, n = punches[2], punches.shape[1]
        fresh = np.ones(n, bool)
        fresh[1:] = (np.diff(punches[:2], axis=1) != 0).any(axis=0) | (np.diff(times) > self.timeout)
        first = np.flatnonzero(fresh)
        place = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        ins = np.flatnonzero(place % 2 == 0)
        closed = np.append(~fresh[1:], False)[ins]
        out = np.where(closed, times[np.minimum(ins + 1, n - 1)], times[ins] + self.timeout)
        # Only a person's last stay can still be open.
        open_ = ~closed & (out > passed)
        done = ins[~open_]
        stays = pd.DataFrame({
            "person": pd.arrays.IntegerArray(punches[1][done], punches[0][done] > 0),
            "in_us": times[done],
            "out_us": out[~open_],
            "closed_by": np.where(closed[~open_], "punch", "timeout"),
        })
        return stays, punches[:, ins[open_]]

    def _wake(self, at: int | None) -> None:
        """Keeps the bucket's timer at the earliest time asked for."""
        if at is None:
            return
        ms = -(-at // 1000)
        before = self.wake.get()[0] if self.wake.exists() else None
        if before is not None and before <= ms:
            return
        if before is not None:
            self.handle.deleteTimer(before)
        self.handle.registerTimer(ms)
        self.wake.update((ms,))

    def close(self) -> None:
        pass


def live_state(stream: DataFrame, timeout: timedelta, lateness: timedelta, buckets: int = 1024) -> DataFrame:
    """Stays of each person: ``(person, in_ts, out_ts, closed_by)``.

    A punch opens a stay, the next one closes it (``punch``); a stay open for
    longer than ``timeout`` is closed by a timer (``timeout``). The query needs the
    RocksDB state store, which keeps state on disk instead of in the heap. Persons are
    dealt to ``buckets`` by a hash; a bucket's punches and open stays are handled at
    once in one Python worker. The number stays with a query's checkpoint.
    """
    rows = stream.withWatermark("ts", seconds(lateness)).select(
        F.pmod(F.hash("person"), F.lit(buckets)).alias("bucket"),
        F.col("person").isNull().alias("unknown"),
        F.coalesce("person", F.lit(0)).cast("long").alias("known_person"),
        "ts",
        F.unix_micros("ts").alias("at"),
    )
    stays = rows.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=Stays(timeout), outputStructType=STAYS, outputMode="Append", timeMode="EventTime"
    )
    return stays.select(
        "person",
        F.timestamp_micros("in_us").alias("in_ts"),
        F.timestamp_micros("out_us").alias("out_ts"),
        "closed_by",
    )
