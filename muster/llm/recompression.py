"""Substring dedup by recompression.

Words become symbols, and rounds rewrite every document's symbols: a run of one
symbol is named by the symbol and its length, then neighbours ``x y`` become one
symbol where a coin that hangs on the symbol's name puts ``x`` on the left side
and ``y`` on the right. A name is a hash of what it stands for, so names are global
without a dictionary, and equal substrings get equal symbols in their interior:
only symbols at their edges can depend on what lies outside.

From these edges each window of ``WINDOW`` words gets its anchor: of the symbols that
are the same in every occurrence of the window, the one of the highest level
and least name. Neighbouring windows mostly share an anchor, so one row per anchor
goes through the shuffle instead of one per word. Rows with the same anchor meet in
order of document and place. Two windows are the same if their anchors' names, the
anchors' places in them and the 64-bit hashes of all their words agree; the one met later is a
repeat. Of a name, 32 bits go along: anchors that share these meet, but no more than that.

Repeats inside a batch of documents are found in the same way before the shuffle and
verified word by word, and only the first of them is sent on. Removal is judged on the input: every word covered by a window
that also starts earlier goes.

A row is known by its id and a 64-bit hash of its text: marks made for one row never
reach another that shares its id. Of rows equal in both, one is a document and the others
are copies of it that come later, so all their windows are repeats.

Edge cases: a null text has no words and equals an empty one; texts under a window's length
lose nothing; rows with equal ids are ordered by the hash of their text; null ids come first;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import STEP, U, Words, blocks, mix, session_parallelism, texts, windows, written

WINDOW = 20
ROUNDS = 3
# Longest symbol in words: a window always holds some symbol whole.
LONGEST = 6
# Bytes of text whose windows are in a task's memory together, at some hundred bytes a word.
EMIT_BYTES = 3 << 20


# ---- rounds -----------------------------------------------------------------------


class Level:
    """The symbols of one round: first word, length in words, name; ``of`` maps a first word to its symbol."""

    def __init__(self, start: np.ndarray, size: np.ndarray, name: np.ndarray, total: int):
        self.start, self.size, self.name = start, size, name
        self.of = np.zeros(total + 1, np.int32)
        self.of[start] = np.arange(len(start), dtype=np.int32)


def name_runs(level: Level, doc: np.ndarray, total: int) -> Level:
    """Runs of one symbol, in pieces of at most ``LONGEST`` words counted from the run's start."""
    same = np.zeros(len(level.start), bool)
    same[1:] = (level.name[1:] == level.name[:-1]) & (doc[level.start[1:]] == doc[level.start[:-1]])
    if not same.any():
        return level
    first = np.flatnonzero(~same)
    place = np.arange(len(same)) - np.repeat(first, np.diff(np.append(first, len(same))))
    most = np.maximum(LONGEST // level.size, 1)
    heads = np.flatnonzero(place % most == 0)
    count = np.diff(np.append(heads, len(same)))
    name = np.where(count > 1, mix(level.name[heads] ^ mix(count.astype(U) + U(77))), level.name[heads])
    return Level(level.start[heads], np.add.reduceat(level.size, heads), name, total)


def left_side(name: np.ndarray, turn: int) -> np.ndarray:
    return (mix(name ^ U(1000 + turn)) & U(1)).astype(bool)


def name_pairs(level: Level, doc: np.ndarray, turn: int, total: int) -> Level:
    left = left_side(level.name, turn)
    join = left[:-1] & ~left[1:] & (level.size[:-1] + level.size[1:] <= LONGEST) & (doc[level.start[:-1]] == doc[level.start[1:]])
    second = np.zeros(len(left), bool)
    second[1:] = join
    keep = np.flatnonzero(~second)
    pair = np.zeros(len(left), bool)
    pair[:-1] = join
    pair = pair[keep]
    name, size = level.name[keep], level.size[keep].copy()
    after = keep[pair] + 1
    name[pair] = mix(name[pair] * STEP + level.name[after] + U(turn))
    size[pair] += level.size[after]
    return Level(level.start[keep], size, name, total)


def anchors(code: np.ndarray, doc: np.ndarray, valid: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Name of the anchor of the window at each of the places ``valid``, and the anchor's first word."""
    total = len(code)
    level = Level(np.arange(total), np.ones(total, np.int64), code, total)
    rows, lo, hi = np.arange(len(valid)), valid, valid + WINDOW
    states = [(level, rows, lo, hi)]
    # Runs: the first and the last run of a window may go on outside.
    lo, hi = run_bounds(level, lo, hi)
    level = name_runs(level, doc, total)
    for turn in range(rounds):
        ok = lo < hi
        rows, lo, hi = rows[ok], lo[ok], hi[ok]
        # A right-side symbol at the front may belong to one before it, a left-side one at the end to one behind.
        left = left_side(level.name, turn)
        head, tail = level.of[lo], symbol_before(level, hi)
        lo = np.where(left[head], lo, lo + level.size[head])
        hi = np.where(left[tail], hi - level.size[tail], hi)
        level = name_pairs(level, doc, turn, total)
        states.append((level, rows, lo, hi))
    name, at, open_ = np.zeros(len(valid), U), np.zeros(len(valid), np.int64), np.ones(len(valid), bool)
    for level, rows, lo, hi in reversed(states):  # the highest level that has a whole symbol
        now = (lo < hi) & open_[rows]
        if now.any():
            choose(level, lo[now], hi[now], rows[now], name, at)
            open_[rows[now]] = False
    return name, at


def symbol_before(level: Level, end: np.ndarray) -> np.ndarray:
    """The symbol that ends where ``end`` says."""
    return np.searchsorted(level.start, end) - 1


def run_bounds(level: Level, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``lo`` and ``hi`` without the runs at the edges, which may be longer than the window shows."""
    change = np.ones(len(level.start) + 1, bool)
    change[1:-1] = level.name[1:] != level.name[:-1]
    heads = np.flatnonzero(change[:-1])
    first, last = level.of[lo], symbol_before(level, hi)
    ends = np.append(heads[1:], len(level.start))
    # A run of one symbol at the front is whole only if what is before differs, which the window can't know.
    after = ends[np.searchsorted(heads, first, "right") - 1]
    before = heads[np.searchsorted(heads, last, "right") - 1]
    starts = np.append(level.start, level.start[-1] + level.size[-1])
    return np.minimum(starts[after], hi), np.maximum(level.start[before], lo)


def choose(level: Level, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, name: np.ndarray, at: np.ndarray) -> None:
    """The least name among a window's whole symbols of this level, the first of equal ones."""
    a, b = level.of[lo], np.searchsorted(level.start, hi)
    rank = mix(level.name ^ U(5))
    best, where = rank[a].copy(), a.astype(np.int64)
    for step in range(1, int((b - a).max(initial=0))):
        i = np.minimum(a + step, len(rank) - 1)
        better = (a + step < b) & (rank[i] < best)
        best = np.where(better, rank[i], best)
        where = np.where(better, i, where)
    name[rows], at[rows] = level.name[where], level.start[where]


# ---- in tasks -------------------------------------------------------------------

# ``span`` holds the first window's place above bit 33, the words it has ahead of its anchor (fewer
# than 20) above bit 28, and the number of windows. Rows of known repeats have no hashes and
# no anchor, and all 33 bits for the number.
ROWS = "name int, doc long, th long, span long, hashes binary"
NAMES = ["name", "doc", "th", "span", "hashes"]
MARKS = ["doc", "th", "place", "count"]
PLACE, AHEAD = 33, 28


def _short(name: np.ndarray) -> np.ndarray:
    """The 32 bits of a name that rows are dealt by."""
    return (name >> U(32)).astype(np.uint32).view(np.int32)


def _first(name: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each window, the first of those with its anchor's name and its key."""
    order = np.lexsort((key, name))  # stable: the first of equal ones stays in front
    name, key = name[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (name[1:] != name[:-1]) | (key[1:] != key[:-1])
    head = np.empty(len(order), np.int64)
    head[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    return head


def _key(hashes: np.ndarray, ahead: np.ndarray) -> np.ndarray:
    """A window's hash and its anchor's place in it, as one value."""
    return mix(hashes ^ mix(ahead.astype(U) + U(3)))


def _runs(doc: np.ndarray, place: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of consecutive places of one document (sorted), also equal in ``more`` plus place."""
    if not len(doc):
        return np.zeros(0, int), np.zeros(0, int)
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1)
    for x in more:
        new[1:] |= x[1:] != x[:-1]
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(doc)))


def _flags(doc: np.ndarray, th: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
    """Repeated windows as runs: document, text, first place, number."""
    order = np.lexsort((place, th, doc))
    doc, th, place = doc[order], th[order], place[order]
    start, count = _runs(doc, place, th)
    return doc[start], th[start], place[start], count


def _known(*later: np.ndarray) -> pa.RecordBatch:
    """Rows of repeats found before the shuffle; their name only spreads them."""
    doc, th, place, count = _flags(*later)
    spread = _short(mix(doc.astype(U) ^ mix(th.astype(U))))
    arrays = [pa.array(a) for a in (spread, doc, th, (place << PLACE) | count)]
    return pa.RecordBatch.from_arrays([*arrays, pa.nulls(len(doc), pa.binary())], NAMES)


def _marks(doc: np.ndarray, th: np.ndarray, place: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    arrays = [pa.array(doc), pa.array(th), pa.array(place.astype(np.int32)), pa.array(count.astype(np.int32))]
    return pa.RecordBatch.from_arrays(arrays, MARKS)


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch)
        ids, hashed = batch.column("doc").to_numpy(), batch.column("th").to_numpy()
        for lo, hi in blocks(offsets, EMIT_BYTES):
            words = Words(data, offsets[lo : hi + 1])
            n = np.diff(words.at)
            doc = np.repeat(np.arange(hi - lo), n)
            hashes = windows(words.code, WINDOW)
            valid = np.flatnonzero(np.arange(len(hashes)) + WINDOW <= words.at[1:][doc[: len(hashes)]]) if len(hashes) else np.zeros(0, int)
            if not len(valid):
                continue
            ranks = np.empty(hi - lo, np.int64)  # of the block's rows by id and text
            ranks[np.lexsort((hashed[lo:hi], ids[lo:hi]))] = np.arange(hi - lo)
            own, place = ranks[doc[valid]], valid - words.at[doc[valid]]
            # Windows of the block in order of document and place; of equal ones the first goes on.
            name, at = anchors(words.code, doc, valid)
            ahead = at - valid
            key = _key(hashes[valid], ahead)
            order = np.lexsort((place, own))
            head = np.empty(len(order), np.int64)
            head[order] = order[_first(name[order], key[order])]
            later = np.flatnonzero(head != np.arange(len(head)))
            same = np.ones(len(later), bool)
            for i in range(WINDOW):
                same &= words.code[valid[later] + i] == words.code[valid[head[later]] + i]
            later = later[same]
            of = lo + doc[valid]
            if len(later):
                yield _known(ids[of[later]], hashed[of[later]], place[later])
            keep = np.delete(np.arange(len(valid)), later)
            start, count = _runs(doc[valid[keep]], place[keep], at[keep], name[keep])
            begin = keep[start]
            raw = hashes[valid[keep]].astype("<u8").tobytes()
            cut = np.append(start, len(keep)).astype(np.int64) * 8
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(cut), pa.py_buffer(raw)])
            span = (place[begin] << PLACE) | (ahead[begin] << AHEAD) | count
            arrays = [pa.array(a) for a in (_short(name[begin]), ids[of[begin]], hashed[of[begin]], span)]
            yield pa.RecordBatch.from_arrays([*arrays, packed.cast(pa.binary())], NAMES)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows, from rows sorted by anchor, document, text and place.

    What a batch's last anchor has shown so far is carried on: its distinct windows.
    """
    held_name = None
    held: tuple[np.ndarray, ...] = (np.zeros(0, U), *[np.zeros(0, np.int64)] * 3)
    for batch in batches:
        if not batch.num_rows:
            continue
        flagged = batch.column("hashes").is_null().to_numpy(zero_copy_only=False)
        if flagged.any():
            doc, th, span = (batch.column(c).to_numpy()[flagged] for c in ("doc", "th", "span"))
            yield _marks(doc, th, span >> PLACE, span & ((1 << PLACE) - 1))
        rows = batch.filter(pa.array(~flagged))
        if not rows.num_rows:
            continue
        name, doc, th, span = (rows.column(c).to_numpy() for c in ("name", "doc", "th", "span"))
        place, ahead, count = span >> PLACE, (span >> AHEAD) & ((1 << PLACE - AHEAD) - 1), span & ((1 << AHEAD) - 1)
        _, offsets, raw = rows.column("hashes").buffers()
        lo = int(np.frombuffer(offsets, np.int32)[rows.column("hashes").offset])
        value = np.frombuffer(raw[lo : lo + int(count.sum()) * 8], "<u8").astype(U)
        row = np.repeat(np.arange(len(name)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        own, hashed, at = doc[row], th[row], place[row] + step
        key = _key(value, ahead[row] - step)
        group = name[row]
        if held_name is not None and group[0] == held_name:
            carried = len(held[0])
            key, own, hashed, at = (np.concatenate(pair) for pair in zip(held, (key, own, hashed, at)))
            group = np.concatenate([np.full(carried, held_name), group])
        else:
            carried = 0
        head = _first(group, key)
        later = head != np.arange(len(head))
        later[:carried] = False
        if later.any():
            yield _marks(*_flags(own[later], hashed[later], at[later]))
        held_name = group[-1]
        last = np.unique(head[group == held_name])
        held = (key[last], own[last], hashed[last], at[last])


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = texts(batch)
        marks, ids = batch.column("marks"), batch.column("doc_id")
        for lo, hi in blocks(offsets):
            words = Words(data, offsets[lo : hi + 1])
            n = np.diff(words.at)
            kept, removed = [], []
            raw = words.data.tobytes()
            for i in range(hi - lo):
                a, b = int(words.at[i]), int(words.at[i + 1])
                start, end = words.start[a:b], words.end[a:b]
                gone = 0
                if marks[lo + i].is_valid and b - a >= WINDOW:
                    runs = marks[lo + i].values
                    place, count = runs.field("place").to_numpy(), runs.field("count").to_numpy()
                    change = np.zeros(b - a + 1, np.int64)
                    np.add.at(change, place, 1)
                    np.add.at(change, np.minimum(place + count + WINDOW - 1, b - a), -1)
                    keep = np.cumsum(change[:-1]) == 0
                    gone = int((~keep).sum())
                    start, end = start[keep], end[keep]
                kept.append(b" ".join(map(raw.__getitem__, map(slice, start.tolist(), end.tolist()))))
                removed.append(gone)
            text = pa.array(kept, pa.binary()).cast(pa.string())
            arrays = [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), pa.array(removed, pa.int64()), text]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept"])


def _once(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` with one row of those equal in id and text, and the others (none: null)."""
    equal = written(rows.groupBy("doc", "th").agg(F.count("*").alias("n")).where("n > 1").select("doc", "th"), "recompression-equal")
    if equal.isEmpty():
        return rows, None
    # Numbered and written, so that the choice stays the same.
    copies = written(rows.join(equal, ["doc", "th"], "left_semi").withColumn("row", F.monotonically_increasing_id()), "recompression-copies")
    heads = copies.groupBy("doc", "th").agg(F.min("row").alias("head"))
    told = copies.join(heads, ["doc", "th"])
    first, others = (told.where(test).select(rows.columns) for test in ("row = head", "row <> head"))
    return rows.join(equal, ["doc", "th"], "left_anti").select(rows.columns).unionByName(first), others


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: the words that stay, joined by one space."""
    spark = docs.sparkSession
    # Null ids stand before all others.
    doc = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    th = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), doc.alias("doc"), th.alias("th"), F.col(text_col).alias("text"))
    rows, others = _once(rows)
    sent = rows.select("doc", "th", "text").mapInArrow(_emit, ROWS)
    met = sent.repartition(session_parallelism(spark), "name").sortWithinPartitions("name", "doc", "th", "span")
    flags = met.mapInArrow(_judge, "doc long, th long, place int, count int")
    marks = flags.groupBy("doc", "th").agg(F.collect_list(F.struct("place", "count")).alias("marks"))
    joined = rows.join(marks, ["doc", "th"], "left").select("doc_id", "text", "marks")
    if others is not None:
        all_windows = F.array(F.struct(F.lit(0).alias("place"), F.lit(1 << 30).alias("count")))
        joined = joined.unionByName(others.select("doc_id", "text", all_windows.alias("marks")))
    return joined.mapInArrow(_remove, "doc_id long, n_words long, n_removed long, kept string")
