"""Mixture-controlled packing of token ids into windows of a fixed size.

Every source is a queue. In each round every queue's deficit grows by its share of the
window, and the queue serves the whole tokens of its deficit; what is left of the window
goes to the queue with the largest share, whose deficit takes up the difference.
What a queue has served before any window is thus known from the window's number,
so a task that holds a part of a queue cuts it without seeing the rest: deficits
carry across windows and partitions alike. When a queue runs dry, one window is
filled from what the others have and the rounds go on with the queues left.

Tokens are made once and written to the shared folder, with each document's place
in its partition of its queue. The partitions' sizes, summed per queue, place
every document in its queue; token ids are never shuffled unless the table of
sizes is too large for Spark to broadcast.

Edge cases: a null text is empty and gives the end token alone; a null source
is a queue of its own; null ids and repeated rows are packed like any other; an
empty table gives no pieces; extra columns are ignored.

Sources with a target and the largest others have queues of their own; all the rest
share one, in which a second round robin serves them: its round is a window's worth of
the queue (or several, where that is less than a token a source), and a source's tokens
before any round follow from the round's number by the same kind of formula. Places
in that queue are a running sum over (round, source), made in tasks by range.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from muster.llm.chunks import ChunkCache
from muster.llm.common import blocks, rebuilt, texts, worker_state, written

WINDOW = 4096
END_ID = 2
MAX_QUEUES = 64
# Shares are rounded to this many parts, so that products fit 64 bits.
SHARE_PARTS = 1 << 30
# Bytes of ids dealt to rounds at a time: a piece may be one token.
DEAL_BYTES = 256 << 10
# Bytes of text cut into tokens at a time: each chunk is a string meanwhile.
TOKEN_BYTES = 1 << 20

TOKENS = "doc_id long, source string, part int, start long, n long, ids binary"
DEALT = "doc_id long, source string, turn long, at long, skip long, n long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_file() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


# ---- tokens -----------------------------------------------------------------

# A word of letters with one-letter lower cases, the stops that end its chunk, or any other chunk:
# the tokenizer, too, parts words and stops there.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]"
CHUNKS = rf"(?<![^ \n\t\r]){LETTERS}++(?=[.,;:!?]*(?:[ \n\t\r]|\Z))|(?<={LETTERS})[.,;:!?]+(?=[ \n\t\r]|\Z)|[^ \n\t\r]+"
WORD = re.compile(f"{LETTERS}+")


class WordEncoder:
    """Ids of chunks without blanks by a word-end BPE tokenizer of the tokenizers library."""

    def __init__(self, model: str, threads: int = 1):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.tokenizer = Tokenizer.from_str(model)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # The same model without what leaves lower-case letters as they are.
        self.letters = Tokenizer.from_str(model)
        self.letters.normalizer = normalizers.Sequence([])
        self.letters.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )

    def _words(self, words: list[str]) -> dict[str, Sequence[int]]:
        """Letters only: many in one text, cut again at the word ends."""
        out: dict[str, Sequence[int]] = {}
        for lo in range(0, len(words), 512):
            some = words[lo : lo + 512]
            ids = self.letters.encode(" ".join(some), add_special_tokens=False).ids
            cuts = [0, *(np.flatnonzero(self.ends[ids]) + 1).tolist()]
            if len(cuts) == len(some) + 1:
                out.update(zip(some, map(ids.__getitem__, map(slice, cuts, cuts[1:]))))
            else:
                out.update((w, e.ids) for w, e in zip(some, self.tokenizer.encode_batch(some, add_special_tokens=False)))
        return out

    def __call__(self, chunks: Sequence[str]) -> list[Sequence[int]]:
        lower = {c: c.lower() for c in chunks if WORD.fullmatch(c)}
        words = self._words(list(dict.fromkeys(lower.values())))
        rest = [c for c in chunks if c not in lower]
        other = dict(zip(rest, (e.ids for e in self.tokenizer.encode_batch(rest, add_special_tokens=False))))
        return [words[lower[c]] if c in lower else other[c] for c in chunks]


def lowered(text: str) -> str:
    """Lower case as the tokenizer makes it, so that fewer chunks differ; only where case has no special rules."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return text.lower()


def _cache(model: str) -> ChunkCache:
    """One cache per Python worker and model; it outlives a task."""
    return worker_state(("word", hash(model)), lambda: ChunkCache(WordEncoder(model), CHUNKS))


def _tokens(batches: Iterator[pa.RecordBatch], model: str, end_id: int) -> Iterator[pa.RecordBatch]:
    cache, part = _cache(model), TaskContext.get().partitionId()
    served: dict[str | None, int] = {}
    for batch in batches:
        _, offsets = texts(batch)
        for lo, hi in blocks(offsets, TOKEN_BYTES):
            some = batch.slice(lo, hi - lo)
            flat, counts, _, _ = cache.ids([lowered(t) if t else "" for t in some.column("text").to_pylist()])
            ends = np.cumsum(counts)
            flat = np.insert(flat, ends, end_id).astype("<u4")
            sizes = counts + 1
            at = np.concatenate([[0], np.cumsum(sizes)])
            sources = some.column("source").to_pylist()
            starts = []
            for source, n in zip(sources, sizes.tolist()):
                starts.append(served.get(source, 0))
                served[source] = starts[-1] + n
            # Small vocabularies are kept in two bytes each.
            width = 2 if len(flat) == 0 or flat.max() < 1 << 16 else 4
            raw = flat.astype("<u2" if width == 2 else "<u4").tobytes()
            ids = [bytes([width]) + raw[a * width : b * width] for a, b in zip(at.tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [some.column("doc_id"), pa.array(sources, pa.string()), pa.array([part] * len(sources), pa.int32()),
                 pa.array(starts, pa.int64()), pa.array(sizes), pa.array(ids, pa.binary())],
                ["doc_id", "source", "part", "start", "n", "ids"],
            )


def tokenised(docs: DataFrame, model_file: str, end_id: int = END_ID) -> DataFrame:
    """The documents' ids, written: ``ids`` is a width byte and the ids in that many bytes each."""
    with open(model_file, encoding="utf-8") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary's file, of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    return written(rows.mapInArrow(lambda b: _tokens(b, model.value, end_id), TOKENS), "pack-tokens")


# ---- rounds -------------------------------------------------------------------


class Rounds:
    """What deficit round robin has served of each queue before any window.

    ``totals`` are the queues' tokens, ``targets`` their shares of a window (in
    proportion to the totals if not given). A run of rounds over the same queues is
    a segment ``(window, served, parts, lead)``; a window filled by hand has no parts.
    """

    def __init__(self, totals: Sequence[int], targets: Sequence[float] | None = None, size: int = WINDOW):
        self.size, self.count = size, len(totals)
        self.segments: list[tuple[int, np.ndarray, np.ndarray | None, int]] = []
        left, window = np.array(totals, np.int64), 0
        while left.sum():
            share = np.where(left > 0, np.array(targets if targets is not None else totals, float), 0.0)
            if not share.sum():
                share = left.astype(float)
            parts = np.floor(share / share.sum() * SHARE_PARTS).astype(np.int64)
            lead = int(parts.argmax())
            parts[lead] += SHARE_PARTS - parts.sum()
            served = np.array(totals, np.int64) - left
            lo, hi = 0, int(left.sum() // size)
            while lo < hi:
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if (self._quota(np.array([mid]), parts, lead)[0] <= left).all() else (lo, mid - 1)
            if lo:
                self.segments.append((window, served, parts, lead))
                left = left - self._quota(np.array([lo]), parts, lead)[0]
                window += lo
            if left.sum():
                served = np.array(totals, np.int64) - left
                self.segments.append((window, served, None, lead))
                left = left - self._fill(left, parts)
                window += 1
        self.windows = window
        self.segments.append((window, np.array(totals, np.int64), None, 0))
        self.starts = [s[0] for s in self.segments]

    def _quota(self, rounds: np.ndarray, parts: np.ndarray, lead: int) -> np.ndarray:
        """Tokens served by each queue after so many rounds; rows add up to rounds * size."""
        x = rounds.astype(np.int64)[:, None] * self.size
        out = x // SHARE_PARTS * parts[None, :] + x % SHARE_PARTS * parts[None, :] // SHARE_PARTS
        out[:, lead] += x[:, 0] - out.sum(axis=1)
        return out

    def _fill(self, left: np.ndarray, parts: np.ndarray) -> np.ndarray:
        take = np.minimum(left, self.size * parts // SHARE_PARTS)
        room = min(self.size, int(left.sum())) - int(take.sum())
        for q in np.argsort(-parts, kind="stable"):
            more = min(room, int(left[q] - take[q]))
            take[q] += more
            room -= more
        return take

    def before(self, lo: int, hi: int) -> np.ndarray:
        """Row ``i``: tokens of each queue in the windows before ``lo + i``; rows up to ``hi``."""
        out = np.empty((hi - lo + 1, self.count), np.int64)
        w = lo
        while w <= hi:
            k = bisect_right(self.starts, w) - 1
            first, served, parts, lead = self.segments[k]
            end = min(hi, self.starts[k + 1] - 1) if k + 1 < len(self.segments) else hi
            rounds = np.arange(w, end + 1) - first
            out[w - lo : end + 1 - lo] = served if parts is None else served + self._quota(rounds, parts, lead)
            w = end + 1
        return out

    def window_of(self, queue: int, place: int) -> int:
        """The window that holds the queue's token ``place``."""
        lo, hi = 0, self.windows - 1
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if int(self.before(mid, mid)[0, queue]) <= place else (lo, mid - 1)
        return lo


# ---- the shared queue -----------------------------------------------------------


def turn_of(place: int, tokens: int, length: int, total: int) -> int:
    """The round that serves token ``place`` of a source with so many of ``total`` tokens, ``length`` of them a round."""
    return -(-(place + 1) * total // (tokens * length)) - 1


def served_before(turn: int, tokens: int, length: int, total: int) -> int:
    return min(tokens, turn * tokens * length // total)


def _deal(batches: Iterator[pa.RecordBatch], length: int, total: int) -> Iterator[pa.RecordBatch]:
    """Documents cut where the rounds of the shared queue end; ``at`` is a piece's place in its source."""
    for batch in batches:
        ids = batch.column("ids")
        offsets = np.frombuffer(ids.buffers()[1], np.int32 if pa.types.is_binary(ids.type) else np.int64)[ids.offset : ids.offset + len(ids) + 1]
        for lo, hi in blocks(offsets, DEAL_BYTES):
            out: list[tuple] = []
            for row in batch.slice(lo, hi - lo).to_pylist():
                width, a, end = row["ids"][0], row["at"], row["at"] + row["n"]
                while a < end:
                    turn = turn_of(a, row["total"], length, total)
                    b = min(end, served_before(turn + 1, row["total"], length, total))
                    skip = a - row["at"]
                    raw = row["ids"][:1] + row["ids"][1 + skip * width : 1 + (skip + b - a) * width]
                    out.append((row["doc_id"], row["source"], turn, a, skip, b - a, row["n"], raw))
                    a = b
            kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5, pa.binary()]
            names = [f.split()[0] for f in DEALT.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def _shared(rows: DataFrame, length: int, total: int) -> DataFrame:
    """Pieces of the shared queue's documents with their places in it, in that order."""
    dealt = written(rows.mapInArrow(lambda b: _deal(b, length, total), DEALT), "pack-dealt")
    served = dealt.groupBy("turn", "source").agg(F.sum("n").alias("tokens"), F.min("at").alias("head"))
    # A running sum by range: each range is summed, then lifted by the ranges before it.
    ranges = written(served.repartitionByRange("turn", "source").withColumn("range", F.spark_partition_id()), "pack-served")
    sums = ranges.groupBy("range").agg(F.sum("tokens").alias("all"))
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select("range", F.coalesce(F.sum("all").over(upto(Window.orderBy("range"))), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("tokens").over(upto(Window.partitionBy("range").orderBy("turn", "source"))), F.lit(0))
    starts = ranges.withColumn("inside", inside).join(bases, "range")
    starts = starts.select(F.col("turn").alias("t"), F.col("source").alias("s"), "head", (F.col("base") + F.col("inside")).alias("base"))
    met = dealt.join(starts, (dealt.turn == starts.t) & dealt.source.eqNullSafe(starts.s))
    placed = met.withColumn("place", F.col("base") + F.col("at") - F.col("head"))
    return placed.repartitionByRange("place").sortWithinPartitions("place")


# ---- pieces -------------------------------------------------------------------


def _cut(batches: Iterator[pa.RecordBatch], rounds: Rounds) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in ("queue", "place", "n", "skip", "doc_tokens")}
        ids, docs = batch.column("ids"), batch.column("doc_id")
        order = np.lexsort((columns["place"], columns["queue"]))
        # A run: documents that follow each other in one queue.
        queue, place, n = (columns[c][order] for c in ("queue", "place", "n"))
        breaks = np.flatnonzero((queue[1:] != queue[:-1]) | (place[1:] != place[:-1] + n[:-1])) + 1
        for lo, hi in zip([0, *breaks.tolist()], [*breaks.tolist(), len(order)]):
            if lo < hi:
                rows = order[lo:hi]
                whole = columns["skip"][rows], columns["doc_tokens"][rows]
                yield _pieces(rounds, int(queue[lo]), place[lo:hi], n[lo:hi], *whole, rows, ids, docs)


def _pieces(
    rounds: Rounds, queue: int, place: np.ndarray, n: np.ndarray, skip: np.ndarray, doc_tokens: np.ndarray, rows: np.ndarray, ids: pa.Array, docs: pa.Array
) -> pa.RecordBatch:
    end = int(place[-1] + n[-1])
    first, last = rounds.window_of(queue, int(place[0])), rounds.window_of(queue, end - 1)
    served = rounds.before(first, last + 1)
    cuts = served[:, queue]
    bounds = np.unique(np.concatenate([place, cuts[(cuts > place[0]) & (cuts < end)], [end]]))
    begin, length = bounds[:-1], np.diff(bounds)
    doc = np.searchsorted(place, begin, "right") - 1
    window = np.searchsorted(cuts, begin, "right") - 1
    # Empty windows of this queue repeat a cut: the search gives the last, which has tokens.
    ahead = (served[1:, :queue] - served[:-1, :queue]).sum(axis=1)
    offset = ahead[window] + begin - cuts[window]
    start = begin - place[doc]
    crcs, held, raw, width = [], -1, b"", 2
    for d, a, k in zip(doc.tolist(), start.tolist(), length.tolist()):
        if d != held:
            packed = ids[int(rows[d])].as_buffer()
            width = memoryview(packed)[0]
            raw = np.frombuffer(packed, "<u2" if width == 2 else "<u4", offset=1).astype("<u4")
            held = d
        crcs.append(zlib.crc32(raw[a : a + k]))
    arrays = [docs.take(pa.array(rows[doc])), start + skip[doc], length, np.array(crcs, np.int64), doc_tokens[doc], first + window, offset]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays([pa.array(a) if isinstance(a, np.ndarray) else a for a in arrays], names)


def pack(docs: DataFrame, targets: dict[str | None, float] | None = None, model_file: str | None = None, window: int = WINDOW, max_queues: int = MAX_QUEUES, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents: where each run of ids lies in which sequence.

    ``targets`` gives sources their share of a window; by default each source's
    share of all tokens, so that every window has the corpus' mixture. Every source with
    a target gets it; those without follow, in proportion, when those are dry.
    """
    if any(not math.isfinite(x) or x < 0 for x in (targets or {}).values()):
        raise ValueError("targets must be finite and not negative")
    spark = docs.sparkSession
    tokens = tokenised(docs, model_file or tokenizer_file(), end_id)
    sizes = tokens.groupBy("source", "part").agg(F.sum("n").alias("tokens"))
    per_source = sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"))
    every = per_source.agg(F.sum("tokens").alias("tokens"), F.count("*").alias("sources")).first()
    total = every.tokens or 0
    aimed = [k for k, x in (targets or {}).items() if x > 0]
    first = F.coalesce(F.col("source").isin([k for k in aimed if k is not None]), F.lit(None in aimed))
    top = per_source.orderBy(F.desc(first), F.desc("tokens"), "source").limit(max(max_queues - 1, len(aimed))).collect()
    totals = [r.tokens for r in top]
    rest = total - sum(totals)
    goal = None if targets is None else [float(targets.get(r.source, 0.0)) for r in top]
    if rest:
        totals.append(rest)
        if goal is not None:
            goal.append(0.0)  # no source of the rest has a target
    rounds = spark.sparkContext.broadcast(vars(Rounds(totals, goal, window)))  # a few numbers per queue
    names = spark.createDataFrame([(r.source, i) for i, r in enumerate(top)], "source string, queue int")
    queued = sizes.join(F.broadcast(names), sizes.source.eqNullSafe(names.source), "left").select(
        sizes.source, "part", "tokens", F.coalesce("queue", F.lit(len(top))).alias("queue")
    )
    own = Window.partitionBy("source")
    before = own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = queued.select(
        F.col("source").alias("s"), F.col("part").alias("p"), "queue",
        F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("base"), F.sum("tokens").over(own).alias("total"),
    )
    placed = tokens.join(bases, tokens.source.eqNullSafe(bases.s) & (tokens.part == bases.p))
    placed = placed.withColumn("at", F.col("base") + F.col("start"))
    columns = ["doc_id", "queue", "place", "n", "skip", "doc_tokens", "ids"]
    whole = placed.where(F.col("queue") < len(top)) if rest else placed
    rows = whole.select("doc_id", "queue", F.col("at").alias("place"), "n", F.lit(0).cast("long").alias("skip"), F.col("n").alias("doc_tokens"), "ids")
    if rest:
        # What shares windows with the rest in proportion: all, or all without a target.
        among = total - sum(n for n, x in zip(totals, goal or []) if x > 0)
        # A round is as many windows as give the rest a token a source.
        length = window * max(1, math.ceil((every.sources - len(top)) * among / (rest * window)))
        dealt = placed.where(F.col("queue") == len(top)).select("doc_id", "source", "at", "n", "total", "ids")
        rows = rows.unionByName(_shared(dealt, length, among).withColumn("queue", F.lit(len(top))).select(columns))
    return rows.mapInArrow(lambda b: _cut(b, rebuilt(Rounds, rounds.value)), PIECES)
