"""Alignment of two tokenizers' tokens, each distinct text tokenised once.

Texts are shuffled whole and counted, so every distinct one is tokenised and aligned
once, and its pair counts weigh as often as it occurs. Both tokenizers see the text with
a space in front. Their tokens are laid over its UTF-8 bytes: the offsets where tokens
of both end cut them into groups, and the tokens that end there are linked.

A text falls into chunks before each blank or line end that follows another character
than white space, and around the stops that follow a word of letters. No token of either
tokenizer reaches over such a place, so a chunk's groups and links are those of the
whole text, and a worker keeps those it has met.

One row is written per block of texts: measures that need no counts, the block's id
pairs, and how often each is linked in each text. Pairs are summed over all blocks,
joined back to the blocks' pairs, and give each of a block's texts its sums; so the
rows shuffled are as many as blocks have different pairs, not links. The measures are
joined to documents by the SHA-256 of the text.

Edge cases: a null or empty text, and one whose joined token bytes differ from a space
and the text (say with U+2581 in it), has no tokens: zeros and an empty digest; null
and repeated ids get the measures of their text; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from muster.llm.common import blocks, texts, worker_state, written

MARK = "▁"
# A cut lies before a blank or line end that follows neither, and between a letter and a
# stop if all up to the next such cut are stops.
LETTERS, STOPS = "A-Za-zÀ-ÖØ-öø-ÿ", ".,;:!?"
CHUNKS = rf"[ \n][{LETTERS}]++(?=[{STOPS}]*(?:[ \n]|\Z))|(?<=[{LETTERS}])[{STOPS}]+(?=[ \n]|\Z)|[ \n]+[^ \n]*(?:(?<=\s)[ \n]+[^ \n]*)*"
CACHED = 400_000
# An id pair as one number: a * PAIR + b.
PAIR = 1 << 24

BLOCKS = (
    "block long, digests array<binary>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>, "
    "pairs array<long>, links array<long>, ends array<int>, step array<int>, times array<int>"
)
MEASURES = "digest binary, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def byte_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def piece_file() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


# ---- tokens and their bytes -------------------------------------------------------


def byte_letters() -> dict[str, int]:
    """The byte each letter of a byte-level vocabulary stands for: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Pair:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, byte_model: str, piece_model: bytes):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = "1", "false"
        self.a = Tokenizer.from_str(byte_model)
        self.a.encode_special_tokens = True
        letter = byte_letters()
        vocab = self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.a_bytes[i] = bytes(letter[c] for c in t) if set(t) <= set(letter) else t.encode()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_model)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        if any(re.search(f"[^{MARK}]{MARK}|\n|[{LETTERS}][{STOPS}]", p) for p in pieces):
            raise ValueError("a piece reaches over a cut")
        self.a_size, self.b_size = list(map(len, self.a_bytes)), list(map(len, self.b_bytes))
        self.names = list(map(str, range(max(len(self.a_bytes), len(pieces)))))

    def encode(self, chunks: Sequence[str]) -> Iterator[tuple[list[int], list[int]]]:
        """Ids of chunks, each of which begins with a blank, a line end or a stop."""
        left = self.a.encode_batch(list(chunks), add_special_tokens=False)
        # A blank in front is the one that B adds; a line end merges with nothing.
        right = self.b.encode([c[1:] if c[0] == " " else c if c[0] == "\n" else "\n" + c for c in chunks], num_threads=1)
        for c, x, y in zip(chunks, left, right):
            yield x.ids, [self.mark] if c == " " else y if c[0] == " " else y[1:] if c[0] == "\n" else y[2:]

    def align(self, chunk: str, x: Sequence[int], y: Sequence[int]) -> tuple[str, list[int]] | None:
        """The groups as text and a number for each link; None if the tokens are not the chunk's bytes."""
        raw = chunk.encode()
        if b"".join(map(self.a_bytes.__getitem__, x)) != raw or b"".join(map(self.b_bytes.__getitem__, y)) != raw:
            return None
        place = dict(zip(accumulate(map(self.b_size.__getitem__, y)), range(1, len(y) + 1)))
        xs, ys = [*map(self.names.__getitem__, x)], [*map(self.names.__getitem__, y)]
        groups, links, i0, j0, i = [], [], 0, 0, 0
        for e in accumulate(map(self.a_size.__getitem__, x)):
            i += 1
            if e in place:
                j = place[e]
                one = xs[i0] if i == i0 + 1 else ",".join(xs[i0:i])
                groups.append(f"{one}|{ys[j0] if j == j0 + 1 else ','.join(ys[j0:j])}")
                links.append(x[i - 1] * PAIR + y[j - 1])
                i0, j0 = i, j
        return ";".join(groups), links


class Aligner:
    """Alignments of the chunks met so far."""

    def __init__(self, byte_model: str, piece_model: bytes):
        self.pair, self.find = Pair(byte_model, piece_model), re.compile(CHUNKS).findall
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.groups: list[str] = []
        self.count = np.zeros((0, 3), np.int64)  # tokens of A, of B, groups; -1 if there are none
        self.start, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int64)
        self.uses = np.zeros(0, np.int64)

    def _shrink(self) -> None:
        """Keeps what was used more than once since the last time."""
        kept = np.flatnonzero(self.uses > 1)
        names, groups, count, start, flat = list(self.place), self.groups, self.count, self.start, self.flat
        self.clear()
        if len(kept) <= CACHED // 2:
            self.place = {names[k]: i for i, k in enumerate(kept.tolist())}
            self.groups, self.count = [groups[k] for k in kept.tolist()], count[kept]
            size = start[kept + 1] - start[kept]
            self.start = np.concatenate([[0], np.cumsum(size)])
            self.flat = flat[np.repeat(start[kept] - self.start[:-1], size) + np.arange(int(size.sum()))]
            self.uses = np.zeros(len(kept), np.int64)

    def _learn(self, chunks: list[str]) -> None:
        count, flat, size = [], [], []
        for c, (x, y) in zip(chunks, self.pair.encode(chunks)):
            found = self.pair.align(c, x, y)
            text, links = found or ("", [])
            self.place[c] = len(self.groups)
            self.groups.append(text)
            flat += links
            size.append(len(links))
            count.append((len(x), len(y), len(links)) if found else (-1, -1, -1))
        self.count = np.concatenate([self.count, np.array(count, np.int64).reshape(-1, 3)])
        self.start = np.concatenate([self.start, self.start[-1] + np.cumsum(np.array(size, np.int64))])
        self.flat = np.concatenate([self.flat, np.array(flat, np.int64)])
        self.uses = np.concatenate([self.uses, np.zeros(len(chunks), np.int64)])

    def __call__(self, some: Sequence[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Per text: counts of tokens and groups, digest of the groups; the links of all texts and their number in each."""
        split = [self.find(" " + t) for t in some]
        new = {c for s in split for c in s if c not in self.place}
        if len(self.place) + len(new) > CACHED:
            self._shrink()
            new = {c for s in split for c in s if c not in self.place}
        if new:
            self._learn(list(new))
        at, digests = [], []
        for s in split:
            ids = list(map(self.place.__getitem__, s))
            at.append(np.array(ids, np.int64))
            whole = ";".join(map(self.groups.__getitem__, ids))
            digests.append(hashlib.sha256(whole.encode()).hexdigest())
        sizes = np.array([len(x) for x in at])
        flat = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.uses += np.bincount(flat, minlength=len(self.uses))
        first = np.cumsum(sizes) - sizes
        own = self.count[flat]
        good = np.minimum.reduceat(own[:, 0], first) >= 0
        counts = np.where(good[:, None], np.add.reduceat(own, first), 0)
        flat = flat[np.repeat(good, sizes)]
        size = self.start[flat + 1] - self.start[flat]
        where = np.repeat(self.start[flat] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return counts, [d if g else "" for d, g in zip(digests, good.tolist())], self.flat[where], counts[:, 2]


def _aligner(byte_model: str, piece_model: bytes) -> Aligner:
    """One per Python worker and pair of models; it outlives a task."""
    return worker_state(("align", hash((byte_model, piece_model))), lambda: Aligner(byte_model, piece_model))


# ---- blocks of texts ----------------------------------------------------------------


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    """One list with all of ``values``."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values, kind))


def _align(batches: Iterator[pa.RecordBatch], aligner: Aligner) -> Iterator[pa.RecordBatch]:
    part, done = TaskContext.get().partitionId(), 0
    for batch in batches:
        _, offsets = texts(batch)
        for lo, hi in blocks(offsets):
            some = batch.slice(lo, hi - lo)
            values = some.column("text").to_pylist()
            weight = some.column("n").to_numpy()
            counts, groups, links, per_text = aligner(values)
            pairs, inverse = np.unique(links, return_inverse=True)
            owner = np.repeat(np.arange(len(values)), per_text)
            weighed = np.zeros(len(pairs), np.int64)
            np.add.at(weighed, inverse, weight[owner])
            own, times = np.unique(owner * max(1, len(pairs)) + inverse, return_counts=True)
            text_no, pair_no = own // max(1, len(pairs)), own % max(1, len(pairs))
            ends = np.searchsorted(text_no, np.arange(len(values)), "right")
            step = np.diff(pair_no, prepend=0)  # small steps take less room than places
            digests = pa.array([hashlib.sha256(t.encode()).digest() for t in values], pa.binary())
            one = pa.array([0, len(values)], pa.int32())
            arrays = [
                pa.array([(part << 32) + done], pa.int64()), pa.ListArray.from_arrays(one, digests), *[_lists(counts[:, i], pa.int64()) for i in range(3)],
                pa.ListArray.from_arrays(one, pa.array(groups, pa.string())), _lists(pairs, pa.int64()), _lists(weighed, pa.int64()),
                _lists(ends, pa.int32()), _lists(step, pa.int32()), _lists(times, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in BLOCKS.split(", ")])
            done += 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of each text from its block's pairs and their counts."""
    for batch in batches:
        for r in range(batch.num_rows):
            of = lambda name: batch.column(name)[r].values
            n = len(of("digests"))
            found = of("counts")
            count, best = np.zeros(len(of("pairs")), np.int64), np.zeros(len(of("pairs")), np.int64)
            if found is not None and len(found):
                place = found.field("place").to_numpy()
                count[place] = found.field("count").to_numpy()
                best[place] = found.field("best").to_numpy(zero_copy_only=False)
            times, pair = of("times").to_numpy().astype(np.int64), np.cumsum(of("step").to_numpy().astype(np.int64))
            ends = of("ends").to_numpy()
            until = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[ends], prepend=0)
            sums = [until(times), until(times * best[pair]), until(times * count[pair])]
            arrays = [of("digests"), of("n_a"), of("n_b"), of("n_groups"), *map(pa.array, sums), of("groups")]
            assert all(len(a) == n for a in arrays)
            yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in MEASURES.split(", ")])


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, count, best``: how many links hold an id pair; ``best`` if none with its B id has more."""
    counts = written(rows.select(F.explode(F.arrays_zip("pairs", "links")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.links").alias("count")), "align-counts")
    b = F.pmod("pair", F.lit(PAIR))
    highest = counts.groupBy(b.alias("b")).agg(F.max("count").alias("highest"))
    return counts.join(highest, b == F.col("b")).select("pair", "count", (F.col("count") == F.col("highest")).cast("long").alias("best"))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", byte_model: str | None = None, piece_model: str | None = None) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every document."""
    with open(byte_model or byte_file(), encoding="utf-8") as f, open(piece_model or piece_file(), "rb") as g:
        models = docs.sparkSession.sparkContext.broadcast((f.read(), g.read()))  # two vocabularies' files, of fixed size
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    filled = docs.where("text <> ''")
    distinct = filled.groupBy("text").agg(F.count("*").alias("n"))
    rows = written(distinct.mapInArrow(lambda b: _align(b, _aligner(*models.value)), BLOCKS), "align-blocks")
    # What each block's pairs count in the whole corpus: as many entries as the block has pairs.
    own = rows.select("block", F.posexplode("pairs").alias("place", "pair"))
    looked_up = own.join(pair_counts(rows), "pair").groupBy("block").agg(F.collect_list(F.struct("place", "count", "best")).alias("counts"))
    measures = rows.drop("links").join(looked_up, "block", "left").mapInArrow(_measure, MEASURES)
    keyed = filled.select("doc_id", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    aligned = keyed.join(measures, "digest").select("doc_id", *NUMBERS, "groups_sha256")
    zeros = docs.where("text IS NULL OR text = ''").select("doc_id", *[F.lit(0).cast("long").alias(n) for n in NUMBERS], F.lit("").alias("groups_sha256"))
    return aligned.unionByName(zeros)
