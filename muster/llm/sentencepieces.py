"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is read here, and its normaliser, metaspace marker, scores and
byte fallback are rebuilt as a tokenizer of that library: a unigram model keeps its
scores, a BPE model gets its merges back, since a piece's rank is its score.
Batches are encoded with several threads, each distinct chunk once. The ids are that
tokenizer's alone; the sentencepiece library encodes every chunk as well, and
``n_mismatched`` counts a text's chunks for which the two differ.

Texts are cut into chunks before each marker, which changes no ids as long as no
piece holds a marker behind another character; a model that has one is encoded
in whole texts.

Edge cases: a null text is empty and has no ids; null ids of documents and repeated
rows pass through; an empty table gives none; extra columns are dropped. Models of
words or characters, with user-defined symbols or a marker as suffix are refused.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers

from muster.llm.chunks import ChunkCache
from muster.llm.common import blocks, texts

MARK = "▁"
# Fixed values of the public model format: kinds of pieces and models.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
# Chunks kept per Python worker, next to the two libraries' own tables.
CACHED = 300_000

ENCODED = "doc_id long, ids array<int>, ids_crc32 long, n_unknown long, n_byte long, n_mismatched long, normal string"
VERIFIED = "doc_id long, n_tokens long, ids_crc32 long, n_unknown long, n_byte long, n_mismatched long, round_trip boolean"


def model_file() -> str:
    return public_tokenizers.path("piece_bpe_32k.model")


# ---- the model file -----------------------------------------------------------


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = raw[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of each field of a protobuf message."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            if kind == 2:
                size, at = _varint(raw, at)
            elif kind in (1, 5):
                size = 8 if kind == 1 else 4
            else:
                raise ValueError(f"not a sentencepiece model: wire type {kind}")
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_mark: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    trim_spaces: bool = True
    mark_spaces: bool = True


def read_model(raw: bytes) -> Model:
    out = Model()
    for number, value in fields(raw):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.pieces.append((piece, score, kind))
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    out.kind = v
                elif n == 24:
                    out.suffix_mark = bool(v)
                elif n == 35:
                    out.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 2:
                    out.charsmap = v
                elif n == 3:
                    out.dummy_prefix = bool(v)
                elif n == 4:
                    out.trim_spaces = bool(v)
                elif n == 5:
                    out.mark_spaces = bool(v)
    if out.kind not in (UNIGRAM, BPE) or out.suffix_mark or any(k == USER for _, _, k in out.pieces):
        raise ValueError("only unigram and BPE models without user-defined symbols and suffix marks")
    return out


def merges(model: Model) -> list[tuple[str, str]]:
    """Every way to join two pieces into a third, best score first."""
    usable = {p: i for i, (p, _, k) in enumerate(model.pieces) if k in (NORMAL, UNUSED)}
    found = []
    for piece, i in usable.items():
        for cut in range(1, len(piece)):
            left, right = usable.get(piece[:cut]), usable.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[i][1], left, right, piece[:cut], piece[cut:]))
    return [(a, b) for *_, a, b in sorted(found)]


def normaliser(model: Model) -> normalizers.Normalizer:
    steps: list[normalizers.Normalizer] = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.trim_spaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK if model.mark_spaces else " "))
    if model.mark_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def tokenizer(model: Model) -> Tokenizer:
    """Encodes normalised text: the normaliser is applied before texts are cut."""
    vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
    unknown = next(i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN)
    if model.kind == UNIGRAM:
        # Control pieces are never found in text.
        low = min(s for _, s, k in model.pieces if k == NORMAL) - 1000.0
        scores = [(p, s if k == NORMAL else low) for p, s, k in model.pieces]
        out = Tokenizer(models.Unigram(scores, unknown, model.byte_fallback))
    else:
        kind = models.BPE(vocab, merges(model), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
        out = Tokenizer(kind)
    steps: list[decoders.Decoder] = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if model.dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    out.decoder = decoders.Sequence(steps)
    return out


# ---- encoding -------------------------------------------------------------------


class Codec:
    """A model's tokenizer with the cache of its chunks, for one Python worker."""

    def __init__(self, raw: bytes, threads: int):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        self.model = read_model(raw)
        self.normaliser, self.tokenizer = normaliser(self.model), tokenizer(self.model)
        self.judge = sentencepiece.SentencePieceProcessor(model_proto=raw)
        kinds = np.array([k for _, _, k in self.model.pieces])
        self.unknown, self.bytes = kinds == UNKNOWN, kinds == BYTE
        whole = not self.model.mark_spaces or any(re.search(f"[^{MARK}]{MARK}", p) for p, _, _ in self.model.pieces)
        self.cache = ChunkCache(self._encode, r"(?s).+" if whole else f"{MARK}*[^{MARK}]+|{MARK}+", CACHED)
        self.wrong: set[str] = set()

    def _encode(self, chunks: Sequence[str]) -> list[Sequence[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch(list(chunks), add_special_tokens=False)]
        # sentencepiece puts the prefix on by itself.
        plain = [c.replace(MARK, " ")[self.model.dummy_prefix :] if self.model.mark_spaces else c for c in chunks]
        judged = self.judge.encode(plain, num_threads=1)
        # A lone mark can't be asked for: it would be the prefix of an empty text.
        self.wrong.update(c for c, p, a, b in zip(chunks, plain, found, judged) if p and a != b)
        return found

    def normal(self, text: str) -> str:
        if not text or self.model.charsmap or self.model.trim_spaces:
            return self.normaliser.normalize_str(text) if text else ""
        text = " " + text if self.model.dummy_prefix else text
        return text.replace(" ", MARK) if self.model.mark_spaces else text

    def encode(self, texts: Sequence[str]) -> tuple[list[str], np.ndarray, np.ndarray, list[int]]:
        """Normalised texts, all ids, their count per text, and per text the chunks that the libraries cut differently."""
        normal = [self.normal(t) for t in texts]
        flat, counts, chunks, per_text = self.cache.ids(normal)
        if not self.wrong:
            return normal, flat, counts, [0] * len(normal)
        bad = np.fromiter((c in self.wrong for c in chunks), np.int64, len(chunks))
        ends = np.concatenate([[0], np.cumsum(bad)])
        at = np.concatenate([[0], np.cumsum(per_text)])
        return normal, flat, counts, (ends[at[1:]] - ends[at[:-1]]).tolist()


class Decoder:
    """The bytes of every id; light, since decoding runs beside an encoder."""

    def __init__(self, raw: bytes):
        model = read_model(raw)
        byte = lambda p: bytes([int(p[1:-1], 16)])
        self.prefix = model.dummy_prefix
        self.out = [
            byte(p) if k == BYTE else b"" if k == CONTROL else (" ⁇ " if k == UNKNOWN else p.replace(MARK, " ")).encode()
            for p, _, k in model.pieces
        ]

    def decode(self, ids: Sequence[int]) -> str:
        text = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text[:1] == " " else text


WORKER: dict[tuple, Codec] = {}


def codec(raw: bytes, threads: int = 1) -> Codec:
    key = (hash(raw), threads)
    if key not in WORKER:
        WORKER[key] = Codec(raw, threads)
    return WORKER[key]


def _encoded(batches: Iterator[pa.RecordBatch], c: Codec) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, dict[str, pa.Array]]]:
    """Normalised texts, ids, their bounds and the counted columns of some texts at a time."""
    for batch in batches:
        _, offsets = texts(batch)
        for lo, hi in blocks(offsets):
            some = batch.slice(lo, hi - lo)
            normal, flat, counts, wrong = c.encode([t or "" for t in some.column("text").to_pylist()])
            at = np.concatenate([[0], np.cumsum(counts)])
            data = flat.astype("<u4")
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
            seen = [np.concatenate([[0], np.cumsum(kind[flat])]) for kind in (c.unknown, c.bytes)]
            unknown, byte = (pa.array((s[at[1:]] - s[at[:-1]]).astype(np.int64)) for s in seen)
            columns = {"ids_crc32": pa.array(crc, pa.int64()), "n_unknown": unknown, "n_byte": byte, "n_mismatched": pa.array(wrong, pa.int64())}
            yield normal, flat, at, {"doc_id": some.column("doc_id"), **columns}


def _encode(batches: Iterator[pa.RecordBatch], raw: bytes, threads: int) -> Iterator[pa.RecordBatch]:
    for normal, flat, at, columns in _encoded(batches, codec(raw, threads)):
        ids = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
        columns = {"doc_id": columns.pop("doc_id"), "ids": ids, **columns, "normal": pa.array(normal, pa.string())}
        yield pa.RecordBatch.from_pydict(columns)


def _verify(batches: Iterator[pa.RecordBatch], raw: bytes, threads: int) -> Iterator[pa.RecordBatch]:
    decoder, c = Decoder(raw), codec(raw, threads)
    mark = MARK if c.model.mark_spaces else " "
    for normal, flat, at, columns in _encoded(batches, c):
        same = [
            decoder.decode(flat[a:b].tolist()) == t.replace(MARK, " ")[t[:1] == mark and c.model.dummy_prefix :]
            for a, b, t in zip(at.tolist(), at[1:].tolist(), normal)
        ]
        columns = {"doc_id": columns.pop("doc_id"), "n_tokens": pa.array(np.diff(at)), **columns, "round_trip": pa.array(same)}
        yield pa.RecordBatch.from_pydict(columns)


def _decode(batches: Iterator[pa.RecordBatch], raw: bytes, column: str) -> Iterator[pa.RecordBatch]:
    decoder = Decoder(raw)
    for batch in batches:
        ids = batch.column(column)
        decoded = [decoder.decode(x.values.to_numpy().tolist()) if x.is_valid else None for x in ids]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.string())], [*batch.schema.names, "decoded"])


def encode(docs: DataFrame, path: str | None = None, threads: int = 2) -> DataFrame:
    """``doc_id``, ``ids`` and what is known of them, see ``ENCODED``; ``normal`` is the normalised text."""
    with open(path or model_file(), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())  # the vocabulary's file, of fixed size
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _encode(b, raw.value, threads), ENCODED)


def decode(encoded: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """``encoded`` with the text of its ids as ``decoded``; null ids have none."""
    with open(path or model_file(), "rb") as f:
        raw = encoded.sparkSession.sparkContext.broadcast(f.read())
    schema = T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())])
    return encoded.mapInArrow(lambda b: _decode(b, raw.value, column), schema)


def verify(docs: DataFrame, path: str | None = None, threads: int = 2) -> DataFrame:
    """What encoding gives for each document, see ``VERIFIED``, and whether decoding gives the normalised text again."""
    with open(path or model_file(), "rb") as f:
        raw = docs.sparkSession.sparkContext.broadcast(f.read())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda b: _verify(b, raw.value, threads), VERIFIED)
