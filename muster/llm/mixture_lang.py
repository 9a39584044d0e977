"""Language ID by multilingual mixture inference.

A document is a mixture of languages: each word (run of letters) comes from one of
them, with the likelihood of its letter trigrams in that language's model.
Expectation-maximisation estimates the document's language proportions. A larger
set of languages must pay for itself: the set with the best penalised likelihood
(BIC in the number of words) is selected, and the language with the largest
proportion in it is the prediction, that proportion the score.

The set is found by search, not by trying all subsets: sets of the likeliest languages of every
size, then single languages put in or taken out as long as that gains. No number of languages
is a limit: sizes end where the bound on the likelihood of all languages together proves
that no larger set can win.

A model is trigram counts of hashed buckets, counted by Spark over the labelled rows;
at most about ``max_docs`` rows of a language are used, chosen by a hash of the row.

Edge cases: a null text or one without a letter is ``und`` with score 0, as is
every text when nothing could be learned; rows with a null label teach nothing; ties go to the
language first in alphabetical order; null ids, repeated rows and other columns
pass through (``lang_pred`` and ``score`` are replaced); an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from muster.llm.common import U, blocks, mix, rebuilt, texts, worker_state

BUCKET_BITS = 16
MAX_TRAIN_DOCS = 20_000
SMOOTHING = 0.5
EM_STEPS = 20
PENALTY = 1.0
UNDETERMINED = "und"

# Bytes of text handled at a time: a byte takes up to 100 bytes meanwhile.
TEXT_BYTES = 1 << 20

LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])


def letters(values: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, 0 for anything but a letter, and each text's first place.

    A 0 stands before, between and behind the texts.
    """
    lowered = [(t or "").lower() for t in values]
    at = np.cumsum([1, *[len(t) + 1 for t in lowered]])
    code = np.frombuffer(("\0" + "\0".join(lowered) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = LETTER[np.minimum(code, 0xFFFF)]
    high = np.flatnonzero(code > 0xFFFF)
    keep[high] = [chr(c).isalpha() for c in code[high]]
    return np.where(keep, code, 0), at


def trigrams(code: np.ndarray) -> np.ndarray:
    """The bucket of the trigram around every inner place."""
    c = code.astype(U)
    x = c[:-2] * U(0x9E3779B97F4A7C15) + c[1:-1] * U(0xC2B2AE3D27D4EB4F) + c[2:] * U(0x165667B19E3779F9)
    return (mix(x) >> U(64 - BUCKET_BITS)).astype(np.int64)


@dataclass
class Model:
    languages: list[str]
    logp: np.ndarray  # bucket x language


# ---- learning -------------------------------------------------------------------


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    worker_state()  # nothing is kept here: let go what another operator has left
    seen: dict[str, np.ndarray] = {}
    for batch in batches:
        _, offsets = texts(batch)
        for lo, hi in blocks(offsets, TEXT_BYTES):
            some = batch.slice(lo, hi - lo)
            code, at = letters(some.column("text").to_pylist())
            bucket = trigrams(code)
            inside = code[1:-1] > 0
            langs = np.array(some.column("lang").to_pylist(), object)
            of = np.repeat(np.arange(len(langs)), np.diff(at))[: len(bucket)]
            names, index = np.unique(langs.astype(str), return_inverse=True)
            for k, name in enumerate(names):
                own = inside & (index[of] == k)
                seen[name] = seen.get(name, 0) + np.bincount(bucket[own], minlength=1 << BUCKET_BITS)
    for name, counts in seen.items():
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([name] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(counts[found])], ["lang", "bucket", "n"]
        )


def learn(labelled: DataFrame, max_docs: int = MAX_TRAIN_DOCS) -> Model:
    """Trigram models of the languages in ``lang`` from ``text``.

    The driver gets one row per language and bucket, 65536 per language at most.
    """
    rows = labelled.select(F.col("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    place = F.pmod(F.xxhash64("text"), F.lit(1 << 20))
    chosen = F.lit(False)
    for lang, n in sizes.items():
        chosen = chosen | ((F.col("lang") == lang) & (place < int(min(1.0, max_docs / n) * (1 << 20))))
    counts = rows.where(chosen).mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = counts.toArrow()
    langs = np.array(found.column("lang").to_pylist(), object)
    names = sorted(set(langs))
    table = np.full((1 << BUCKET_BITS, len(names)), SMOOTHING)
    if names:
        column = np.searchsorted(np.array(names, object), langs)
        table[found.column("bucket").to_numpy(), column] += found.column("n").to_numpy()
    return Model(names, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))


# ---- inference ------------------------------------------------------------------


def word_scores(code: np.ndarray, at: np.ndarray, model: Model, size: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of every word in every language, and the first word of each text."""
    inside = code > 0
    edge = np.flatnonzero(np.diff(inside.astype(np.int8)))
    start, end = edge[::2] + 1, edge[1::2] + 1
    bucket = trigrams(code)
    out = np.empty((len(start), len(model.languages)), np.float32)
    lo = 0
    while lo < len(start):  # some words at a time, for memory
        hi = max(lo + 1, int(np.searchsorted(end, start[lo] + size, "right")))
        first, last = int(start[lo]), int(end[hi - 1])
        values = model.logp[bucket[first - 1 : last - 1]]
        values[~inside[first:last]] = 0
        out[lo:hi] = np.add.reduceat(values, start[lo:hi] - first, axis=0)
        lo = hi
    return out, np.searchsorted(start, at)


def em(like: np.ndarray, counts: np.ndarray, allowed: np.ndarray, steps: int = EM_STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of texts, each a run of ``counts`` words (no run is empty).

    ``like`` holds log-likelihoods; ``allowed`` the languages that a text may use.
    """
    first = np.cumsum(counts) - counts
    peak = like.max(axis=1, keepdims=True)
    p = np.ascontiguousarray(np.exp(like - peak).T)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    # A text stops by itself, so that its result does not depend on the texts beside it.
    moving = np.ones(len(counts), bool)

    def weighted(k: int) -> np.ndarray:
        return p[k] * np.repeat(share[:, k].astype(np.float32), counts)

    def summed() -> np.ndarray:
        # A word that none of the allowed languages can have made at all counts as hardly likely.
        return np.maximum(sum(weighted(k) for k in range(p.shape[0])), np.float32(1e-30))

    for _ in range(steps):
        total = summed()
        new = np.stack([np.add.reduceat(weighted(k) / total, first, dtype=np.float64) for k in range(p.shape[0])], axis=1)
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
        far = np.abs(new - share).max(axis=1) >= 1e-4
        share = np.where(moving[:, None], new, share)
        moving &= far
        if not moving.any():
            break
    return share, np.add.reduceat(np.log(summed()) + peak[:, 0], first, dtype=np.float64)


def bound(like: np.ndarray, counts: np.ndarray, share: np.ndarray, fit: np.ndarray) -> np.ndarray:
    """What no mixture's log-likelihood exceeds, from proportions EM has reached.

    By Jensen's inequality another mixture gains at most, per word, the logarithm of the largest
    mean ratio of one language's likelihood to the mixture's.
    """
    first = np.cumsum(counts) - counts
    p = np.exp(like - like.max(axis=1, keepdims=True))
    total = np.maximum((p * np.repeat(share, counts, axis=0)).sum(axis=1, keepdims=True), 1e-30)
    ratio = np.add.reduceat(p / total, first, axis=0, dtype=np.float64).max(axis=1) / counts
    return fit + counts * np.log(np.maximum(ratio, 1.0))


def infer(like: np.ndarray, counts: np.ndarray, steps: int = EM_STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Language proportions of each text under its selected set; other languages have 0."""
    n, k = len(counts), like.shape[1]
    first = np.cumsum(counts) - counts
    alone = np.add.reduceat(like, first, axis=0, dtype=np.float64)
    best = alone.argmax(axis=1)
    chosen = np.zeros((n, k))
    chosen[np.arange(n), best] = 1.0
    if k == 1:
        return chosen
    full, top = em(like, counts, np.ones((n, k)), steps)
    top = bound(like, counts, full, top)
    price = penalty * np.log(counts + 1.0)
    value = 2 * alone[np.arange(n), best]
    sets = chosen > 0
    order = np.argsort(-full, axis=1, kind="stable")

    def attempt(rows: np.ndarray, allowed: np.ndarray) -> np.ndarray:
        """Tries a set for each of some texts; those of them that it has won."""
        mask = np.zeros(n, bool)
        mask[rows] = True
        share, fit = em(like[np.repeat(mask, counts)], counts[rows], allowed.astype(float), steps)
        gain = 2 * fit - price[rows] * (allowed.sum(axis=1) - 1)
        won = gain > value[rows] + 1e-6
        value[rows[won]], chosen[rows[won]], sets[rows[won]] = gain[won], share[won], allowed[won]
        return rows[won]

    def open_to(size: int | np.ndarray, rows: np.ndarray) -> np.ndarray:
        """The texts that a set of this size could win."""
        return rows[2 * top[rows] - price[rows] * (size - 1) > value[rows]]

    could = open_to(2, np.arange(n))
    rows = could
    for size in range(2, k + 1):
        rows = open_to(size, rows)
        if not len(rows):
            break
        allowed = np.zeros((len(rows), k), bool)
        np.put_along_axis(allowed, order[rows, :size], True, axis=1)
        attempt(rows, allowed)
    while len(could):  # every win raises a text's value, of which there are finitely many
        moved = []
        for language in range(k):
            allowed = sets[could].copy()
            allowed[:, language] ^= True
            size = allowed.sum(axis=1)
            fine = (size > 0) & (2 * top[could] - price[could] * (size - 1) > value[could])
            if fine.any():
                moved.append(attempt(could[fine], allowed[fine]))
        could = np.unique(np.concatenate(moved)) if moved else could[:0]
    return chosen


def predict(values: list[str | None], model: Model) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language and score of each text, and the proportions behind them."""
    langs = np.full(len(values), UNDETERMINED, object)
    score, shares = np.zeros(len(values)), np.zeros((len(values), len(model.languages)))
    if model.languages:
        code, at = letters(values)
        like, word = word_scores(code, at, model)
        counts = np.diff(word)
        with_words = np.flatnonzero(counts)
        if len(with_words):
            got = infer(like, counts[with_words])
            shares[with_words] = got
            langs[with_words] = np.array(model.languages, object)[got.argmax(axis=1)]
            score[with_words] = got.max(axis=1)
    return langs.tolist(), np.minimum(score, 1.0), shares


def _predict(batches: Iterator[pa.RecordBatch], model: Model, text_col: str) -> Iterator[pa.RecordBatch]:
    worker_state()
    for batch in batches:
        _, offsets = texts(batch, text_col)
        for lo, hi in blocks(offsets, TEXT_BYTES):
            some = batch.slice(lo, hi - lo)
            langs, score, _ = predict(some.column(text_col).to_pylist(), model)
            yield pa.RecordBatch.from_arrays(
                [*some.columns, pa.array(langs, pa.string()), pa.array(score)], [*some.schema.names, "lang_pred", "score"]
            )


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    rows = docs.drop("lang_pred", "score")
    # 256 kB per language.
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))
    schema = T.StructType([*rows.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(lambda b: _predict(b, rebuilt(Model, shared.value), text_col), schema)
