"""Nearest neighbours by a block matrix join.

Vectors are quantised to int8 with one scale each and dealt to blocks; query
blocks and candidate blocks meet in tiles by an equi-join on the tile's number. A
tile's int8 products give every inner product to within a bound that follows from
the quantisation errors (Cauchy-Schwarz). A pair whose upper bound is below its
query's k-th best lower bound cannot be an answer; surviving pairs are
recomputed from the float vectors in double precision. Bounded heaps of the tiles are merged per
query. The bounds are proven, so the answer is exact.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component
take no part; rows with a null id neither; only vectors of equal length are
compared; a query's own id is no candidate; repeated rows of a candidate count
each, a repeated query is asked once (its least vector); ties go to the smaller
id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.llm.common import session_parallelism, written

K = 20
QUERY_BLOCK, CANDIDATE_BLOCK = 2048, 4096

BLOCK = "ids binary, ints binary, scale binary, error binary, floats binary"
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scale and the length of the error of each row."""
    peak = np.abs(x).max(axis=1)
    scale = np.maximum(peak / 127.0, np.finfo(np.float64).tiny)
    q = np.clip(np.rint(x / scale[:, None]), -127, 127)
    error = np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))
    return q.astype(np.int8), scale, error


def _pack(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per block from rows sorted by ``keys``; a block's rows may span batches."""
    held: tuple | None = None
    ids: list[np.ndarray] = []
    parts: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        x = np.concatenate(parts)
        q, scale, error = quantise(x)
        row = {k: [v] for k, v in zip(keys, held)}
        row |= {"ids": [np.concatenate(ids).tobytes()], "ints": [q.tobytes()], "scale": [scale.tobytes()]}
        row |= {"error": [error.tobytes()], "floats": [x.tobytes()]}
        names = [*keys, "ids", "ints", "scale", "error", "floats"]
        kinds = [pa.int32()] * len(keys) + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(row[n], t) for n, t in zip(names, kinds)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(k).to_numpy() for k in keys], axis=1)
        cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            mark = tuple(int(x) for x in marks[lo])
            if mark != held:
                if held is not None:
                    yield flush()
                held, ids, parts = mark, [], []
            v = batch.column("v").slice(lo, hi - lo)
            parts.append(v.flatten().to_numpy().reshape(hi - lo, -1))
            ids.append(batch.column("id").slice(lo, hi - lo).to_numpy())
    if held is not None:
        yield flush()


def _blocks(vectors: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
    """Blocks of about ``size`` vectors of one length, and the number of blocks a length has."""
    count = max(1, -(-vectors.count() // size))
    keys = [name, "dim"]
    dealt = vectors.withColumn(name, F.pmod(F.xxhash64("id"), F.lit(count)).cast("int")).withColumn("dim", F.size("v"))
    packed = dealt.repartition(min(count, 4 * session_parallelism(vectors.sparkSession)), *keys).sortWithinPartitions(*keys, "id")
    return packed.mapInArrow(lambda batches: _pack(batches, keys), f"{name} int, dim int, {BLOCK}"), count


def _load(row: dict, dim: int) -> tuple[np.ndarray, ...]:
    ids = np.frombuffer(row["ids"], np.int64)
    ints = np.frombuffer(row["ints"], np.int8).reshape(-1, dim).astype(np.float32)
    return ids, ints, np.frombuffer(row["scale"]), np.frombuffer(row["error"]), np.frombuffer(row["floats"]).reshape(-1, dim)


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise inner products, summed from left to right in double precision."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def tile(query: tuple, cand: tuple, best: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, candidate rows and scores of the pairs that may be among the ``k`` best.

    ``best`` is each query's k-th best score so far.
    """
    qid, q, qs, qe, qx = query
    cid, c, cs, ce, cx = cand
    # int8 products are whole numbers below 2**24 up to 1040 dimensions; beyond, double keeps them exact.
    kind = np.float32 if q.shape[1] <= 1040 else np.float64
    near = (q.astype(kind) @ c.astype(kind).T).astype(np.float64)
    near *= qs[:, None]
    near *= cs[None, :]
    qn, cn = np.sqrt((q.astype(np.float64) ** 2).sum(1)) * qs, np.sqrt((c.astype(np.float64) ** 2).sum(1)) * cs
    slack = qe[:, None] * (cn + ce)[None, :]
    slack += qn[:, None] * ce[None, :]
    # Rounding of the doubles themselves, far below the quantisation error.
    slack += 1e-12 * (qn + qe)[:, None] * (cn + ce)[None, :]
    near[qid[:, None] == cid[None, :]] = -np.inf
    low = near - slack
    if low.shape[1] > k:
        bar = np.maximum(best, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
    else:
        bar = best
    near += slack
    i, j = np.nonzero((near >= bar[:, None]) & (near > -np.inf))
    score = np.empty(len(i))
    for lo in range(0, len(i), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        score[part] = exact_products(qx[i[part]], cx[j[part]])
    return i, j, score


def _search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each query over a run of tiles with the same query block."""
    held, query = None, None
    heap: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
    best = np.zeros(0)

    def flush() -> pa.RecordBatch:
        i, ids, score = heap
        return pa.RecordBatch.from_arrays([pa.array(query[0][i]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])

    for batch in batches:
        for row in batch.to_pylist():
            mark = (row["qb"], row["dim"])
            if mark != held:
                if held is not None:
                    yield flush()
                held = mark
                query = _load({n: row[f"q_{n}"] for n in ("ids", "ints", "scale", "error", "floats")}, row["dim"])
                heap = (np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0))
                best = np.full(len(query[0]), -np.inf)
            cand = _load(row, row["dim"])
            i, j, score = tile(query, cand, best, k)
            i, ids, score = np.concatenate([heap[0], i]), np.concatenate([heap[1], cand[0][j]]), np.concatenate([heap[2], score])
            order = np.lexsort((ids, -score, i))
            i, ids, score = i[order], ids[order], score[order]
            place = np.arange(len(i)) - np.searchsorted(i, i)
            keep = place < k
            heap = (i[keep], ids[keep], score[keep])
            full = place[keep] == k - 1
            best[heap[0][full]] = heap[2][full]
    if held is not None:
        yield flush()


def _merge(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best of each query from rows sorted by query; a query's rows may span batches."""

    def rows() -> Iterator[tuple[int, int, float]]:
        for b in batches:
            yield from zip(b.column("query_id").to_pylist(), b.column("vec_id").to_pylist(), b.column("score").to_pylist())

    out: list[tuple] = []
    for query, found in groupby(rows(), key=lambda r: r[0]):
        best = heapq.nsmallest(k, ((-s, v) for _, v, s in found))
        out += [(query, n, v, -s) for n, (s, v) in enumerate(best, 1)]
        if len(out) >= 20_000:
            yield _ranked(out)
            out = []
    if out:
        yield _ranked(out)


def _ranked(rows: list[tuple]) -> pa.RecordBatch:
    q, n, v, s = zip(*rows)
    arrays = [pa.array(q, pa.int64()), pa.array(n, pa.int32()), pa.array(v, pa.int64()), pa.array(s, pa.float64())]
    return pa.RecordBatch.from_arrays(arrays, ["query_id", "rank", "vec_id", "score"])


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = K,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest inner products among ``vectors``."""
    cand = written(usable(vectors, id_col, vec_col), "ann-candidates")
    asked = usable(queries, id_col, vec_col).groupBy("id").agg(F.min("v").alias("v"))
    asked = written(asked, "ann-queries")
    q, nq = _blocks(asked, query_block, "qb")
    c, nc = _blocks(cand, candidate_block, "cb")
    q, c = written(q, "ann-query-blocks"), written(c, "ann-candidate-blocks")
    q = q.select("qb", "dim", *[F.col(n).alias(f"q_{n}") for n in ("ids", "ints", "scale", "error", "floats")])
    q = q.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(nc - 1))))
    c = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(nq - 1))))
    parts = max(1, min(nq * nc, 2 * session_parallelism(vectors.sparkSession)))
    # Tiles of a query block in one task share its running heap.
    tiles = q.hint("merge").join(c, ["qb", "cb", "dim"]).repartition(parts, "qb", F.pmod("cb", F.lit(parts))).sortWithinPartitions("qb", "dim")
    found = tiles.mapInArrow(lambda b: _search(b, k), FOUND)
    dealt = found.repartition(session_parallelism(vectors.sparkSession), "query_id").sortWithinPartitions("query_id")
    return dealt.mapInArrow(lambda b: _merge(b, k), "query_id long, rank int, vec_id long, score double")
