"""N-gram Jaccard join: size-aware, with light and heavy sets.

A document's set is its distinct word shingles. Tokens are ordered rarest first; two
sets that are similar enough share at least ``l`` of their first ``a - ceil(t a) + l``
tokens (``a`` the set's size, ``t`` the threshold). Light sets, up to a boundary size, enumerate
all subsets of fixed size two of that prefix (``l = 2``), so that only sets sharing a
whole subset meet. Heavy sets are found by scanning inverted lists of single
prefix tokens (``l = 1``), which light sets near the boundary enter as well. The
boundary is the one with the least estimated cost: subsets written against
list entries scanned.

Sets are compared once per distinct set. In each list, all sets are first held
against one of them, the hub; those found similar are one component, and only
pairs that lie in different components remain. Those left over meet a second hub. A list
that still holds several components is cut into tiles of bounded size; a task holds a
tile's parity bitmaps, which prove that sets differ in so many tokens, against each
other and puts out the few pairs they leave open. So large groups of near copies cost a
comparison per member, no link between components is lost, pairs within a component are
never looked at, and no pairs are listed but those that are nearly similar or met a hub.
Pairs left open by their bitmaps are verified on the whole sets.

The order of tokens comes from counts within each task's part of the corpus, added up
over all tasks; it decides cost only, never the result, and its table is cut
to ``MAX_ORDERED`` tokens.

Edge cases: a null or blank text has an empty set and is linked with nothing; texts with
fewer words than a shingle have one; equal sets are linked; repeated rows are
rows of their own; a null id is linked but never names a component unless the
component has no other; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.common import U, Words, as_longs, blocks, mix, rebuilt, texts, windows, with_lower, worker_state, written
from muster.llm.components import components

WIDTH = 5
NUM, DEN = 75, 100
MAX_ORDERED = 1 << 20
# A token counts as frequent from so many sets; each task tells those it has met this often.
MIN_SEEN, MIN_SEEN_IN_TASK = 4, 2
MAX_LIGHT = 256

LIGHT, HEAVY, BORDER = 0, 1, 2


# ---- sets -----------------------------------------------------------------------


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(with_lower(data[int(offsets[0]) : int(offsets[-1])]), offsets - offsets[0])
    code = windows(words.code, width)
    out = []
    for a, b in zip(words.at.tolist(), words.at[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(code[a : b - width + 1]))
        else:
            out.append(windows(words.code[a:b], b - a) if b > a else np.zeros(0, U))
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value per set."""
    return np.array([mix(mix(s).sum(dtype=U, keepdims=True) ^ U(len(s)))[0] if len(s) else U(0) for s in sets], U)


def _sets(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[np.ndarray], np.ndarray]]:
    data, offsets = texts(batch)
    for lo, hi in blocks(offsets):
        sets = shingle_sets(data, offsets[lo : hi + 1])
        yield lo, hi, sets, fingerprints(sets)


PROFILE = "doc_id long, fp long, n int, bits binary, token long, seen long, digest binary"
MIN_BITS, MAX_BITS = 64, 1 << 16


def parity_bits(s: np.ndarray) -> bytes:
    """Parity of the number of tokens by their low bits, with four places a token or more."""
    places = min(MAX_BITS, max(MIN_BITS, 1 << (4 * len(s)).bit_length()))
    return np.packbits((np.bincount((s & U(places - 1)).astype(np.int64), minlength=places) & 1).astype(bool)).tobytes()


def may_link(a: int, b: int, x: np.ndarray, y: np.ndarray) -> bool:
    """Whether parity bits leave room for similar sets of sizes ``a`` and ``b``.

    Sets differ in at least as many tokens as their parities in places; more places
    fold onto fewer by exclusive or.
    """
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    both = (a + b - int(np.bitwise_count(x ^ y).sum())) // 2
    return DEN * both >= NUM * (a + b - both)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows with how many distinct sets of a batch hold a token."""
    worker_state()  # nothing is kept here: let go what another operator has left
    names = [f.split()[0] for f in PROFILE.split(", ")]
    for batch in batches:
        known: set[int] = set()
        parts = []
        for lo, hi, sets, fp in _sets(batch):
            nothing = pa.nulls(hi - lo, pa.int64())
            n = pa.array([len(s) for s in sets], pa.int32())
            bits = pa.array([parity_bits(s) for s in sets], pa.binary())
            some = batch.slice(lo, hi - lo)
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(as_longs(fp)), n, bits, nothing, nothing, some.column("digest")], names)
            for f, s in zip(fp.tolist(), sets):
                if f not in known:
                    known.add(f)
                    parts.append(s)
        token, seen = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, U), np.zeros(0, int))
        often = seen >= MIN_SEEN_IN_TASK
        k = int(often.sum())
        arrays = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.array(as_longs(token[often])), pa.array(seen[often]), pa.nulls(k, pa.binary())], names)


# ---- cost -----------------------------------------------------------------------


def least_overlap(a: int) -> int:
    return -(-NUM * a // DEN)


def prefix(a: int, shared: int) -> int:
    return a - least_overlap(a) + shared


def prefix_list_length(seen: np.ndarray, tokens: float) -> float:
    """Mean length of the list a prefix token stands in: prefixes hold the rarest part of all tokens.

    ``seen`` are the counts of frequent tokens, the others count as met once.
    """
    part = tokens * (1 - NUM / DEN)
    upwards = np.sort(seen).astype(float)
    mass = np.cumsum(upwards) + max(0.0, tokens - float(upwards.sum()))
    taken = upwards[mass <= part]
    return float(((taken**2).sum() + part - taken.sum()) / max(1.0, part))


# Costs of a row written and shuffled and of a list entry scanned.
WRITE, SCAN = 1.0, 0.1


def boundary(sizes: dict[int, int], list_length: float) -> int:
    """The largest light size with the least cost; ``sizes`` has the number of sets by size."""

    def subsets(a: int) -> float:
        p = prefix(a, 2)
        return p * (p - 1) / 2 * (WRITE + SCAN)

    def cost(b: int) -> float:
        total = 0.0
        for a, n in sizes.items():
            if a >= 3:
                scan = prefix(a, 1) * (WRITE + SCAN * list_length)
                total += n * (scan if a > b else subsets(a) + (scan if a >= least_overlap(b + 1) else 0))
        return total

    return min(range(2, MAX_LIGHT + 1), key=cost)


# ---- signatures -----------------------------------------------------------------


class Order:
    """Rarest first: tokens without a level, then by level (log of their count), then by hash."""

    def __init__(self, token: np.ndarray, seen: np.ndarray):
        by = np.argsort(token)
        self.token, self.level = token[by], np.log2(np.maximum(seen[by], 1)).astype(np.int64) + 1

    def first(self, s: np.ndarray, count: int) -> np.ndarray:
        if not len(self.token):
            return s[:count]
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        level = np.where(self.token[at] == s, self.level[at], 0)
        return s[np.argsort(level, kind="stable")[:count]] if level.any() else s[:count]


SIGNATURES = "sig long, fp long, n int, kind int"


def signatures(s: np.ndarray, order: Order, light: int) -> list[tuple[np.ndarray, int]]:
    """Signatures of a set and their kind. Sets under three tokens are only like their equals."""
    a = len(s)
    if a < 3:
        return []
    first = order.first(s, prefix(a, 2))
    out = []
    if a <= light:
        i, j = np.triu_indices(len(first), 1)
        out.append((mix(first[i] * U(0x9E3779B97F4A7C15) + mix(first[j])), LIGHT))
    if a > light or a >= least_overlap(light + 1):
        out.append((first[: prefix(a, 1)], HEAVY if a > light else BORDER))
    return out


def _sign(batches: Iterator[pa.RecordBatch], order: Order, light: int) -> Iterator[pa.RecordBatch]:
    known: set[int] = set()  # sets met in this task
    for batch in batches:
        for _, _, sets, fp in _sets(batch):
            sig, owner, size, kind = [], [], [], []
            for f, s in zip(fp.tolist(), sets):
                if f in known:
                    continue
                known.add(f)
                for values, k in signatures(s, order, light):
                    sig.append(values)
                    owner.append(np.full(len(values), f, U))
                    size.append(np.full(len(values), len(s), np.int32))
                    kind.append(np.full(len(values), k, np.int32))
            if sig:
                arrays = [as_longs(np.concatenate(sig)), as_longs(np.concatenate(owner)), np.concatenate(size), np.concatenate(kind)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["sig", "fp", "n", "kind"])


# ---- verification ---------------------------------------------------------------


def _emit_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, sets, fp in _sets(batch):
            yield pa.RecordBatch.from_arrays([pa.array(as_longs(fp)), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "tokens"])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return DEN * both >= NUM * (len(x) + len(y) - both)


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = batch.column("x"), batch.column("y")
        good = [linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)) for x, y in zip(xs, ys)]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = zip(batch.column("an").to_pylist(), batch.column("bn").to_pylist(), batch.column("x"), batch.column("y"))
        good = [may_link(a, b, np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)) for a, b, x, y in rows]
        yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


class Verifier:
    """Holds pairs of sets against each other: their parity bits first, the sets of what remains then."""

    def __init__(self, docs: DataFrame, owners: DataFrame):
        self.docs, self.owners = docs, owners
        self.bits = written(owners.groupBy("fp").agg(F.first("n").alias("n"), F.first("bits").alias("bits")), "jaccard-bits")

    def __call__(self, edges: DataFrame) -> DataFrame:
        """The pairs ``(a, b)`` of ``edges`` whose sets are similar enough."""
        x = self.bits.select(F.col("fp").alias("a"), F.col("n").alias("an"), F.col("bits").alias("x"))
        y = self.bits.select(F.col("fp").alias("b"), F.col("n").alias("bn"), F.col("bits").alias("y"))
        near = written(edges.join(x, "a").join(y, "b").select("a", "b", "an", "bn", "x", "y").mapInArrow(_screen, "a long, b long"), "jaccard-near")
        # The sets, from one document each.
        wanted = written(near.select(F.col("a").alias("fp")).unionByName(near.select(F.col("b").alias("fp"))).distinct(), "jaccard-wanted")
        ids = self.owners.join(wanted, "fp", "left_semi").groupBy("fp").agg(F.min("doc_id").alias("rep")).select("rep").distinct()
        ids = written(ids, "jaccard-ids")
        chosen = self.docs.join(ids, self.docs.doc_id.eqNullSafe(ids.rep), "left_semi").select("text")
        # An id may stand for several rows, with the same or another set: one of each set that is wanted.
        sets = chosen.mapInArrow(_emit_sets, "fp long, tokens binary").join(wanted, "fp", "left_semi").groupBy("fp").agg(F.first("tokens").alias("tokens"))
        sets = written(sets, "jaccard-sets")
        x = sets.select(F.col("fp").alias("a"), F.col("tokens").alias("x"))
        y = sets.select(F.col("fp").alias("b"), F.col("tokens").alias("y"))
        met = near.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long").distinct()
        return written(met, "jaccard-links")


# ---- tiles ----------------------------------------------------------------------

# Sets of a list that are held against each other at a time.
TILE = 1024
TILE_ROWS = "sig long, i int, j int, fp long, n int, kind int, root long, bucket int, bits binary"


def _left_open(rows: dict[str, list], among: bool) -> Iterator[tuple[int, int]]:
    """Pairs of a tile in different components whose bitmaps leave room for similar sets.

    ``among``: all rows are one bucket; else pairs have a row of either bucket.
    """
    fp, n, kind, root, bucket = (np.array(rows[c]) for c in ("fp", "n", "kind", "root", "bucket"))
    places = np.array([len(b) for b in rows["bits"]])
    maps = {size: (own := np.flatnonzero(places == size), np.stack([np.frombuffer(rows["bits"][k], U) for k in own.tolist()])) for size in np.unique(places).tolist()}
    for size, (own, left) in maps.items():
        for other, (them, right) in maps.items():
            if other < size:
                continue
            right = np.bitwise_xor.reduce(right.reshape(len(them), -1, left.shape[1]), axis=1)
            for k, x in zip(own.tolist(), left):
                ok = (root[them] != root[k]) & (DEN * np.minimum(n[them], n[k]) >= NUM * np.maximum(n[them], n[k])) & ((kind[them] != BORDER) | (kind[k] != BORDER))
                ok &= (them > k) if other == size else True
                ok &= True if among else bucket[them] != bucket[k]
                at = np.flatnonzero(ok)
                both = (n[k] + n[them[at]] - np.bitwise_count(right[at] ^ x).sum(axis=1, dtype=np.int64)) // 2
                for m in them[at[DEN * both >= NUM * (n[k] + n[them[at]] - both)]].tolist():
                    yield min(fp[k], fp[m]), max(fp[k], fp[m])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile to the distinct pairs left open; a tile may go on in the next batch."""
    names = ["fp", "n", "kind", "root", "bucket", "bits"]
    now, rows = None, {c: [] for c in names}
    met: set[tuple[int, int]] = set()

    def out() -> pa.RecordBatch:
        pairs = list(met)
        met.clear()
        return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("sig", "i", "j"))))
        columns = {c: batch.column(c).to_pylist() for c in names}
        starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
        for lo, hi in zip(starts, [*starts[1:], len(keys)]):
            if keys[lo] != now:
                if now is not None:
                    met.update(_left_open(rows, now[1] == now[2]))
                now, rows = keys[lo], {c: [] for c in names}
            for c in names:
                rows[c] += columns[c][lo:hi]
        if len(met) > 1 << 16:
            yield out()
    if now is not None:
        met.update(_left_open(rows, now[1] == now[2]))
    yield out()


def open_pairs(lists: DataFrame, bits: DataFrame, tile: int = 0) -> DataFrame:
    """Pairs ``(a, b)`` of different components that share a list and may be similar.

    A list of up to ``TILE`` sets is one tile; a longer one is dealt to buckets of about that
    size, and each two buckets are a tile.
    """
    size = lists.groupBy("sig").agg(F.ceil(F.count("*") / (tile or TILE)).cast("int").alias("buckets"))
    rows = lists.join(size, "sig").join(bits.select("fp", "bits"), "fp")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("fp"), F.col("buckets")).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    rows = rows.withColumn("i", F.least("bucket", "o")).withColumn("j", F.greatest("bucket", "o")).select([f.split()[0] for f in TILE_ROWS.split(", ")])
    dealt = rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    return dealt.mapInArrow(_tiles, "a long, b long").distinct()


def _comparable(a: Column, b: Column) -> Column:
    return DEN * F.least(a, b) >= NUM * F.greatest(a, b)


def _pairs(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def _open(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the lists that still hold more than one component, with ``root``."""
    named = shared.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    w = Window.partitionBy("sig")
    marked = named.withColumn("lo", F.min("root").over(w)).withColumn("hi", F.max("root").over(w))
    return written(marked.where("lo <> hi").drop("lo", "hi"), "jaccard-open")


def _distinct_lists(rows: DataFrame) -> DataFrame:
    """``rows`` without lists that hold the very members of another list."""
    w = Window.partitionBy("sig")
    # Two sums of hashes stand for the members; kinds belong to them.
    one = F.xxhash64("fp", "kind")
    marked = rows.withColumn("m1", F.sum(F.shiftright(one, 20)).over(w)).withColumn("m2", F.sum(one.bitwiseAND(F.lit((1 << 40) - 1))).over(w))
    marked = marked.withColumn("m3", F.count("*").over(w))
    keep = marked.groupBy("m1", "m2", "m3").agg(F.min("sig").alias("sig")).select("sig")
    return written(rows.join(keep, "sig", "left_semi"), "jaccard-lists")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per document."""
    named = _with_roots(docs, id_col, text_col)
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    joined = named.where("n > 0").join(least, "root").select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = named.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return joined.unionByName(empty)


def _with_roots(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, digest, fp, n, root`` of every row: its text's digest, its set, and its component."""
    spark = docs.sparkSession
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    profile = written(docs.withColumn("digest", text_digest(F.col("text"))).mapInArrow(_profile, PROFILE), "jaccard-profile")
    owners = profile.where("fp IS NOT NULL").select("doc_id", "digest", "fp", "n", "bits")
    frequent = profile.where("token IS NOT NULL").groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= MIN_SEEN)
    top = frequent.orderBy(F.desc("seen"), "token").limit(MAX_ORDERED).toArrow()
    token, seen = top.column("token").to_numpy().view(U), top.column("seen").to_numpy()
    sizes = {r.n: r.sets for r in owners.where(F.col("n") <= 2 * MAX_LIGHT).groupBy("n").agg(F.count_distinct("fp").alias("sets")).collect()}
    all_tokens = float(owners.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    light = boundary(sizes, prefix_list_length(seen, all_tokens))

    order = spark.sparkContext.broadcast(vars(Order(token, seen)))  # MAX_ORDERED tokens at most
    rows = docs.select("text").mapInArrow(lambda b: _sign(b, rebuilt(Order, order.value), light), SIGNATURES)
    w = Window.partitionBy("sig")
    hub = F.min(F.when(F.col("kind") != BORDER, F.struct("fp", "n"))).over(w)
    marked = rows.withColumn("hub", hub).withColumn("lo", F.min("fp").over(w)).withColumn("hi", F.max("fp").over(w))
    shared = written(marked.where("lo <> hi AND hub IS NOT NULL").drop("lo", "hi"), "jaccard-shared")

    verified = Verifier(docs, owners)
    # Against the first hub, then another one, then whatever is left.
    tested = written(_pairs(shared.where((F.col("fp") != F.col("hub.fp")) & _comparable(F.col("n"), F.col("hub.n"))), "fp", "hub.fp"), "jaccard-tested")
    links = verified(tested)
    roots = components(links)
    left = _open(shared, roots)
    if not left.isEmpty():
        # Another hub in each list, out of its largest component: whoever is not linked
        # yet meets as many different hubs as it stands in lists.
        size = F.count("*").over(Window.partitionBy("sig", "root"))
        held = left.withColumn("size", size)
        other = F.max(F.when(F.col("kind") != BORDER, F.struct("size", F.xxhash64("fp", "sig").alias("h"), "fp", "n", "root"))).over(w)
        held = held.withColumn("other", other).where((F.col("root") != F.col("other.root")) & _comparable(F.col("n"), F.col("other.n")))
        found = written(_pairs(held, "fp", "other.fp"), "jaccard-second")
        links = links.unionByName(verified(written(found.join(tested, ["a", "b"], "left_anti"), "jaccard-tested")))
        roots = components(links)
        left = _open(left.drop("root"), roots)
    if not left.isEmpty():
        lists = _distinct_lists(left).select("sig", "fp", "n", "kind", "root")
        links = links.unionByName(verified(written(open_pairs(lists, verified.bits), "jaccard-left")))
        roots = components(links)
    named = owners.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return named.select("doc_id", "digest", "fp", "n", F.coalesce("root", "fp").alias("root"))


def text_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(F.coalesce(text.cast("string"), F.lit("")), "UTF-8"), 256))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: the one that names it.

    Rows are told apart by id and text: of those equal in both one stays, also of empty texts,
    each of which is a component of its own. A component without any id keeps the text with
    the least digest.
    """
    named = written(_with_roots(docs, id_col, text_col).select("doc_id", "digest", "n", "root"), "jaccard-named")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")
    first = named.where("n > 0").groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.digest")
    stay = first.unionByName(named.where("n = 0").select("doc_id", "digest").distinct()).select(F.col("doc_id").alias("i"), F.col("digest").alias("d"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("x"))
    keyed = rows.withColumn("i", F.col(f"x.`{id_col}`").cast("long")).withColumn("d", text_digest(F.col(f"x.`{text_col}`")))
    s = stay.alias("s")
    out = keyed.alias("k").join(s, F.col("k.i").eqNullSafe(F.col("s.i")) & (F.col("k.d") == F.col("s.d")), "left_semi")
    repeated = named.groupBy("doc_id", "digest").agg(F.count("*").alias("rows")).where("rows > 1").limit(1)
    out = out if repeated.isEmpty() else out.dropDuplicates(["i", "d"])
    return out.select([F.col(f"x.`{c}`") for c in docs.columns])
