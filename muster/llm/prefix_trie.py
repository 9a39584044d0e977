"""Trie of conversation prefixes, with a count-min screen before the shuffle.

Each conversation is rebuilt: the first turns of the conversation that opens its
hundred, as many as a checksum of its id says, then its own turns after as many. Every
distinct sequence of first turns is a node.

* **Digests.** The turns are sorted by range over all conversations, so one that holds
  most rows lies in many tasks. Each task sums ``hash(turn) * base ** place`` in two lanes of
  64 bits; what a task's first conversation brings along from the tasks before comes
  from one summary row per task. A rebuilt prefix's digest follows from such sums
  at its ends, so no conversation is ever held whole.
* **Screen.** All prefix digests go into a count-min sketch of saturating counters. An
  estimate of one proves that no other conversation has the prefix: its node is put out in
  place. Prefixes that may be shared are shuffled and grouped exactly, so a false
  alarm costs a shuffled row and nothing else. A lane of the sketch has ``MAX_WIDTH``
  counters at most: beyond that, more prefixes count as perhaps shared.
* **Subtrees without levels.** A conversation owns the nodes whose smallest member it is:
  all from some depth on. A subtree's leaves are its members that own a childless node,
  and the text saved in it is, summed over its members, what a member has there before
  its first own node. So one grouping by node gives every measure, however deep the trie.

The members that end at a node are hashed in order of id: ids are sorted by range and
joined in pieces of bounded size, which are then fed to one hash per node.

Edge cases: a null turn comes first; turns of equal number are ordered by the hash of role
and text; null roles and texts are empty; rows without a conversation id are left
out; repeated rows are turns of their own; ids may be negative, and the remainder has
their sign; an empty table has no node; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import U, as_longs, mix, written

FAMILY, HEADS = 100, 6
# Odd factors, one for each lane of a digest.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WRAP = 1 << 64
SKETCH_LANES, MIN_WIDTH, MAX_WIDTH = 3, 1 << 12, 1 << 22  # 1.5 MB of bits when full
CHUNK = 1 << 16  # counters of a sketch in one row
IDS_PER_PIECE = 4096

LOCAL = "part int, conv long, i long, t1 long, t2 long, s1 long, s2 long, len long, upto long"
TURNS = LOCAL.removeprefix("part int, ")
ROWS = "conv long, depth long, d1 long, d2 long, p1 long, p2 long, before long, len long, ends boolean"
NODE = ["depth", "d1", "d2"]


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _batch(columns: list[np.ndarray], schema: str) -> pa.RecordBatch:
    arrays = [pa.array(as_longs(c) if c.dtype == U else c) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, _names(schema))


def _unsigned(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy().view(U) for n in names]


# ---- running sums over sorted turns ----------------------------------------------


def powers_at(base: int, places: np.ndarray) -> np.ndarray:
    """``base ** places`` modulo 2 ** 64, for places from 0 on."""
    out, square, left = np.ones(len(places), U), U(base), places.astype(np.int64)
    while left.any():
        out = np.where(left & 1, out * square, out)
        left = left >> 1
        base = base * base % WRAP
        square = U(base)
    return out


def _inside(conv: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Running sums within each run of equal ``conv``."""
    total = np.cumsum(values, dtype=values.dtype)
    starts = np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))
    base = np.zeros(len(starts), values.dtype)
    base[1:] = total[starts[1:] - 1]
    return total - np.repeat(base, np.diff(np.append(starts, len(conv))))


class Held(NamedTuple):
    """What has been summed of a conversation: turns, two lanes of hashes, code points."""

    conv: int
    n: int
    s1: int
    s2: int
    upto: int


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and sums of sorted turns, counted from the task's own start of each conversation."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        if not batch.num_rows:
            continue
        conv, length = batch.column("conv").to_numpy(), batch.column("len").to_numpy()
        raw = np.frombuffer(b"".join(batch.column("hash").to_pylist()), U).reshape(-1, 4)
        more = (conv == held[0]) if held else np.zeros(len(conv), bool)
        was = held or Held(0, 0, 0, 0, 0)
        place = _inside(conv, np.ones(len(conv), np.int64)) - 1 + np.where(more, was.n, 0)
        turns = [raw[:, k] * powers_at(BASES[k], place) for k in (0, 1)]
        sums = [_inside(conv, t) + np.where(more, U(s), U(0)) for t, s in zip(turns, (was.s1, was.s2))]
        upto = _inside(conv, length) + np.where(more, was.upto, 0)
        held = Held(int(conv[-1]), int(place[-1]) + 1, int(sums[0][-1]), int(sums[1][-1]), int(upto[-1]))
        yield _batch([np.full(len(conv), part, np.int32), conv, place, *turns, *sums, length, upto], LOCAL)


def _joined(held: Held | None, more: Held) -> Held:
    """The sums of a conversation's part and the part that follows."""
    if held is None or held.conv != more.conv:
        return more
    lanes = [(a + b * pow(base, held.n, WRAP)) % WRAP for a, b, base in zip((held.s1, held.s2), (more.s1, more.s2), BASES)]
    return Held(more.conv, held.n + more.n, *lanes, held.upto + more.upto)


def brought_along(local: DataFrame) -> dict[int, Held]:
    """By task: what its first conversation has in the tasks before. One row per task goes to the driver."""
    last = F.max(F.struct("conv", "i", "s1", "s2", "upto")).alias("last")
    rows = local.groupBy("part").agg(F.min("conv").alias("first"), last).orderBy("part").collect()
    out: dict[int, Held] = {}
    held = None
    for r in rows:
        if held and held.conv == r.first:
            out[r.part] = held
        own = Held(r.last.conv, r.last.i + 1, r.last.s1 % WRAP, r.last.s2 % WRAP, r.last.upto)
        held = _joined(held, own) if r.first == r.last.conv else own
    return out


def _shift(batches: Iterator[pa.RecordBatch], brought: dict[int, tuple]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, conv, i, length, upto = (batch.column(n).to_numpy().copy() for n in ("part", "conv", "i", "len", "upto"))
        lanes = [x.copy() for x in _unsigned(batch, "t1", "t2", "s1", "s2")]
        for p in np.unique(part).tolist():
            if p in brought:
                was = Held(*brought[p])
                rows = (part == p) & (conv == was.conv)
                for k in (0, 1):
                    by = U(pow(BASES[k], was.n, WRAP))
                    lanes[k][rows] *= by
                    lanes[2 + k][rows] = lanes[2 + k][rows] * by + U((was.s1, was.s2)[k])
                i[rows] += was.n
                upto[rows] += was.upto
        yield _batch([conv, i, *lanes, length, upto], TURNS)


def turns_with_sums(conversations: DataFrame) -> DataFrame:
    """``TURNS``: every turn's place, its weighed hash and the sums up to it, written."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.encode(whole, "UTF-8"), 256)).alias("hash"), F.length(text).cast("long").alias("len"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "hash"]
    ordered = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "hash", "len")
    local = written(ordered.mapInArrow(_sum, LOCAL), "trie-local")
    brought = {p: tuple(h) for p, h in brought_along(local).items()}  # an entry per task at most
    return written(local.mapInArrow(lambda b: _shift(b, brought), TURNS), "trie-turns")


# ---- rebuilt conversations -------------------------------------------------------


def heads_of(conv: Column) -> Column:
    return F.crc32(F.encode(conv.cast("string"), "UTF-8")) % HEADS


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuilt digests of own turns: what the head has, and the own sums since the cut at the head's place."""
    inverse = [np.array([pow(pow(b, -1, WRAP), k, WRAP) for k in range(HEADS)], U) for b in BASES]
    for batch in batches:
        conv, i, length, upto, h, hc, n, head_len, cut_len = (
            batch.column(c).to_numpy() for c in ("conv", "i", "len", "upto", "h", "hc", "n", "head_len", "cut_len")
        )
        out = []
        for k in (0, 1):
            t, s, head, cut = _unsigned(batch, f"t{k + 1}", f"s{k + 1}", f"head{k + 1}", f"cut{k + 1}")
            by = inverse[k][h - hc]
            out.append((head + by * (s - cut), by * t))
        (d1, t1), (d2, t2) = out
        depth = i - h + hc + 1
        yield _batch([conv, depth, d1, d2, d1 - t1, d2 - t2, head_len + upto - length - cut_len, length, i == n - 1], ROWS)


def _minus(a: Column, b: Column) -> Column:
    """a - b modulo 2 ** 64 on longs, without overflow."""
    half, whole = (F.lit(str(n)).cast("decimal(38,0)") for n in (WRAP // 2, WRAP))
    wide = a.cast("decimal(38,0)") - b.cast("decimal(38,0)") + half
    return (F.pmod(wide, whole) - half).cast("long")


def prefixes(turns: DataFrame) -> DataFrame:
    """``ROWS``: a row for every prefix of every rebuilt conversation, the empty one included."""
    first = F.when(F.col("i") < HEADS - 1, F.struct("i", "t1", "t2", "s1", "s2", "len", "upto"))
    leads = written(turns.groupBy("conv").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(first)).alias("lead")), "trie-leads")
    opening = leads.select(F.col("conv").alias("base"), F.col("lead").alias("opening"))
    one = leads.withColumn("h", heads_of(F.col("conv"))).withColumn("base", F.col("conv") - F.col("conv") % FAMILY)
    one = one.join(opening, "base", "left")  # a hundred conversations for each opening one at most
    one = one.withColumn("head", F.slice(F.coalesce("opening", F.array().cast(leads.schema["lead"].dataType)), F.lit(1), F.col("h").cast("int")))
    one = one.withColumn("hc", F.size("head").cast("long"))
    at = lambda array, place, field: F.coalesce(F.try_element_at(array, place.cast("int")).getField(field), F.lit(0).cast("long"))
    end = F.when(F.col("hc") > 0, F.col("hc")).otherwise(F.lit(99))
    cut = F.when(F.col("h") > 0, F.col("h")).otherwise(F.lit(99))
    one = one.select(
        "conv", "n", "h", "hc", "head",
        *[at(F.col("head"), end, f).alias(a) for f, a in (("s1", "head1"), ("s2", "head2"), ("upto", "head_len"))],
        *[at(F.col("lead"), cut, f).alias(a) for f, a in (("s1", "cut1"), ("s2", "cut2"), ("upto", "cut_len"))],
    )
    one = written(one, "trie-heads")
    zero = F.lit(0).cast("long")
    done = F.col("n") <= F.col("h")
    root = one.select("conv", zero.alias("depth"), *[zero.alias(c) for c in ("d1", "d2", "p1", "p2", "before", "len")], (done & (F.col("hc") == 0)).alias("ends"))
    x = one.select("conv", "hc", done.alias("done"), F.explode("head").alias("x"))
    head = x.select(
        "conv", (F.col("x.i") + 1).alias("depth"), F.col("x.s1").alias("d1"), F.col("x.s2").alias("d2"),
        _minus(F.col("x.s1"), F.col("x.t1")).alias("p1"), _minus(F.col("x.s2"), F.col("x.t2")).alias("p2"),
        (F.col("x.upto") - F.col("x.len")).alias("before"), F.col("x.len").alias("len"), (F.col("done") & (F.col("x.i") + 1 == F.col("hc"))).alias("ends"),
    )
    own = turns.where(F.col("i") >= heads_of(F.col("conv"))).join(one.where(~done).drop("head"), "conv").mapInArrow(_own, ROWS)
    return written(root.unionByName(head).unionByName(own), "trie-prefixes")


# ---- the screen --------------------------------------------------------------------


def cells(depth: np.ndarray, d1: np.ndarray, d2: np.ndarray, width: int) -> list[np.ndarray]:
    """The counter of each lane of the sketch for some digests."""
    one = mix(mix(d1 + depth.astype(np.int64).view(U)) ^ d2)
    return [(mix(one + U(k * 0xA24BAED4963EE407 % WRAP)) & U(width - 1)).astype(np.int64) for k in range(SKETCH_LANES)]


def _count(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """A task's sketch in chunks of counters that stop at two."""
    table = np.zeros((SKETCH_LANES, width), np.uint8)
    for batch in batches:
        for k, cell in enumerate(cells(batch.column("depth").to_numpy(), *_unsigned(batch, "d1", "d2"), width)):
            cell, times = np.unique(cell, return_counts=True)
            table[k, cell] = np.minimum(2, table[k, cell] + np.minimum(times, 2))
    yield from _chunks((c, part) for c, part in enumerate(table.reshape(-1, min(width, CHUNK))) if part.any())


def _chunks(parts) -> Iterator[pa.RecordBatch]:
    for c, part in parts:
        planes = (np.packbits(part > 0).tobytes(), np.packbits(part > 1).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), *[pa.array([p], pa.binary()) for p in planes]], ["chunk", "some", "many"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sketches of tasks added up, chunk by chunk."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, some, many in zip(*(batch.column(n).to_pylist() for n in ("chunk", "some", "many"))):
            own = np.unpackbits(np.frombuffer(some, np.uint8)) + np.unpackbits(np.frombuffer(many, np.uint8))
            total[c] = np.minimum(2, total[c] + own) if c in total else own
    yield from _chunks(total.items())


def shared_cells(rows: DataFrame, width: int) -> np.ndarray:
    """Packed bits of the sketch's counters that are over one."""
    sketch = "chunk int, some binary, many binary"
    parts = rows.where("depth > 0").mapInArrow(lambda b: _count(b, width), sketch)
    merged = parts.repartition("chunk").mapInArrow(_merge, sketch).select("chunk", "many").toArrow()
    size = min(width, CHUNK) // 8
    out = np.zeros(SKETCH_LANES * width // 8, np.uint8)
    for c, many in zip(merged.column("chunk").to_pylist(), merged.column("many").to_pylist()):
        out[c * size : (c + 1) * size] = np.frombuffer(many, np.uint8)
    return out


def _screen(batches: Iterator[pa.RecordBatch], bits: np.ndarray, width: int) -> Iterator[pa.RecordBatch]:
    """Adds ``single`` and ``parent_single``: whether one conversation alone has the prefix, and the one before."""
    table = bits.reshape(SKETCH_LANES, -1)

    def proven(depth: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
        over = np.ones(len(depth), bool)
        for k, cell in enumerate(cells(depth, d1, d2, width)):
            over &= (table[k, cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 == 1
        return ~over & (depth > 0)

    for batch in batches:
        depth = batch.column("depth").to_numpy()
        single = proven(depth, *_unsigned(batch, "d1", "d2"))
        parent = proven(depth - 1, *_unsigned(batch, "p1", "p2"))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(single), pa.array(parent)], [*batch.schema.names, "single", "parent_single"])


def screened(rows: DataFrame) -> DataFrame:
    width = MIN_WIDTH
    count = rows.count()
    while width < min(MAX_WIDTH, 2 * count):
        width *= 2
    bits = rows.sparkSession.sparkContext.broadcast(shared_cells(rows, width))
    return written(rows.mapInArrow(lambda b: _screen(b, bits.value, width), f"{ROWS}, single boolean, parent_single boolean"), "trie-screened")


# ---- nodes ---------------------------------------------------------------------------


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids of sorted rows joined by node, ``IDS_PER_PIECE`` in a piece at most."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        key = [batch.column(n).to_numpy() for n in NODE]
        new = np.ones(batch.num_rows, bool)
        new[1:] = np.any([k[1:] != k[:-1] for k in key], axis=0)
        conv, starts = batch.column("conv").to_pylist(), np.flatnonzero(new).tolist()
        rows = [(a, b) for lo, hi in zip(starts, [*starts[1:], len(conv)]) for a in range(lo, hi, IDS_PER_PIECE) for b in [min(hi, a + IDS_PER_PIECE)]]
        first = np.array([a for a, _ in rows], np.int64)
        ids = pa.array([",".join(map(str, conv[a:b])) for a, b in rows], pa.string())
        numbers = [np.full(len(rows), part, np.int32), np.arange(seq, seq + len(rows))]
        seq += len(rows)
        yield pa.RecordBatch.from_arrays([*[pa.array(k[first]) for k in key], *map(pa.array, numbers), ids], [*NODE, "part", "seq", "ids"])


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One SHA-256 per node over its pieces, which come in order."""
    now, state = None, None
    found: list[tuple] = []

    def out() -> pa.RecordBatch:
        columns = list(zip(*[(*k, d) for k, d in found])) or [[], [], [], []]
        found.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        for key, ids in zip(zip(*(batch.column(n).to_pylist() for n in NODE)), batch.column("ids").to_pylist()):
            if key == now:
                state.update(b"," + ids.encode())
            else:
                if now is not None:
                    found.append((now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
        yield out()
    if now is not None:
        found.append((now, state.hexdigest()))
        yield out()


def ends_hash(rows: DataFrame) -> DataFrame:
    """``depth, d1, d2, ends_sha256`` of nodes at which conversations end."""
    order = [*NODE, "conv"]
    ordered = rows.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ordered.mapInArrow(_pieces, "depth long, d1 long, d2 long, part int, seq long, ids string")
    by_node = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part", "seq")
    return by_node.mapInArrow(_hash, "depth long, d1 long, d2 long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """Every node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    rows = screened(prefixes(turns_with_sums(conversations)))
    shared, alone = rows.where("NOT single"), rows.where("single")
    members = shared.groupBy(*NODE).agg(
        F.min("conv").alias("owner"), F.count("*").alias("members"), F.count_if("ends").alias("ended"), F.min("before").alias("before")
    )
    members = written(members, "trie-members")
    # Where each conversation's own nodes begin, and whether it owns a leaf.
    owners = members.groupBy(F.col("owner").alias("conv")).agg(
        F.min("depth").alias("own1"), F.min("before").alias("from1"), F.max(F.col("members") == F.col("ended")).alias("leaf1")
    )
    convs = rows.groupBy("conv").agg(
        F.max("depth").alias("n"), F.min(F.when(F.col("single"), F.col("depth"))).alias("own2"),
        F.min(F.when(F.col("single"), F.col("before"))).alias("from2"), F.max(F.col("before") + F.col("len")).alias("total"),
    )
    convs = convs.join(owners, "conv", "left").select(
        "conv", "n", F.least("own1", "own2").alias("own"), F.coalesce(F.least("from1", "from2"), "total").alias("from"),
        (F.col("own2").isNotNull() | F.coalesce("leaf1", F.lit(False))).cast("long").alias("leaf"),
    )
    convs = written(convs, "trie-convs")
    below = F.coalesce((F.col("own") <= F.col("depth") + 1) & (F.col("n") > F.col("depth")), F.lit(False))
    nodes = shared.join(convs, "conv").groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if(below).alias("n_children"), F.sum("leaf").alias("n_leaves"),
        F.sum(F.greatest(F.col("from") - F.col("before"), F.lit(0))).alias("saved_tokens"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
    )
    ended = ends_hash(shared)
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    nodes = nodes.join(ended, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).drop("d1", "d2")
    one = F.lit(1).cast("long")
    own_id = F.sha2(F.encode(F.col("conv").cast("string"), "UTF-8"), 256)
    tails = alone.select(
        "depth", F.col("conv").alias("conv_id"), one.alias("n_convs"), (~F.col("ends")).cast("long").alias("n_children"), one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), "p1", "p2", F.when(F.col("ends"), own_id).otherwise(nothing).alias("ends_sha256"), "parent_single",
    )
    # A parent that is not among the grouped ones is proven to have one member: the child's.
    asked = nodes.unionByName(tails.where("NOT parent_single").drop("parent_single"))
    parents = members.select((F.col("depth") + 1).alias("depth"), F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("owner").alias("parent_conv_id"))
    met = asked.join(parents, ["depth", "p1", "p2"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    placed = met.withColumn("parent_conv_id", parent).select(*columns)
    inner = tails.where("parent_single").withColumn("parent_conv_id", F.col("conv_id")).select(*columns)
    return placed.unionByName(inner)
