"""Sharding by balanced label propagation.

Documents with equal text are linked through their text. Groups too large to be moved
within a quota are placed first, largest first: each goes whole to the shard whose
room it fills best, and one that is larger than any room is split into as few parts as
the rooms allow. There are at most ``LARGE`` such groups a shard, however many rows there are,
so the driver may hold their list of sizes.

All other documents start where room is left, so that shard sizes differ by at most one row.
In each round, joins give a group's documents the shard where most of the group already is,
and they ask to move there. Moves are granted within quotas that leave every shard's
row count as it is: a shard that gains movers returns as many unlinked documents, which cut
no link wherever they are. Every granted move brings a row to its group's shard, so rounds
come to an end by themselves: they stop when two in a row grant nothing. Where a
group is spread evenly, each round favours another shard, so that what one round could
not grant may balance in the next.

A group stays cut only where no room holds it, or where its shards have no unlinked
documents left to return; ``cut_links`` counts such groups.

The law is ``rows``: counts of any two shards differ by at most one.

Edge cases: a null text counts as empty and is linked with the other empty ones; null
ids and repeated rows are rows like any other; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm.common import ranked, written

SHARDS = 8
# A group of more than this part of a shard is placed before the rounds.
LARGE = 64
GROUP = ["g", "text_crc32", "size"]
STATE = ["doc_id", *GROUP, "linked", "shard"]


def _state(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
    )


def place(sizes: list[int], rooms: list[int]) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Shards and row counts for each of ``sizes``, and the room that is left.

    Largest first, each where it leaves least room. What is larger than any room fills the
    largest one; the rest of it is placed like a group of its own.
    """
    rooms, parts = list(rooms), [[] for _ in sizes]
    queue = [(-n, i) for i, n in enumerate(sizes)]
    heapq.heapify(queue)
    while queue:
        n, i = heapq.heappop(queue)
        n = -n
        fits = [s for s, room in enumerate(rooms) if room >= n]
        s = min(fits, key=lambda s: (rooms[s], s)) if fits else max(range(len(rooms)), key=lambda s: (rooms[s], -s))
        took = min(n, rooms[s])
        rooms[s] -= took
        parts[i].append((s, took))
        if took < n:
            heapq.heappush(queue, (took - n, i))
    return parts, rooms


def _upto(counts: list[tuple[int, int]], column: str) -> Column:
    """The shard of a row by its rank: the first ``n`` rows to the first shard, and so on."""
    out, end = F.when(F.lit(False), F.lit(0)), 0
    for shard, n in counts:
        end += n
        out = out.when(F.col(column) < end, shard)
    return out.cast("int")


def _placed(rows: DataFrame, large: list, parts: list[list[tuple[int, int]]]) -> DataFrame:
    """The rows of large groups with the shards of their groups' parts."""
    spark, names = rows.sparkSession, "g long, text_crc32 long, size long"
    both = [((r.g, r.text_crc32, r.size), p) for r, p in zip(large, parts)]
    whole = F.broadcast(spark.createDataFrame([(*key, p[0][0]) for key, p in both if len(p) == 1], f"{names}, shard int"))
    out = rows.join(whole, GROUP).select(*rows.columns, "shard")
    ends = []
    for key, p in both:
        end = 0
        for shard, n in p if len(p) > 1 else []:
            ends.append((*key, shard, end, end + n))
            end += n
    if ends:
        keys = F.broadcast(spark.createDataFrame(sorted({x[:3] for x in ends}), names))
        own = ranked(written(rows.join(keys, GROUP, "left_semi"), "shard-split"), GROUP, ["doc_id"], "place")
        # Ranges of ranks: fewer than there are large groups and shards together.
        ranges = F.broadcast(spark.createDataFrame(ends, f"{names}, shard int, first long, last long"))
        cut = own.join(ranges, GROUP).where("place >= first AND place < last")
        out = out.unionByName(cut.select(*rows.columns, "shard"))
    return out.select("doc_id", *GROUP, F.lit(True).alias("linked"), "shard")


def _start(rows: DataFrame, shards: int) -> tuple[DataFrame | None, DataFrame]:
    """Rows of large groups, placed for good (none: null), and the others on their first shards."""
    total = rows.count()
    sizes = written(rows.groupBy(*GROUP).agg(F.count("*").alias("n")).where("n > 1"), "shard-groups")
    # Fewer than shards * LARGE groups can be that large.
    large = sizes.where(F.col("n") * (shards * LARGE) > total).collect()
    large.sort(key=lambda r: (-r.n, r.g, r.text_crc32, r.size))
    parts, rooms = place([r.n for r in large], [total // shards + (s < total % shards) for s in range(shards)])
    others, placed = rows, None
    if large:
        placed = _placed(rows, large, parts)
        keys = rows.sparkSession.createDataFrame([(r.g, r.text_crc32, r.size) for r in large], "g long, text_crc32 long, size long")
        others = rows.join(F.broadcast(keys), GROUP, "left_anti").select(*rows.columns)
    told = others.join(sizes.select(*GROUP, F.lit(True).alias("more")), GROUP, "left")
    small = told.select(*rows.columns, F.col("more").isNotNull().alias("linked"))
    # In an order that says nothing of the groups: bringing them together is the rounds' work.
    dealt = ranked(written(small, "shard-small"), [], [F.xxhash64("doc_id", "g"), "doc_id", *GROUP], "place")
    return placed, dealt.withColumn("shard", _upto(list(enumerate(rooms)), "place")).select(*STATE)


def _wishes(state: DataFrame, turn: int) -> DataFrame:
    """Adds ``to``: the shard where most of the row's group is, for linked rows elsewhere; else null."""
    most = state.where("linked").groupBy(*GROUP, "shard").agg(F.count("*").alias("n"))
    # Ties go to the shard next in a hashed order, another one each round.
    order = F.struct("n", F.xxhash64("g", "shard", F.lit(turn)), "shard")
    best = most.groupBy(*GROUP).agg(F.max(order).getField("shard").alias("best"))
    joined = state.join(best, GROUP, "left")
    return joined.select(*state.columns, F.when(F.col("best") != F.col("shard"), F.col("best")).alias("to"))


def grant(wanted: dict[tuple[int, int], int], free: list[int]) -> tuple[dict[tuple[int, int], int], dict[tuple[int, int], int]]:
    """Moves of linked rows and counter-moves of unlinked ones, both by (from, to).

    Every shard sends and receives equally many rows. Where a shard has too few
    unlinked rows to return, fewer moves into it are granted.
    """
    granted = {pair: n for pair, n in wanted.items() if n}
    shards = range(len(free))
    while True:
        surplus = [sum(n for (a, b), n in granted.items() if b == s) - sum(n for (a, b), n in granted.items() if a == s) for s in shards]
        short = [s for s in shards if surplus[s] > free[s]]
        if not short:
            break
        excess = surplus[short[0]] - free[short[0]]
        for pair in sorted((p for p in granted if p[1] == short[0]), key=lambda p: -granted[p]):
            less = min(excess, granted[pair])
            granted[pair], excess = granted[pair] - less, excess - less
    back, takers = {}, [[s, -surplus[s]] for s in shards if surplus[s] < 0]
    for s in shards:
        left = max(0, surplus[s])
        while left:
            n = min(left, takers[-1][1])
            back[s, takers[-1][0]] = n
            left, takers[-1][1] = left - n, takers[-1][1] - n
            if not takers[-1][1]:
                takers.pop()
    return {p: n for p, n in granted.items() if n}, back


def _moved(wishes: DataFrame, granted: dict, back: dict, wanted: dict) -> DataFrame:
    """The state after the granted moves."""
    # Ranks within a class of movers; classes granted in full need none.
    partial = {p: n for p, n in granted.items() if n < wanted[p]}
    cuts: list[Column] = []
    kind = F.when(F.col("to").isNotNull(), 1).when(~F.col("linked"), 0)
    needs = F.lit(False)
    for a, b in partial:
        needs = needs | ((F.col("shard") == a) & (F.col("to") == b))
    for a in {a for a, _ in back}:
        needs = needs | ((F.col("shard") == a) & (kind == 0))
    new = F.when(F.lit(False), F.lit(0))
    for (a, b), n in granted.items():
        if n == wanted[a, b]:
            cuts.append((F.col("shard") == a) & (F.col("to") == b))
            new = new.when(cuts[-1], b)
    still = wishes.where(~F.coalesce(needs, F.lit(False)))
    rest = still.select(*STATE[:-1], new.otherwise(F.col("shard")).cast("int").alias("shard"))
    if not partial and not back:
        return rest
    chosen = written(wishes.where(F.coalesce(needs, F.lit(False))).withColumn("kind", kind), "shard-movers")
    placed = ranked(chosen, ["shard", "kind", "to"], ["g", "doc_id", "text_crc32", "size"], "place")
    new = F.when(F.lit(False), F.lit(0))
    for (a, b), n in partial.items():
        new = new.when((F.col("shard") == a) & (F.col("to") == b) & (F.col("place") < n), b)
    for a in sorted({a for a, _ in back}):
        upto = 0
        for (x, b), n in sorted(back.items()):
            if x == a:
                upto += n
                new = new.when((F.col("shard") == a) & (F.col("kind") == 0) & (F.col("place") < upto), b)
    return rest.unionByName(placed.select(*STATE[:-1], new.otherwise(F.col("shard")).cast("int").alias("shard")))


def balanced_shards(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot``: one row per document."""
    rows = written(_state(docs, id_col, text_col), "shard-rows")
    large, state = _start(rows, shards)
    turn = idle = 0
    while True:
        wishes = written(_wishes(written(state, "shard-state"), turn), "shard-wishes")
        # At most 2 * shards * (shards + 1) rows reach the driver.
        counts = wishes.groupBy("shard", "to", "linked").agg(F.count("*").alias("n")).collect()
        wanted = {(r.shard, r.to): r.n for r in counts if r.to is not None}
        free = [sum(r.n for r in counts if r.shard == s and not r.linked) for s in range(shards)]
        granted, back = grant(wanted, free)
        idle = 0 if granted else idle + 1
        state = _moved(wishes, granted, back, wanted) if granted else wishes.select(*STATE)
        turn += 1
        if not wanted or idle == 2 or granted == wanted:
            break
    final = written(state if large is None else state.unionByName(large.select(*STATE)), "shard-final")
    placed = ranked(final, ["shard"], ["g", "doc_id", "text_crc32", "size"], "slot")
    return placed.select("doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def cut_links(placed: DataFrame) -> DataFrame:
    """One row: groups of linked documents, those on more than one shard, links and cut links.

    ``placed`` is a result of ``balanced_shards``. A link is a pair of documents with equal text.
    """
    pairs = F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2
    key = ["text_crc32", "size"]
    inside = placed.groupBy(*key, "shard").agg(F.count("*").alias("n"))
    groups = inside.groupBy(*key).agg(F.sum("n").alias("n"), F.count("*").alias("shards"), F.sum(pairs).alias("kept"))
    linked = groups.where("n > 1").select("shards", "kept", pairs.alias("links"))
    return linked.agg(
        F.count("*").alias("groups"),
        F.count_if(F.col("shards") > 1).alias("cut_groups"),
        F.coalesce(F.sum("links"), F.lit(0)).cast("decimal(38,0)").alias("links"),
        F.coalesce(F.sum(F.col("links") - F.col("kept")), F.lit(0)).cast("decimal(38,0)").alias("cut_links"),
    )
