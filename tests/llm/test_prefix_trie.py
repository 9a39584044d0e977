"""The trie of conversations against a plain version, with narrow sketches and one large conversation."""

from __future__ import annotations

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from muster.llm import prefix_trie, queries
from muster.llm.common import table
from oracle_check import compare, connect

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def order(row):
    _, turn, role, text = row
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest())


def plain(rows):
    own = collections.defaultdict(list)
    for row in sorted((r for r in rows if r[0] is not None), key=order):
        own[row[0]].append((row[2] or "", row[3] or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        rebuilt[c] = tuple(own.get(base, [])[:h] + turns[h:])
    members = collections.defaultdict(list)
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = collections.Counter(path[:-1] for path in members if path)
    leaves, saved = collections.Counter(), collections.Counter()
    for path, own_members in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(own_members) - 1) * len(path[-1][1]) if path else 0
    for path, own_members in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in own_members if len(rebuilt[c]) == len(path)))
        parent = min(members[path[:-1]]) if path else None
        yield (
            min(own_members), len(path), parent, len(own_members), children[path], leaves[path], saved[path], hashlib.sha256(ends.encode()).hexdigest(),
        )


def check(df, rows):
    got = prefix_trie.prefix_trie(df)
    assert got.columns == COLUMNS
    assert collections.Counter(map(tuple, got.collect())) == collections.Counter(plain(rows))


def some_rows(seed, convs, letters="ab"):
    rng = random.Random(seed)
    ids = sorted(rng.sample(range(-250, 450), convs))
    rows = [(c, i, rng.choice(["u", "v", None]), rng.choice(letters) * rng.choice([1, 1, 4])) for c in ids for i in range(rng.choice([1, 2, 3, 7, 9]))]
    # Repeated turns, turns of equal number, null turns, texts and ids.
    rows += rng.sample(rows, 10) + [(c, None, "u", None) for c in ids[:9]] + [(c, 1, "u", "b") for c in ids[9:20]]
    return rows + [(None, 0, "u", "a"), (None, None, None, None)]


def test_given_conversations_and_sql(spark, folder):
    rows = table(spark, folder, "conversations")
    check(rows, [tuple(r) for r in rows.collect()])
    got = queries.QUERIES["op11_prefix_trie"](spark, folder).toArrow()
    assert compare(got, connect(folder).sql(queries.SQL["op11_prefix_trie"]).to_arrow_table()) is None


@pytest.mark.parametrize("width", [8, 1 << 12])
def test_random_conversations(spark, monkeypatch, width):
    monkeypatch.setattr(prefix_trie, "MIN_WIDTH", width)
    monkeypatch.setattr(prefix_trie, "MAX_WIDTH", width)
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    monkeypatch.setattr(prefix_trie, "IDS_PER_PIECE", 3)
    rows = some_rows(width, 150)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("conv", "depth", "i", "n", "h", "head", "part", "ends"):
        df = df.withColumn(name, F.lit("x"))
    check(df, rows)


def test_a_conversation_over_many_tasks_and_copies_of_a_long_one(spark):
    long = [(100, i, "u", f"t{i % 11}") for i in range(3000)]
    copies = [(c, i, "u", f"t{i % 11}") for c in (101, 102, 107) for i in range(120)]
    rows = long + copies + [(150, 0, "u", "x" * 100_000), (250, 0, "u", ""), (251, 0, "", None), (333, 5, "u", "z")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = prefix_trie.turns_with_sums(df.where("conv_id = 100"))
        assert [r.upto for r in turns.orderBy("i").collect()] == [sum(len(f"t{j % 11}") for j in range(i + 1)) for i in range(3000)]
        # The same digests whether one task or many have added them up.
        one = prefix_trie.turns_with_sums(df.coalesce(1).where("conv_id = 100").hint("coalesce", 1))
        assert turns.exceptAll(one).isEmpty()
        small = [r for r in rows if r[0] != 100 or r[1] < 150]
        check(spark.createDataFrame(small, SCHEMA), small)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_sums_of_parts_join_to_sums_of_the_whole():
    held = prefix_trie.Held
    hashes = [((i * 0x9E3779B97F4A7C15) % 2**64, (i * 0xD6E8FEB86659FD93) % 2**64) for i in range(1, 40)]

    def summed(part):
        lanes = [sum(h[k] * pow(prefix_trie.BASES[k], i, 2**64) for i, h in enumerate(part)) % 2**64 for k in (0, 1)]
        return held(7, len(part), *lanes, 3 * len(part))

    for cut in (1, 13, 38):
        assert prefix_trie._joined(summed(hashes[:cut]), summed(hashes[cut:])) == summed(hashes)


def test_empty_tables(spark):
    for rows in ([], [(None, 1, "u", "a")]):
        assert prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA)).count() == 0
