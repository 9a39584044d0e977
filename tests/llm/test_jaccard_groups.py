"""The join on groups that no hub links: tiles, rows without ids, one document of each group."""

from __future__ import annotations

import collections
import itertools

import numpy as np
import pytest

from muster.llm import jaccard
from test_operators import near_copies, plain_components

SCHEMA = "doc_id long, text string"


def loose_copies(n, words=150, seed=5):
    """Copies so far from each other that few are linked, in one group."""
    rng = np.random.default_rng(seed)
    base, rows = [f"w{x}" for x in range(words)], []
    for i in range(n):
        w = list(base)
        for at in rng.integers(0, words, rng.integers(2, 9)):
            w[at] = f"e{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("tile", [3, 1024])
def test_lists_cut_into_tiles_lose_no_link(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard, "TILE", tile)
    rows = loose_copies(90) + [(i + 500, t) for i, t in near_copies(np.random.default_rng(1), 40)]
    got = jaccard.jaccard_components(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert sorted(map(tuple, got), key=repr) == plain_components(rows)


def test_a_tile_leaves_open_every_linked_pair_of_different_components():
    rows = loose_copies(60)
    data = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    sets = jaccard.shingle_sets(data, np.cumsum([0, *(len(t) for _, t in rows)]))
    n, root = [len(s) for s in sets], [i % 7 for i in range(len(sets))]
    tile = {"fp": list(range(len(sets))), "n": n, "kind": [jaccard.HEAVY] * len(sets), "root": root, "bucket": [i % 2 for i in range(len(sets))]}
    tile["bits"] = [jaccard.parity_bits(s) for s in sets]
    pairs = {(a, b) for a, b in itertools.combinations(range(len(sets)), 2) if root[a] != root[b]}
    linked = {(a, b) for a, b in pairs if jaccard.linked(sets[a], sets[b])}
    found = set(jaccard._left_open(tile, True))
    assert linked and linked <= found <= pairs and len(found) < len(pairs) // 2
    across = {(a, b) for a, b in linked if a % 2 != b % 2}
    assert across <= set(jaccard._left_open(tile, False)) <= {(a, b) for a, b in pairs if a % 2 != b % 2}


def test_rows_without_ids_do_not_multiply(spark):
    """Many rows without an id of each of two near texts: one set of each is verified."""
    a = " ".join(f"x{i}" for i in range(60))
    rows = [(None, a)] * 1000 + [(None, a + " more")] * 1000 + [(7, "another text that is linked with nothing else")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = collections.Counter(map(tuple, jaccard.jaccard_components(df).collect()))
    assert got == {(None, 56, None): 1000, (None, 57, None): 1000, (7, 4, 7): 1}
    kept = jaccard.one_of_each(df).collect()
    assert len(kept) == 2 and {r.doc_id for r in kept} == {None, 7}


def test_one_of_each_tells_rows_apart_by_text(spark):
    a, b = (" ".join(f"{p}{i}" for i in range(40)) for p in "ab")
    rows = [(None, a), (None, a + " z"), (None, b), (None, b + " z"), (3, a + " y"), (3, "quite another text under the same id"), (4, b + " y"), (4, b + " y")]
    df = spark.createDataFrame([(*r, "k", "k") for r in rows], SCHEMA + ", d string, i string")
    got = jaccard.one_of_each(df)
    assert got.columns == ["doc_id", "text", "d", "i"]
    assert sorted((r.doc_id, r.text, r.d) for r in got.collect()) == sorted([(3, a + " y", "k"), (3, rows[5][1], "k"), (4, b + " y", "k")])
    # A component without ids keeps one text.
    assert jaccard.one_of_each(spark.createDataFrame(rows[:4], SCHEMA)).count() == 2
