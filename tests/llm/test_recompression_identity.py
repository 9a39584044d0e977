"""Operator 10: when two windows are the same, across batches and documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from muster.llm import recompression
from muster.llm.common import U

KINDS = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]


def batch(*rows):
    """Rows ``(name, doc, place, ahead, hashes)`` as they reach the judge; the text's hash is 7."""
    spans = [(place << recompression.PLACE) | (ahead << recompression.AHEAD) | len(h) for _, _, place, ahead, h in rows]
    columns = [[r[0] for r in rows], [r[1] for r in rows], [7] * len(rows), spans, [np.array(r[4], "<u8").tobytes() for r in rows]]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], recompression.NAMES)


def judged(*batches):
    return [(m["doc"], m["place"], m["count"]) for b in recompression._judge(iter(batches)) for m in b.to_pylist()]


@pytest.mark.parametrize("cut", [False, True])
def test_windows_of_one_anchor_are_told_apart_by_every_bit(cut):
    rows = [(5, 1, 0, 3, [1 << 40, 2 << 40]), (5, 2, 10, 3, [(1 << 40) + 1, 2 << 40]), (5, 3, 0, 3, [1 << 40, (2 << 40) + (1 << 63)])]
    batches = [batch(r) for r in rows] if cut else [batch(*rows)]
    # Of document 2 the second window was met before, of document 3 the first.
    assert judged(*batches) == [(2, 11, 1), (3, 0, 1)]


@pytest.mark.parametrize("cut", [False, True])
def test_the_anchor_and_its_place_are_part_of_a_window(cut):
    same, moved, other = (5, 2, 0, 3, [9]), (5, 3, 0, 2, [9]), (6, 4, 0, 3, [9])
    rows = [(5, 1, 0, 3, [9]), same, moved, other]
    assert judged(*([batch(r) for r in rows] if cut else [batch(*rows)])) == [(2, 0, 1)]


def test_many_documents_under_one_anchor_against_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = [(1, doc, 0, 19, rng.integers(0, 40, rng.integers(1, 20)).tolist()) for doc in range(300)]
    met, want = set(), set()
    for _, doc, place, ahead, hashes in rows:
        for i, h in enumerate(hashes):
            if (ahead - i, h) in met:
                want.add((doc, place + i))
            met.add((ahead - i, h))
    got = judged(*(batch(*rows[i : i + 7]) for i in range(0, 300, 7)))
    assert {(d, p + i) for d, p, n in got for i in range(n)} == want and sum(n for *_, n in got) == len(want)


def test_known_repeats_keep_their_place_and_number():
    doc, th = np.zeros(70_000, np.int64), np.full(70_000, 7)
    known = recompression._known(doc, th, np.arange(70_000) + (1 << 29))
    assert judged(known) == [(0, 1 << 29, 70_000)]


def test_the_first_of_equal_windows_comes_first():
    name, key = np.array([2, 1, 2, 1, 2], U), np.array([8, 8, 9, 8, 8], U)
    assert recompression._first(name, key).tolist() == [0, 1, 2, 1, 0]
    assert recompression._first(name[:0], key[:0]).tolist() == []
