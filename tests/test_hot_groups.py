"""Large groups are worked on in slices, with the same result as small ones."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from datetime import timedelta

import pytest

from helpers import at, final_plan, make_punches, rows
from muster.functions.skew import repeat_rows, split_hot, total_before
from muster.operators import cleaning, intervals, timeline

GAP = timedelta(minutes=5)


@pytest.fixture(scope="module")
def crowded(spark):
    """One person holds a third of all punches; many punches share their time."""
    rng = random.Random(7)
    data = []
    for _ in range(1500):
        person = 1 if rng.random() < 0.34 else rng.randint(2, 40)
        day, hour = (3, 9) if rng.random() < 0.3 else (rng.randint(1, 9), rng.randint(0, 23))
        data.append((person, at(day, hour, rng.randint(0, 59), rng.choice([0, 0, 30]), rng.choice([0, 0, 1]))))
    data += [(1, at(5, 12))] * 75 + [(2, at(5, 12))] * 6
    rng.shuffle(data)
    return make_punches(spark, data).cache()


@pytest.fixture(scope="module")
def local(crowded):
    people = defaultdict(list)
    for r in crowded.collect():
        people[r.person].append((r.ts, r.punch_id))
    return {p: sorted(times) for p, times in people.items()}


# 0: every group is large; 100: some are; the default: none is.
LIMITS = pytest.mark.parametrize("limit", [0, 100, 5_000_000])


@LIMITS
def test_drop_repeats(crowded, local, limit):
    want = []
    for person, times in local.items():
        for i, (ts, punch_id) in enumerate(times):
            if i == 0 or ts - times[i - 1][0] >= GAP:
                want.append((punch_id, person, ts))
    got = cleaning.drop_repeats(crowded, GAP, limit)
    assert rows(got, "punch_id", "person", "ts") == sorted(want, key=repr)


@LIMITS
def test_pair_punches(crowded, local, limit):
    want = []
    for person, times in local.items():
        days = defaultdict(list)
        for ts, _ in times:
            days[ts.date()].append(ts)
        for day, stamps in days.items():
            stamps = stamps + [None] * (len(stamps) % 2)
            want += [(person, day, a, b) for a, b in zip(stamps[::2], stamps[1::2])]
    got = intervals.pair_punches(crowded, limit)
    assert rows(got, "person", "day", "in_ts", "out_ts") == sorted(want, key=repr)


@LIMITS
def test_presence_sessions(crowded, local, limit):
    gap, want = timedelta(hours=2), []
    for person, times in local.items():
        run = []
        for ts, _ in times + [(None, None)]:
            if run and (ts is None or ts - run[-1] >= gap):
                want.append((person, run[0], run[-1] + gap, len(run)))
                run = []
            run.append(ts)
    got = timeline.presence_sessions(crowded, gap, limit)
    assert rows(got, "person", "session_start", "session_end", "punches") == sorted(want, key=repr)


@LIMITS
def test_close_punches_counts_every_pair(crowded, local, limit):
    pairs, earlier = Counter(), Counter()
    for person, times in local.items():
        for j, (ts, _) in enumerate(times):
            for before, _ in times[:j]:
                if ts - before < GAP:
                    pairs[person, ts] += 1
            earlier[person, ts] = sum(before < ts and ts - before < GAP for before, _ in times)
    got = timeline.close_punches(crowded, GAP, limit)
    want = [(person, ts, n, earlier[person, ts]) for (person, ts), n in pairs.items()]
    assert rows(got, "person", "ts", "pairs", "earlier") == sorted(want, key=repr)


@LIMITS
def test_last_before(crowded, local, limit):
    others = crowded.filter("punch_id % 3 = 0")
    want = []
    for person, times in local.items():
        for ts, punch_id in times:
            if punch_id % 3:
                last = max(((t, i) for t, i in times if i % 3 == 0 and t <= ts), default=(None, None))
                want.append((punch_id, person, ts, *last))
    got = timeline.last_before(crowded.filter("punch_id % 3 <> 0"), others, limit)
    assert rows(got, "punch_id", "person", "ts", "last_ts", "last_id") == sorted(want, key=repr)


def test_split_keeps_every_row(crowded):
    few, many = split_hot(crowded, ["person"], 100)
    assert few.count() + many.count() == crowded.count()
    assert [r.person for r in many.select("person").distinct().collect()] == [1]


def test_split_keeps_rows_without_a_person(spark):
    df = spark.createDataFrame([(None,), (None,), (1,)], "person long")
    few, many = split_hot(df, ["person"], 1)
    assert few.count() + many.count() == 3


def test_total_before(spark):
    data = [(at(1, 0, 0, 1, 5), 1), (at(1, 0, 0, 1, 9), 2), (at(1, 0, 0, 2), 4), (at(1, 23), 8), (at(7), 16)]
    df = spark.createDataFrame(data, "ts timestamp_ntz, n long")
    assert [r.b for r in total_before(df, [], "n", "b").orderBy("ts").collect()] == [0, 1, 3, 7, 15]


def test_repeat_rows(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 25_001)], "k long, copies long")
    assert rows(repeat_rows(df, "copies", ["k"]).groupBy("k").count()) == [(1, 2), (25001, 3)]


@pytest.mark.parametrize(
    "build",
    [
        lambda p: cleaning.drop_repeats(p, GAP),
        intervals.pair_punches,
        lambda p: timeline.presence_sessions(p, GAP),
        lambda p: timeline.close_punches(p, GAP),
    ],
    ids=["drop_repeats", "pair_punches", "presence_sessions", "close_punches"],
)
def test_no_cost_without_large_groups(punches, build):
    """The branch for large groups and its joins are gone; punches shuffle once."""
    plan = final_plan(build(punches))
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Join" not in plan
    assert plan.count("FileScan") == 1


@pytest.fixture(scope="module")
def gaps(spark):
    """Rows without a time or a person, in large groups too, and a map column."""
    rng = random.Random(11)
    data = []
    for i in range(600):
        person = rng.choice([1, 1, 2, 3, None, None])
        ts = None if rng.random() < 0.2 else at(rng.randint(1, 3), rng.randint(8, 10), rng.randint(0, 59))
        data.append((i, person, ts, {"k": i}))
    return spark.createDataFrame(data, "punch_id long, person long, ts timestamp_ntz, props map<string,int>")


@pytest.mark.parametrize(
    "build",
    [
        lambda p, n: cleaning.drop_repeats(p, GAP, n).select("punch_id", "person", "ts"),
        lambda p, n: intervals.pair_punches(p, n),
        lambda p, n: timeline.presence_sessions(p.filter("ts IS NOT NULL"), timedelta(hours=2), n),
        lambda p, n: timeline.close_punches(p.filter("ts IS NOT NULL"), GAP, n),
        lambda p, n: timeline.last_before(p.filter("punch_id % 3 <> 0"), p.filter("punch_id % 3 = 0"), n),
    ],
    ids=["drop_repeats", "pair_punches", "presence_sessions", "close_punches", "last_before"],
)
def test_both_sides_of_the_limit_agree(gaps, build):
    want = rows(build(gaps, 5_000_000))
    assert want
    for limit in (0, 100):
        assert rows(build(gaps, limit)) == want


def test_no_row_without_a_time_is_lost(gaps):
    for limit in (0, 100, 5_000_000):
        kept = cleaning.drop_repeats(gaps, GAP, limit)
        assert kept.filter("ts IS NULL").count() == gaps.filter("ts IS NULL").count()
        assert kept.schema["props"].dataType == gaps.schema["props"].dataType
        last = timeline.last_before(gaps, gaps.limit(0), limit)
        assert last.count() == gaps.count()


def test_rows_without_a_person_are_a_large_group(gaps):
    few, many = split_hot(gaps, ["person"], 100)
    assert {r.person for r in many.select("person").distinct().collect()} >= {None}
    assert few.filter("person IS NULL").count() == 0
