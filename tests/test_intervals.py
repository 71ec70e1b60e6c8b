"""Interval joins against brute force."""

import random

import pytest

from sessionlens.operators.intervals import interval_join
from sessionlens.sources.staging import stage


def sides(frame, rng, n=120, hot=0):
    """Points and intervals from a second to months, some empty, some with nulls, many on the same place."""
    second = 10**6
    points = [(rng.choice("abc"), i, rng.randrange(-5, 10**7) * second) for i in range(n)]
    points += [("a", 1000 + i, 77 * second) for i in range(hot)] + [(None, 1, 5), ("a", 2, None), ("b", 7, 5 * second), ("b", 7, 5 * second)]
    spans = []
    for i in range(n):
        begin = rng.randrange(-5, 10**7) * second
        spans.append((rng.choice("abc"), -i, begin, begin + rng.choice((-1, 0, 1, 60, 3_600, 86_400, 9_000_000)) * second))
    spans += [("a", 1, 77 * second, 77 * second), ("a", 2, 0, 78 * second), (None, 3, 0, 10**15), ("a", 4, None, 5), ("b", 5, 5 * second, None)]
    return points, spans, frame("k string, p long, t long", points), frame("k string, i long, s long, e long", spans)


def brute(points, spans, keyed):
    for k, p, t in points:
        for k2, i, s, e in spans:
            if None not in (t, s, e) and s <= t <= e and (not keyed or (k == k2 and k is not None)):
                yield (k, p, t, i, s, e) if keyed else (p, t, i, s, e)


MODES = {"plain": {}, "split": {"materialise": lambda t: stage(t, "hot")[0], "hot_points": 5}}


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("keyed", [True, False])
def test_pairs_equal_brute_force(frame, mode, keyed):
    points, spans, p, i = sides(frame, random.Random(3), hot=40)
    if not keyed:
        p, i = p.drop("k"), i.drop("k")
    got = [tuple(r) for r in interval_join(p, i, ["k"] if keyed else [], "t", "s", "e", **MODES[mode]).collect()]
    assert sorted(got, key=repr) == sorted(brute(points, spans, keyed), key=repr) and len(got) > 100


def test_a_hot_bin_is_dealt_over_parts_and_no_loop_is_planned(spark, frame):
    kept = []
    keep = lambda t: kept.append(stage(t, "hot")[0]) or kept[-1]
    points = spark.range(3_000).selectExpr("'a' AS k", "id AS p", "77L AS t")
    spans = frame("k string, i long, s long, e long", [("a", 1, 0, 100), ("a", 2, 78, 100)])
    joined = interval_join(points, spans, ["k"], "t", "s", "e", materialise=keep, hot_points=500)
    assert joined.count() == 3_000 and kept[0].first()["_parts"] == 6
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_empty_sides(frame):
    points, spans = frame("k string, p long, t long", []), frame("k string, i long, s long, e long", [("a", 1, 0, 5)])
    assert interval_join(points, spans, ["k"], "t", "s", "e").count() == 0
    assert interval_join(frame("k string, p long, t long", [("a", 1, 3)]), spans.where("false"), ["k"], "t", "s", "e").count() == 0
