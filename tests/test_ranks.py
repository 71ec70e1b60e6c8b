import numpy as np
import pytest

from sessionlens.functions.ranks import average_ranks, exact_quantiles, value_bin
from sessionlens.sources.staging import stage


def _expected(values, q):
    v = np.sort(np.asarray(values, dtype=float))
    return float(np.quantile(v, q)), float(v[max(int(np.ceil(q * len(v))) - 1, 0)])


WRITTEN = {"materialise": lambda t: stage(t, "bins")[0]}
MODES = {"broadcast": {"few_groups": True}, "counted": {}, "written": WRITTEN, "divided": {**WRITTEN, "largest": 3}}


@pytest.mark.parametrize("mode", MODES)
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 1.0])
def test_quantiles_are_exact(frame, mode, q):
    rng = np.random.default_rng(7)
    groups = {
        "wide": rng.lognormal(5, 3, 401), "tiny": rng.random(6) * 1e-6, "one": [4.25], "two": [1.0, 1e9],
        "zeros": [0.0] * 50 + [3.0, 7.0], "signed": rng.normal(0, 1000, 200), "close": 1e6 + rng.random(300),
    }
    rows = [(g, float(x)) for g, xs in groups.items() for x in xs] + [("none", None), ("one", None)]
    got = {r["g"]: r for r in exact_quantiles(frame("g string, v double", rows), ["g"], "v", q, **MODES[mode]).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        cont, disc = _expected(xs, q)
        assert got[g]["n"] == len(xs)
        assert got[g]["q_cont"] == pytest.approx(cont, rel=1e-12, abs=1e-12), g
        assert got[g]["q_disc"] == disc, g


def test_quantiles_null_group_and_no_group(frame):
    df = frame("g string, h boolean, v double", [(None, True, 1.0), (None, True, 3.0), ("", True, 9.0), ("a", None, 5.0)])
    got = {(r["g"], r["h"]): r["q_cont"] for r in exact_quantiles(df, ["g", "h"], "v").collect()}
    assert got == {(None, True): 2.0, ("", True): 9.0, ("a", None): 5.0}
    assert exact_quantiles(df, [], "v").first()["q_cont"] == 4.0


def test_nan_is_ignored_and_infinity_is_a_value(frame):
    inf = float("inf")
    df = frame("v double", [(float("nan"),), (-inf,), (1.0,), (2.0,), (3.0,), (inf,), (inf,), (None,)])
    for mode in MODES.values():
        r = exact_quantiles(df, [], "v", 0.5, **mode).first()
        assert (r["n"], r["q_disc"]) == (6, 2.0) and r["q_cont"] == 2.5
    assert exact_quantiles(df, [], "v", 1.0).first()["q_disc"] == inf


def test_weighted_values_count_that_often(frame):
    df = frame("g string, v double, n long", [("a", 1.0, 3), ("a", 5.0, 2), ("a", 9.0, 1), ("b", 2.0, 1), ("b", 4.0, 1)])
    for mode in MODES.values():
        got = {r["g"]: (r["n"], r["q_cont"], r["q_disc"]) for r in exact_quantiles(df, ["g"], "v", weight="n", **mode).collect()}
        assert got == {"a": (6, 3.0, 1.0), "b": (2, 3.0, 2.0)}


def test_hot_group_with_one_value_collapses(spark):
    """A group of many equal rows is one counted value, however many rows it has."""
    df = spark.range(300_000).selectExpr("IF(id % 3 = 0, 'cold', 'hot') AS g", "IF(id % 3 = 0, id * 1.5, 7.0) AS v")
    got = {r["g"]: r["q_cont"] for r in exact_quantiles(df, ["g"], "v").collect()}
    assert got["hot"] == 7.0
    assert got["cold"] == float(np.quantile(np.arange(0, 300_000, 3) * 1.5, 0.5))


@pytest.mark.parametrize("q", [0.25, 0.5])
def test_close_values_are_divided_until_no_task_ranks_many(spark, q):
    """Half of a group's values lie in one bin, and half of those in one part of it: parts are divided until few rows are left."""
    written = []

    def materialise(table):
        written.append(stage(table, "bins")[0])
        return written[-1]

    close = "IF(id % 4 = 0, id * 1.0, IF(id % 4 = 1, 1e6 + id * 1e-3, 1e6 + id * 1e-9))"
    df = spark.range(40_000).selectExpr(f"{close} AS v")
    r = exact_quantiles(df, [], "v", q, materialise=materialise, largest=200).first()
    cont, disc = _expected([x["v"] for x in df.collect()], q)
    assert (r["q_cont"], r["q_disc"]) == (pytest.approx(cont, rel=1e-15), disc)
    most = [t.agg({"_rows": "max"}).first()[0] for t in written]
    assert len(most) >= 3 and most[0] > 20_000 and most[-1] <= 200 and most == sorted(most, reverse=True)


def test_equal_values_are_not_divided(spark):
    written = []
    df = spark.range(5_000).selectExpr("7.5D AS v")
    keep = lambda t: written.append(stage(t, "bins")[0]) or written[-1]
    assert exact_quantiles(df, [], "v", materialise=keep, largest=10).first()["q_disc"] == 7.5 and len(written) == 1


def test_bins_are_monotone(frame):
    xs = sorted([0.0, 1e-9, -1e-9, 0.5, 1, 2, 3.5, 1e3, 1e6, 1e12, -5, -1e8, 2.0000001])
    bins = [r[0] for r in frame("v double", [(float(x),) for x in xs]).select(value_bin("v")).collect()]
    assert bins == sorted(bins)


def test_average_ranks_share_ties(frame):
    xs = [3.0, 1.0, 3.0, 2.0, 3.0, 100.0, 2.0]
    got = {r["v"]: r["r"] for r in average_ranks(frame("v double", [(x,) for x in xs]), "v", "r").collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 5.0, 100.0: 7.0}
