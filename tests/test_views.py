"""Slices of slices, views in an order of their own, and what keeps it."""

import random

import pytest
from pyspark.sql import functions as F

from orrery.operators import bridge, filters
from orrery.snapshot import snapshot

N = 97


@pytest.fixture(scope="module")
def s(spark):
    cols = [F.col("id").alias("pidx"), (F.col("id") * 5 % N).alias("iord"), F.when(F.col("id") < 40, "gas").otherwise("dm").alias("family"), *[(F.col("id") * 1.0).alias(c) for c in "xyz"], F.lit(1.0).alias("mass")]
    return snapshot(spark.range(N).select(*cols))


def rows(view):
    return [r[0] for r in view.ordered().select("pidx").collect()]


def test_slices_equal_those_of_a_list(s):
    rng = random.Random(4)
    pick = lambda: rng.choice([None, None, *range(-N - 5, N + 5, 7)])
    for _ in range(25):
        view, want = s, list(range(N))
        for _ in range(rng.choice([1, 2, 3])):
            cut = slice(pick(), pick(), rng.choice([None, 1, 2, 5, -1, -3]))
            view, want = view[cut], want[cut]
        assert rows(view) == want
        assert {r[0]: r[1] for r in view._placed().collect()} == {p: i for i, p in enumerate(want)}
    with pytest.raises(ValueError):
        s[::0]


def test_slices_of_slices_need_no_shuffle(s):
    for view in (s[10:80:3][5:20][::2], s[::-1][3:50:4], s[-50:-10][::-2]):
        plan = view.df._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Join" not in plan
        assert "Exchange" not in view._placed()._jdf.queryExecution().executedPlan().toString()


def test_places_in_order_and_again(s):
    assert rows(s.take([5, 2, 2, -1, 5])) == [5, 2, 2, 96, 5]
    assert rows(s[[5, 2, 2]]) == [5, 2, 2]
    assert rows(s.gas.take([39, 0, 0])) == [39, 0, 0]
    assert rows(s.dm.take([1, 3, 8])) == [41, 43, 48]
    view = s.take([50, 7, 7, 60, 3])
    assert rows(view.where(F.col("pidx") < 60)) == [50, 7, 7, 3]
    assert rows(view.gas) == [7, 7, 3] and rows(view.where(filters.LowPass("x", 55.0))) == [50, 7, 7, 3]
    assert rows(view[1:4]) == [7, 7, 60] and rows(view[::-1]) == [3, 60, 7, 7, 50]
    assert rows(view.take([4, 0, 1, 1])) == [3, 50, 7, 7]
    assert rows(view.intersect(s.gas)) == [7, 7, 3] and rows(view.union(s[:2])) == [0, 1, 3, 7, 50, 60]
    assert "__place" not in view.keys()
    with pytest.raises(IndexError):
        s.take([N])


def test_backward_slices_keep_their_order(s):
    back = s[::-1]
    assert rows(back.gas)[:3] == [39, 38, 37]
    assert rows(back.where(F.col("pidx") % 10 == 0)) == [90, 80, 70, 60, 50, 40, 30, 20, 10, 0]
    assert rows(back.gas[2:5]) == [37, 36, 35] and rows(back.gas[::-7]) == [0, 7, 14, 21, 28, 35]
    assert rows(s.gas[::-13]) == [39, 26, 13, 0]


def test_bridges_keep_the_order_of_a_view(spark, s):
    other = snapshot(s.df.select("pidx", (F.col("pidx") * 7 % N).alias("iord"), "family", "x", "y", "z", "mass"))
    pair = {5 * i % N: i for i in range(N)}
    partner = {i: next(j for j in range(N) if 7 * j % N == 5 * i % N) for i in range(N)}
    b = bridge.order_bridge(s, other, allow_family_change=True)
    view = s.take([9, 4, 4, 80])
    assert rows(b(view, ordered=True)) == [partner[k] for k in (9, 4, 4, 80)]
    assert rows(b(s[5:9], ordered=True)) == [partner[k] for k in range(5, 9)]
    assert rows(b(s[9:4:-2], ordered=True)) == [partner[k] for k in (9, 7, 5)]
    assert rows(b(view)) == sorted({partner[k] for k in (9, 4, 80)})
    assert len(pair) == N


def test_ids_that_no_row_has(spark, s):
    ids = spark.createDataFrame([(3,), (500,), (4,)], "iord long")
    assert s.ids(ids).df.count() == 2
    with pytest.raises(KeyError, match="500"):
        s.ids(ids, missing="raise")


def test_quantiles_of_one_bin_of_all_rows(spark):
    import numpy as np

    from orrery.operators.profile import Profile

    rng = np.random.default_rng(1)
    n = 5000
    # a third of the values are one and the same
    v = np.where(rng.random(n) < 0.33, 7.0, rng.normal(size=n)).round(2)
    w = rng.uniform(1, 2, n)
    df = spark.createDataFrame([(i, "dm", float(1 + i % 2), 0.0, 0.0, float(w[i]), float(v[i])) for i in range(n)], "pidx long, family string, x double, y double, z double, mass double, t double")
    p = Profile(snapshot(df), edges=[0.0, 5.0])
    got = p.quantiles("t", (0.1, 0.5, 0.9)).first()
    assert got[1:] == pytest.approx(tuple(np.percentile(v, [10, 50, 90])))
    assert p.median("t").first()[1] == np.sort(v)[n // 2]
    order = np.lexsort((w, v))
    c = np.cumsum(w[order])
    f = (c - c[0]) / (c[-1] - c[0])
    assert p.weighted_quantiles("t", "mass", (0.25, 0.5)).first()[1:] == pytest.approx(tuple(np.interp([0.25, 0.5], f, v[order])))
    for q in (p.quantiles("t"), p.median("t"), p.weighted_quantiles("t", "mass")):
        plan = q._jdf.queryExecution().executedPlan().toString()
        windows = [line for line in plan.splitlines() if "Window [" in line and "__i" in line]
        assert windows and all("__p" in line for line in windows)


def test_edges_with_one_hot_value(spark):
    from orrery.operators.profile import equal_edges

    df = spark.range(900).select(F.when(F.col("id") < 300, 5.0).otherwise(F.col("id") * 1.0).alias("x"))
    e = equal_edges(df, "x", 3)
    assert e[1:3] == [5.0, 599.0] and e[0] < 5.0 and e[-1] > 899.0
