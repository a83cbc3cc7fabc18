"""Findings of the third round on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery.operators import structure
from orrery.operators.profile import Profile


def _snap(spark, rows):
    return sn.snapshot(spark.createDataFrame([(i, *map(float, r), 1.0, 0.0, 0.0, 0.0) for i, r in enumerate(rows)], "pidx long, x double, y double, z double, mass double, vx double, vy double, vz double"))


def _first_fall(r, scale):
    r = np.sort(r)
    v = np.cbrt(np.arange(1, len(r) + 1) / scale)
    ok = v < np.append(r[1:], np.inf)
    return np.maximum(v, r)[ok].min()


@pytest.mark.parametrize("density", [1e-4, 3e-3, 0.05, 1.0, 30.0])
def test_virial_radius_is_the_first_fall(spark, density):
    # a hollow shell with a core: the density falls, rises and falls again; or never falls
    rng = np.random.default_rng(3)
    r = np.concatenate([rng.uniform(0.5, 1, 40), rng.uniform(8, 10, 900)])
    s = _snap(spark, [(v, 0, 0) for v in r])
    assert structure.virial_radius(s, density, 1.0) == pytest.approx(_first_fall(r, 4 / 3 * math.pi * density), rel=1e-9)


def test_midplane_on_rows_at_ring_points_and_the_centre(spark):
    rows = [(0, 0, 0), (2, 0, 0), (5, 1, 1), (-4, 3, 0), (0, -7, 2), (6, -6, 1)]
    got = Profile(_snap(spark, rows), edges=[0.0, 4.0, 8.0, 12.0], ndim=2).table("v_circ", "pot", "Q").orderBy("bin").collect()
    assert got[0]["pot"] == -math.inf and math.isnan(got[0]["v_circ"]) and math.isnan(got[0]["Q"])
    assert math.isfinite(got[1]["pot"])
    # a row at the centre, no row at a ring's point
    q = Profile(_snap(spark, [(0, 0, 0), (1, 1, 0), *rows[2:]]), edges=[0.0, 4.0, 8.0, 12.0], ndim=2).table("Q").orderBy("bin").first()["Q"]
    assert math.isnan(q)


def test_bisection_counts_marks(spark):
    marks = [-3.0, 0.0, 0.5, 7.0, 7.5, 9.0, 11.0]
    xs = [-9.0, -3.0, -1.0, 0.0, 6.9, 7.0, 10.9, 11.0, 99.0]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for n in range(1, len(marks) + 1):
        got = [r[0] for r in df.select(sn.at_most(F.lit(marks[:n]), n, F.col("x"))).collect()]
        assert got == [sum(m <= x for m in marks[:n]) for x in xs]


@pytest.mark.parametrize("box", [None, 4.0])
def test_kernel_sums_move_no_pairs(spark, box):
    from orrery.operators import neighbours, sph

    rng = np.random.default_rng(5)
    at = rng.uniform(-2, 2, (300, 3))
    df = spark.createDataFrame([(i, *map(float, p), 1.0 + i % 3, *map(float, rng.normal(size=3))) for i, p in enumerate(at)], "pidx long, x double, y double, z double, mass double, vx double, vy double, vz double")
    s = sn.snapshot(df, None, {"boxsize": box} if box else None)
    rho = sph.density(s, 8)
    lists = neighbours.near_lists(df, df, 8, box=box, block_points=40, weight="mass")
    assert {r["pidx"]: [n["neighbour"] for n in r["near"]] for r in lists.collect()} == {r["pidx"]: [n["neighbour"] for n in r["near"]] for r in neighbours.smoothing_lists(s, 8).collect()}
    rows = df.join(rho.withColumnRenamed("smooth", "h"), "pidx")
    term = lambda d2, h, d, there, here: {"n": (d2 < 4 * h * h * (1 - 1e-12)) * 1.0, "m": there["mass"] * (np.sqrt(d2) < 2 * h * (1 - 1e-12))}
    got = neighbours.kernel_sums(rows, 8, box, ["mass"], term, ["n", "m"], 40)
    assert {r["n"] for r in got.collect()} == {7.0} and got.count() == 300
    got = sph.sph_sum(s, "mean", "vx", 8)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan or "neighbour" not in plan


def test_spans_are_joined_by_place_not_by_pairs(spark):
    from orrery.operators import groups

    n = 3000
    s = sn.snapshot(spark.createDataFrame([(i, ("gas", "star", "dm")[i * 7 % 3]) for i in range(n)], "pidx long, family string"))
    spans = [(0, "gas", 0, 5), (1, "gas", 995, 10**12), (2, "dm", -3, 5), (3, "star", 10, 990), (4, "dm", 7, 0), (5, "gas", 3, 4)]
    h = spark.createDataFrame(spans, "halo long, family string, offset long, length long")
    c = groups.from_family_offsets(s, h)
    place = {f: [i for i in range(n) if ("gas", "star", "dm")[i * 7 % 3] == f] for f in ("gas", "star", "dm")}
    want = sorted((k, p) for k, f, o, m in spans for p in place[f][max(o, 0) : max(o + m, 0)])
    assert sorted(map(tuple, c.members.collect())) == want


def test_gravity_of_all_in_tiles(spark):
    from orrery.operators import gravity

    rng = np.random.default_rng(8)
    p, m = rng.normal(size=(70, 3)), rng.uniform(1, 2, 70)
    p[1] = p[0]
    s = sn.snapshot(spark.createDataFrame([*[(i, *map(float, p[i]), float(m[i])) for i in range(70)], (70, None, 0.0, 0.0, 1.0)], "pidx long, x double, y double, z double, mass double"))
    got = gravity.all_direct(s, 0.0, 16).orderBy("pidx").toPandas()
    d = p[:, None] - p[None]
    with np.errstate(divide="ignore"):
        inv = 1 / np.sqrt((d * d).sum(2))
    inv[np.isinf(inv)] = 0
    assert np.allclose(got["phi"][:70], -(inv * m).sum(1)) and np.isnan(got["phi"][70])
    assert np.allclose(got[["ax", "ay", "az"]][:70], -((inv**3 * m)[..., None] * d).sum(1))
    assert np.allclose(gravity.all_direct(s, 0.0, 16, force=False).orderBy("pidx").toPandas()["phi"][:70], got["phi"][:70])
