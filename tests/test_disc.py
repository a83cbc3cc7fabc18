"""Disc analysis and lattices."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery.functions.cosmology import Cosmology
from orrery.operators import disc
from orrery.operators.profile import Profile
from orrery.sources import lattice


@pytest.fixture(scope="module")
def s(spark):
    rng = np.random.default_rng(7)
    n = 4000
    r, phi = rng.exponential(2.0, n) + rng.exponential(2.0, n), rng.uniform(0, 2 * math.pi, n)
    rows = [(i, "star" if i % 2 else "dm", float(a * math.cos(p)), float(a * math.sin(p)), float(rng.normal() * 0.1), float(-math.sin(p)), float(math.cos(p)), 0.0, 1.0, 4.0) for i, (a, p) in enumerate(zip(r, phi, strict=True))]
    return sn.snapshot(spark.createDataFrame(rows, "pidx long, family string, x double, y double, z double, vx double, vy double, vz double, mass double, t_mag double"))


def test_exponential_disc(s):
    t = disc.surface_brightness(s, "t", np.linspace(0.5, 10, 20).tolist())
    _, length = disc.fit_exponential(t)
    assert length == pytest.approx(2.0, rel=0.15)
    _, _, n = disc.fit_sersic(t)
    assert n == pytest.approx(1.0, abs=0.35)


def test_stability_and_rotation(s):
    p = Profile(s, edges=[1.0, 2.0, 3.0, 4.0, 5.0], ndim=2)
    rows = disc.stability(p, 0.5).orderBy("bin").collect()
    assert len(rows) == 4 and all(r["omega"] == pytest.approx(r["v_circ"] / r["rbins"]) and r["kappa"] > 0 and r["q"] is not None for r in rows)
    by = {(r["family"], r["k"]): r["v_circ"] for r in disc.rotation_by_family(s, [2.0, 5.0], 0.5).collect()}
    for k in (0, 1):
        assert by["all", k] ** 2 == pytest.approx(by["star", k] ** 2 + by["dm", k] ** 2, rel=0.02)


def test_fourier_map_has_no_mean(s):
    p = Profile(s, edges=[1.0, 3.0, 6.0], ndim=2)
    rows = disc.fourier_map(p, (1, 2), 50, 100).groupBy("bin").agg(F.avg("value").alias("v"), F.count(F.lit(1)).alias("n")).collect()
    assert [r["n"] for r in rows] == [50, 50] and all(abs(r["v"]) < 1e-9 for r in rows)
    d = disc.density_profile(s, 0.5, 8.0, 5).collect()
    assert len(d) == 5 and d[0]["err"] > 0


def test_lattice(spark):
    c = Cosmology(0.3, 0.7, 0.7, 0.1)
    t = lattice.initial_conditions(spark, (3, 4, 5), 10.0, c)
    rows = t.df.orderBy("pidx").collect()
    assert len(rows) == 60 and (rows[4]["x"], rows[4]["y"], rows[4]["z"]) == (15.0, 15.0, 5.0)
    assert rows[59]["z"] == 45.0 and rows[0]["mass"] == pytest.approx(c.rho_matter(0.0) * 1000)
