"""Units, columns, filters, transformations and analysis against NumPy."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery import units
from orrery.functions import massfunction, nfw, tables
from orrery.functions.cosmology import Cosmology
from orrery.operators import bridge, filters, gravity, groups, neighbours, render, sph, structure, transform
from orrery.operators.profile import Profile, bin_of


def test_units():
    u = units.parse
    assert u("Msol kpc^-3").ratio("m_p cm^-3") == pytest.approx(4.04e-8, rel=1e-2)
    assert u("km s^-1").ratio("kpc Gyr^-1") == pytest.approx(1.0227, rel=1e-4)
    assert (u("kpc") ** (1, 2) * u("kpc") ** (1, 2)) == u("kpc")
    assert u("kpc a").ratio("kpc", a=0.5) == 0.5
    assert u("J").dimensional_project(["m", "s", "kg"]) == [Fraction(2), Fraction(-2), Fraction(1)]
    assert u("erg s^-1").is_compatible("W") and not u("m").is_compatible("s")
    assert u("m**1/2") ** 2 == u("m")
    with pytest.raises(units.UnitsError):
        u("m").ratio("s")
    with pytest.raises(units.UnitsError):
        u("parsnip")
    with pytest.raises(units.UnitsError):
        u("m").dimensional_project(["s"])


def test_conversions_are_exact():
    u = units.parse
    assert u("0.2 Mpc").ratio("kpc") == 200.0 and u("0.1 Mpc").ratio("kpc") == 100.0
    assert u("3 Gyr").ratio("Myr") == 3000.0 and u("kpc a^2").ratio("pc", a=0.1) == 10.0


def test_low_pass_leaves_out_rows_at_its_limit(spark):
    s = sn.snapshot(spark.createDataFrame([(0, 200.0, 0.0, 0.0), (1, 120.0, 160.0, 0.0), (2, 199.0, 0.0, 0.0)], "pidx long, x double, y double, z double"), {"pos": "kpc"})
    assert _ids(s.where(filters.LowPass("r", "0.2 Mpc"))) == [2]


@pytest.fixture(scope="module")
def blob(spark):
    rng = np.random.default_rng(1337)
    n = 1000
    pos, vel, mass = rng.normal(size=(n, 3)), rng.normal(size=(n, 3)), rng.uniform(1, 10, n)
    fam = ["gas"] * 250 + ["dm"] * 500 + ["star"] * 250
    df = spark.createDataFrame([(i, 2 * i + 5, fam[i], *map(float, pos[i]), *map(float, vel[i]), float(mass[i])) for i in range(n)], "pidx long, iord long, family string, x double, y double, z double, vx double, vy double, vz double, mass double")
    s = sn.snapshot(df, {"pos": "kpc", "vel": "km s^-1", "mass": "Msol"}, {"a": 1.0, "h": 0.7})
    return s, pos, vel, mass


def _ids(s):
    return sorted(r[0] for r in s.df.select("pidx").collect())


def test_columns(blob):
    s, pos, vel, _ = blob
    got = s.select("pidx", "r", "j2", "vr").orderBy("pidx").toPandas()
    r = np.linalg.norm(pos, axis=1)
    assert np.allclose(got["r"], r) and np.allclose(got["vr"], (pos * vel).sum(1) / r)
    assert np.allclose(got["j2"], (np.cross(pos, vel) ** 2).sum(1))
    assert s.unit("r") == "kpc" and s.unit("j2") == "kpc^2 km^2 s^-2"
    with pytest.raises(KeyError):
        s.col("nothing")

    @sn.derived("loop_a")
    def loop_a(t):
        return t.col("loop_b")

    @sn.derived("loop_b")
    def loop_b(t):
        return t.col("loop_a")

    with pytest.raises(sn.DependencyError):
        s.col("loop_a")
    p = s.physical_units("pc", "m s^-1", "kg")
    assert np.allclose(p.select("x").toPandas()["x"].sum(), pos[:, 0].sum() * 1000) and p.unit("vel") == "m s^-1"


def test_ragged_columns(blob):
    s, *_ = blob
    t = sn.snapshot(s.df.withColumn("rho", F.when(F.col("family") == "gas", 1.0)), s.units, s.properties, {"rho": {"gas"}})
    with pytest.raises(KeyError):
        t.col("rho")
    assert t.gas.select("rho").count() == 250


def test_filters(blob):
    s, pos, *_ = blob
    r = np.linalg.norm(pos, axis=1)
    where = lambda m: np.flatnonzero(m).tolist()
    assert _ids(s.where(filters.Sphere("1000 pc"))) == where(r < 1)
    assert _ids(s.where(filters.Annulus(0.5, 1.0))) == where((r >= 0.5) & (r < 1))
    assert _ids(s.where(~(filters.Sphere(1.0) | filters.HighPass("x", 0.5)))) == where(~((r < 1) | (pos[:, 0] > 0.5)))
    assert _ids(s.where(filters.Cuboid(-1.0))) == where((np.abs(pos) < 1).all(1))
    assert _ids(s.gas) == list(range(250)) and _ids(s.family("d")) == list(range(250, 750))
    plan = s.where(filters.BandPass("x", -0.5, 0.5)).df._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan
    c = [F.lit(v) for v in (3.0, 0.0, 0.0)]
    assert s.spark.range(1).select(filters.Sphere(1.0).touches_cells(c, 1.0), filters.Sphere(3.0).touches_cells(c, 1.0)).first()[:] == (False, True)


def test_sets_and_views(blob):
    s, pos, *_ = blob
    a, b = s.where(filters.HighPass("x", 0.0)), s.where(filters.HighPass("y", 0.0))
    assert _ids(a.union(b)) == np.flatnonzero((pos[:, 0] > 0) | (pos[:, 1] > 0)).tolist()
    assert _ids(a.setdiff(b)) == np.flatnonzero((pos[:, 0] > 0) & ~(pos[:, 1] > 0)).tolist()
    assert a.is_descendant(s) and not s.is_descendant(a) and a.ancestor() is s
    assert a.same_rows(s.where(filters.HighPass("x", 0.0))) and not a.same_rows(b)
    new = sn.new(s.spark, gas=3, dm=2)
    assert new.df.count() == 5 and _ids(new.dm) == [3, 4]


def test_transformations(blob):
    s, pos, *_ = blob
    m = transform.random_rotation(3)
    t = transform.rotate(transform.translate(s, (1, 2, 3)), m)
    got = t.df.orderBy("pidx").select("x", "y", "z").toPandas().to_numpy()
    assert np.allclose(got, (pos + [1, 2, 3]) @ m.T)
    back = transform.revert(transform.revert(t))
    assert np.allclose(back.df.orderBy("pidx").select("x", "y", "z").toPandas().to_numpy(), pos) and back.done == ()
    other = transform.apply_chain(t.done, s)
    assert np.allclose(other.df.orderBy("pidx").select("x").toPandas()["x"], got[:, 0])
    with pytest.raises(ValueError):
        transform.rotate(s, np.ones((3, 3)))
    with pytest.raises(ValueError):
        transform.revert(s)


def test_profile_bins(spark, blob):
    s, pos, _, mass = blob
    e = [0.0, 0.5, 1.0, 2.0]
    rows = spark.createDataFrame([(v,) for v in (-1.0, 0.0, 0.5, 1.999, 2.0, 3.0)], "v double").select(bin_of(F.col("v"), e), bin_of(F.col("v"), e, True)).collect()
    assert [r[0] for r in rows] == [None, 0, 1, 2, None, None] and rows[4][1] == 2
    p = Profile(s, type="equaln", nbins=5, ndim=3)
    n = [r["n"] for r in p.table("n").orderBy("bin").collect()]
    assert sum(n) == 1000 and max(n) - min(n) <= 2
    r = np.linalg.norm(pos, axis=1)
    q = Profile(s, edges=e, ndim=3).weighted_quantiles("r", "mass").orderBy("bin").collect()
    for k, row in enumerate(q):
        i = np.flatnonzero((r >= e[k]) & (r < e[k + 1]))
        i = i[np.argsort(r[i])]
        cum = np.cumsum(mass[i])
        assert row["q50"] == pytest.approx(np.interp(0.5, (cum - cum[0]) / (cum[-1] - cum[0]), r[i]))


def test_neighbours_and_kernels(blob):
    s, pos, _, mass = blob
    d2 = ((pos[:, None] - pos[None]) ** 2).sum(-1)
    near = np.sort(d2, axis=1)[:, :8]
    got = neighbours.smoothing_neighbours(s, 8).toPandas().sort_values(["pidx", "rank"])
    assert np.allclose(got["d2"].to_numpy().reshape(1000, 8), near)
    h = 0.5 * np.sqrt(near[:, -1])
    order = np.argsort(d2, axis=1)[:, :8]
    rho = (mass[order] * sph.CUBIC.value(np.sqrt(near) / h[:, None])).sum(1) / (math.pi * h**3)
    assert np.allclose(sph.density(s, 8).orderBy("pidx").toPandas()["rho"], rho)
    x = np.linspace(0, 2, 2001)
    for k in sph.KERNELS.values():
        assert np.trapezoid(4 * math.pi * x**2 * k.value(x) / math.pi, x) == pytest.approx(1, rel=1e-4)
        assert len(sph.projected(k)) == 201


def test_neighbours_on_a_line_and_without_coordinates(spark):
    kind = "pidx long, x double, y double, z double"
    x = np.linspace(0, 500, 600)
    line = sn.snapshot(spark.createDataFrame([(i, float(v), 1.0, 2.0) for i, v in enumerate(x)], kind))
    got = neighbours.smoothing_neighbours(line, 4).toPandas().sort_values(["pidx", "rank"])
    want = np.sort((x[:, None] - x[None]) ** 2, axis=1)[:, :4]
    assert len(got) == 2400 and np.allclose(got["d2"].to_numpy().reshape(600, 4), want)
    # three points of five have a place
    holes = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 1.0, 1.0, 0.0), (2, 0.0, 2.0, 1.0), (3, None, 0.0, 0.0), (4, 1.0, float("nan"), 0.0)], kind)
    got = neighbours.smoothing_neighbours(sn.snapshot(holes), 4).toPandas()
    assert sorted(zip(got["pidx"], got["rank"], strict=True)) == [(i, r) for i in range(3) for r in (1, 2, 3)]


@pytest.mark.parametrize("box", [None, 2.0])
def test_neighbours_of_clustered_points_over_blocks(spark, box):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([rng.normal(0.3, 0.004, (900, 3)), rng.uniform(-1, 1, (300, 3)), np.repeat([[0.5, 0.5, 0.5]], 40, axis=0), [[0.999, -0.999, 0.999]] * 3])
    n, k = len(xyz), 9
    df = spark.createDataFrame([(int(i), *map(float, v)) for i, v in enumerate(xyz)], "pidx long, x double, y double, z double")
    got = neighbours.knn(df.where("pidx % 3 = 0"), df, k, box=box, block_points=60).toPandas().sort_values(["pidx", "rank"])
    d = xyz[:, None] - xyz[None]
    d = d - box * np.round(d / box) if box else d
    d2 = (d * d).sum(-1)
    for i in range(0, n, 3):
        mine = got[got["pidx"] == i]
        want = np.sort(d2[i])[:k]
        assert np.allclose(mine["d2"], want, atol=1e-12) and list(mine["rank"]) == list(range(1, k + 1))
        assert np.allclose(d2[i][mine["neighbour"]], want, atol=1e-12) and mine["neighbour"].is_unique
    # ties by the least id
    assert got[got["pidx"] == 1203]["neighbour"].tolist() == list(range(1200, 1209))
    at = neighbours.cuts(df, 60)
    assert at.inner == 31 and np.bincount(at.block(xyz)).max() < 160


def test_slices_of_views(spark):
    s = sn.snapshot(spark.range(1000, numPartitions=4).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 3 == 0, "gas").otherwise("dm").alias("family")))
    places = lambda v: [int(r["x"]) for r in v.df.orderBy("x").collect()]
    assert places(s.rows(0, 600)) == list(range(600)) and s.df.agg(F.max("pidx")).first()[0] == 999
    gas = s.where(F.col("x") >= 30).gas
    own = [k for k in range(30, 1000) if k % 3 == 0]
    assert places(gas.rows(0, 10)) == own[:10]
    assert places(gas[5:-3:7]) == own[5:-3:7] and places(gas[-4:]) == own[-4:] and places(gas[:2000]) == own
    assert places(gas[[0, 3, -1]]) == [own[0], own[3], own[-1]] and places(gas[1]) == [own[1]]
    assert places(gas[2:50][3:5]) == own[5:7]
    assert places(s[F.col("x") < 2]) == [0, 1] and places(s["gas"]) == places(s.g) == list(range(0, 1000, 3))
    assert s.df.select(s["x"]).count() == 1000 and s.neutrino.df.count() == 0
    with pytest.raises(IndexError):
        gas[[len(own)]]
    with pytest.raises(AttributeError):
        s.nothing


def test_pattern_speed(spark):
    # a bar that turns as a solid
    rng = np.random.default_rng(1)
    r, phi = rng.uniform(1, 2, 4000), np.concatenate([rng.normal(0.5, 0.2, 2000), rng.normal(0.5 - np.pi, 0.2, 2000)])
    rows = [(i, float(a * np.cos(f)), float(a * np.sin(f)), 0.0, float(-0.3 * a * np.sin(f)), float(0.3 * a * np.cos(f)), 0.0, 1.0) for i, (a, f) in enumerate(zip(r, phi, strict=True))]
    s = sn.snapshot(spark.createDataFrame(rows, "pidx long, x double, y double, z double, vx double, vy double, vz double, mass double"))
    got = Profile(s, edges=[1.0, 1.5, 2.0]).pattern_frequency(0.5).collect()
    assert [x["pattern_frequency"] for x in got] == pytest.approx([-0.3, -0.3], abs=0.01)


def test_gravity_of_two_bodies(spark):
    s = sn.snapshot(spark.createDataFrame([(0, 1.0, 0.0, 0.0, 2.0), (1, -1.0, 0.0, 0.0, 2.0)], "pidx long, x double, y double, z double, mass double"))
    phi, ax = gravity.direct(s, [(0.0, 0.0, 0.0), (3.0, 0.0, 0.0)], 0.0).orderBy("point").select("phi", "ax").collect()[1]
    assert phi == pytest.approx(-1.5) and ax == pytest.approx(-2 / 4 - 2 / 16)
    assert [r["phi"] for r in gravity.all_direct(s, 0.0, 1).collect()] == pytest.approx([-1, -1])


def test_structure(spark, blob):
    s, pos, vel, mass = blob
    assert np.allclose(structure.com(s), (pos * mass[:, None]).sum(0) / mass.sum())
    assert np.allclose(structure.angular_momentum(s), (np.cross(pos, vel) * mass[:, None]).sum(0))
    assert np.linalg.norm(structure.shrink_sphere(transform.translate(s, (5, 0, 0)), least=50) - [5, 0, 0]) < 0.4
    m = structure.faceon_matrix(np.array([1.0, 2.0, 3.0]))
    assert np.allclose(m @ np.array([1, 2, 3]), [0, 0, math.sqrt(14)]) and np.allclose(m @ m.T, np.eye(3))
    r = structure.virial_radius(s, 0.5)
    rr = np.linalg.norm(pos, axis=1)
    assert mass[rr < r].sum() / (4 / 3 * math.pi * r**3) == pytest.approx(89, rel=0.05)
    assert structure.bisect(lambda v: v * v - 2, 0, 2) == pytest.approx(math.sqrt(2), rel=1e-5)
    stretched = sn.snapshot(s.df.withColumn("z", F.col("z") * 0.5))
    ca = [t["ca"] for t in structure.shape(stretched, 1, least=0.01, most=3.0, bins="lin")]
    assert 0.35 < ca[0] < 0.65


def test_bridges_and_groups(spark, blob):
    s, *_ = blob
    end = sn.snapshot(s.df.where("pidx % 3 = 0").withColumn("pidx", F.col("pidx") + 10_000))
    b = bridge.order_bridge(s, end)
    assert _ids(b(s.where(filters.HighPass("x", 10)))) == []
    view = s.rows(0, 10)
    assert _ids(b(view)) == [10_000, 10_003, 10_006, 10_009] and _ids(b(b(view))) == [0, 3, 6, 9]
    with pytest.raises(ValueError):
        bridge.one_to_one(s, end)
    off = spark.createDataFrame([(1, 0, 10), (2, 5, 3), (3, 995, 5)], "halo long, offset long, length long")
    c = groups.from_offsets(s, off)
    arr = {r["pidx"]: r["grp"] for r in c.group_array().collect()}
    assert arr[0] == 1 and arr[6] == 2 and arr[999] == 3 and arr[500] == -1
    assert c.halo(2).df.count() == 3 and [r["halo"] for r in c.sizes().orderBy("rank").collect()] == [1, 3, 2]
    got = spark.createDataFrame([(5 + 2**31 - 2**32, 8.0)], "i long, m double").select(bridge.repaired_id(F.col("i"), F.col("m"), 3)).first()[0]
    assert got == 5 + 2**31 - 2**32 + 2**32


def test_sky_pixels_have_equal_area(spark):
    nside = 4
    n = 40_000
    df = spark.range(n).select(F.acos(1 - 2 * (F.col("id") + 0.5) / n).alias("t"), F.pmod(F.col("id") * 2.399963229728653, F.lit(2 * math.pi)).alias("p"))
    counts = df.groupBy(render.ring_pixel(F.col("t"), F.col("p"), nside).alias("pix")).count().toPandas()
    assert sorted(counts["pix"]) == list(range(12 * nside * nside))
    assert counts["count"].std() / counts["count"].mean() < 0.1


def _sky(df, n):
    out = np.zeros(n)
    for row in df.collect():
        out[row["pix"]] = row["value"]
    return out


def test_sky_spreads_kernels(spark):
    rng = np.random.default_rng(5)
    n, nside = 120, 4
    pos = rng.normal(size=(n, 3)) * np.geomspace(0.3, 10, n)[:, None]
    pos[:3] = [[0, 0, 2], [0, 0, -3], [0, 0, 0]]
    h, m, rho, q = rng.uniform(0.2, 2, n), rng.uniform(1, 3, n), rng.uniform(1, 2, n), rng.uniform(1, 9, n)
    rows = [(i, *map(float, pos[i]), float(h[i]), float(m[i]), float(rho[i]), float(q[i])) for i in range(n)]
    s = sn.snapshot(spark.createDataFrame(rows, "pidx long, x double, y double, z double, smooth double, mass double, rho double, temp double"))
    middles = []
    for i in range(1, 4 * nside):
        k = min(i, nside, 4 * nside - i)
        z = (2 * nside - i) / (1.5 * nside) if nside <= i <= 3 * nside else math.copysign(1 - k * k / (3 * nside * nside), 2 * nside - i)
        shift = 0.0 if nside < i < 3 * nside and (i - nside) % 2 else 0.5
        middles += [(z, 2 * math.pi * (j + shift) / (4 * k)) for j in range(4 * k)]
    z, phi = np.array(middles).T
    at = spark.createDataFrame([(k, float(math.acos(a)), float(b + 1e-9)) for k, (a, b) in enumerate(zip(z, phi, strict=True))], "k long, t double, p double")
    assert at.where(render.ring_pixel(F.col("t"), F.col("p"), nside) != F.col("k")).count() == 0
    unit = np.stack([np.sqrt(1 - z * z) * np.cos(phi), np.sqrt(1 - z * z) * np.sin(phi), z], axis=1)
    r = np.linalg.norm(pos, axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        angle = np.arccos(np.clip(unit @ (pos / r[:, None]).T, -1, 1))
        table = np.array(sph.projected(sph.CUBIC))
        k = np.nan_to_num(201 * (r * angle / (2 * h)) ** 2, nan=201).astype(int)
    column = np.where(k < 201, table[np.minimum(k, 200)], 0) * (r / h) ** 2 * q * m / rho
    assert np.allclose(_sky(render.sky(s, nside, quantity="temp"), len(z)), column.sum(1), rtol=1e-5)
    flat = np.where(k < 201, table[np.minimum(k, 200)], 0) * (r / h) ** 2 * m / rho
    assert np.allclose(_sky(render.sky(s, nside, quantity="temp", denoise=True), len(z)), column.sum(1) / flat.sum(1), rtol=1e-5)
    d = np.linalg.norm(2.0 * unit[:, None] - pos[None], axis=2)
    shell = sph.CUBIC.value(d / h) / (math.pi * h**3) * q * m / rho
    assert np.allclose(_sky(render.sky(s, nside, 2.0, "temp"), len(z)), shell.sum(1))
    # a small distant row: its column over all pixels is its mass
    one = sn.snapshot(spark.createDataFrame([(0, 30.0, 40.0, 10.0, 4.0, 2.0, 5.0)], "pidx long, x double, y double, z double, smooth double, mass double, rho double"))
    got = render.sky(one, 64)
    assert got.count() > 100 and got.agg(F.sum("value")).first()[0] * 4 * math.pi / (12 * 64 * 64) == pytest.approx(2.0, rel=0.02)


def test_cosmology():
    c = Cosmology(0.3, 0.7, 0.7)
    assert c.age(0.0) == pytest.approx(13.4617, rel=1e-3)
    assert c.redshift(c.age(2.0)) == pytest.approx(2.0, rel=1e-4)
    assert math.isnan(c.redshift(-1.0))
    assert Cosmology(1.0, 0.0, 0.7).growth(1.0) == pytest.approx(0.5, rel=1e-4)
    assert c.rho_crit(0.0) == pytest.approx(135.99, rel=1e-2)
    assert c.hubble(0.0) == pytest.approx(70.0)
    p = massfunction.PowerSpectrum.analytic(c, sigma8=0.8)
    assert math.sqrt(p.variance_r(8.0)) == pytest.approx(0.8, rel=1e-3)
    m, sigma, number = massfunction.halo_mass_function(p, 10, 15, 0.25)
    assert (np.diff(sigma) < 0).all() and (np.diff(number) < 0).all()
    assert massfunction.halo_bias(p, 1e15) > massfunction.halo_bias(p, 1e12)
    for w in (massfunction.TopHat, massfunction.Gaussian, massfunction.HarmonicStep):
        assert w.mass(w.radius(1e12, 3.0), 3.0) == pytest.approx(1e12)


def test_multiplicity_kernels():
    # by hand at nu = 1 and sigma = 1: ln(1 / sigma) is 0
    one, st = np.array([1.0]), 0.3222 * math.sqrt(2 * 0.707 / math.pi)
    g1, g2, tail = math.exp(-0.16 / 0.72), math.exp(-0.5625 / 0.08), math.exp(-1.08 * 0.707 / 2)
    lobe = 1 + 0.707**-0.3
    assert massfunction.KERNELS["REEDU"](one, one)[0] == pytest.approx(st * (lobe + 0.2 * g1) * tail)
    assert massfunction.KERNELS["REEDZ"](one, one, -2.0)[0] == pytest.approx(st * (lobe + 0.6 * g1 + 0.4 * g2) * tail * math.exp(-0.03))
    a = 0.788 / 2**0.01
    assert massfunction.KERNELS["B"](one, one, 1.0)[0] == pytest.approx(0.333 / 2**0.11 * math.sqrt(2 / math.pi) * (1 + a**-0.807) * a ** (1.795 / 2) * math.exp(-a / 2))
    p = massfunction.PowerSpectrum.analytic(Cosmology(0.3, 0.7, 0.7), sigma8=0.8)
    st = massfunction.halo_mass_function(p, 11, 14, 0.25)[2]
    for kern in ("REEDU", "REEDZ", "B"):
        got = massfunction.halo_mass_function(p, 11, 14, 0.25, kern)[2]
        assert (np.abs(np.log(got / st)) < 0.5).all()


def test_nfw():
    f = nfw.NFW.of_mass(1e12, 200.0, 10.0)
    assert f.enclosed(200.0) == pytest.approx(1e12) and f.concentration == 10
    assert f.slope(f.r_s) == pytest.approx(-2)
    r = np.geomspace(1, 200, 40)
    g = nfw.NFW.fit(r, f.density(r))
    assert g.r_s == pytest.approx(f.r_s, rel=1e-6) and g.rho_s == pytest.approx(f.rho_s, rel=1e-6)


def test_tables(spark):
    axes = (np.array([0.0, 1.0, 3.0]), np.array([0.0, 2.0]))
    values = np.add.outer(2 * axes[0], 5 * axes[1])
    got = tables.multilinear(axes, values, [np.array([0.5, 2.0, -1.0, np.nan]), np.array([1.0, 9.0, 0.5, 0.0])])
    assert np.allclose(got[:3], [6.0, 14.0, 2.5]) and math.isnan(got[3])
    t = tables.read_stellar_table("# Z age V\n0.01 6 1\n0.01 8 3\n0.1 6 2\n0.1 8 4", ["v"])
    s = sn.snapshot(spark.createDataFrame([(0, "star", 10.0, 0.01, 13.0 - 1e-2)], "pidx long, family string, mass double, metals double, tform double"), None, {"time": 13.0})
    t.register()
    assert s.select("v_mag").first()[0] == pytest.approx(2.0 - 2.5, abs=1e-6)
