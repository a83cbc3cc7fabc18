"""Folders of columns and initial conditions, maps of densities and images in levels."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import sources
from orrery.functions.cosmology import Cosmology
from orrery.operators import filters, hist, render
from orrery.snapshot import snapshot
from orrery.sources import column_files, grafic, nchilada


def attribute(path, values, time=0.25):
    values = np.asarray(values)
    code = {"f4": 9, "f8": 10, "i4": 5, "i8": 7}[values.dtype.str[1:]]
    width = 1 if values.ndim == 1 else values.shape[1]
    big = values.astype(values.dtype.newbyteorder(">"))
    lo, hi = (f(big.reshape(len(big), width), axis=0).astype(big.dtype) if len(big) else np.zeros(width, big.dtype) for f in (np.min, np.max))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(struct.pack(">idqii", 1062053, time, len(values), width, code) + lo.tobytes() + hi.tobytes() + big.tobytes())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at, rng, told = tmp_path_factory.mktemp("nc"), np.random.default_rng(1), {}
    for fam, n in (("gas", 700), ("dark", 1300), ("star", 0)):
        told[fam] = {"position": rng.random((n, 3)).astype("f4"), "mass": rng.random(n), "iord": np.arange(n, dtype="i8") * 3, **({"temperature": rng.random(n).astype("f4")} if fam == "gas" else {})}
        for name, v in told[fam].items():
            attribute(at / fam / name, v)
    xml = "".join(f'<family name="{f}">' + "".join(f'<attribute name="{a}" link="{f}/{a}"/>' for a in cols) + "</family>" for f, cols in told.items())
    (at / "description.xml").write_text(f"<?xml version='1.0'?><simulation>{xml}</simulation>")
    return at, told


def test_columns_of_families(spark, folder, monkeypatch):
    at, told = folder
    monkeypatch.setattr(column_files, "ROWS", 300)
    s = sources.read(spark, str(at))
    assert s.prop("a") == 0.25 and s.df.count() == 2000
    assert s.df.rdd.getNumPartitions() == 8
    for fam, of in (("gas", s.gas), ("dark", s.dm)):
        got = of.df.orderBy("pidx").toPandas()
        assert np.array_equal(got[["x", "y", "z"]].to_numpy("f4"), told[fam]["position"])
        assert np.array_equal(got["mass"], told[fam]["mass"]) and np.array_equal(got["iord"], told[fam]["iord"])
    assert np.array_equal(s.gas.df.orderBy("pidx").toPandas()["temp"].to_numpy("f4"), told["gas"]["temperature"])
    assert [r[0] for r in s.df.select("pidx").orderBy("pidx").collect()] == list(range(2000))
    with pytest.raises(KeyError):
        s.col("temp")
    assert "Exchange" not in s.df._jdf.queryExecution().executedPlan().toString()


def test_other_columns_open_no_file(spark, folder):
    at, told = folder
    masses = at / "gas" / "mass"
    kept = masses.read_bytes()
    masses.write_bytes(kept[:100])
    try:
        assert sources.read(spark, str(at), columns=["x", "temp"]).df.agg(F.count("x"), F.count("temp")).first()[:] == (2000, 700)
        with pytest.raises(Exception, match="ends before"):
            sources.read(spark, str(at), columns=["mass"]).df.count()
    finally:
        masses.write_bytes(kept)


def test_runs_of_rows(spark, folder):
    at, told = folder
    every = [tuple(r) for r in nchilada.read(spark, str(at)).df.orderBy("pidx").collect()]
    runs = [(0, 3), (1295, 1305), (1990, 5000)]
    got = [tuple(r) for r in nchilada.read(spark, str(at), runs=runs).df.orderBy("pidx").collect()]
    assert got == [every[i] for a, b in runs for i in range(a, min(b, 2000))]


def test_broken_folders(spark, folder, tmp_path):
    (tmp_path / "description.xml").write_text('<s><family name="gas"><attribute name="mass" link="m"/></family></s>')
    (tmp_path / "m").write_bytes(b"\0" * 40)
    with pytest.raises(OSError, match="no file"):
        nchilada.read(spark, str(tmp_path))


def plane_file(path, header, values, order):
    mark = lambda n: struct.pack(f"{order}i", n)
    with open(path, "wb") as f:
        raw = struct.pack(f"{order}3i8f", *header)
        f.write(mark(len(raw)) + raw + mark(len(raw)))
        for plane in values:
            raw = plane.astype(plane.dtype.newbyteorder(order)).tobytes()
            f.write(mark(len(raw)) + raw + mark(len(raw)))


@pytest.mark.parametrize("order,posed", [("<", True), (">", True), ("<", False)])
def test_initial_conditions(spark, tmp_path, monkeypatch, order, posed):
    monkeypatch.setattr(column_files, "ROWS", 17)
    rng, n = np.random.default_rng(2), (4, 5, 3)
    head = (*n, 2.0, 1.0, 2.0, 3.0, 0.1, 0.3, 0.7, 70.0)
    shape = (n[2], n[1], n[0])
    vel = {c: rng.normal(size=shape).astype("f4") for c in "xyz"}
    pos = {c: rng.normal(size=shape).astype("f4") for c in "xyz"}
    for c in "xyz":
        plane_file(tmp_path / f"ic_velc{c}", head, vel[c].reshape(n[2], -1), order)
        if posed:
            plane_file(tmp_path / f"ic_posc{c}", head, pos[c].reshape(n[2], -1), order)
    plane_file(tmp_path / "ic_particle_ids", head, np.arange(60, dtype="i8").reshape(n[2], -1) + 7, order)
    s = sources.read(spark, str(tmp_path))
    got = s.df.orderBy("pidx").toPandas()
    k, j, i = np.meshgrid(*[np.arange(m) for m in shape], indexing="ij")
    grid = {"x": (i + 0.5) * 2.0 + 1.0, "y": (j + 0.5) * 2.0 + 2.0, "z": (k + 0.5) * 2.0 + 3.0}
    c = Cosmology(h=s.prop("h"), omega_m=s.prop("omegaM0"), omega_l=s.prop("omegaL0"), a=s.prop("a"))
    for x in "xyz":
        moved = pos[x] / c.h if posed else vel[x] / (c.a * c.growth_rate(9.0) / c.growth(9.0))
        assert np.allclose(got[x], (grid[x] + moved).ravel(), rtol=1e-5)
        assert np.array_equal(got[f"v{x}"].to_numpy("f4"), vel[x].ravel())
    assert got["iord"].tolist() == list(range(7, 67))
    # one mean density fills the box
    assert got["mass"].sum() == pytest.approx(c.rho_matter(0.0) * 60 * 2000.0**3, rel=1e-5)
    assert s.prop("a") == pytest.approx(0.1) and s.prop("boxsize") == 8.0
    (tmp_path / "ic_velcy").write_bytes(b"")
    one = grafic.read(spark, str(tmp_path), columns=["vx", "mass"], runs=[(19, 22), (59, 60)])
    assert one.df.columns == ["pidx", "family", "vx", "mass"]
    assert [tuple(r) for r in one.df.select("pidx", "vx").orderBy("pidx").collect()] == [(p, float(vel["x"].ravel()[p])) for p in (19, 20, 21, 59)]


def points(spark, n=800):
    rng = np.random.default_rng(4)
    x = rng.normal(size=n)
    y = 0.6 * x + 0.5 * rng.normal(size=n)
    df = spark.createDataFrame([(i, "dm", float(a), float(b), 0.0, 1.0 + i % 3) for i, (a, b) in enumerate(zip(x, y, strict=True))], "pidx long, family string, x double, y double, z double, mass double")
    return snapshot(df), x, y


@pytest.mark.parametrize("weights,correlated,norm", [(None, True, False), ("mass", False, True), (None, True, True)])
def test_kde_equals_brute_force(spark, weights, correlated, norm):
    s, x, y = points(spark)
    got = np.zeros((30, 20))
    for r in hist.kde(s, "x", "y", 30, 20, weights=weights, correlated=correlated, norm=norm).collect():
        got[r[0], r[1]] = r[2]
    cut = [np.minimum(np.floor((v - v.min()) / ((v.max() - v.min()) / n)), n - 1).astype(int) for v, n in ((x, 30), (y, 20))]
    w = 1.0 + np.arange(len(x)) % 3 if weights else np.ones(len(x))
    grid = np.zeros((30, 20))
    np.add.at(grid, tuple(cut), w)
    cov = np.cov(np.array(cut, float))
    cov = cov if correlated else np.diag(np.diag(cov))
    scott = len(x) ** (-1 / 6)
    reach = [int(v) // 2 for v in np.round(scott * 2 * np.pi * np.sqrt(np.diag(cov)))]
    inverse, want = np.linalg.inv(cov * scott**2), np.zeros((30, 20))
    for i, j in zip(*np.nonzero(grid), strict=True):
        for a in range(-reach[0], reach[0] + 1):
            for b in range(-reach[1], reach[1] + 1):
                if 0 <= i + a < 30 and 0 <= j + b < 20:
                    want[i + a, j + b] += grid[i, j] * np.exp(-0.5 * np.array([a, b]) @ inverse @ np.array([a, b]))
    want /= np.sqrt(np.linalg.det(2 * np.pi * cov * scott**2))
    if norm:
        want /= len(x) * np.ptp(x) / 30 * np.ptp(y) / 20
    assert np.allclose(got, want)
    if norm and not weights:
        assert abs(got.sum() * np.ptp(x) / 30 * np.ptp(y) / 20 - 1) < 0.1


def test_kde_of_nothing(spark):
    s, *_ = points(spark, 5)
    assert hist.kde(s.where(filters.HighPass("x", 99.0)), "x", "y").count() == 0


def gas(spark, n=400):
    rng = np.random.default_rng(6)
    rows = [(i, "gas", *map(float, rng.uniform(-5, 5, 3)), 1.0, 1.0, float(h)) for i, h in enumerate(rng.choice([0.1, 0.3, 1.0, 3.0], n))]
    return snapshot(spark.createDataFrame(rows, "pidx long, family string, x double, y double, z double, mass double, rho double, smooth double"))


@pytest.mark.parametrize("project", [False, True])
def test_levels_are_near_the_full_image(spark, project):
    s, n = gas(spark), 64
    full, near = np.zeros((n, n)), np.zeros((n, n))
    for to, frame in ((full, render.image(s, "rho", 10.0, n, project)), (near, render.approximate(s, "rho", 10.0, n, 3, 4, project=project))):
        for r in frame.collect():
            to[r[0], r[1]] = r[2]
    inner = slice(4, -4)
    error = np.abs(full - near)[inner, inner]
    assert error.mean() < 0.05 * full[inner, inner].mean() and error.max() < 0.5 * full.max()
    assert near[inner, inner].sum() == pytest.approx(full[inner, inner].sum(), rel=0.03)
    with pytest.raises(ValueError):
        render.approximate(s, "rho", 10.0, 60, 3, 8)


def test_levels_share_rows_and_bound_their_pixels(spark):
    s, n = gas(spark), 64
    step = 10.0 / n
    parts = [render.image(s, "rho", 10.0, n, smooth_range=r) for r in ((0.0, 4.0), (4.0, 16.0), (16.0, None))]
    whole = render.image(s, "rho", 10.0, n)
    summed = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("px", "py").agg(F.sum("value").alias("v"))
    assert whole.join(summed, ["px", "py"]).where("abs(value - v) > 1e-9").count() == 0
    assert whole.count() == summed.count()
    # one wide row touches at most the pixels of a kernel of `factor` pixels on its own level
    wide = s.where(F.col("pidx") == s.df.where("smooth = 3").first()["pidx"])
    assert render.image(wide, "rho", 10.0, n // 4, smooth_range=(1.0, 4.0)).count() == 0
    assert render.image(wide, "rho", 10.0, n // 16, smooth_range=(1.0, None)).count() <= 16
    assert 3.0 / step > 16


def test_zoom_is_bilinear(spark):
    img = spark.createDataFrame([(0, 0, 1.0), (1, 0, 3.0), (2, 1, 5.0)], "px int, py int, value double")
    got = np.zeros((12, 12))
    for r in render.zoomed(img, 3, 12).collect():
        got[r[0], r[1]] = r[2]
    coarse = np.zeros((5, 5))
    coarse[1, 1], coarse[2, 1], coarse[3, 2] = 1.0, 3.0, 5.0
    u = (np.arange(12) + 0.5) / 4 + 0.5
    k, t = np.floor(u).astype(int), u - np.floor(u)
    want = sum(coarse[np.ix_(k + a, k + b)] * np.outer(t if a else 1 - t, t if b else 1 - t) for a in (0, 1) for b in (0, 1))
    assert np.allclose(got, want)
