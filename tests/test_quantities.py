"""Columns with units, numbers of groups and runs of ids against NumPy and by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery import units
from orrery.functions import quantity as qt
from orrery.operators import groups, hist, structure


@pytest.fixture(scope="module")
def s(spark):
    rng = np.random.default_rng(5)
    rows = [(i, 100 - i, ["gas", "dm"][i % 2], *map(float, rng.normal(size=6)), float(i % 7 + 1), float(10.0 ** (i % 3)), 100.0 * (i + 1)) for i in range(40)]
    df = spark.createDataFrame(rows, "pidx long, iord long, family string, x double, y double, z double, vx double, vy double, vz double, mass double, rho double, temp double")
    return sn.snapshot(df.repartition(3), {"pos": "kpc a", "vel": "km s^-1", "mass": "Msol", "rho": "Msol kpc^-3", "temp": "K"}, {"a": 0.5, "h": 0.7})


def _values(s, q):
    return np.array([r[0] for r in s.df.orderBy("pidx").select(q.column).collect()], float)


def test_units_of_expressions(s):
    x, v, m = qt.quantity(s, "x"), qt.quantity(s, "vx"), qt.quantity(s, "mass")
    plain = _values(s, x)
    assert (m * v**2).unit == "Msol km^2 s^-2" and (m / v).unit == "Msol km^-1 s" and (1 / v).unit == "km^-1 s"
    assert (2 * x).unit == x.unit and (-x).unit == x.unit and abs(x).unit == x.unit
    # a kpc is two comoving ones at a = 1/2
    assert np.allclose(_values(s, x + units.unit("kpc")), plain + 2)
    assert np.allclose(_values(s, "1 kpc" - x), 1 - plain / 2)
    assert np.allclose(_values(s, x.in_units("kpc")), plain / 2) and np.allclose(_values(s, x.in_units("kpc", a=0.25)), plain / 4)
    assert qt.apply("sqrt", m).unit ** 2 == "Msol" and qt.apply("square", m).unit == "Msol^2" and qt.apply("sin", x).unit.dimensionless
    assert x.var().unit == x.unit**2 and x.std().unit == x.unit and x.with_unit("s").unit == "s"
    for wrong in (lambda: x + v, lambda: x < v, lambda: x.in_units("s"), lambda: qt.Quantity(F.lit(1.0)) < x, lambda: qt.Quantity(F.lit(1.0)).in_units("m"), lambda: qt.apply("sec", x)):
        with pytest.raises(units.UnitsError):
            wrong()
    assert s.where(x > "0.5 kpc").df.count() == (plain > 1).sum()
    got = s.df.agg(x.sum().column, x.ptp().column, x.var().column).first()
    assert np.allclose(got, [plain.sum(), np.ptp(plain), plain.var()])
    assert np.allclose(_values(s, qt.norm(qt.vector(s, "vel"))), np.sqrt(sum(_values(s, p) ** 2 for p in qt.vector(s, "vel"))))
    assert qt.with_quantity(s, "p", m * v).unit("p") == "Msol km s^-1"


def test_no_context_between_snapshots(s):
    other = sn.snapshot(s.df, {"pos": "kpc"}, {"a": 0.25})
    with pytest.raises(units.UnitsError):
        qt.quantity(s, "x") + qt.quantity(other, "x")
    # a view shares its snapshot's context
    qt.quantity(s, "x") + qt.quantity(s.family("gas"), "x").in_units("kpc")


def test_arguments_in_units(s):
    @qt.takes_arg_in_units("s", r="kpc")
    def f(s, r):
        return r

    assert f(s, "1 Mpc") == pytest.approx(1000) and f(s, r=3.0) == 3.0 and f(s, "4 kpc a") == pytest.approx(2)


def test_along_rows(s):
    x = _values(s, qt.quantity(s, "x"))
    got = qt.cumsum(qt.quantity(s, "x")).orderBy("pidx").toPandas()
    assert np.allclose(got["cumsum"], np.cumsum(x))
    got, unit = qt.gradient(qt.quantity(s, "x"), qt.Quantity(F.lit(0.5), units.unit("s")))
    assert np.allclose(got.orderBy("pidx").toPandas()["gradient"], np.gradient(x, 0.5)) and unit == units.unit("kpc a") / "s"
    assert np.allclose(qt.difference(s, "x").orderBy("pidx").toPandas()["diff"], np.diff(x))
    assert [qt.is_sorted(s, c) for c in ("temp", "iord", "mass")] == [1, -1, 0]
    empty = s.where(F.lit(False))
    assert qt.is_sorted(empty, "x") == 1 and qt.cumsum(qt.quantity(empty, "x")).count() == 0 and qt.gradient(qt.quantity(empty, "x"))[0].count() == 0


def test_unit_texts():
    u = units.parse("km s^-1")
    assert u.dimensionality() == "length time**-1" and units.is_unit_like("kpc a") and not units.is_unit_like("parsnip")
    assert units.parse("2 m^2 s^-1").latex() == r"2\,\mathrm{m}^{2}\,\mathrm{s}^{-1}" and units.parse("km").latex() == r"10^{3}\,\mathrm{m}"
    assert units.parse("km m^-1").dimensionless_constant() == pytest.approx(1000)


def test_temperature(spark):
    gas = spark.createDataFrame([(0, "gas", u) for u in (1.0, 100.0, 115.0, 140.0, 1000.0)], "pidx long, family string, u double")
    s = sn.snapshot(gas)
    got = [r[0] for r in s.df.orderBy("u").select(s.col("temp")).collect()]
    k = (units.M_P / units.K_B).ratio("K km^-2 s^2") * 2 / 3
    want = []
    for u in (1.0, 100.0, 115.0, 140.0, 1000.0):
        mu = 1.0
        for _ in range(5):
            t = u * k * mu
            mu = 4 / (8 - 5 * 0.245) if t >= 1e4 else 4 / (4 - 3 * 0.245)
        want.append(t)
    assert np.allclose(got, want, rtol=1e-6)
    ions = sn.snapshot(gas.selectExpr("*", "0.2D HI", "0.5D HII", "0.1D HeI", "0.02D HeII", "0.03D HeIII"))
    t = ions.df.where("u = 1").select(ions.col("temp")).first()[0]
    assert t == pytest.approx(k / (0.2 + 1.0 + 0.1 + 0.04 + 0.09), rel=1e-6)


def test_times_of_formation(spark):
    s = sn.snapshot(spark.createDataFrame([(0, "star", 0.5), (1, "star", 1.0), (2, "star", None), (3, "star", 0.0)], "pidx long, family string, aform double"))
    got = [r[0] for r in s.df.orderBy("pidx").select(s.col("tform")).collect()]
    from orrery.functions.cosmology import Cosmology

    c = Cosmology.of(s)
    assert got[:2] == pytest.approx([c.age(1.0), c.age(0.0)], rel=1e-4) and got[2:] == [None, None]


def test_phases(spark):
    two = spark.createDataFrame([(0, "gas", 2.0, 10.0, 5.0, 100.0, 50.0, 1.0), (1, "gas", 2.0, 10.0, 5.0, 100.0, 0.0, 0.0), (2, "dm", 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)], "pidx long, family string, mass double, rho double, u double, temp double, uHot double, MassHot double")
    s = sn.snapshot(two)
    # the second row's hot phase has no density
    assert hist.density_temperature(s, nx=4, ny=4).agg(F.sum("h")).first()[0] == 3
    merged = sn.snapshot(two.withColumn("Tinc", F.col("temp") * (F.col("pidx") + 1)).withColumn("rho", F.col("rho") + F.col("pidx")))
    assert hist.density_temperature(merged, phases="merge", nx=4, ny=4).agg(F.sum("h")).first()[0] == 2
    with pytest.raises(ValueError):
        hist.density_temperature(s, phases="both")


def test_circular_j_by_curve(spark):
    rng = np.random.default_rng(2)
    r, phi = rng.uniform(1, 10, 400), rng.uniform(0, 2 * np.pi, 400)
    rows = [(i, float(a * np.cos(b)), float(a * np.sin(b)), 0.0, 0.0, 0.0, 0.0, 1.0) for i, (a, b) in enumerate(zip(r, phi))]
    s = sn.snapshot(spark.createDataFrame(rows, "pidx long, x double, y double, z double, vx double, vy double, vz double, mass double").withColumn("eps", F.lit(0.5)))
    got = structure.circular_j_by_curve(s, 20.0, 1.0, 100).orderBy("pidx").toPandas()["j_circ"].to_numpy()
    assert len(got) == 400 and (got > 0).all() and got[np.argmax(r)] >= got[np.argmin(r)]


@pytest.fixture(scope="module")
def found(spark, s):
    halos = spark.createDataFrame([(0, 7, 3, -1), (1, 9, 5, 7), (2, 4, 5, 9), (3, 8, 1, 99)], "halo long, ID long, n long, up long")
    members = spark.createDataFrame([(h, 10 * h + i) for h, n in enumerate((3, 5, 5, 1)) for i in range(n)], "halo long, pidx long")
    return groups.Catalogue(s, members, halos)


def test_numbers_of_groups(spark, found):
    want = {"file-order": [0, 1, 2, 3], "v1": [1, 2, 3, 4], "length-order": [2, 0, 1, 3], "length-order-v1": [3, 1, 2, 4], "own": [7, 9, 4, 8]}
    for how, numbers in want.items():
        got = dict(groups.numbering(found.halos, how).collect())
        assert [got[i] for i in range(4)] == numbers
    with pytest.raises(ValueError):
        groups.numbering(found.halos, "any")
    own = groups.numbering(found.halos, "own")
    assert {tuple(r) for r in groups.places(own, spark.createDataFrame([(9,), (4,), (9,)], "n long")).collect()} == {(9, 1), (4, 2)}
    with pytest.raises(KeyError):
        groups.places(own, spark.createDataFrame([(9,), (5,)], "n long"))
    with pytest.raises(ValueError):
        groups.renumbered(found, found.halos.select("halo", F.lit(1).alias("number")))


def test_parents(found):
    c = groups.with_parents(found, "ID", "up")
    assert dict(c.halos.select("halo", "parent").collect()) == {0: None, 1: 0, 2: 1, 3: None}
    r = groups.renumbered(c, groups.numbering(c.halos, "own"))
    assert dict(r.halos.select("halo", "parent").collect()) == {7: None, 9: 7, 4: 9, 8: None}
    assert sorted(x[0] for x in r.members.where("halo = 4").select("pidx").collect()) == [20, 21, 22, 23, 24]
    assert {k: v for k, v in r.children().collect()} == {7: [9], 9: [4], 4: [], 8: []}


def test_hosts(spark, s, found):
    subs = groups.Catalogue(s, spark.createDataFrame([(0, 1), (1, 11), (2, 12)], "halo long, pidx long"), spark.createDataFrame([(0, 0), (1, 1), (2, None), (3, -1)], "halo long, HostHaloId long"))
    c = groups.hosted(subs, found)
    kids = {r["from"]: (r["halo"], r["parent"]) for r in c.halos.where("halo > 3").collect()}
    assert kids == {0: (4, 0), 1: (5, 1), 2: (6, None), 3: (7, None)}
    assert c.members.count() == 17 and [r[0] for r in c.subhalos(1).halos.select("from").collect()] == [1]
    with pytest.raises(ValueError):
        groups.hosted(groups.Catalogue(s, subs.members, subs.halos.withColumn("HostHaloId", F.lit(50))), found)


def test_runs_of_ids(spark, s):
    ids = [100 - i for i in (5, 6, 7, 0, 1)] + [5000]
    bound = spark.createDataFrame(list(enumerate(ids)), "at long, id long")
    halos = groups.run_lengths(spark.createDataFrame([(0, 0, 0), (1, 3, 1)], "halo long, offset long, offset_unbound long"), 6)
    halos = groups.run_lengths(halos, 2, "offset_unbound", "length_unbound")
    c = groups.from_id_runs(s, halos, bound)
    assert {tuple(r) for r in c.members.collect()} == {(0, 5), (0, 6), (0, 7), (1, 0), (1, 1)}
    unbound = spark.createDataFrame([(0, 80), (1, 100)], "at long, id long")
    more = groups.from_id_runs(s, halos, bound, unbound)
    assert {tuple(r) for r in more.members.collect()} == {(0, 5), (0, 6), (0, 7), (0, 20), (1, 0), (1, 1)}


def test_ranks_of_many_rows(spark):
    # more rows than a range partitioner samples; the extra column and the struct key are used twice
    df = spark.range(6000).select((F.col("id") * 7919 % 6000).alias("k"), F.rand(1).alias("v")).repartition(5)
    got = sn.numbered(df, "k", "at", 8).toPandas()
    assert sorted(got["at"]) == list(range(6000)) and (got["k"] == got["at"]).all()
    keyed = df.withColumn("s", F.struct((-F.col("k")).alias("a"), F.lit("x").alias("b")))
    got = sn.numbered(keyed, "s", "at").select("k", "at").toPandas()
    assert (got["at"] == 5999 - got["k"]).all()
