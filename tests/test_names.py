"""Names of codes' tables, units from attributes, and columns that are the same in all views."""

import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery import units
from orrery.operators import sph
from orrery.sources import names


def test_tables_of_a_code(spark):
    gas = spark.createDataFrame([(3, [1.0, 2.0, 3.0], 5.0, [0.02, 0.25]), (1, [4.0, 5.0, 6.0], None, None)], "ParticleIDs long, Coordinates array<double>, Density double, Metallicity array<double>")
    star = spark.createDataFrame([(2, [7.0, 8.0, 9.0], 0.5)], "ParticleIDs long, Coordinates array<double>, StellarFormationTime double")
    s = names.from_tables(spark, {"PartType4": star, "PartType0": gas}, "gizmo", {"pos": "kpc"})
    got = [tuple(r) for r in s.df.orderBy("pidx").select("pidx", "family", "iord", "x", "rho", "metals", "He", "aform").collect()]
    assert got == [(0, "gas", 1, 4.0, None, None, None, None), (1, "gas", 3, 1.0, 5.0, 0.02, 0.25, None), (2, "star", 2, 7.0, None, None, None, 0.5)]
    assert s.family("gas").col("rho") is not None
    with pytest.raises(KeyError):
        s.col("rho")
    back = names.to_tables(s, "gizmo")
    assert set(back) == {"PartType0", "PartType1", "PartType4", "PartType5"} and "Density" in back["PartType0"].columns and "Density" not in back["PartType4"].columns
    again = names.from_tables(spark, {k: t for k, t in back.items() if k in ("PartType0", "PartType4")}, "gizmo")
    assert [tuple(r) for r in again.df.orderBy("pidx").select("iord", "x", "z").collect()] == [(1, 4.0, 6.0), (3, 1.0, 3.0), (2, 7.0, 9.0)]
    with pytest.raises(KeyError):
        names.from_tables(spark, {"PartType9": gas})
    with pytest.raises(ValueError):
        names.from_tables(spark, {})


def test_two_columns_of_one_name_and_empty_tables(spark):
    t = spark.createDataFrame([(1, 2.0, None), (2, None, 3.0), (3, None, None)], "ParticleIDs long, Masses double, SubgridMasses double")
    s = names.from_tables(spark, {"PartType5": t, "PartType0": t.where("false")}, "swift")
    assert [r[0] for r in s.df.orderBy("pidx").select("mass").collect()] == [2.0, 3.0, None]
    assert s.df.select("family").distinct().collect()[0][0] == "bh"


def test_units_of_attributes():
    system = {"length": "kpc", "mass": "Msol", "velocity": "km s^-1", "time": "Gyr", "temp": "K"}
    assert names.unit_of("rho", {"aexp-scale-exponent": -3, "h-scale-exponent": 2}, system) == "Msol kpc^-3 a^-3 h^2"
    assert names.unit_of("odd", {"aexp-scale-exponent": 1}, system) is None and names.unit_of("rho", {}, system) is None
    assert names.unit_of("any", {"length_scaling": -3.0, "mass_scaling": 1.0, "velocity_scaling": 0.0, "a_scaling": -3.0, "h_scaling": 2.0}, system) == "Msol kpc^-3 a^-3 h^2"
    assert names.unit_of("any", {"U_L exponent": 2.0, "U_t exponent": -2.0, "U_M exponent": 0.0, "a-scale exponent": 0.5}, system) == units.parse("kpc^2 Gyr^-2") * units.parse("a^1/2")


def test_units_like(spark):
    s = sn.snapshot(spark.range(2).select(F.col("id").alias("pidx"), F.lit(1.0).alias("q")), {"pos": "kpc a", "vel": "km s^-1", "mass": "1e10 Msol"})
    assert names.original_unit(s, "kg m^-3") == units.parse("1e10 Msol kpc^-3")
    assert names.with_unit_like(s, "q", "J").unit("q") == units.parse("1e10 Msol km^2 s^-2")


def test_stable_columns(spark):
    df = spark.range(60).select(F.col("id").alias("pidx"), F.when(F.col("id") % 2 == 0, "gas").otherwise("dm").alias("family"), (100 - F.col("id") % 10).alias("iord"), *[F.rand(k).alias(c) for k, c in enumerate(("x", "y", "z", "vx", "vy", "vz"))], F.lit(1.0).alias("mass"))
    s = sn.snapshot(df)
    view = sph.with_stable(s.family("gas"), "rho", "smooth", "v_disp", "v_curl_y", k=8)
    whole = dict(sph.density(s, 8).select("pidx", "rho").collect())
    curl = dict(sph.sph_sum(s, "curl", "vel", 8).select("pidx", "vel_curl_y").collect())
    got = view.df.collect()
    assert len(got) == 30 and all(r["rho"] == pytest.approx(whole[r["pidx"]]) and r["v_curl_y"] == pytest.approx(curl[r["pidx"]]) and r["v_disp"] >= 0 for r in got)
    with pytest.raises(KeyError):
        sph.with_stable(s, "nothing")
    order = [r[1] for r in sph.row_order_of_ids(s).orderBy("pidx").collect()]
    assert order == sorted(range(60), key=lambda i: (100 - i % 10, i))
