"""Round trips of the formats, catalogues from text, and the stream."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery import sources
from orrery.operators import filters
from orrery.sources import catalogues, parquet, tipsy
from orrery.streaming.profiles import windowed_profile


@pytest.fixture(scope="module")
def s(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(60, 7)).astype(np.float32).astype(float)
    fam = ["gas"] * 20 + ["dm"] * 30 + ["star"] * 10
    rows = [(i, 100 + i, fam[i], *map(float, v[i]), 1.0 if i < 20 else None, 2.0 if i < 20 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "pidx long, iord long, family string, x double, y double, z double, vx double, vy double, vz double, mass double, rho double, u double")
    return sn.snapshot(df, {"pos": "kpc a h^-1"}, {"a": 0.5, "h": 0.7, "boxsize": 10.0})


def _same(a, b, cols=("family", "x", "vz", "mass")):
    pick = lambda t: t.df.orderBy("pidx").select("pidx", *cols).collect()
    for p, q in zip(pick(a), pick(b), strict=True):
        assert p["pidx"] == q["pidx"] and p["family"] == q["family"]
        assert [p[c] for c in cols[1:]] == pytest.approx([q[c] for c in cols[1:]], rel=1e-6)


def test_parquet(spark, s, tmp_path):
    p = str(tmp_path / "snap")
    sources.write(s, p)
    t = sources.read(spark, p)
    _same(s, t)
    assert t.unit("pos") == s.unit("pos") and t.prop("boxsize") == 10
    plan = t.gas.df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(family" in plan or "family#" in plan.split("PartitionFilters")[1][:80]
    parquet.write_column(s, "r", p)
    assert parquet.read_column(t, "r", p).df.where("r is null").count() == 0
    with pytest.raises(Exception, match="exists"):
        parquet.write_column(s, "r", p)
    assert parquet.read_units("pos: kpc a\n# no\nmass: Msol")["pos"] == "kpc a"


@pytest.mark.parametrize("order", "<>")
def test_tipsy(spark, s, tmp_path, order, monkeypatch):
    p = str(tmp_path / "t.bin")
    tipsy.write(s, p, order)
    t = sources.read(spark, p)
    _same(s, t)
    assert t.prop("a") == 0.5
    with pytest.raises(KeyError):
        t.col("rho")
    assert t.gas.select("rho").first()[0] == 1.0
    with open(p + ".tag", "wb") as f:
        f.write(struct.pack(f"{order}i", 60) + np.arange(60, dtype=f"{order}f4").tobytes())
    with open(p + ".txtag", "w") as f:
        f.write("60\n" + "\n".join(map(str, range(60))))
    for name in ("tag", "txtag"):
        assert tipsy.read_column(spark, f"{p}.{name}", name, order).where(F.col("pidx") != F.col(name)).count() == 0


def test_gadget(spark, s, tmp_path):
    p = str(tmp_path / "g")
    sources.write(s, p, "gadget")
    t = sources.read(spark, p)
    _same(s, t)
    assert [r[0] for r in t.df.orderBy("pidx").select("iord").collect()] == list(range(100, 160))
    assert t.gas.select("u").first()[0] == 2.0 and t.prop("h") == 0.7
    with pytest.raises(KeyError):
        t.col("u")


def test_ascii(spark, tmp_path):
    p = tmp_path / "a.txt"
    p.write_text("x y z mass\n1 2 3 4\n\n5 6  7 8\n")
    t = sources.read(spark, str(p))
    assert [tuple(r) for r in t.df.orderBy("pidx").select("pidx", "x", "mass").collect()] == [(0, 1, 4), (1, 5, 8)]
    with pytest.raises(OSError):
        (tmp_path / "odd.dat").write_bytes(b"nothing at all that is known to any reader")
        sources.read(spark, str(tmp_path / "odd.dat"))


def test_catalogues(spark, s, tmp_path):
    (tmp_path / "m.txt").write_text("2\n3 7\n100 0\n101 0\n102 0\n1 8\n110 1\n")
    (tmp_path / "p.txt").write_text("#ID(1) hostHalo(2) Mvir(3)\n7 0 1e12\n8 7 1e10\n")
    c = catalogues.from_files(s, str(tmp_path / "m.txt"), str(tmp_path / "p.txt"))
    assert {r["halo"]: r["n"] for r in c.sizes().collect()} == {0: 3, 1: 1}
    assert {r["halo"]: r["children"] for r in c.children().collect()} == {0: [1], 1: []}
    (tmp_path / "t.grp").write_text("60\n" + "\n".join(str(i % 3 - 1) for i in range(60)))
    assert {r["halo"]: r["n"] for r in catalogues.tags(s, str(tmp_path / "t.grp")).sizes().collect()} == {0: 20, 1: 20}


def test_star_log(spark, s):
    log = spark.createDataFrame([(150, 1.0, 0), (150, 2.0, 1), (151, 5.0, 2)], "iord long, massform double, entry int")
    got = {r["iord"]: r["massform"] for r in tipsy.star_log(log, s.star).df.collect()}
    assert got[150] == 2.0 and got[151] == 5.0 and got[155] is None and len(got) == 10


def test_stream_equals_batch(spark, sf_dir):
    path = f"{sf_dir}/events.parquet"
    batch = spark.read.parquet(path)
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events*")
    edges = [0.0, 100.0, 200.0, 500.0]
    ask = lambda df: windowed_profile(df, F.col("value"), edges, values=["value"], window="1 day", late="3650 days")
    q = ask(stream).writeStream.format("memory").queryName("prof").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((str(r["start"]), r["bin"], r["n"], round(r["value"], 6)) for r in df.collect())
    assert key(spark.table("prof")) == key(ask(batch))


def test_scan_prunes_columns_and_pushes_filters(spark, sf_dir, tmp_path):
    from orrery.plans import views

    p = str(tmp_path / "e")
    sources.write(views.plain_events(spark, sf_dir), p)
    t = sources.read(spark, p)
    plan = t.where(filters.Sphere(50.0)).df.select("x", "mass")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,-50.0)" in plan and "temp" not in plan.split("ReadSchema")[1]
