"""Files written by many tasks: what comes back, what a failed job leaves."""

import inspect
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import sources
from orrery.snapshot import snapshot
from orrery.sources import gadget, placed_writer, tipsy

N = 1000


@pytest.fixture(scope="module")
def s(spark):
    rng = np.random.default_rng(3)
    fam = ["gas", "dm", "star"]
    rows = [(7 * i, fam[i % 3], 10_000 + i, *map(float, rng.random(6)), float(i), None if i % 50 == 0 else 1.0, 2.0, 0.5) for i in range(N)]
    df = spark.createDataFrame(rows, "pidx long, family string, iord long, x double, y double, z double, vx double, vy double, vz double, mass double, rho double, temp double, eps double").repartition(5, "mass")
    return snapshot(df, {"pos": "kpc"}, {"a": 0.5, "h": 0.7, "boxsize": 1.0})


def by_family(s, *cols):
    order = {"gas": 0, "dm": 1, "star": 2}
    return [tuple(r) for _, _, *r in sorted((order[r["family"]], r["pidx"], *[r[c] for c in cols]) for r in s.df.select("family", "pidx", *cols).collect())]


@pytest.mark.parametrize("rows", [37, 500_000])
def test_many_tasks_write_one_file(spark, s, tmp_path, monkeypatch, rows):
    monkeypatch.setattr(placed_writer, "ROWS", rows)
    for form, module in (("tipsy", tipsy), ("gadget", gadget)):
        at = str(tmp_path / form)
        sources.write(s, at, form)
        back = sources.read(spark, at)
        assert back.df.count() == N
        got = by_family(back, "mass", "x", "vz")
        assert np.allclose(got, by_family(s, "mass", "x", "vz"), rtol=1e-6)
        assert os.listdir(tmp_path).count(form) == 1 and not [f for f in os.listdir(tmp_path) if f.endswith(".part")]
    assert [r[0] for r in by_family(sources.read(spark, str(tmp_path / "gadget")), "iord")] == [r[0] for r in by_family(s, "iord")]
    # no value is 0 in the file
    assert sources.read(spark, str(tmp_path / "tipsy")).gas.df.where("rho = 0").count() == s.gas.df.where("rho is null").count()


def test_a_column_of_a_file_is_replaced(spark, s, tmp_path, monkeypatch):
    monkeypatch.setattr(placed_writer, "ROWS", 90)
    at = str(tmp_path / "t")
    tipsy.write(s, at)
    before = sources.read(spark, at)
    kept = by_family(before, "x", "vy", "eps")
    changed = before.with_column("mass", F.col("mass") * 2 + 1)
    tipsy.update(changed, at, "mass")
    after = sources.read(spark, at)
    assert by_family(after, "x", "vy", "eps") == kept
    assert np.allclose(by_family(after, "mass"), np.array(by_family(s, "mass")) * 2 + 1)
    with pytest.raises(ValueError):
        tipsy.update(s.gas, at, "mass")
    with pytest.raises(ValueError):
        tipsy.write(s.with_column("family", F.lit("bh")), at)


def test_a_column_beside_a_file(spark, s, tmp_path, monkeypatch):
    monkeypatch.setattr(placed_writer, "ROWS", 90)
    at = str(tmp_path / "t")
    tipsy.write(s, at)
    tipsy.write_column(s, "mass", at)
    got = tipsy.read_column(spark, f"{at}.mass", "mass").orderBy("pidx").collect()
    assert [(r[1],) for r in got] == by_family(s, "mass") and [r[0] for r in got] == list(range(N))


def test_what_fails_leaves_the_file_as_it_was(spark, s, tmp_path):
    at = str(tmp_path / "t")
    tipsy.write(s, at)
    with open(at, "rb") as f:
        raw = f.read()
    broken = s.with_column("mass", F.when(F.col("mass") == 500.0, F.raise_error(F.lit("lost"))).otherwise(F.col("mass")))
    with pytest.raises(Exception, match="lost"):
        tipsy.write(broken, at)
    rows = placed_writer.placed(s, ["mass"])
    with pytest.raises(OSError, match="of 1001"):
        placed_writer.write(rows, at, 10, [], [], N + 1)
    with open(at, "rb") as f:
        assert f.read() == raw
    assert os.listdir(tmp_path) == ["t"]


def test_tasks_write_the_same_twice(spark, s, tmp_path):
    at = str(tmp_path / "t")
    tipsy.write(s, at)
    with open(at, "rb") as f:
        raw = f.read()
    # the tasks of a job run again on the finished file
    sizes = {r["family"]: r["n"] for r in s.families().collect()}
    begin, _ = tipsy._places(sizes, ">")
    layouts = [placed_writer.Layout(f, begin[f], tipsy.record(f, ">").descr) for f in tipsy.FIELDS]
    rows = placed_writer.placed(s, [c for c in tipsy.COLUMNS if c in s.df.columns]).where("place % 3 < 2").sortWithinPartitions("family", "place")
    assert rows.mapInArrow(placed_writer._task(at, layouts), "n long").agg(F.sum("n")).first()[0] > 0
    with open(at, "rb") as f:
        assert f.read() == raw


def test_no_rows_come_to_the_driver():
    for module in (tipsy, gadget, placed_writer):
        text = inspect.getsource(module)
        assert "toLocalIterator" not in text and "toPandas" not in text
