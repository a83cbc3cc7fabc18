"""Stored snapshots: regions read what they touch, and give what a scan of all rows gives."""

import math
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.checkpoints import fresh_dir
from orrery.operators import filters, neighbours
from orrery.snapshot import snapshot
from orrery.sources import cells, spatial

COLS = "pidx long, family string, x double, y double, z double, mass double"


def rows(n=4000, seed=5):
    rng = np.random.default_rng(seed)
    xyz = np.concatenate([rng.normal(0, 3, (n // 2, 3)), rng.uniform(-50, 50, (n // 2, 3))])
    out = [(i, ["gas", "dm"][i % 2], *map(float, p), 1.0 + i % 3) for i, p in enumerate(xyz)]
    return [*out, (n, "gas", None, 0.0, 0.0, 1.0), (n + 1, "dm", 0.0, math.nan, 0.0, 1.0), (n + 2, "dm", math.inf, 0.0, 0.0, 1.0)]


REGIONS = {
    "sphere": filters.Sphere(4.0, (1.0, 2.0, 0.0)),
    "sphere_units": filters.Sphere("4000 pc", (20.0, 20.0, 20.0)),
    "cuboid": filters.Cuboid(-10.0, -5.0, 10.0, 30.0, 5.0, 20.0),
    "disc": filters.Disc(20.0, 2.0, (10.0, 0.0, 30.0)),
    "annulus": filters.Annulus(6.0, 30.0),
    "outside": ~filters.Sphere(30.0),
    "either": filters.Sphere(2.0, (40.0, 40.0, 40.0)) | filters.Cuboid(-50.0, -50.0, -50.0, -40.0, -40.0, -40.0),
    "both": filters.Sphere(9.0) & filters.FamilyFilter("gas") & filters.HighPass("x", 1.0),
    "edge": filters.Sphere(12.0, (49.0, -49.0, 48.0)),
    "corner": filters.Cuboid(40.0, 40.0, 40.0, 60.0, 60.0, 60.0),
    "nothing": filters.Sphere(0.5, (500.0, 0.0, 0.0)),
}


@pytest.fixture(scope="module", params=[False, True], ids=["open", "periodic"])
def store(spark, request):
    s = snapshot(spark.createDataFrame(rows(), COLS), {"pos": "kpc", "mass": "Msol"}, {"a": 1.0} | ({"boxsize": 100.0} if request.param else {}))
    at = fresh_dir(spark, "store")
    spatial.write(s, at, block_points=100)
    return s, spatial.open_store(spark, at)


@pytest.mark.parametrize("name", REGIONS)
def test_regions_equal_a_scan(store, name):
    s, kept = store
    region = REGIONS[name]
    got, want = kept.where(region).df, s.where(region).df
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_regions_read_few_files(store):
    s, kept = store
    total = kept.bounds.count()
    assert total >= 32 and kept.bounds.agg(F.sum("rows")).first()[0] == 4003
    for name, most in (("sphere", 0.5), ("sphere_units", 0.2), ("cuboid", 0.3), ("edge", 0.4), ("nothing", 0.1)):
        files = kept.where(REGIONS[name]).df.inputFiles()
        assert len(files) <= max(1, most * total), name
        assert len(files) == len(kept.files(REGIONS[name]))
    if "boxsize" not in s.properties:
        # what lies wholly within is left out, too
        assert len(kept.files(~filters.Sphere(30.0))) < total
        how = {r["how"]: r["files"] for r in kept.count_blocks(filters.Sphere(12.0)).collect()}
        assert how["covered"] > 0 and how["left out"] > 0


def test_bounds_are_those_of_the_files(store):
    _, kept = store
    read = kept.spark.read.parquet(f"{kept.path}/rows").where("__block >= 0")
    lo = read.groupBy(F.regexp_extract(F.input_file_name(), r"(__block=[^/]*/[^/]*)$", 1).alias("file")).agg(F.min("x").alias("a"), F.max("z").alias("b"))
    both = lo.join(kept.bounds, "file").where("a = lo_x and b = hi_z").count()
    assert both == lo.count() == kept.bounds.where("lo_x is not null").count()
    assert kept.bounds.where("lo_x is null").agg(F.sum("rows")).first()[0] == 3


def test_predicates_reach_the_files(store):
    s, kept = store
    plan = kept.where(filters.Sphere(4.0, (1.0, 2.0, 0.0))).df.select("pidx")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "Exchange" not in plan
    assert ("GreaterThan(x," in plan) == ("boxsize" not in s.properties)
    assert "mass" not in plan.partition("ReadSchema")[2].splitlines()[0]


def test_units_properties_and_columns_come_back(spark):
    s = snapshot(spark.createDataFrame(rows(200), COLS), {"pos": "kpc", "mass": "Msol"}, {"a": 0.5, "h": 0.7})
    at = fresh_dir(spark, "store")
    spatial.write(s, at, block_points=50, columns=["r"])
    back = spatial.open_store(spark, at).snapshot()
    assert back.unit("pos") == "kpc" and back.prop("a") == 0.5
    assert back.df.columns == ["pidx", "family", "x", "y", "z", "r"] and back.df.count() == 203


def test_rows_at_one_place_and_none(spark):
    same = [(i, "dm", 1.0, 1.0, 1.0, 1.0) for i in range(500)]
    for some, n in ((same, 500), ([], 0)):
        at = fresh_dir(spark, "store")
        spatial.write(snapshot(spark.createDataFrame(some, COLS)), at, block_points=10)
        kept = spatial.open_store(spark, at)
        assert kept.where(filters.Sphere(2.0)).df.count() == n
        assert kept.where(filters.Sphere(0.1)).df.count() == 0


def grid(spark, n=5000, side=5):
    """Rows in the order of the cells of a grid over a box of 100, and its table."""
    rng = np.random.default_rng(3)
    xyz = rng.uniform(-50, 50, (n, 3))
    cell = np.floor((xyz + 50) / (100 / side)).astype(int) @ [1, side, side * side]
    order = np.argsort(cell, kind="stable")
    xyz, cell = xyz[order], cell[order]
    df = spark.createDataFrame([(i, "dm", *map(float, p), int(c)) for i, (p, c) in enumerate(zip(xyz, cell, strict=True))], "pidx long, family string, x double, y double, z double, cell int")
    path = fresh_dir(spark, "cells")
    df.coalesce(1).sortWithinPartitions("pidx").write.option("parquet.block.size", 8192).option("parquet.page.row.count.limit", 50).option("parquet.page.size.row.check.min", 10).parquet(path)
    width = 100 / side
    centre = lambda k: (k % side + 0.5) * width - 50
    counts = [(int(c), float(centre(c)), float(centre(c // side)), float(centre(c // side // side)), int((cell == c).sum())) for c in np.unique(cell)]
    at = cells.table(spark.createDataFrame(counts, "cell int, x double, y double, z double, n long"), ["cell"])
    return path, at, width, xyz, cell


def numbers_read(df):
    """Rows that the scan gave."""
    df.write.format("noop").mode("overwrite").save()
    plan, out = df._jdf.queryExecution().executedPlan(), []
    df.collect()

    def walk(p):
        if p.nodeName().startswith("Scan") or "Scan" in p.nodeName():
            out.append(p.metrics().apply("numOutputRows").value())
        kids = p.children()
        for i in range(kids.size()):
            walk(kids.apply(i))

    walk(plan)
    return out


@pytest.mark.parametrize("most", [256, 3])
@pytest.mark.parametrize("box", [None, 100.0])
def test_regions_of_cells(spark, most, box):
    path, at, width, xyz, cell = grid(spark)
    s = snapshot(spark.read.parquet(path), None, {"boxsize": box} if box else {})
    for region, centre, r in ((filters.Sphere(8.0, (3.0, 1.0, -2.0)), (3.0, 1.0, -2.0), 8.0), (filters.Sphere(15.0, (48.0, 0.0, -49.0)), (48.0, 0.0, -49.0), 15.0)):
        got = cells.take_region(s, at, region, width, most)
        near = {c for c in np.unique(cell) if touches(c, centre, r, box)}
        assert sorted(x[0] for x in got.df.select("pidx").collect()) == np.flatnonzero(np.isin(cell, list(near))).tolist()
        assert sorted(x[0] for x in got.where(region).df.select("pidx").collect()) == sorted(x[0] for x in s.where(region).df.select("pidx").collect())
    some = at.where("cell in (0, 1, 7, 80, 124)")
    assert {x[0] for x in cells.take_cells(s, some, most).df.select("cell").distinct().collect()} == {0, 1, 7, 80, 124}
    assert cells.take_cells(s, at.where("cell < 0")).df.count() == 0


def touches(c, centre, r, box, side=5, width=20.0):
    lo = np.array([c % side, c // side % side, c // side // side]) * width - 50
    moves = [-box, 0, box] if box else [0]
    d = [min(max(a + m - v, v - (a + width + m), 0) for m in moves) for a, v in zip(lo, centre, strict=True)]
    return sum(x * x for x in d) <= r * r


def test_only_the_runs_of_a_region_are_read(spark):
    path, at, width, _, cell = grid(spark)
    s = snapshot(spark.read.parquet(path))
    got = cells.take_region(s, at, filters.Sphere(8.0, (3.0, 1.0, -2.0)), width).df.select("pidx", "x")
    want = got.count()
    (scanned,) = numbers_read(got)
    assert want <= scanned < want + 600 < len(cell)
    assert "PushedFilters: [Or(" in got._jdf.queryExecution().executedPlan().toString() or "PushedFilters: [" in got._jdf.queryExecution().executedPlan().toString()


def test_cells_that_follow_each_other_are_one_run(spark):
    at = spark.createDataFrame([(0, 5), (5, 5), (20, 1), (21, 0), (21, 4), (100, 2)], "first long, n long")
    assert sorted(map(tuple, cells.runs(at.where("n > 0")).collect())) == [(0, 10), (20, 25), (100, 102)]


@pytest.mark.parametrize("box", [None, 10.0])
def test_ball_counts_equal_all_pairs(spark, box):
    rng = np.random.default_rng(2)
    p = np.concatenate([rng.uniform(-5, 5, (400, 3)), rng.normal(4, 0.1, (200, 3)), np.full((100, 3), -4.9)]).clip(-5, 5).round(1)
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(999, None, 0.0, 0.0)], "pidx long, x double, y double, z double")
    s = snapshot(df, None, {"boxsize": box} if box else {})
    d = p[:, None] - p[None]
    if box:
        d = np.where(d > box / 2, d - box, np.where(d < -box / 2, d + box, d))
    for r in (0.75, 3.05, 6.05):
        want = ((d * d).sum(2) <= r * r).sum(1)
        got = {x[0]: x[1] for x in neighbours.ball_counts(s, r, 50).collect()}
        assert got == dict(enumerate(want.tolist()))


def test_many_points_at_one_place(spark):
    n = 100_000
    df = spark.range(n).select(F.col("id").alias("pidx"), *[F.lit(1.0).alias(c) for c in "xyz"])
    s = snapshot(df)
    began = time.time()
    got = neighbours.ball_counts(s, 0.5).agg(F.min("n"), F.max("n"), F.count("n")).first()
    assert tuple(got) == (n, n, n)
    assert time.time() - began < 60
    near = neighbours.knn(df, df, 4)
    assert near.agg(F.count("id" if "id" in near.columns else "pidx"), F.max("neighbour"), F.max("d2")).first()[:] == (4 * n, 3, 0.0)


def test_counts_within_equal_all_pairs():
    rng = np.random.default_rng(1)
    for n, m, r in ((1, 1, 0.1), (5, 300, 0.3), (1000, 700, 0.1), (300, 2000, 0.5), (65, 64, 2.0), (0, 5, 1.0), (5, 0, 1.0)):
        q, p = rng.random((n, 3)).round(2), rng.random((m, 3)).round(2)
        d = q[:, None] - p[None]
        want = (d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= r * r).sum(1)
        assert neighbours.counts_within(q, p, r).tolist() == want.tolist()
