"""What larger tables brought to light."""

import numpy as np
import pyarrow as pa
import pytest

from orrery import snapshot as sn
from orrery.operators import gravity, groups, neighbours
from orrery.operators.neighbours import tree


def test_members_of_spans_are_not_broadcast(spark):
    # few short spans of many places: their size is estimated before places are made
    n = 5000
    s = sn.snapshot(spark.range(n).toDF("pidx"))
    spans = [(0, -3, 10), (1, 0, n), (2, 4090, 10), (3, 4999, 10**9), (4, 7, 0), (5, 10**7, 3)]
    members = groups.from_offsets(s, spark.createDataFrame(spans, "halo long, offset long, length long")).members
    got = sorted(map(tuple, members.collect()))
    assert got == sorted((h, p) for h, a, m in spans for p in range(max(a, 0), min(a + m, n)))
    assert "Broadcast" not in members._jdf.queryExecution().executedPlan().toString()


def potentials(p, q, m, e2):
    d = p[:, None] - q[None]
    r2 = (d * d).sum(2) + e2
    r2[r2 == 0] = np.inf
    return (m / np.sqrt(r2)).sum(1)


@pytest.mark.parametrize("e2", [0.0, 1e-8, 4.0])
def test_potentials_both_ways_are_as_from_differences(e2):
    rng = np.random.default_rng(4)
    # on a lattice with common places, a dense clump, far from the origin
    p = np.concatenate([rng.integers(-5, 5, (400, 3)) * 0.25, rng.normal(size=(300, 3)) * 1e-4, rng.uniform(-300, 300, (900, 3))]) + 1000.0
    p, m = p[tree(p, gravity.SQUARE).order], rng.uniform(1, 5, 1600)
    q = p[tree(p[:700], gravity.SQUARE).order]
    out, back = gravity._potentials(p.T, q.T, m, m[:700], e2)
    assert np.allclose(out, potentials(p, q, m[:700], e2), rtol=1e-11, atol=0)
    assert np.allclose(back, potentials(q, p, m, e2), rtol=1e-11, atol=0)


def test_gravity_of_all_reads_blocks_and_copies_no_rows(spark):
    rng = np.random.default_rng(5)
    n = 5000
    p, m = rng.uniform(-50, 50, (n, 3)).round(1), rng.uniform(1, 2, n)
    rows = [(i, *map(float, p[i]), float(m[i]) if i % 7 else None, 2.0 + (i % 2 if i < 2000 else 0)) for i in range(n)]
    df = spark.createDataFrame(rows, "pidx long, x double, y double, z double, mass double, eps double")
    w = np.where(np.arange(n) % 7, m, 0.0)
    # one softening, in a block of several pieces and in many blocks; then one for each row
    for s, eps, block, e2 in ((sn.snapshot(df), 2.0, n, 4.0), (sn.snapshot(df), 2.0, 400, 4.0), (sn.snapshot(df), None, 2000, np.array([r[5] ** 2 for r in rows]))):
        got = gravity.all_direct(s, eps, block, force=False)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" in plan and "explode" not in plan
        got = got.orderBy("pidx").toPandas()
        assert got["pidx"].tolist() == list(range(n))
        assert np.allclose(got["phi"], -potentials(p, p, w, e2), rtol=1e-12)


def test_gravity_of_few_rows_in_many_blocks(spark):
    kind = "pidx long, x double, y double, z double, mass double"
    assert gravity.all_direct(sn.snapshot(spark.createDataFrame([], kind)), 1.0).collect() == []
    # some blocks have no rows
    s = sn.snapshot(spark.createDataFrame([(i, float(i), 0.0, 0.0, 1.0) for i in range(20)], kind))
    got = [r["phi"] for r in gravity.all_direct(s, 0.0, 1, force=False).orderBy("pidx").collect()]
    assert np.allclose(got, [-sum(1 / abs(i - j) for j in range(20) if j != i) for i in range(20)])


def test_packed_points_are_the_same():
    rng = np.random.default_rng(6)
    many = np.arange(70_000)
    some = [rng.normal(size=(1000, 3)), rng.integers(0, 300, (1000, 3)) * 0.1, np.zeros((300, 3)), rng.normal(size=(1, 3)), np.array([[-0.0, 1e308, 5e-324], [np.pi, -1e308, 0.1]])]
    for p in [*some, np.stack([many // 2 * 0.01, many % 997 * 0.5, many % 101 * 5.0], axis=1), np.stack([np.arange(257.0)] * 3, axis=1).repeat(3, axis=0)]:
        assert (neighbours.unpacked(pa.py_buffer(neighbours.packed(p))) == p).all()


def test_points_are_dealt_in_few_bytes(spark):
    # as rows each point took 56 bytes before compression, in each block that it is dealt to
    rng = np.random.default_rng(7)
    n, box, r = 40_000, 500.0, 60.0
    p = np.stack([rng.exponential(50, n).round(2) - 245, np.arange(n) % 997 * 0.5 - 249, rng.integers(0, 101, n) * 5.0 - 250], axis=1)
    df = spark.createDataFrame([(*map(float, v),) for v in p], "x double, y double, z double")
    at = neighbours.cuts(df, 5000)
    own, got, size = at.block(p), [], 0
    for b in range(at.inner + 1):
        rows = p[own == b]
        batch = pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(own == b)), *map(pa.array, rows.T), pa.array(np.full(len(rows), b))], ["id", "x", "y", "z", "block"])
        for out in neighbours._with_reach(at, r, box)(iter([batch.slice(0, 100), batch.slice(100)])):
            size += sum(len(row["points"]) for row in out.to_pylist() if row["ids"] is None)
            got += [(row["block"], row["image"], row["ids"], neighbours.unpacked(pa.py_buffer(row["points"]))) for row in out.to_pylist()]
    ids = np.concatenate([np.frombuffer(x[2], np.int64) for x in got if x[2] is not None])
    assert sorted(ids.tolist()) == list(range(n)) and (np.concatenate([x[3] for x in got if x[2] is not None]) == p[ids]).all()
    dealt = [x for x in got if x[2] is None]
    # each block has the points that its balls reach
    moves = neighbours._images(box)
    for b in range(at.inner + 1):
        held = np.concatenate([x[3] + moves[x[1]] for x in dealt if x[0] == b])
        for q in p[own == b][::1000]:
            d = p - q
            d = np.where(d > box / 2, d - box, np.where(d < -box / 2, d + box, d))
            assert (((held - q) ** 2).sum(1) <= r * r).sum() == ((d * d).sum(1) <= r * r).sum()
    points = sum(len(x[3]) for x in dealt)
    assert points > 3 * n and size < 8 * points


def test_slabs_keep_columns_whole(spark):
    rng = np.random.default_rng(9)
    p = np.stack([rng.normal(size=3000), rng.integers(0, 30, 3000) * 1.0, rng.integers(0, 9, 3000) * 1.0], axis=1)
    for most in (1, 500, 1000, 5000):
        slabs = neighbours._slabs(p, most)
        assert sorted(np.concatenate(slabs).tolist()) == list(range(3000))
        held = [set(p[s, 2]) for s in slabs]
        assert sum(map(len, held)) == 9 and all(len(s) <= most or len(h) == 1 for s, h in zip(slabs, held, strict=True))
    q = p[::50]
    want = neighbours.column_counts(q, p, 0 * p, 1.5)
    assert sum(neighbours.column_counts(q, p[s], 0 * p[s], 1.5) for s in neighbours._slabs(p, 500)).tolist() == want.tolist()
