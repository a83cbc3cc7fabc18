import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import neighbours
from orrery.operators.columns import column_counts
from orrery.snapshot import snapshot


def all_pairs(q, p, r, box=None):
    d = p[None] - q[:, None]
    if box:
        d = np.where(d > box / 2, d - box, np.where(d < -box / 2, d + box, d))
    return (d[..., 0] * d[..., 0] + d[..., 1] * d[..., 1] + d[..., 2] * d[..., 2] <= r * r).sum(1)


def images(p, box):
    moves = neighbours._images(box)
    return np.repeat(p, len(moves), axis=0), np.tile(moves, (len(p), 1))


@pytest.mark.parametrize("box", [None, 10.0])
@pytest.mark.parametrize("axis", [0, 1, 2])
def test_column_counts_equal_all_pairs(box, axis):
    rng = np.random.default_rng(3)
    for digits in (0, 1, 9):
        q = rng.uniform(-5, 5, (200, 3)).round(digits)
        q[:, axis] = rng.uniform(-5, 5, 200).round(2)
        p = np.concatenate([q, q[:50], rng.uniform(-5, 5, (300, 3)).round(digits)])
        for r in (0.5, 1.0, 3.0, 4.99):
            assert column_counts(q, *images(p, box), r).tolist() == all_pairs(q, p, r, box).tolist()
    assert column_counts(q, *images(p, box), 1.0, full=2.0) is None
    assert column_counts(q[:0], p, 0 * p, 1.0).tolist() == [] and column_counts(q, p[:0], p[:0], 1.0).tolist() == [0] * 200


def test_ends_of_a_ball_across_a_box_are_as_in_sql():
    # differences first, then the box: moved points would differ in the last digit
    x = np.concatenate([-245 + np.arange(0, 60, 0.01).round(2), -245 + np.arange(435, 495, 0.01).round(2)])
    p = np.stack([x, np.zeros(len(x)), np.zeros(len(x))], axis=1)
    q = p[::7]
    want = all_pairs(q, p, 60.0, 500.0)
    at, move = images(p, 500.0)
    assert column_counts(q, at, move, 60.0).tolist() == want.tolist()
    assert neighbours.counts_within(q, at, 60.0, move).tolist() == want.tolist()


def test_periodic_counts_are_as_in_sql(spark):
    x = np.concatenate([-245 + np.arange(0, 60, 0.05).round(2), -245 + np.arange(435, 495, 0.05).round(2)])
    df = spark.createDataFrame([(i, float(v), 0.0, 0.0) for i, v in enumerate(x)], "pidx long, x double, y double, z double")
    p = np.stack([x, 0 * x, 0 * x], axis=1)
    got = dict(map(tuple, neighbours.ball_counts(snapshot(df, None, {"boxsize": 500.0}), 60.0, 100).collect()))
    assert got == dict(enumerate(all_pairs(p, p, 60.0, 500.0).tolist()))


def test_full_columns_cost_no_more_than_their_look_ups(spark):
    # 100 columns of 4000 points: 1.6e11 pairs, of which a ball holds a third
    n, r = 400_000, 60.0
    df = spark.range(n).select(
        F.col("id").alias("pidx"), ((F.col("id") / 100).cast("long") * F.lit(0.1)).alias("x"), (F.col("id") % 10 * 5.0).alias("y"), ((F.col("id") / 10).cast("long") % 10 * 5.0).alias("z")
    )
    began = time.time()
    got = {k: v for k, v in map(tuple, neighbours.ball_counts(snapshot(df), r).where("pidx % 4001 = 0").collect())}
    assert time.time() - began < 60
    xyz = df.orderBy("pidx").select("x", "y", "z").toPandas().to_numpy(float)
    some = np.arange(0, n, 4001)
    assert got == {int(k): int(all_pairs(xyz[k : k + 1], xyz, r)[0]) for k in some}
