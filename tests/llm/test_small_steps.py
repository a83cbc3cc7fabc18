"""Steps of near-duplicate classes that take many partitions: how many jobs and tables."""

import contextlib

import numpy as np
import pytest

from orrery.llm import bagminhash, components, textkit
from orrery.llm.urlfilter import build_filter


@contextlib.contextmanager
def partitions(spark, n):
    """As many partitions after each shuffle, none put together."""
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_small_filter_takes_no_job_a_partition(spark):
    sc = spark.sparkContext
    with partitions(spark, 24):
        sc.setJobGroup("filter", "filter")
        made = build_filter(spark.range(500).selectExpr("xxhash64(id) AS h"), "h", 1 << 20)
        jobs = len(sc.statusTracker().getJobIdsForGroup("filter"))
        sc.setLocalProperty("spark.jobGroup.id", None)
    hashes = [r.h for r in spark.range(500).selectExpr("xxhash64(id) AS h").collect()]
    assert made.may_have(np.array(hashes, np.int64)).all()
    assert jobs < 12


@pytest.mark.parametrize(
    ("edges", "want", "most"),
    [
        # stars as they are, links twice and in both directions
        ([(k, 1) for k in range(2, 9)] + [(1, 4), (5, 1)] + [(21, 20)], {1: {*range(1, 9)}, 20: {20, 21}}, 2),
        # one hub that isn't its star's least node
        ([(9, k) for k in range(2, 9)], {2: {*range(2, 10)}}, 6),
        ([], {}, 2),
        ([(3, 3), (None, 3), (4, None)], {}, 2),
    ],
)
def test_stars_are_known_without_a_round(spark, monkeypatch, edges, want, most):
    made = []
    in_scratch = textkit.Scratch.stored
    monkeypatch.setattr(components, "stored", lambda df, what: made.append(what) or textkit.stored(df, what))
    monkeypatch.setattr(textkit.Scratch, "stored", lambda self, df, what: made.append(what) or in_scratch(self, df, what))
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {n: root for root, nodes in want.items() for n in nodes}
    assert len(made) <= most


def test_agreement_is_that_of_all_slots(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(0, 1 << 16, bagminhash.SLOTS).astype(np.uint16)
    sigs = {0: a}
    for k in (1, 47, 48, 125):
        b = a.copy()
        b[rng.choice(bagminhash.SLOTS, k, replace=False)] ^= np.uint16(0x0100)
        sigs[k] = b
    signed = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in sigs.items()], "node long, sig binary")
    pairs = spark.createDataFrame([(k, 0) for k in (1, 47, 48, 125)], "a long, b long")
    # 78 of 125 slots are 0.624, 77 are 0.616
    got = bagminhash._estimated(pairs, signed, bagminhash.least_agreement(0.8))
    assert {tuple(r) for r in got.collect()} == {(1, 0), (47, 0)}
