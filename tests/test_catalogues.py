"""Catalogues found beside a snapshot, and their numbers."""

import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery.sources import catalogues


@pytest.fixture(scope="module")
def s(spark):
    return sn.snapshot(spark.range(8).select(F.col("id").alias("pidx"), (F.col("id") + 10).alias("iord"), F.lit("dm").alias("family"), (F.col("id") % 2).alias("grp")))


def _sets(c):
    out = {}
    for h, r in c.members.select("halo", "pidx").collect():
        out.setdefault(h, set()).add(r)
    return out


def test_kinds(spark, s, tmp_path):
    path = str(tmp_path / "snap")
    assert _sets(catalogues.halos(s)) == {0: {0, 2, 4, 6}, 1: {1, 3, 5, 7}}
    assert _sets(catalogues.halos(s, path)) == _sets(catalogues.halos(s))
    for kind in ("ahf", "amiga", "hop", "tags"):
        with pytest.raises(OSError):
            catalogues.halos(s, path, kind)
    with pytest.raises(KeyError):
        catalogues.halos(s, path, "any")
    (tmp_path / "snap.grp").write_text("8\n-1\n3\n3\n-1\n5\n5\n5\n-1\n")
    assert _sets(catalogues.halos(s, path)) == {3: {1, 2}, 5: {4, 5, 6}}
    (tmp_path / "snap.amiga.grp").write_text("8\n0\n1\n1\n0\n2\n2\n2\n0\n")
    assert _sets(catalogues.halos(s, path)) == {1: {1, 2}, 2: {4, 5, 6}}
    (tmp_path / "snap.hop.grp").write_text("8\n-1\n0\n0\n0\n-1\n-1\n-1\n-1\n")
    assert _sets(catalogues.halos(s, path, "hop")) == {0: {1, 2, 3}}


def test_lists_and_numbers(spark, s, tmp_path):
    # two blocks, as of two writers; an id that no row has is left out
    (tmp_path / "snap.z0.AHF_particles").write_text("2\n2\n10 1\n11 1\n1\n12 1\n\n1\n3\n13 1\n14 1\n99 1\n")
    (tmp_path / "snap.z0.AHF_halos").write_text("#ID(1) hostHalo(2) npart(3)\n70 0 2\n71 70 1\n72 70 3\n")
    path = str(tmp_path / "snap")
    assert _sets(catalogues.halos(s, path)) == {70: {0, 1}, 71: {2}, 72: {3, 4}}
    assert dict(catalogues.halos(s, path).halos.select("halo", "parent").collect()) == {70: None, 71: 70, 72: 70}
    assert _sets(catalogues.halos(s, path, numbers="file-order")) == {0: {0, 1}, 1: {2}, 2: {3, 4}}
    assert _sets(catalogues.halos(s, path, numbers="v1")) == {1: {0, 1}, 2: {2}, 3: {3, 4}}
    assert _sets(catalogues.halos(s, path, numbers="length-order")) == {1: {0, 1}, 2: {2}, 0: {3, 4}}
    assert _sets(catalogues.halos(s, path, "ahf", numbers="length-order-v1")) == {2: {0, 1}, 3: {2}, 1: {3, 4}}
