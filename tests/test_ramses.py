"""Octree outputs: leaf cells and particles equal a brute-force octree, in any domain and
dimension."""

import numpy as np
import pytest

from orrery import sources
from orrery.sources import ramses
from orrery.sources.records import Records


def record(f, values, dtype="i4", order="<"):
    raw = np.asarray(values, f"{order}{dtype}").tobytes()
    f.write(np.array([len(raw)], f"{order}i4").tobytes() + raw + np.array([len(raw)], f"{order}i4").tobytes())


def octree(rng, ndim, depth):
    """Octs by level: middle, domain, whether each cell is refined and the cells' values."""
    levels, todo = [], [np.full(ndim, 0.5)]
    for level in range(depth):
        octs, below = [], []
        for middle in todo:
            refined = (rng.random(1 << ndim) < 0.5) & (level + 1 < depth)
            octs.append({"middle": middle, "cpu": int(rng.integers(1, 4)), "refined": refined, "values": rng.random((1 << ndim, 6)), "phi": rng.random((1 << ndim, 4))})
            for k in np.flatnonzero(refined):
                sub = np.array([k >> d & 1 for d in range(ndim)]) - 0.5
                below.append(middle + 0.5 ** (level + 1) * sub)
        levels.append(octs)
        todo = below
    return levels


def write_output(path, rng, levels, ndim, ncpu=3, bounds=0, boxlen=2.0, order="<", explicit=False, cosmo=True, gravity=True):
    path.mkdir(parents=True)
    depth, nc = len(levels), 1 << ndim
    step = path.name[-5:]
    info = {"ncpu": ncpu, "ndim": ndim, "boxlen": boxlen, "time": 3.0, "aexp": 0.5, "H0": 70.0, "omega_m": 0.3, "omega_l": 0.7, "unit_l": 3e21, "unit_d": 1e-24, "unit_t": 3e15}
    text = "".join(f"{k:12s}= {v!r}\n" for k, v in info.items()) + "\nordering type=hilbert\n"
    (path / f"info_{step}.txt").write_text(text if cosmo else text.replace("70.0", "1.0").replace("aexp        = 0.5", "aexp        = 1.0"))
    told = []
    rec = lambda f, v, t="i4": record(f, v, t, order)
    for cpu in range(1, ncpu + 1):
        # files hold other domains' octs, too, which aren't the domain's own
        here = [[[o for o in octs if o["cpu"] == k and (k == cpu or rng.random() < 0.6)] for k in range(1, ncpu + 1)] for octs in levels]
        ghosts = [[octs[:1] for _ in range(bounds)] for octs in levels]
        with open(path / f"amr_{step}.out{cpu:05d}", "wb") as f:
            for v in (ncpu, ndim):
                rec(f, [v])
            rec(f, [1, 1, 1])
            for v in (depth, 100, bounds, 10):
                rec(f, [v])
            rec(f, [boxlen], "f8")
            for _ in range(13):
                rec(f, [0])
            rec(f, [[len(x) for x in lv] for lv in here])
            rec(f, [0])
            if bounds:
                rec(f, [0])
                rec(f, [0])
                rec(f, [[len(x) for x in lv] for lv in ghosts])
            for _ in range(2 + 1 + 3):
                rec(f, [0])
            for lv, out in zip(here, ghosts, strict=True):
                for octs in [*lv, *out]:
                    if octs:
                        n = len(octs)
                        for _ in range(3):
                            rec(f, [0] * n)
                        for d in range(ndim):
                            rec(f, [o["middle"][d] for o in octs], "f8")
                        for _ in range(1 + 2 * ndim):
                            rec(f, [0] * n)
                        for k in range(nc):
                            rec(f, [9 if o["refined"][k] else 0 for o in octs])
                        for _ in range(2 * nc):
                            rec(f, [0] * n)
        for kind, key, nvar in (("hydro", "values", 6), *((("grav", "phi", 4),) if gravity else ())):
            with open(path / f"{kind}_{step}.out{cpu:05d}", "wb") as f:
                for v in (ncpu, nvar, ndim, depth, bounds) if kind == "hydro" else (ncpu, ndim, depth, bounds):
                    rec(f, [v])
                if kind == "hydro":
                    rec(f, [1.4], "f8")
                for level, (lv, out) in enumerate(zip(here, ghosts, strict=True)):
                    for octs in [*lv, *out]:
                        rec(f, [level + 1])
                        rec(f, [len(octs)])
                        if octs:
                            for k in range(nc):
                                for v in range(nvar):
                                    rec(f, [o[key][k, v] for o in octs], "f8")
        n = int(rng.integers(0, 40)) if cpu > 1 else 40
        cols = {name: (rng.integers(1, 1000, n) if kind == "i4" else rng.random(n)) for name, kind in ramses.PARTICLES}
        cols["tform"] = np.where(rng.random(n) < 0.5, 0.0, cols["tform"])
        kinds = [*ramses.PARTICLES, *([("family", "i1"), ("tag", "i1")] if explicit else [])]
        family = rng.choice([1, 2, 3, 0, -1, 9, -9], n) if explicit else None
        cols |= {"family": family, "tag": np.zeros(n)} if explicit else {}
        with open(path / f"part_{step}.out{cpu:05d}", "wb") as f:
            for v in (ncpu, ndim, n):
                rec(f, [v])
            rec(f, [1, 2, 3, 4])
            rec(f, [0])
            rec(f, [0.0], "f8")
            rec(f, [0.0], "f8")
            rec(f, [0])
            for name, kind in kinds:
                rec(f, cols[name], kind)
        pick = {1: "dm", 2: "star", 3: "cloud", 9: "debris", 0: "gas_tracer", -1: "dm_tracer", -9: "debris_tracer"}
        told += [(cpu, pick[int(family[i])] if explicit else "star" if cols["tform"][i] else "dm", {k: cols[k][i] for k in cols}) for i in range(n)]
    if explicit:
        back = {"i4": "i", "f8": "d", "i1": "b"}
        (path / "part_file_descriptor.txt").write_text("# version:  1\n# ivar, variable_name, variable_type\n" + "".join(f"{i}, {name}, {back[kind]}\n" for i, (name, kind) in enumerate(kinds, 1)))
    return told


def leaves(levels, ndim, boxlen, last):
    """Brute force: place, width, level, domain and values of all leaf cells."""
    out = []
    for level, octs in enumerate(levels[:last]):
        for o in octs:
            for k in range(1 << ndim):
                if not o["refined"][k] or level + 1 == last:
                    width = boxlen * 0.5 ** (level + 1)
                    sub = [(k >> d & 1) - 0.5 for d in range(ndim)]
                    place = [boxlen * m + width * s for m, s in zip(o["middle"], sub, strict=True)] + [0.0] * (3 - ndim)
                    out.append((*place, width, level + 1, o["cpu"], *o["values"][k], *o["phi"][k]))
    return sorted(np.round(out, 9).tolist())


@pytest.mark.parametrize("ndim,bounds,order", [(3, 0, "<"), (3, 2, ">"), (2, 0, "<"), (1, 1, "<")])
def test_leaves_equal_brute_force(spark, tmp_path, ndim, bounds, order):
    rng = np.random.default_rng(ndim + bounds)
    levels = octree(rng, ndim, 4)
    at = tmp_path / "output_00012"
    write_output(at, rng, levels, ndim, bounds=bounds, order=order)
    names = ["x", "y", "z", "smooth", "level", "cpu", "rho", "vx", "vy", "vz", "p", "metal", "phi", "a_x", "a_y", "a_z"]
    for last in (None, 1, 2, 3, 9):
        s = sources.read(spark, str(at), maxlevel=last)
        got = sorted(np.round(s.gas.df.select(*names).toPandas().to_numpy(float), 9).tolist())
        assert got == leaves(levels, ndim, 2.0, min(last or 4, 4))
    assert abs(s.gas.df.selectExpr(f"sum(pow(smooth, {ndim}))").first()[0] - 2.0**ndim) < 1e-9
    one = sources.read(spark, str(at), cpus=[2])
    assert {r[0] for r in one.df.select("cpu").distinct().collect()} == {2}


@pytest.mark.parametrize("explicit", [False, True])
def test_particles_and_numbers(spark, tmp_path, explicit):
    rng = np.random.default_rng(5)
    at = tmp_path / "output_00003"
    told = write_output(at, rng, octree(rng, 3, 2), 3, explicit=explicit)
    s = sources.read(spark, str(at))
    df = s.df.where("family <> 'gas'").select("cpu", "family", "iord", "x", "vz", "mass", "tform").toPandas()
    want = sorted((c, f, int(v["iord"]), v["x"], v["vz"], v["mass"], v["tform"]) for c, f, v in told)
    assert sorted(map(tuple, df.to_numpy().tolist())) == want
    # rows are numbered without gaps, a family's together and a domain's together in it
    rows = s.df.select("pidx", "family", "cpu").orderBy("pidx").collect()
    assert [r[0] for r in rows] == list(range(len(rows)))
    seen = [(r[1], r[2]) for r in rows]
    assert len(set(seen)) == sum(a != b for a, b in zip(seen, [None, *seen], strict=False))
    assert sources.read(spark, str(at), families=["star"]).df.select("family").distinct().count() == 1


def test_units_and_derived_columns(spark, tmp_path):
    rng = np.random.default_rng(6)
    at = tmp_path / "output_00001"
    write_output(at, rng, octree(rng, 3, 2), 3)
    s = sources.read(spark, str(at))
    assert s.prop("a") == 0.5 and s.prop("h") == 0.7 and s.prop("boxsize") == 2.0
    assert s.factor("pos", "kpc") == pytest.approx(3e21 / 3.0857e21, rel=1e-3)
    g = s.gas.df.selectExpr("max(abs(mass - rho * pow(smooth, 3)))", "max(abs(u - 1.5 * p / rho))").first()
    assert max(g) < 1e-12
    t = s.gas
    assert t.df.select(t.col("temp").alias("t")).dropna().count() == t.df.count()
    assert s.star.df.where("mass is null or smooth is not null").count() == 0
    with pytest.raises(KeyError):
        s.col("smooth")


def test_only_columns_asked_for_are_read(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(7)
    at = tmp_path / "output_00002"
    write_output(at, rng, octree(rng, 3, 3), 3)
    s = sources.read(spark, str(at), columns=["rho"])
    assert s.df.columns == ["pidx", "family", "x", "y", "z", "rho"]
    read = []
    plain = Records.read
    monkeypatch.setattr(Records, "read", lambda self, kind: read.append(kind) or plain(self, kind))
    out = ramses.Output(str(at))
    for _ in ramses.cells(out, 1, {"rho"}, None):
        pass
    some = read.count("f8")
    read.clear()
    for _ in ramses.cells(out, 1, set(out.columns()), None):
        pass
    assert some < read.count("f8") / 2


def test_broken_files_and_other_folders(spark, tmp_path):
    rng = np.random.default_rng(8)
    at = tmp_path / "output_00004"
    write_output(at, rng, octree(rng, 3, 2), 3, gravity=False, cosmo=False)
    s = sources.read(spark, str(at))
    assert "phi" not in s.df.columns and "a" not in s.properties
    assert not ramses.can_read(spark, str(tmp_path))
    part = at / "amr_00004.out00001"
    part.write_bytes(part.read_bytes()[:-7])
    with pytest.raises(Exception, match="record|buffer"):
        sources.read(spark, str(at)).df.count()
