"""Files of group finders: what generated files hold comes back, whatever is cut where."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery import snapshot as sn
from orrery.sources import catalogues, group_files

N = 3000


@pytest.fixture(scope="module")
def s(spark):
    # ids are in another order than rows
    df = spark.range(N).select(F.col("id").alias("pidx"), (F.col("id") * 7 % N).alias("iord"), F.lit("dm").alias("family"))
    return sn.snapshot(df, None, {"a": 0.5})


@pytest.fixture(params=[7, 1 << 18])
def piece(request, monkeypatch):
    monkeypatch.setattr(group_files, "PIECE", request.param)
    return request.param


def row_of(i):
    return i * pow(7, -1, N) % N


def sets(c):
    out = {}
    for h, r in c.members.select("halo", "pidx").collect():
        out.setdefault(h, []).append(r)
    return {h: sorted(v) for h, v in out.items()}


def record(f, values, kind, order="<"):
    raw = np.asarray(values, f"{order}{kind}").tobytes()
    f.write(np.array([len(raw)], f"{order}i4").tobytes() + raw + np.array([len(raw)], f"{order}i4").tobytes())


def write_bricks(path, groups, new, wide, contaminated, order="<"):
    real, whole = ("f8" if new else "f4"), ("i8" if wide else "i4")
    names = (group_files._NEW_BRICK if new else group_files._BRICK).split(";") + (group_files._CONTAMINATION.split(";") if contaminated else [])
    told = {}
    with open(path, "wb") as f:
        record(f, [N], whole, order)
        for v in (1.5, 0.5, 1.0, 7.0):
            record(f, [v], real, order)
        record(f, [len(groups) - 1, 1], whole, order)
        for number, (host, ids) in groups.items():
            record(f, [len(ids)], whole, order)
            record(f, ids, whole, order)
            record(f, [number], whole, order)
            told[number] = {}
            for rec in names:
                if rec.strip() == "*":
                    record(f, np.arange(number + 1), real, order)
                    continue
                keys = rec.split()
                kind = whole if keys[0] in group_files._INTEGERS else real
                values = [host if k == "host_id" else (number * 7 + i) % 3 if k == "contaminated" else number * 10 + i for i, k in enumerate(keys)]
                told[number] |= dict(zip(keys, values, strict=True))
                record(f, values, kind, order)
    return told


@pytest.mark.parametrize("new,wide,contaminated,order", [(False, False, False, "<"), (True, False, False, "<"), (True, False, True, "<"), (True, True, True, ">"), (True, True, False, "<")])
def test_bricks(spark, s, tmp_path, piece, new, wide, contaminated, order):
    rng = np.random.default_rng(1)
    groups = {k: (host, rng.choice(N, n, replace=False).tolist()) for k, host, n in ((1, 1, 200), (2, 2, 1), (3, 1, 55), (9, 3, 20))}
    told = write_bricks(tmp_path / "tree_bricks012", groups, new, wide, contaminated, order)
    head = group_files.brick_header(str(tmp_path / "tree_bricks012"))
    assert (head["new"], head["contamination"], head["nhalos"], head["nsubs"], head["npart"]) == (new, contaminated, 3, 1, N)
    c = group_files.bricks(s, str(tmp_path / "tree_bricks012"))
    assert sets(c) == {k: sorted(map(row_of, ids)) for k, (_, ids) in groups.items()}
    halos = {r["halo"]: r.asDict() for r in c.halos.collect()}
    assert {k: h["parent"] for k, h in halos.items()} == {1: None, 2: None, 3: 1, 9: 3}
    for k, values in told.items():
        assert halos[k]["npart"] == len(groups[k][1])
        assert {n: halos[k][n] for n in values} == pytest.approx(values)
    (tmp_path / "output_00012").mkdir()
    (tmp_path / "tree_bricks012").rename(tmp_path / "output_00012" / "tree_bricks012")
    assert sets(catalogues.halos(s, str(tmp_path / "output_00012"), "adaptahop")) == sets(group_files.bricks(s, str(tmp_path / "output_00012" / "tree_bricks012")))


def test_broken_bricks(spark, s, tmp_path):
    write_bricks(tmp_path / "b", {1: (1, [1, 2, 3]), 2: (1, [4])}, True, False, False)
    raw = (tmp_path / "b").read_bytes()
    (tmp_path / "b").write_bytes(raw[:-30])
    with pytest.raises(Exception, match="record|buffer"):
        group_files.bricks(s, str(tmp_path / "b")).members.count()


def write_stars(tmp_path, revision, groups, files=3, scale=0.5):
    kind = group_files.structure(group_files.REVISIONS[revision])
    head = group_files.structure(group_files._HEAD)
    numbers = sorted(groups)
    told = {}
    for k in range(files):
        own = numbers[len(numbers) * k // files : len(numbers) * (k + 1) // files]
        h = np.zeros(1, head)
        h["num_halos"], h["scale"], h["format_revision"] = len(own), scale, 1 if revision in ("1", "galaxies") else 2
        rows = np.zeros(len(own), kind)
        for i, n in enumerate(own):
            rows[i]["id"], rows[i]["num_p"], rows[i]["m"], rows[i]["pos"] = n, len(groups[n]), n + 0.5, (n, n + 1, n + 2)
            if "num_bound" in kind.names:
                rows[i]["num_bound"], rows[i]["num_p"] = len(groups[n]), 9999
            told[n] = (n + 0.5, n + 1.0)
        with open(tmp_path / f"halos_15.{k}.bin", "wb") as f:
            f.write(h.tobytes().ljust(256, b"\0"))
            f.write(rows.tobytes())
            for n in own:
                f.write(np.array(groups[n], "<i8").tobytes())
    return told


@pytest.mark.parametrize("revision", ["1", "2", "caterpillar", "galaxies"])
def test_stars(spark, s, tmp_path, piece, revision):
    rng = np.random.default_rng(2)
    groups = {k: rng.choice(N, n, replace=False).tolist() for k, n in ((4, 30), (5, 0), (6, 211), (7, 1), (8, 14), (9, 2), (10, 9))}
    told = write_stars(tmp_path, revision, groups)
    c = group_files.stars(s, str(tmp_path / "halos_15"), "caterpillar" if revision == "caterpillar" else None)
    assert sets(c) == {k: sorted(map(row_of, v)) for k, v in groups.items() if v}
    assert {r["halo"]: (r["m"], r["pos_1"]) for r in c.halos.collect()} == told
    assert {r["halo"]: r["npart"] for r in c.halos.collect()} == {k: len(v) for k, v in groups.items()}
    if revision != "caterpillar":
        assert sets(catalogues.halos(s, str(tmp_path / "snap_15"))) == sets(c)
    with pytest.raises(OSError):
        group_files.stars(sn.snapshot(s.df, None, {"a": 0.9}), str(tmp_path / "halos_15"))


def write_tables(path, groups, subs, files, wide=False):
    """Groups (ids in file order) and subgroups (group, parent within it, begin and length
    within the group's ids), dealt to files of tables, and ids to files that end elsewhere."""
    path.mkdir()
    step = path.name.rpartition("_")[2]
    ids = np.concatenate([g for g in groups]).astype("<i8" if wide else "<i4")
    starts = np.cumsum([0, *[len(g) for g in groups]])
    share = lambda n, k: range(n * k // files, n * (k + 1) // files)
    for k in range(files):
        own, kids = list(share(len(groups), k)), list(share(len(subs), k))
        part = ids[len(ids) * k // files : len(ids) * (k + 1) // files]
        tab = {"group_len": [len(groups[g]) for g in own], "group_off": [starts[g] for g in own], "mass": [g + 0.25 for g in own], "pos": [[g, g + 1, g + 2] for g in own]}
        sub = {
            "sub_len": [subs[i][3] for i in kids], "sub_off": [starts[subs[i][0]] + subs[i][2] for i in kids], "sub_parent": [subs[i][1] for i in kids],
            "sub_groupNr": [subs[i][0] for i in kids], "sub_mostboundID": [i + 5 for i in kids],
        }
        with open(path / f"subhalo_tab_{step}.{k}", "wb") as f:
            f.write(np.array([len(own), len(groups), len(part), len(ids), 0, files, len(kids), len(subs)], "<i4").tobytes())
            for text, found, n in ((group_files._TAB, tab, len(own)), (group_files._SUBTAB, sub, len(kids))):
                for col in text.split():
                    name, _, kind = col.partition(":")
                    dtype = {"i": "<i4", "f": "<f4", "d": "<i8" if wide else "<i4"}[kind[0]]
                    f.write(np.array(found.get(name, np.zeros(n * int(kind[1:] or 1))), dtype).tobytes())
        with open(path / f"subhalo_ids_{step}.{k}", "wb") as f:
            f.write(np.zeros(7, "<i4").tobytes() + part.tobytes())


@pytest.mark.parametrize("files,wide", [(1, False), (4, False), (4, True)])
def test_tables(spark, s, tmp_path, piece, files, wide):
    rng = np.random.default_rng(3)
    groups = [rng.choice(N, n, replace=False) for n in (500, 3, 0, 260, 41)]
    subs = [(0, 0, 0, 300), (0, 0, 300, 90), (0, 1, 310, 10), (1, 0, 0, 3), (3, 0, 0, 100), (3, 0, 120, 50)]
    at = tmp_path / "groups_015"
    write_tables(at, groups, subs, files, wide)
    c = group_files.tables(s, str(at))
    assert sets(c) == {k: sorted(map(row_of, g.tolist())) for k, g in enumerate(groups) if len(g)}
    got = {r["halo"]: (r["npart"], r["mass"], r["pos_y"]) for r in c.halos.collect()}
    assert got == {k: (len(g), k + 0.25, k + 1.0) for k, g in enumerate(groups)}
    d = group_files.tables(s, str(at), subhalos=True)
    assert sets(d) == {i: sorted(map(row_of, groups[g][b : b + n].tolist())) for i, (g, _, b, n) in enumerate(subs)}
    assert {r["halo"]: r["parent"] for r in d.halos.collect()} == {0: None, 1: 0, 2: 1, 3: None, 4: None, 5: 4}
    assert {r["halo"]: r["children"] for r in group_files.subgroups(s, str(at)).collect()} == {0: [0, 1, 2], 1: [3], 3: [4, 5]}
    assert sets(catalogues.halos(s, str(tmp_path / "snap_015"))) == sets(c)
    assert sets(catalogues.halos(s, str(tmp_path / "snap_015"), subhalos=True, kind="subfind")) == sets(d)


def test_text_lists_are_cut(spark, s, tmp_path, piece):
    rng = np.random.default_rng(4)
    groups = [rng.choice(N, n, replace=False).tolist() for n in (100, 0, 1, 36)]
    lists = lambda gs: f"{len(gs)}\n" + "".join(f"{len(g)}\n" + "".join(f"{i} 1\n" for i in g) for g in gs)
    (tmp_path / "lists").write_text(lists(groups[:3]) + "\n\n" + lists(groups[3:]) + "\n")
    spans = group_files.indexed(spark, [str(tmp_path / "lists")], lambda p, k=piece: group_files._text_index(p, k), {})
    assert spans.where("halo = 0").count() == -(-100 // piece)
    got = {}
    for h, _, i in group_files.members(spans, piece).orderBy("halo", "place").collect():
        got.setdefault(h, []).append(i)
    assert got == {k: g for k, g in enumerate(groups) if g}
    assert catalogues.member_lists(spark, f"file://{tmp_path}/lists").count() == 137
    (tmp_path / "lists").write_text("1\n5\n1\n2\n")
    with pytest.raises(Exception, match="ends within"):
        catalogues.member_lists(spark, str(tmp_path / "lists")).count()


def test_no_file_is_one_task(spark, s, tmp_path, monkeypatch):
    monkeypatch.setattr(group_files, "PIECE", 10)
    write_stars(tmp_path, "2", {0: list(range(2500))}, 1)
    index = group_files.indexed(spark, [str(tmp_path / "halos_15.0.bin")], lambda p: group_files._star_index(p, None), {})
    rows = group_files.members(index.select(*group_files._SPAN)).withColumn("task", F.spark_partition_id())
    each = [r["count"] for r in rows.groupBy("task").count().collect()]
    assert len(each) > 8 and max(each) <= 400
    assert rows.agg(F.count("iord"), F.countDistinct("iord")).first()[:] == (2500, 2500)
