"""Groups from binary and text files of group finders, by an index of their records.

Members of groups are records of any length, one group behind the other.  A first pass
goes from record to record and notes where each group's ids are and how many; it reads
lengths and properties and passes the ids.  Runs of ids are then cut into pieces of bounded
size, and a second pass reads the pieces, dealt evenly over the tasks: neither a file nor a
group is one task's.  Files have to be on a file system that all executors mount."""

from __future__ import annotations

import glob
import math
import os
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..operators.groups import Catalogue, from_ids
from ..snapshot import Snapshot
from .records import Records

#: Ids of a piece, and pieces that a task reads.
PIECE = 1 << 18
PIECES = 8

# ---- pieces of runs of ids

SPAN = "path string, halo long, first long, at long, n long, bytes long, kind string"
_SPAN = [c.split()[0] for c in SPAN.split(", ")]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, halo, first, at, n, size, kind in zip(*(b.column(c).to_pylist() for c in _SPAN), strict=True):
            with open(path, "rb") as f:
                f.seek(at)
                raw = f.read(size)
            if kind == "text":
                ids = np.array([line.split()[0] for line in raw.splitlines() if line.strip()], np.int64)
            else:
                ids = np.frombuffer(raw, kind).astype(np.int64)
            if len(ids) != n:
                raise OSError(f"{path} has {len(ids)} ids of {n} at {at}")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, halo)), pa.array(np.arange(first, first + n)), pa.array(ids)], ["halo", "place", "iord"])


def members(spans: DataFrame, piece: int | None = None) -> DataFrame:
    """halo, place (in the group's list, from 0) and iord of runs of ids (`SPAN`).  Runs of
    fixed width are cut into pieces here; text is cut where the index was made."""
    piece = piece or PIECE
    fixed = spans.where("kind <> 'text' AND n > 0")
    width = F.expr("bytes div n")
    k = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {piece}")))
    cut = fixed.select("*", k.alias("k")).select(
        "path", "halo", (F.col("first") + F.col("k") * piece).alias("first"), (F.col("at") + F.col("k") * piece * width).alias("at"),
        F.least(F.lit(piece), F.col("n") - F.col("k") * piece).alias("n"), (F.least(F.lit(piece), F.col("n") - F.col("k") * piece) * width).alias("bytes"), "kind",
    )
    pieces = cut.unionByName(spans.where("kind = 'text' AND n > 0").select(_SPAN))
    # descriptions of pieces are small, what they describe isn't: as many tasks as there are
    # pieces to read, which Spark must not join by the descriptions' size
    tasks = math.ceil((pieces.agg(F.sum(F.ceil(F.col("n") / piece))).first()[0] or 0) / PIECES)
    return pieces.repartition(max(1, tasks)).mapInArrow(_read, "halo long, place long, iord long")


Indexer = Callable[[str], Iterator[dict]]


def indexed(spark: SparkSession, paths: Sequence[str], index: Indexer, properties: dict[str, str]) -> DataFrame:
    """The rows that `index` gives for each file, a task for each: `SPAN` and properties.
    They are kept in the shared folder, so that files are gone through once."""
    names = [*_SPAN, *properties]
    types = {**dict(c.split() for c in SPAN.split(", ")), **properties}
    arrow = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}

    def run(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows: list[dict] = []
                for row in index(path):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield batch(rows)
                        rows = []
                yield batch(rows)

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], arrow[types[n]]) for n in names], names)

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return checkpointed(files.mapInArrow(run, ", ".join(f"`{n}` {types[n]}" for n in names)))


def _halos(index: DataFrame, properties: Sequence[str]) -> DataFrame:
    """A group's row for each first run."""
    return index.where("first = 0").select("halo", F.col("n").alias("npart"), *[F.col(f"`{p}`") for p in properties])


# ---- text lists


def _text_index(path: str, piece: int = PIECE) -> Iterator[dict]:
    """Of a number of groups, then each group's size and its lines of ids; more such
    blocks may follow, and empty lines.  One line at a time is held."""
    halo = 0
    with open(path, "rb") as f:

        def number() -> int | None:
            for line in iter(f.readline, b""):
                if line.strip():
                    return int(line.split()[0])
            return None

        while (groups := number()) is not None:
            for _ in range(groups):
                n = number()
                if n is None:
                    raise OSError(f"{path} ends before group {halo}")
                for first in range(0, n, piece) or (0,):
                    at, want = f.tell(), min(piece, n - first)
                    got = 0
                    while got < want:
                        line = f.readline()
                        if not line:
                            raise OSError(f"{path} ends within group {halo}")
                        got += bool(line.strip())
                    yield {"path": path, "halo": halo, "first": first, "at": at, "n": want, "bytes": f.tell() - at, "kind": "text"}
                halo += 1


def text_lists(spark: SparkSession, path: str, piece: int = PIECE) -> DataFrame:
    """halo (from 0) and iord of a text list."""
    spans = indexed(spark, [path.removeprefix("file://")], lambda p: _text_index(p, piece), {})
    return members(spans, piece).select("halo", "iord")


# ---- bricks of a substructure finder: Fortran records

# Records behind a group's ids and number; numbers of a record are told from
# its length, so that files of either width are read.
_BRICK = "timestep; level host_id first_subhalo_id n_subhalos next_subhalo_id; m; pos_x pos_y pos_z; vel_x vel_y vel_z; angular_momentum_x angular_momentum_y angular_momentum_z; max_distance shape_a shape_b shape_c; kinetic_energy potential_energy total_energy; spin; virial_radius virial_mass virial_temperature virial_velocity; nfw_rho0 nfw_R_c"
_NEW_BRICK = "timestep; level host_id first_subhalo_id n_subhalos next_subhalo_id; m; ntot; mtot; pos_x pos_y pos_z; vel_x vel_y vel_z; angular_momentum_x angular_momentum_y angular_momentum_z; max_distance shape_a shape_b shape_c; kinetic_energy potential_energy total_energy; spin; velocity_dispersion; virial_radius virial_mass virial_temperature virial_velocity; max_velocity_radius max_velocity; nfw_concentration; R200c M200c; r_half_mass r_90percent_mass; *; *; nfw_rho0 nfw_R_c"
_CONTAMINATION = "contaminated; m_contam mtot_contam; n_contam ntot_contam"
_INTEGERS = {"timestep", "level", "host_id", "first_subhalo_id", "n_subhalos", "next_subhalo_id", "ntot", "contaminated", "n_contam", "ntot_contam"}


def _numbers(r: Records, names: str) -> dict[str, float | int]:
    """The next record's values by name; * is a list of any length, which is passed."""
    if names.strip() == "*":
        r.skip()
        return {}
    keys, size = names.split(), r.length()
    if size is None or size % len(keys) or size // len(keys) not in (4, 8):
        raise OSError(f"a record of {size} bytes can't hold {names}")
    kind = f"{'i' if keys[0] in _INTEGERS else 'f'}{size // len(keys)}"
    return dict(zip(keys, r.read(kind).tolist(), strict=True))


def _whole(r: Records) -> int:
    return int(r.read(f"i{r.length()}")[0])


def brick_header(path: str) -> dict[str, float | int | bool]:
    """Numbers of particles and groups, and whether the file has the newer records and
    contamination."""
    with open(path, "rb") as f:
        r = Records(f)
        out: dict[str, float | int | bool] = {"npart": _whole(r)}
        for name in ("massp", "aexp", "omega_t", "age"):
            size = r.length()
            out[name], out["new"] = r.read(f"f{size}").tolist()[0], size == 8
        out["nhalos"], out["nsubs"] = r.read(f"i{r.length() // 2}").tolist()
        out["contamination"] = False
        if out["nhalos"] + out["nsubs"] and out["new"]:
            r.skip(3)
            for names in _NEW_BRICK.split(";"):
                _numbers(r, names)
            # a group would go on with its size and as many ids
            if r.length() is not None:
                n = _whole(r)
                out["contamination"] = r.length() not in (4 * n, 8 * n)
        return out


def _brick_index(path: str) -> Iterator[dict]:
    head = brick_header(path)
    records = (_NEW_BRICK if head["new"] else _BRICK).split(";") + (_CONTAMINATION.split(";") if head["contamination"] else [])
    with open(path, "rb") as f:
        r = Records(f)
        r.skip(6)
        for _ in range(head["nhalos"] + head["nsubs"]):
            n, size, at = _whole(r), r.length(), f.tell() + 4
            if n and size not in (4 * n, 8 * n):
                raise OSError(f"{path} has {size} bytes for {n} ids")
            r.skip()
            row = {"path": path, "halo": _whole(r), "first": 0, "at": at, "n": n, "bytes": size, "kind": f"{r.order}i{size // n if n else 4}"}
            for names in records:
                row |= _numbers(r, names)
            yield row


def bricks(s: Snapshot, path: str) -> Catalogue:
    """Groups and their substructure from a file of bricks, with a group's properties and,
    as its parent, the group that it lies in.  Members are found by their ids, whichever
    family they are of."""
    path = path.removeprefix("file://")
    head = brick_header(path)
    names = [n for rec in (_NEW_BRICK if head["new"] else _BRICK).split(";") + (_CONTAMINATION.split(";") if head["contamination"] else []) for n in rec.split() if n != "*"]
    index = indexed(s.spark, [path], _brick_index, {n: "long" if n in _INTEGERS else "double" for n in names})
    host = F.when((F.col("host_id") > 0) & (F.col("host_id") != F.col("halo")), F.col("host_id"))
    return from_ids(s, members(index.select(_SPAN)).select("halo", "iord"), _halos(index, names).withColumn("parent", host))


# ---- tables of fixed structures with ids behind them

# The header's and a group's values in their order, with the type (f: 4 bytes,
# q: 8, i: 4) and how many; what a revision adds goes before a value or to the end.
_HEAD = "magic:q snap:q chunk:q scale:f Om:f Ol:f h0:f bounds:f6 num_halos:q num_particles:q box_size:f particle_mass:f particle_type:q format_revision:i"
_GROUP = "id:q pos:f3 vel:f3 corevel:f3 bulkvel:f3 m:f r:f child_r:f vmax_r:f mgrav:f vmax:f rvmax:f rs:f klypin_rs:f vrms:f J:f3 energy:f spin:f alt_m:f4 Xoff:f Voff:f b_to_a:f c_to_a:f A:f3 b_to_a2:f c_to_a2:f A2:f3 bullock_spin:f kin_to_pot:f m_pe_b:f m_pe_d:f num_p:q num_child_particles:q p_start:q desc:q flags:q n_core:q min_pos_err:f min_vel_err:f min_bulkvel_err:f"
_HALF = _GROUP.replace("num_p:q", "halfmass_radius:f num_p:q")
REVISIONS = {"1": _GROUP, "2": _HALF, "caterpillar": f"{_HALF} num_bound:q num_iter:q", "galaxies": f"{_GROUP} type:i sm:f gas:f bh:f peak_density:f av_density:f"}
HEAD_BYTES = 256


def structure(text: str) -> np.dtype:
    """A C structure from names and types."""
    kinds = {"f": np.float32, "q": np.int64, "i": np.int32}
    parts = [p.split(":") for p in text.split()]
    return np.dtype([(n, kinds[k[0]], (int(k[1:]),)) if k[1:] else (n, kinds[k[0]]) for n, k in parts], align=True)


def star_header(path: str) -> np.void:
    with open(path, "rb") as f:
        raw = f.read(HEAD_BYTES)
    kind = structure(_HEAD)
    if len(raw) < HEAD_BYTES:
        raise OSError(f"{path} has no header")
    return np.frombuffer(raw[: kind.itemsize], kind)[0]


def star_revision(path: str, revision: str | None = None) -> str:
    """The revision whose structure gives the file's groups ids without gaps."""
    head = star_header(path)
    n = int(head["num_halos"])
    for name in [str(head["format_revision"]), "galaxies"] if revision is None else [str(revision)]:
        if name not in REVISIONS:
            continue
        kind = structure(REVISIONS[name])
        with open(path, "rb") as f:
            f.seek(HEAD_BYTES)
            ids = np.frombuffer(f.read(min(n, 1000) * kind.itemsize), kind)["id"] if n else np.zeros(0, np.int64)
        if (np.diff(ids) == 1).all():
            return name
    raise OSError(f"{path} is of no revision that is known")


def _star_index(path: str, revision: str | None) -> Iterator[dict]:
    head = star_header(path)
    kind, n = structure(REVISIONS[star_revision(path, revision)]), int(head["num_halos"])
    own = "num_bound" if "num_bound" in kind.names else "num_p"
    at = HEAD_BYTES + n * kind.itemsize
    with open(path, "rb") as f:
        f.seek(HEAD_BYTES)
        for i in range(0, n, 4096):
            rows = np.fromfile(f, kind, min(4096, n - i))
            for r in rows:
                row = {"path": path, "halo": int(r["id"]), "first": 0, "at": at, "n": int(r[own]), "bytes": 8 * int(r[own]), "kind": "<i8"}
                at += row["bytes"]
                for name in kind.names[1:]:
                    v = r[name]
                    row |= {f"{name}_{k}": float(x) for k, x in enumerate(v)} if v.ndim else {name: v.item()}
                yield row


def star_files(path: str) -> list[str]:
    """The files of a series: `halos_15` or its first file stand for all."""
    stem = path.removeprefix("file://").removesuffix(".0.bin")
    return sorted(glob.glob(f"{glob.escape(stem)}*.bin") + glob.glob(f"{glob.escape(stem)}*.boundbin"))


def stars(s: Snapshot, path: str, revision: str | None = None) -> Catalogue:
    """Groups of a finder in phase space, from a series of files; those of another scale
    factor than the snapshot's are left out."""
    files = [p for p in star_files(path) if "a" not in s.properties or abs(float(star_header(p)["scale"]) - s.prop("a")) < 1e-6]
    if not files:
        raise OSError(f"no files of groups for {path}")
    kind = structure(REVISIONS[star_revision(files[0], revision)])
    props = {}
    for name in kind.names[1:]:
        base, shape = kind[name].subdtype or (kind[name], ())
        sql = "long" if base.kind == "i" else "double"
        props |= {f"{name}_{k}": "double" for k in range(shape[0])} if shape else {name: sql}
    index = indexed(s.spark, files, lambda p: _star_index(p, revision), props)
    return from_ids(s, members(index.select(_SPAN)).select("halo", "iord"), _halos(index, list(props)))


# ---- tables of columns, with ids in files of their own

# Columns of groups and of subgroups in their order (f: 4 bytes, i: 4, d: an
# id), as many as there are of them in a file.
_TAB = "group_len:i group_off:i mass:f pos:f3 mmean_200:f rmean_200:f mcrit_200:f rcrit_200:f mtop_200:f rtop_200:f cont_count:i contmass:f Nsubs:i first_sub:i"
_SUBTAB = "sub_len:i sub_off:i sub_parent:i sub_mass:f sub_pos:f3 sub_vel:f3 sub_CM:f3 sub_spin:f3 sub_veldisp:f sub_VMax:f sub_VMaxRad:f sub_HalfMassRad:f sub_mostboundID:d sub_groupNr:i"
_TAB_HEAD, _IDS_HEAD = 32, 28


def tab_header(path: str) -> dict[str, int]:
    """Groups here and in all, ids here and in all, files, subgroups here and in all."""
    h = np.fromfile(path, "<i4", 8)
    if len(h) < 8:
        raise OSError(f"{path} has no header")
    return dict(zip(("groups", "all_groups", "ids", "all_ids_low", "all_ids_high", "files", "subs", "all_subs"), h.tolist(), strict=True))


def _columns(f, n: int, text: str, id_bytes: int, at: int) -> tuple[dict[str, np.ndarray], int]:
    """Columns of n rows that begin at a place, and the place behind them."""
    out = {}
    for part in text.split():
        name, _, kind = part.partition(":")
        dtype = {"i": "<i4", "f": "<f4", "d": f"<i{id_bytes}"}[kind[0]]
        width = int(kind[1:] or 1)
        f.seek(at)
        got = np.fromfile(f, dtype, n * width)
        if len(got) < n * width:
            raise OSError(f"{f.name} ends within {name}")
        out |= {f"{name}_{c}": got[k::3] for k, c in enumerate("xyz")} if width == 3 else {name: got}
        at += got.nbytes
    return out, at


def _tab(path: str, subs: bool, id_bytes: int) -> dict[str, np.ndarray]:
    head = tab_header(path)
    with open(path, "rb") as f:
        groups, at = _columns(f, head["groups"], _TAB, id_bytes, _TAB_HEAD)
        return _columns(f, head["subs"], _SUBTAB, id_bytes, at)[0] if subs else groups


class Tab:
    """A folder of tables and ids, such as `groups_015`."""

    def __init__(self, path: str):
        self.path = path.removeprefix("file://").rstrip("/")
        self.step = self.path.rpartition("_")[2]
        first = self.file("tab", 0)
        if not os.path.exists(first):
            raise OSError(f"{path} has no {os.path.basename(first)}")
        self.files = tab_header(first)["files"]
        heads = [tab_header(self.file("tab", k)) for k in range(self.files)]
        self.groups = np.cumsum([0, *[h["groups"] for h in heads]]).tolist()
        self.subs = np.cumsum([0, *[h["subs"] for h in heads]]).tolist()
        sizes = [os.path.getsize(self.file("ids", k)) - _IDS_HEAD for k in range(self.files)]
        told = [h["ids"] for h in heads]
        # the width of an id follows from what the tables say
        self.id_bytes = next((size // n for size, n in zip(sizes, told, strict=True) if n and size % n == 0 and size // n in (4, 8)), 4)
        self.ids = np.cumsum([0, *[size // self.id_bytes for size in sizes]]).tolist()

    def file(self, kind: str, k: int) -> str:
        return os.path.join(self.path, f"subhalo_{kind}_{self.step}.{k}")


def _tab_index(tab: Tab, subs: bool) -> Indexer:
    """Runs of ids of the groups in a table's file, cut where one file of ids ends."""
    before = tab.subs if subs else tab.groups
    starts = np.array(tab.ids)

    def index(path: str) -> Iterator[dict]:
        k = int(path.rpartition(".")[2])
        cols = _tab(path, subs, tab.id_bytes)
        off, n = cols["sub_off" if subs else "group_off"], cols["sub_len" if subs else "group_len"]
        for i in range(len(off)):
            row = {"halo": before[k] + i} | {c: v[i].item() for c, v in cols.items()}
            at, end = int(off[i]), int(off[i]) + int(n[i])
            if end > starts[-1]:
                raise OSError(f"group {row['halo']} ends behind the last id")
            first = 0
            while True:
                j = min(max(0, int(np.searchsorted(starts, at, "right")) - 1), tab.files - 1)
                m = min(end, int(starts[j + 1])) - at
                yield row | {"path": tab.file("ids", j), "first": first, "at": _IDS_HEAD + (at - int(starts[j])) * tab.id_bytes, "n": m, "bytes": m * tab.id_bytes, "kind": f"<i{tab.id_bytes}"}
                at, first = at + m, first + m
                if at >= end:
                    break

    return index


def tables(s: Snapshot, path: str, subhalos: bool = False) -> Catalogue:
    """Groups (or all subgroups) from a folder of tables.  A subgroup's parent is the
    subgroup of its group that it names, its `sub_groupNr` the group."""
    tab = Tab(path)
    text = _SUBTAB if subhalos else _TAB
    props = {}
    for part in text.split():
        name, _, kind = part.partition(":")
        sql = "double" if kind[0] == "f" else "long"
        props |= {f"{name}_{c}": sql for c in "xyz"} if kind[1:] else {name: sql}
    index = indexed(s.spark, [tab.file("tab", k) for k in range(tab.files)], _tab_index(tab, subhalos), props)
    # a group whose ids lie in several files has a row for each
    halos = index.where("first = 0").select("halo", F.col("sub_len" if subhalos else "group_len").alias("npart"), *props)
    if subhalos:
        top = halos.groupBy("sub_groupNr").agg(F.min("halo").alias("__top"))
        up = F.when(F.col("sub_parent") != F.col("halo") - F.col("__top"), F.col("__top") + F.col("sub_parent"))
        halos = halos.join(top, "sub_groupNr").withColumn("parent", F.when(F.col("sub_parent") >= 0, up)).drop("__top")
    return from_ids(s, members(index.select(_SPAN)).select("halo", "iord"), halos)


def subgroups(s: Snapshot, path: str) -> DataFrame:
    """Each group with its subgroups' numbers, in their order."""
    subs = tables(s, path, True).halos
    return subs.groupBy(F.col("sub_groupNr").alias("halo")).agg(F.sort_array(F.collect_list("halo")).alias("children"))


__all__ = ["PIECE", "Tab", "brick_header", "bricks", "indexed", "members", "star_files", "star_header", "stars", "subgroups", "tables", "text_lists"]
