"""Gadget binary snapshots of formats 1 and 2, in one file or several.

A file is a header of 256 bytes and blocks of columns, each between its length before and
after; format 2 names its blocks.  The index of blocks is read on the driver; partitions
are ranges of rows of one type in one file, and read their own bytes of each block.  Files
have to be on a file system that all executors mount."""

from __future__ import annotations

import glob
import os
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..snapshot import ROW, Snapshot, snapshot
from . import placed_writer
from .placed_writer import Layout, placed

# Types in their order, blocks of format 1 in theirs, and names of blocks.
TYPES = ("gas", "dm", "dm", "dm", "star", "bh")
ORDER = ("POS ", "VEL ", "ID  ", "MASS", "U   ", "RHO ", "NE  ", "NH  ", "HSML")
NAMES = {"POS ": "pos", "VEL ": "vel", "ID  ": "iord", "MASS": "mass", "U   ": "u", "RHO ": "rho", "NE  ": "ElectronAbundance", "NH  ": "nh", "HSML": "smooth"}
ONLY_GAS = {"U   ", "RHO ", "NE  ", "NH  ", "HSML"}
WIDE = {"POS ", "VEL "}
ROWS = 500_000
COLUMNS = ("x", "y", "z", "vx", "vy", "vz", "iord", "mass", "u", "rho", "ElectronAbundance", "nh", "smooth")


class Index:
    """Header and places of the blocks of a file."""

    def __init__(self, path: str):
        self.path = path
        with open(path, "rb") as f:
            first = f.read(4)
            for order in "<>":
                size = struct.unpack(f"{order}i", first)[0] if len(first) == 4 else 0
                if size in (8, 256):
                    break
            else:
                raise OSError(f"{path} is no gadget file")
            self.order, self.named = order, size == 8
            f.seek(0)
            self.blocks: dict[str, tuple[int, int]] = {}
            places, name = iter(ORDER), None
            end = os.path.getsize(path)
            while f.tell() < end:
                if self.named:
                    _, name, _, _ = struct.unpack(f"{order}i4sii", f.read(16))
                    name = name.decode("latin-1")
                n = struct.unpack(f"{order}i", f.read(4))[0]
                at = f.tell()
                if not hasattr(self, "header"):
                    self.header = f.read(n)
                    name = None
                    self._parse()
                else:
                    if not self.named:
                        name = next(places, None)
                        while name == "MASS" and not self._massive():
                            name = next(places, None)
                    if name is not None:
                        self.blocks[name] = (at, n)
                f.seek(at + n)
                if struct.unpack(f"{order}i", f.read(4))[0] != n:
                    raise OSError(f"{path} has a broken block at {at}")

    def _parse(self) -> None:
        o, h = self.order, self.header
        self.npart = struct.unpack(f"{o}6i", h[:24])
        self.mass = struct.unpack(f"{o}6d", h[24:72])
        self.time, self.redshift = struct.unpack(f"{o}2d", h[72:88])
        self.total = struct.unpack(f"{o}6i", h[96:120])
        self.files = max(1, struct.unpack(f"{o}i", h[124:128])[0])
        self.boxsize, self.omega_m, self.omega_l, self.h = struct.unpack(f"{o}4d", h[128:160])

    def _massive(self) -> list[int]:
        """Types whose masses are in a block."""
        return [t for t in range(6) if self.npart[t] and not self.mass[t]]

    def rows_of(self, block: str) -> list[int]:
        if block in ONLY_GAS:
            return [0] if self.npart[0] else []
        return self._massive() if block == "MASS" else [t for t in range(6) if self.npart[t]]

    def values(self, f, block: str, kind: int, begin: int, n: int) -> np.ndarray | None:
        """Rows of a type from a block; None if it has none of them."""
        types = self.rows_of(block)
        if block not in self.blocks or kind not in types:
            return None
        at, size = self.blocks[block]
        width = 3 if block in WIDE else 1
        rows = sum(self.npart[t] for t in types)
        each = size // (rows * width)
        dtype = np.dtype(f"{self.order}{'u' if block == 'ID  ' else 'f'}{each}")
        skip = sum(self.npart[t] for t in types if t < kind) + begin
        f.seek(at + skip * width * each)
        out = np.frombuffer(f.read(n * width * each), dtype)
        return out.reshape(n, 3) if width == 3 else out


def parts_of(path: str) -> list[str]:
    """The file, or the numbered files of a snapshot in several."""
    if os.path.isfile(path):
        return [path]
    return sorted(glob.glob(f"{glob.escape(path)}.*[0-9]"), key=lambda p: int(p.rpartition(".")[2]))


class Part(InputPartition):
    def __init__(self, path: str, kind: int, begin: int, rows: int, first: int):
        self.path, self.kind, self.begin, self.rows, self.first = path, kind, begin, rows, first


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]

    def partitions(self):
        files = [Index(p) for p in parts_of(self.path)]
        out, first = [], 0
        for kind in range(6):  # rows of a family are together, whatever file they are in
            for ix in files:
                n = ix.npart[kind]
                out += [Part(ix.path, kind, i, min(ROWS, n - i), first + i) for i in range(0, n, ROWS)]
                first += n
        return out

    def read(self, part):
        ix, n = Index(part.path), part.rows
        with open(part.path, "rb") as f:
            got = {b: ix.values(f, b, part.kind, part.begin, n) for b in NAMES}
        none = pa.nulls(n, pa.float64())
        num = lambda v: none if v is None else pa.array(v.astype(np.float64))
        split = lambda v: [none] * 3 if v is None else [pa.array(np.ascontiguousarray(v[:, k], np.float64)) for k in range(3)]
        ids = pa.nulls(n, pa.int64()) if got["ID  "] is None else pa.array(got["ID  "].astype(np.int64))
        mass = pa.array(np.full(n, ix.mass[part.kind])) if got["MASS"] is None else num(got["MASS"])
        cols = [*split(got["POS "]), *split(got["VEL "]), ids, mass, *[num(got[b]) for b in ("U   ", "RHO ", "NE  ", "NH  ", "HSML")]]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + n)), pa.array([TYPES[part.kind]] * n), *cols], [ROW, "family", *COLUMNS])


class GadgetSource(DataSource):
    @classmethod
    def name(cls):
        return "orrery_gadget"

    def schema(self):
        return f"{ROW} long, family string, " + ", ".join(f"{c} {'long' if c == 'iord' else 'double'}" for c in COLUMNS)

    def reader(self, schema):
        return Reader(self.options)


def _local(path: str) -> str:
    return path.removeprefix("file://")


def can_read(spark: SparkSession, path: str) -> bool:
    try:
        files = parts_of(_local(path))
        return bool(files) and Index(files[0]) is not None
    except (OSError, struct.error):
        return False


def read(spark: SparkSession, path: str, units: dict | None = None, properties: dict | None = None) -> Snapshot:
    ix = Index(parts_of(_local(path))[0])
    spark.dataSource.register(GadgetSource)
    df = spark.read.format("orrery_gadget").load(_local(path))
    found = {"pos": "kpc a h^-1", "vel": "km s^-1 a^1/2", "mass": "1e10 Msol h^-1", "rho": "1e10 Msol h^2 kpc^-3 a^-3", "u": "km^2 s^-2", "smooth": "kpc a h^-1"}
    props = {"a": ix.time, "h": ix.h, "omegaM0": ix.omega_m, "omegaL0": ix.omega_l, "boxsize": ix.boxsize}
    props = {k: v for k, v in props.items() if v} | (properties or {})
    present = {TYPES[k] for k in range(6) if ix.total[k]}
    ragged = {NAMES[b]: frozenset({"gas"}) for b in ONLY_GAS if present - {"gas"}}
    return snapshot(df, found | (units or {}), props, ragged)


def write(s: Snapshot, path: str) -> None:
    """One file of format 2: pos, vel, iord, mass and, of gas, u, rho and smooth.

    Tasks write their rows of each block at their places, see `placed_writer`."""
    kinds = {"gas": 0, "dm": 1, "star": 4, "bh": 5}
    sizes = {r["family"]: r["n"] for r in s.families().collect()}
    if lost := set(sizes) - set(kinds):
        raise ValueError(f"the format has no {sorted(lost)}")
    npart = [0] * 6
    for f, n in sizes.items():
        npart[kinds[f]] = n
    ordered, total = sorted(sizes, key=kinds.get), sum(sizes.values())
    raw = struct.pack("<6i6d2d2i6i2i4d", *npart, *[0.0] * 6, s.prop("a"), s.prop("z"), 0, 0, *npart, 0, 1, s.properties.get("boxsize", 0.0), s.prop("omegaM0"), s.prop("omegaL0"), s.prop("h"))
    blocks = [("POS ", [(c, "<f8") for c in "xyz"], ordered), ("VEL ", [(f"v{c}", "<f8") for c in "xyz"], ordered)]
    if s.has_key("iord"):
        blocks.append(("ID  ", [("iord", "<u8")], ordered))
    blocks.append(("MASS", [("mass", "<f8")], ordered))
    blocks += [(b, [(NAMES[b], "<f8")], ["gas"]) for b in ("U   ", "RHO ", "HSML") if NAMES[b] in s.df.columns and sizes.get("gas")]
    marks, layouts, at = [], [], 0

    def block(name: str, size: int, content: bytes | None = None) -> int:
        """Marks around a block; the byte at which its content begins."""
        nonlocal at
        marks.append((at, struct.pack("<i4siii", 8, name.encode(), size + 8, 8, size)))
        begin = at + 20
        if content is not None:
            marks.append((begin, content))
        marks.append((begin + size, struct.pack("<i", size)))
        at = begin + size + 4
        return begin

    block("HEAD", 256, raw.ljust(256, b"\0"))
    for name, kind, families in blocks:
        width = np.dtype(kind).itemsize
        begin = block(name, width * sum(sizes[f] for f in families))
        for family in families:
            layouts.append(Layout(family, begin, kind))
            begin += width * sizes[family]
    columns = [c for _, kind, _ in blocks for c, _ in kind]
    placed_writer.write(placed(s, columns), _local(path), at, marks, layouts, total)
