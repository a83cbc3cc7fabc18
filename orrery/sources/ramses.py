"""Outputs of an adaptive octree code: leaf cells as gas, and particles.

An output is a folder with a text of its parameters and, for each domain, a file of the
octree, files of the cells' values and one of particles.  A file is a walk from record to
record, so that a domain is a partition; its task walks the octree level by level and gives
the leaf cells of a level at a time.  A first pass over all domains only counts, so that rows
have numbers by family and domain.  Values that aren't asked for are skipped.  Folders
have to be on a file system that all executors mount."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..snapshot import FAMILIES, ROW, Snapshot, snapshot
from .records import Records

# Names of values where no descriptor tells them, the names that descriptors
# use, and families of particles by their number (from 1 up, from 0 down; the last stands
# for all beyond).
HYDRO = ("rho", "vx", "vy", "vz", "p", "metal")
GRAVITY = ("phi", "a_x", "a_y", "a_z")
PARTICLES = (("x", "f8"), ("y", "f8"), ("z", "f8"), ("vx", "f8"), ("vy", "f8"), ("vz", "f8"), ("mass", "f8"), ("iord", "i4"), ("level", "i4"), ("tform", "f8"), ("metal", "f8"))
KNOWN = {
    "density": "rho", "pressure": "p", "metallicity": "metal", "velocity_x": "vx", "velocity_y": "vy", "velocity_z": "vz",
    "position_x": "x", "position_y": "y", "position_z": "z", "identity": "iord", "levelp": "level", "birth_time": "tform",
}
TYPES = {"d": "f8", "f": "f4", "i": "i4", "l": "i8", "b": "i1"}
POSITIVE = ("dm", "star", "cloud", "debris")
NEGATIVE = ("gas_tracer", "dm_tracer", "star_tracer", "cloud_tracer", "debris_tracer")
WHOLE = {"iord", "level", "cpu", "tag"}
#: Rows of a batch.
ROWS = 200_000


def local(path: str) -> str:
    return path.removeprefix("file://").rstrip("/")


def step(path: str) -> str | None:
    """An output's number, as its folder is named."""
    m = re.search(r"output_(\d+)/*$", path)
    return m[1] if m else None


def parameters(path: str) -> dict[str, float | int | str]:
    """What the info file says, and the namelist if there is one."""
    out: dict[str, float | int | str] = {}
    names = [os.path.join(path, f"info_{step(path)}.txt")]
    if os.path.exists(more := os.path.join(path, "namelist.txt")):
        names.append(more)
    for name in names:
        with open(name) as f:
            for line in f:
                key, eq, value = line.partition("!")[0].partition("=")
                if eq:
                    out.setdefault(key.strip(), _parsed(value.strip()))
    return out


def _parsed(value: str) -> float | int | str | bool:
    if value.lower() in (".true.", ".false."):
        return value.lower() == ".true."
    for kind in (int, float):
        try:
            return kind(value.replace("d", "e") if kind is float else value)
        except ValueError:
            pass
    return value


def is_cosmological(info: dict) -> bool:
    """As the namelist says, else whether the Hubble rate and expansion are those of a
    cosmology."""
    if "cosmo" in info:
        return bool(info["cosmo"])
    return float(info.get("H0", 0)) > 1e-3 and not (float(info.get("H0", 0)) == 1.0 and float(info.get("aexp", 1)) == 1.0)


def described(path: str) -> list[tuple[str, str]] | None:
    """Names and types of values from a descriptor: lines of number, name and type."""
    if not os.path.exists(path):
        return None
    with open(path) as f:
        parts = [[w.strip() for w in line.split(",")] for line in f if line.strip() and not line.startswith("#")]
    return [(KNOWN.get(name, name), TYPES[kind]) for _, name, kind in parts]


class Output:
    """Where an output's files are and what they hold."""

    def __init__(self, path: str):
        self.path, self.step = path, step(path)
        if self.step is None or not os.path.exists(self.file("info", None)):
            raise OSError(f"{path} is no output of the code")
        self.info = parameters(path)
        self.ncpu, self.ndim = int(self.info["ncpu"]), int(self.info["ndim"])
        self.bisection = str(self.info.get("ordering type", "")).strip() == "bisection"
        self.gas = os.path.exists(self.file("amr", 1)) and os.path.exists(self.file("hydro", 1))
        self.particles = os.path.exists(self.file("part", 1))
        self.fields = described(os.path.join(path, "part_file_descriptor.txt")) or list(PARTICLES)

    def file(self, kind: str, cpu: int | None) -> str:
        return os.path.join(self.path, f"{kind}_{self.step}.txt" if cpu is None else f"{kind}_{self.step}.out{cpu:05d}")

    def values(self, kind: str) -> list[str]:
        """Names of the cells' values in the files of a kind."""
        if not os.path.exists(self.file(kind, 1)):
            return []
        with open(self.file(kind, 1), "rb") as f:
            head = Records(f)
            head.skip()
            n = 4 if kind == "grav" else head.value("i4")
        if kind == "rt":
            return [f"rad_{k // 4}_{('rho', 'flux_x', 'flux_y', 'flux_z')[k % 4]}" for k in range(n)]
        told = described(os.path.join(self.path, f"{kind}_file_descriptor.txt"))
        names = [name for name, _ in told] if told else list(HYDRO if kind == "hydro" else GRAVITY)
        return (names + [f"{kind}_{k}" for k in range(len(names), n)])[:n]

    def columns(self) -> dict[str, str]:
        """All columns, with their types."""
        cells = ["smooth", "level", *[v for k in ("hydro", "grav", "rt") for v in self.values(k)]] if self.gas else []
        rest = [name for name, _ in self.fields if name != "family"] if self.particles else []
        return {c: "long" if c in WHOLE else "double" for c in dict.fromkeys(["x", "y", "z", "cpu", *cells, *rest])}


def octs(f, cpu: int, bisection: bool, maxlevel: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A domain's own octs, level by level (from 0): the level, the middles of the octs (in
    boxes) and which of their cells, in rows of 2**ndim, are leaves.  Cells of the last level
    that is asked for are leaves in any case."""
    r = Records(f)
    ncpu, ndim, grid, levels, _, bounds = r.value("i4"), r.value("i4"), r.read("i4"), r.value("i4"), r.value("i4"), r.value("i4")
    r.skip(2 + 13)
    here = r.read("i4").reshape(levels, ncpu)
    r.skip()
    if bounds:
        r.skip(2)
        outside = r.read("i4").reshape(levels, bounds)
    r.skip(2 + (5 if bisection else 1) + 3)
    corner, cells = grid[:ndim] / 2 - 0.5, 1 << ndim
    each = 3 + ndim + 1 + 2 * ndim + 3 * cells
    last = min(maxlevel or levels, levels)
    for level in range(last):
        for k in np.flatnonzero(here[level]) + 1:
            if k != cpu:
                r.skip(each)
                continue
            r.skip(3)
            middle = np.stack([r.read("f8") - c for c in corner], axis=1)
            r.skip(1 + 2 * ndim)
            son = np.stack([r.read("i4") for _ in range(cells)])
            r.skip(2 * cells)
            yield level, middle, (son == 0) | (level + 1 == last)
        if bounds:
            r.skip(int(np.count_nonzero(outside[level])) * each)


class Values:
    """The values of a domain's cells, in the order of `octs`."""

    def __init__(self, f, kind: str, cpu: int, names: Sequence[str], wanted: set[str]):
        self.r, self.cpu = Records(f), cpu
        self.ncpu = self.r.value("i4")
        if kind != "grav":
            self.r.skip()
        self.cells, _, self.bounds = 1 << self.r.value("i4"), self.r.skip(), self.r.value("i4")
        if kind != "grav":
            self.r.skip()
        self.names, self.wanted, self.at = names, wanted, 0

    def next(self, level: int, leaf: np.ndarray) -> dict[str, np.ndarray]:
        """Of the leaves of a level's own octs; levels without such are passed."""
        out: dict[str, list[np.ndarray]] = {}
        while self.at <= level:
            for k in range(1, self.ncpu + self.bounds + 1):
                self.r.skip()
                if not self.r.value("i4"):
                    continue
                own = k == self.cpu and self.at == level
                for cell in range(self.cells):
                    for name in self.names:
                        if own and name in self.wanted:
                            out.setdefault(name, []).append(self.r.read("f8")[leaf[cell]])
                        else:
                            self.r.skip()
            self.at += 1
        return {k: np.concatenate(v) for k, v in out.items()}


def cells(out: Output, cpu: int, wanted: set[str], maxlevel: int | None) -> Iterator[dict[str, np.ndarray]]:
    """Leaf cells of a domain, a level at a time."""
    size, half = float(out.info.get("boxlen", 1.0)), np.arange(1 << out.ndim)
    sub = np.stack([half >> k & 1 for k in range(out.ndim)], axis=1) - 0.5
    files = {k: out.values(k) for k in ("hydro", "grav", "rt") if wanted & set(out.values(k))}
    opened = {k: open(out.file(k, cpu), "rb") for k in files}
    try:
        values = [Values(opened[k], k, cpu, names, wanted) for k, names in files.items()]
        with open(out.file("amr", cpu), "rb") as f:
            for level, middle, leaf in octs(f, cpu, out.bisection, maxlevel):
                width = size * 0.5 ** (level + 1)
                cell, oct_ = np.nonzero(leaf)
                place = size * middle[oct_] + width * sub[cell]
                found = {c: place[:, k] for k, c in enumerate("xyz"[: out.ndim])}
                found |= {c: np.zeros(len(cell)) for c in "xyz"[out.ndim :]}
                found |= {"smooth": np.full(len(cell), width), "level": np.full(len(cell), level + 1)}
                for v in values:
                    found |= v.next(level, leaf)
                yield found
    finally:
        for f in opened.values():
            f.close()


def particles(out: Output, cpu: int, wanted: set[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Values of a domain's particles, and their families' names."""
    got: dict[str, np.ndarray] = {}
    with open(out.file("part", cpu), "rb") as f:
        r = Records(f)
        r.skip(2)
        n = r.value("i4")
        r.skip(5)
        explicit = any(name == "family" for name, _ in out.fields)
        need = wanted | ({"family"} if explicit else {"tform", "age"})
        for name, kind in out.fields:
            if r.length() is None:
                break
            if name in need:
                got[name] = r.read(kind)
            else:
                r.skip()
    if explicit:
        number = got.pop("family").astype(int)
        pick = lambda of, k: np.array(of, object)[np.clip(k, 0, len(of) - 1)]
        return got, np.where(number > 0, pick(POSITIVE, number - 1), pick(NEGATIVE, -number))
    # without numbers, what was born is a star
    born = got.get("tform", got.get("age", np.zeros(n))) != 0
    return got, np.where(born, "star", "dm").astype(object)


def _batch(found: dict[str, np.ndarray], rows: np.ndarray, family, columns: dict[str, str]) -> Iterator[pa.RecordBatch]:
    n = len(rows)
    for i in range(0, n, ROWS):
        cut = slice(i, min(n, i + ROWS))
        k = cut.stop - i
        arrays = [pa.array(rows[cut]), pa.array([family] * k) if isinstance(family, str) else pa.array(family[cut])]
        for c, kind in columns.items():
            to = pa.int64() if kind == "long" else pa.float64()
            arrays.append(pa.array(found[c][cut].astype(np.int64 if kind == "long" else np.float64)) if c in found else pa.nulls(k, to))
        yield pa.RecordBatch.from_arrays(arrays, [ROW, "family", *columns])


def _count(path: str, maxlevel: int | None):
    def run(batches):
        out = Output(path)
        for b in batches:
            for cpu in b.column(0).to_pylist():
                n: dict[str, int] = {}
                if out.gas:
                    with open(out.file("amr", cpu), "rb") as f:
                        n["gas"] = sum(int(leaf.sum()) for _, _, leaf in octs(f, cpu, out.bisection, maxlevel))
                if out.particles:
                    for fam, k in zip(*np.unique(particles(out, cpu, set())[1].astype(str), return_counts=True), strict=True):
                        n[str(fam)] = n.get(str(fam), 0) + int(k)
                yield pa.RecordBatch.from_arrays([pa.array([cpu] * len(n), pa.int64()), pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["cpu", "family", "n"])

    return run


class Domain(InputPartition):
    def __init__(self, cpu: int, first: dict[str, int]):
        #: the number of the first row of each family
        self.cpu, self.first = cpu, first


class Reader(DataSourceReader):
    def __init__(self, path: str, columns: dict[str, str], maxlevel: int | None, domains: list[Domain]):
        self.path, self.columns, self.maxlevel, self.domains = path, columns, maxlevel, domains

    def partitions(self):
        return self.domains

    def read(self, part):
        out, wanted, at = Output(self.path), set(self.columns), dict(part.first)
        if "gas" in at and out.gas:
            for found in cells(out, part.cpu, wanted, self.maxlevel):
                n = len(found["smooth"])
                found["cpu"] = np.full(n, part.cpu)
                yield from _batch(found, np.arange(at["gas"], at["gas"] + n), "gas", self.columns)
                at["gas"] += n
        if out.particles and set(at) - {"gas"} or "gas" in at and not out.gas:
            found, family = particles(out, part.cpu, wanted)
            for fam in sorted(set(family) & set(at)):
                rows = np.flatnonzero(family == fam)
                own = {k: v[rows] for k, v in found.items()} | {"cpu": np.full(len(rows), part.cpu)}
                yield from _batch(own, np.arange(at[fam], at[fam] + len(rows)), fam, self.columns)


class RamsesSource(DataSource):
    @classmethod
    def name(cls):
        return "orrery_ramses"

    def schema(self):
        return f"{ROW} long, family string, " + ", ".join(f"`{c}` {kind}" for c, kind in self._columns().items())

    def _columns(self) -> dict[str, str]:
        names = [c for c in self.options["columns"].split(",") if c]
        return {c: "long" if c in WHOLE else "double" for c in names}

    def reader(self, schema):
        # a line for each domain: its number, then families and the numbers of their first rows
        domains = []
        for line in self.options["domains"].split(";"):
            cpu, *rest = line.split(",")
            domains.append(Domain(int(cpu), {rest[i]: int(rest[i + 1]) for i in range(0, len(rest), 2)}))
        level = int(self.options.get("maxlevel", "0"))
        return Reader(self.options["path"], self._columns(), level or None, domains)


def can_read(spark: SparkSession, path: str) -> bool:
    try:
        return Output(local(path)) is not None
    except (OSError, KeyError):
        return False


def read(spark: SparkSession, path: str, units: dict | None = None, properties: dict | None = None, cpus: Sequence[int] | None = None, maxlevel: int | None = None, columns: Sequence[str] | None = None, families: Sequence[str] | None = None) -> Snapshot:
    """A snapshot of an output: of some domains, with cells down to a level, of some columns
    and families.  Positions are in boxes' units of length from a corner; gas has `smooth`, a
    cell's side, its mass and its specific energy."""
    out = Output(local(path))
    every = out.columns()
    known = {c: k for c, k in every.items() if columns is None or c in columns or c in "xyz"}
    cpus = list(range(1, out.ncpu + 1)) if cpus is None else sorted(cpus)
    domains = spark.createDataFrame([(c,) for c in cpus], "cpu long").repartition(max(1, len(cpus)))
    counted = domains.mapInArrow(_count(out.path, maxlevel), "cpu long, family string, n long").where(F.col("n") > 0)
    # a few numbers for each domain
    n = {(r["family"], r["cpu"]): r["n"] for r in counted.collect()}
    order = {f: k for k, f in enumerate(FAMILIES)}
    first: dict[int, dict[str, int]] = {c: {} for c in cpus}
    row, present = 0, sorted({f for f, _ in n}, key=lambda f: (order.get(f, len(order)), f))
    for fam in present:
        if families is not None and fam not in families:
            continue
        for c in cpus:
            if (fam, c) in n:
                first[c][fam] = row
                row += n[fam, c]
    lines = [",".join([str(c), *[str(x) for kv in at.items() for x in kv]]) for c, at in first.items() if at]
    spark.dataSource.register(RamsesSource)
    source = spark.read.format("orrery_ramses").option("path", out.path).option("columns", ",".join(known)).option("maxlevel", str(maxlevel or 0)).option("domains", ";".join(lines))
    df = source.load() if lines else spark.createDataFrame([], f"{ROW} long, family string, " + ", ".join(f"`{c}` {k}" for c, k in known.items()))
    gas = F.col("family") == "gas"
    if out.gas and {"rho", "smooth"} <= set(known):
        made = F.when(gas, F.col("rho") * F.col("smooth") ** 3)
        df = df.withColumn("mass", F.coalesce(made, F.col("mass")) if "mass" in known else made)
        if "p" in known:
            df = df.withColumn("u", F.when(gas, 1.5 * F.col("p") / F.col("rho")))
    length, density, time = (float(out.info.get(k, 1.0)) for k in ("unit_l", "unit_d", "unit_t"))
    found = {
        "pos": f"{length!r} cm", "smooth": f"{length!r} cm", "vel": f"{length / time!r} cm s^-1", "rho": f"{density!r} g cm^-3",
        "mass": f"{density * length**3!r} g", "p": f"{density * (length / time) ** 2!r} g cm^-1 s^-2", "u": f"{(length / time) ** 2!r} cm^2 s^-2",
    }
    props: dict[str, float] = {"boxsize": float(out.info.get("boxlen", 1.0)), "time": float(out.info.get("time", 0.0))}
    if is_cosmological(out.info):
        props |= {"a": float(out.info["aexp"]), "h": float(out.info["H0"]) / 100, "omegaM0": float(out.info["omega_m"]), "omegaL0": float(out.info["omega_l"])}
    only = {c: frozenset({"gas"}) for c in ("smooth", "u", *[v for k in ("hydro", "grav", "rt") for v in out.values(k)]) if c in df.columns and c not in dict(out.fields) and set(present) - {"gas"}}
    return snapshot(df, found | (units or {}), props | (properties or {}), only)
