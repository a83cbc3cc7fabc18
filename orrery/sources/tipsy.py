"""Tipsy snapshots: a header, then records of gas, dark matter and stars.

The file has to be on a file system that all executors mount.  A partition is a range of
rows of one family; it reads only its own bytes."""

from __future__ import annotations

import os
import struct
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..snapshot import ROW, Snapshot, contiguous, snapshot
from . import column_files, placed_writer
from .placed_writer import Layout, placed

# The records' fields in their order.
FIELDS = {
    "gas": ("mass", "x", "y", "z", "vx", "vy", "vz", "rho", "temp", "eps", "metals", "phi"),
    "dm": ("mass", "x", "y", "z", "vx", "vy", "vz", "eps", "phi"),
    "star": ("mass", "x", "y", "z", "vx", "vy", "vz", "metals", "tform", "eps", "phi"),
}
COLUMNS = ("mass", "x", "y", "z", "vx", "vy", "vz", "eps", "phi", "rho", "temp", "metals", "tform")
HEADER = 32
ROWS = 500_000


def header(path: str) -> tuple[float, dict[str, int], str]:
    """Time, rows of the families, and byte order."""
    with open(path, "rb") as f:
        raw = f.read(HEADER)
    if len(raw) < HEADER:
        raise OSError(f"{path} is too short")
    for order in "<>":
        time, n, ndim, gas, dm, star, _ = struct.unpack(f"{order}diiiiii", raw)
        if ndim == 3 and min(gas, dm, star) >= 0 and n == gas + dm + star:
            return time, {"gas": gas, "dm": dm, "star": star}, order
    raise OSError(f"{path} is no tipsy file")


def record(family: str, order: str, wide_pos: bool = False, wide_vel: bool = False) -> np.dtype:
    wide = {c: wide_pos for c in ("x", "y", "z")} | {c: wide_vel for c in ("vx", "vy", "vz")}
    return np.dtype([(c, f"{order}f{8 if wide.get(c) else 4}") for c in FIELDS[family]])


class Part(InputPartition):
    def __init__(self, family: str, begin: int, first: int, rows: int):
        self.family, self.begin, self.first, self.rows = family, begin, first, rows


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.wide = tuple(options.get(k, "false").lower() == "true" for k in ("wide_pos", "wide_vel"))

    def partitions(self):
        _, sizes, order = header(self.path)
        parts, begin, first = [], HEADER, 0
        for family, n in sizes.items():
            size = record(family, order, *self.wide).itemsize
            parts += [Part(family, begin + i * size, first + i, min(ROWS, n - i)) for i in range(0, n, ROWS)]
            begin, first = begin + n * size, first + n
        return parts

    def read(self, part):
        order = header(self.path)[2]
        kind = record(part.family, order, *self.wide)
        with open(self.path, "rb") as f:
            f.seek(part.begin)
            rows = np.frombuffer(f.read(kind.itemsize * part.rows), kind)
        none = pa.nulls(len(rows), pa.float64())
        cols = [pa.array(rows[c].astype(np.float64)) if c in kind.names else none for c in COLUMNS]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.first + len(rows))), pa.array([part.family] * len(rows)), *cols], [ROW, "family", *COLUMNS])


class TipsySource(DataSource):
    @classmethod
    def name(cls):
        return "orrery_tipsy"

    def schema(self):
        return f"{ROW} long, family string, " + ", ".join(f"{c} double" for c in COLUMNS)

    def reader(self, schema):
        return Reader(self.options)


def _local(path: str) -> str:
    return path.removeprefix("file://")


def can_read(spark: SparkSession, path: str) -> bool:
    try:
        return os.path.isfile(_local(path)) and header(_local(path)) is not None
    except OSError:
        return False


def read(spark: SparkSession, path: str, units: dict | None = None, properties: dict | None = None, wide_pos: bool = False, wide_vel: bool = False) -> Snapshot:
    time, sizes, _ = header(_local(path))
    spark.dataSource.register(TipsySource)
    df = spark.read.format("orrery_tipsy").option("wide_pos", str(wide_pos)).option("wide_vel", str(wide_vel)).load(_local(path))
    own = {f for f, n in sizes.items() if n}
    ragged = {c: frozenset(f for f in FIELDS if c in FIELDS[f]) for c in COLUMNS}
    ragged = {c: f for c, f in ragged.items() if not own <= f}
    side = f"{_local(path)}.units"
    found = {}
    if os.path.exists(side):
        from .parquet import read_units

        with open(side) as f:
            found = read_units(f.read())
    return snapshot(df, found | (units or {}), {"a": time, "time": time} | (properties or {}), ragged)


def _places(sizes: dict[str, int], order: str, wide: tuple[bool, bool] = (False, False)) -> tuple[dict[str, int], int]:
    """The byte at which each family's records begin, and the file's size."""
    at, out = HEADER, {}
    for family in FIELDS:
        out[family] = at
        at += sizes.get(family, 0) * record(family, order, *wide).itemsize
    return out, at


def write(s: Snapshot, path: str, order: str = ">", time: float | None = None) -> None:
    """A file of the families gas, dm and star, in file order; absent columns are 0.

    Tasks write their rows at their places, see `placed_writer`."""
    sizes = {r["family"]: r["n"] for r in s.families().collect()}
    if lost := set(sizes) - set(FIELDS):
        raise ValueError(f"the format has no {sorted(lost)}")
    n = [sizes.get(f, 0) for f in FIELDS]
    at, size = _places(sizes, order)
    head = struct.pack(f"{order}diiiiii", s.prop("a") if time is None else time, sum(n), 3, *n, 0)
    layouts = [Layout(f, at[f], record(f, order).descr) for f in FIELDS]
    rows = placed(s, [c for c in COLUMNS if c in s.df.columns])
    placed_writer.write(rows, _local(path), size, [(0, head)], layouts, sum(n))


def update(s: Snapshot, path: str, *names: str, wide_pos: bool = False, wide_vel: bool = False) -> None:
    """Columns of a file replaced by a snapshot's, which has the file's rows; all else stays."""
    time, sizes, order = header(_local(path))
    own = {r["family"]: r["n"] for r in s.families().collect()}
    if own != {f: n for f, n in sizes.items() if n}:
        raise ValueError(f"the snapshot has {own} rows, the file {sizes}")
    wide = (wide_pos, wide_vel)
    at, size = _places(sizes, order, wide)
    with open(_local(path), "rb") as f:
        head = f.read(HEADER)
    layouts = [Layout(f, at[f], record(f, order, *wide).descr, _local(path), tuple(c for c in names if c in FIELDS[f])) for f in FIELDS]
    placed_writer.write(placed(s, names), _local(path), size, [(0, head)], layouts, sum(own.values()))


def write_column(s: Snapshot, name: str, path: str, order: str = ">") -> None:
    """A column file beside a snapshot, `<path>.<name>`: the number of rows, then a value for
    each row of gas, dark matter and stars."""
    sizes = {r["family"]: r["n"] for r in s.families().collect()}
    kind, at, layouts = [(name, f"{order}f4")], 4, []
    for family in FIELDS:
        layouts.append(Layout(family, at, kind))
        at += 4 * sizes.get(family, 0)
    total = sum(sizes.values())
    placed_writer.write(placed(s, [name]), f"{_local(path)}.{name}", at, [(0, struct.pack(f"{order}i", total))], layouts, total)


def read_column(spark: SparkSession, path: str, name: str, order: str = ">") -> DataFrame:
    """An auxiliary column file (`<snapshot>.<name>`): its number of rows, then a value
    for each row, as text or binary.  pidx and the column."""
    with open(_local(path), "rb") as f:
        n = struct.unpack(f"{order}i", f.read(4))[0]
    if os.path.getsize(_local(path)) == 4 + 4 * n:
        column = column_files.Column((name,), _local(path), f"{order}f4", 4)
        return column_files.frame(spark, [column_files.Family("all", n, (column,))]).select(ROW, name)
    # text is split by lines, and its words are numbered through
    words = spark.read.text(f"file://{_local(path)}").select(F.explode(F.split("value", r"\s+")).alias("w")).where("w <> ''")
    return contiguous(words, "at").where("at > 0").select((F.col("at") - 1).alias(ROW), F.col("w").cast("double").alias(name))


def star_log(log, stars: Snapshot, key: str = "iord") -> Snapshot:
    """Stars with the columns of a formation log, joined by id; of an id's entries the
    last counts (column `entry` has their order)."""
    cols = [c for c in log.columns if c not in (key, "entry")]
    last = log.groupBy(key).agg(F.max_by(F.struct(*cols), "entry").alias("l")).select(key, *[F.col(f"l.{c}").alias(c) for c in cols])
    return replace(stars, df=stars.df.join(last, key, "left"))
