"""HDF5 snapshots with a group for each particle type; needs h5py.

Partitions are ranges of rows of one group of one file."""

from __future__ import annotations

import glob
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..snapshot import ROW, Snapshot, components, snapshot
from .names import ADAPTERS

try:
    import h5py
except ImportError:
    h5py = None

ROWS = 500_000


def files_of(path: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return sorted(glob.glob(f"{glob.escape(path)}.*.hdf5"), key=lambda p: int(p.split(".")[-2]))


def _layout(path: str, code: str) -> dict[str, tuple[str, int]]:
    """Columns of all groups: name to (type, width)."""
    out: dict[str, tuple[str, int]] = {}
    adapter = ADAPTERS[code]
    for p in files_of(path):
        with h5py.File(p) as f:
            for g in adapter.types:
                for name, d in f[g].items() if g in f else ():
                    if isinstance(d, h5py.Dataset):
                        kind = "long" if d.dtype.kind in "iu" else "double"
                        out.setdefault(adapter.name(name), (kind, d.shape[1] if d.ndim > 1 else 1))
    return out


def _schema(path: str, code: str) -> str:
    cols = [f"{ROW} long", "family string"]
    for name, (kind, width) in _layout(path, code).items():
        if width == 3:
            cols += [f"`{c}` {kind}" for c in components(name)]
        else:
            cols.append(f"`{name}` {kind}" if width == 1 else f"`{name}` array<{kind}>")
    return ", ".join(cols)


class Part(InputPartition):
    def __init__(self, path: str, group: str, begin: int, rows: int, first: int):
        self.path, self.group, self.begin, self.rows, self.first = path, group, begin, rows, first


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.code = options["path"], options.get("code", "gadget")

    def partitions(self):
        out, first = [], 0
        for g in ADAPTERS[self.code].types:
            for p in files_of(self.path):
                with h5py.File(p) as f:
                    n = len(next(iter(f[g].values()))) if g in f and len(f[g]) else 0
                out += [Part(p, g, i, min(ROWS, n - i), first + i) for i in range(0, n, ROWS)]
                first += n
        return out

    def read(self, part):
        adapter, n = ADAPTERS[self.code], part.rows
        layout = _layout(self.path, self.code)
        heads, cols = [ROW, "family"], [pa.array(np.arange(part.first, part.first + n)), pa.array([adapter.types[part.group]] * n)]
        with h5py.File(part.path) as f:
            own = {adapter.name(k): d for k, d in f[part.group].items() if isinstance(d, h5py.Dataset)}
            for name, (kind, width) in layout.items():
                t = pa.int64() if kind == "long" else pa.float64()
                v = own[name][part.begin : part.begin + n] if name in own else None
                if width == 3:
                    heads += components(name)
                    cols += [pa.nulls(n, t) if v is None else pa.array(v[:, k]).cast(t) for k in range(3)]
                else:
                    heads.append(name)
                    cols.append(pa.nulls(n, t if width == 1 else pa.list_(t)) if v is None else pa.array(v).cast(t) if width == 1 else pa.array(v.tolist(), pa.list_(t)))
        yield pa.RecordBatch.from_arrays(cols, heads)


class HdfSource(DataSource):
    @classmethod
    def name(cls):
        return "orrery_hdf5"

    def schema(self):
        return _schema(self.options["path"], self.options.get("code", "gadget"))

    def reader(self, schema):
        return Reader(self.options)


def can_read(spark: SparkSession, path: str) -> bool:
    return h5py is not None and bool(files_of(path)) and h5py.is_hdf5(files_of(path)[0])


def read(spark: SparkSession, path: str, units: dict | None = None, properties: dict | None = None, code: str = "gadget") -> Snapshot:
    """A snapshot; `code` is one of `names.ADAPTERS`, whose names and types the file has."""
    if h5py is None:
        raise OSError("reading HDF5 needs h5py")
    with h5py.File(files_of(path)[0]) as f:
        head = dict(f["Header"].attrs) if "Header" in f else {}
    keys = {"Time": "a", "HubbleParam": "h", "Omega0": "omegaM0", "OmegaLambda": "omegaL0", "BoxSize": "boxsize"}
    props = {new: float(np.ravel(head[old])[0]) for old, new in keys.items() if old in head}
    spark.dataSource.register(HdfSource)
    return snapshot(spark.read.format("orrery_hdf5").option("code", code).load(path), units, props | (properties or {}))


def write(s: Snapshot, path: str) -> None:
    raise OSError("write Parquet, tipsy or gadget files instead")
