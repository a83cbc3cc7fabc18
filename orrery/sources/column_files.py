"""Folders that hold each column of each family in a file of its own.

A file has values of one width behind each other, perhaps in planes of as many rows with
markers between them, so that the place of any row is known from its number.  Partitions
are ranges of rows of a family; a task reads its bytes of the columns that were asked for
and opens no other file.  A selection of runs of rows reads only these.  Folders have to
be on a file system that all executors mount."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..snapshot import ROW

#: Rows of a partition.
ROWS = 500_000


@dataclass(frozen=True)
class Column:
    """Where the values of a column are: rows of `names` (one, or a vector's components)
    from byte `at` on; `plane` rows lie between gaps of `gap` bytes (0: no planes)."""

    names: tuple[str, ...]
    path: str
    dtype: str
    at: int
    plane: int = 0
    gap: int = 0

    def read(self, f, begin: int, n: int) -> np.ndarray:
        """Rows as an array of n x names."""
        kind, width = np.dtype(self.dtype), len(self.names)
        plane, out, done = self.plane or begin + n or 1, [], 0
        while done < n:
            number, inside = divmod(begin + done, plane)
            take = min(n - done, plane - inside)
            f.seek(self.at + number * (plane * width * kind.itemsize + self.gap) + inside * width * kind.itemsize)
            got = np.fromfile(f, kind, take * width)
            if len(got) < take * width:
                raise OSError(f"{self.path} ends before row {begin + n}")
            out.append(got)
            done += take
        return (np.concatenate(out) if out else np.zeros(0, kind)).reshape(n, width)

    @property
    def whole(self) -> bool:
        return np.dtype(self.dtype).kind in "iu"


@dataclass(frozen=True)
class Family:
    name: str
    rows: int
    columns: tuple[Column, ...]


class Part(InputPartition):
    def __init__(self, family: int, begin: int, rows: int, first: int):
        self.family, self.begin, self.rows, self.first = family, begin, rows, first


def _families(text: str) -> list[Family]:
    return [Family(f["name"], f["rows"], tuple(Column(tuple(c.pop("names")), **c) for c in f["columns"])) for f in json.loads(text)]


def types(families: Sequence[Family]) -> dict[str, str]:
    """All columns with their types; a column that is whole in one family only is a double."""
    out: dict[str, str] = {}
    for f in families:
        for c in f.columns:
            for n in c.names:
                out[n] = "long" if c.whole and out.get(n, "long") == "long" else "double"
    return out


class Reader(DataSourceReader):
    def __init__(self, families: list[Family], names: dict[str, str], rows: int, runs: list[tuple[int, int]] | None):
        self.families, self.names, self.rows, self.runs = families, names, rows, runs

    def partitions(self):
        out, first = [], 0
        for k, f in enumerate(self.families):
            for begin, end in self.runs or [(0, 1 << 62)]:
                a, b = max(0, begin - first), min(f.rows, end - first)
                out += [Part(k, i, min(self.rows, b - i), first + i) for i in range(a, b, self.rows)]
            first += f.rows
        return out

    def read(self, part):
        family, got = self.families[part.family], {}
        for c in family.columns:
            if not set(c.names) & set(self.names):
                continue
            with open(c.path, "rb") as f:
                values = c.read(f, part.begin, part.rows)
            got |= {n: values[:, k] for k, n in enumerate(c.names)}
        arrays = [pa.array(np.arange(part.first, part.first + part.rows)), pa.array([family.name] * part.rows)]
        for n, kind in self.names.items():
            to = pa.int64() if kind == "long" else pa.float64()
            arrays.append(pa.array(np.ascontiguousarray(got[n], np.int64 if kind == "long" else np.float64)) if n in got else pa.nulls(part.rows, to))
        yield pa.RecordBatch.from_arrays(arrays, [ROW, "family", *self.names])


class ColumnSource(DataSource):
    @classmethod
    def name(cls):
        return "orrery_columns"

    def _names(self) -> dict[str, str]:
        return json.loads(self.options["names"])

    def schema(self):
        return f"{ROW} long, family string" + "".join(f", `{n}` {t}" for n, t in self._names().items())

    def reader(self, schema):
        runs = json.loads(self.options["runs"]) if "runs" in self.options else None
        return Reader(_families(self.options["families"]), self._names(), int(self.options["rows"]), runs)


def frame(spark: SparkSession, families: Sequence[Family], columns: Sequence[str] | None = None, runs: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """The rows of families one after the other, with the columns that are asked for; with
    `runs`, only rows whose numbers are in one of these ranges (ends excluded)."""
    names = {n: t for n, t in types(families).items() if columns is None or n in columns}
    spark.dataSource.register(ColumnSource)
    source = spark.read.format("orrery_columns").option("families", json.dumps([asdict(f) for f in families])).option("names", json.dumps(names)).option("rows", str(ROWS))
    return (source if runs is None else source.option("runs", json.dumps([list(map(int, r)) for r in runs]))).load()
