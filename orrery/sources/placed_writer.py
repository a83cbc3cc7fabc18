"""Files of fixed records, written by many tasks at once.

Sizes come first: with them the place of every row in the file is known.  The driver
makes a file of the whole size beside the target and writes headers and markers; tasks,
which get ranges of rows in order, write their rows' bytes at their places.  A task that
runs again, or twice, writes the same bytes to the same places.  Only when all rows are
written is the file renamed to the target, so that a reader never sees a part of it, and
what a failed job leaves is removed.  Folders have to be on a file system that all
executors mount."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, numbered

#: Rows of a task.
ROWS = 500_000


@dataclass(frozen=True)
class Layout:
    """Where rows of a family go: a record of fields (the type's names are columns) for
    each, from byte `at` on.  With `over`, records are those of another file at the same
    places, with these columns changed."""

    family: str
    at: int
    dtype: list
    over: str | None = None
    columns: tuple[str, ...] | None = None


def placed(s: Snapshot, columns: Sequence[str]) -> DataFrame:
    """family, place (from 0 in the family, in file order) and columns; those that the
    snapshot hasn't are left out."""
    have = [c for c in dict.fromkeys(columns) if c in s.df.columns or s.has_key(c)]
    rows = s.df.select(ROW, "family", *[s.col(c).alias(c) for c in have if c not in (ROW, "family")])
    ranked = numbered(rows.withColumn("__k", F.struct("family", ROW)), "__k", "__all").drop("__k")
    # one row for each family
    first = ranked.groupBy("family").agg(F.min("__all").alias("__first"))
    return ranked.join(F.broadcast(first), "family").withColumn("place", F.col("__all") - F.col("__first")).drop("__all", "__first", ROW)


def _task(path: str, layouts: Sequence[Layout]):
    def run(batches):
        done = 0
        with open(path, "r+b") as f:
            for b in batches:
                names = b.schema.names
                family, place = np.array(b.column(names.index("family")).to_pylist(), object), b.column(names.index("place")).to_numpy()
                value = {n: np.nan_to_num(b.column(k).to_numpy(zero_copy_only=False).astype(float)) if b.column(k).type == pa.float64() else b.column(k).fill_null(0).to_numpy(zero_copy_only=False) for k, n in enumerate(names) if n not in ("family", "place")}
                if not len(place):
                    continue
                # rows that follow each other in the file are written at once
                cuts = np.flatnonzero((np.diff(place) != 1) | (family[1:] != family[:-1])) + 1
                for run_ in np.split(np.arange(len(place)), cuts):
                    for layout in layouts:
                        if layout.family == family[run_[0]]:
                            _write(f, layout, int(place[run_[0]]), {n: v[run_] for n, v in value.items()}, len(run_))
                done += len(place)
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], ["n"])

    return run


def _write(f, layout: Layout, place: int, value: dict[str, np.ndarray], n: int) -> None:
    kind = np.dtype([tuple(x) for x in layout.dtype])
    at = layout.at + place * kind.itemsize
    rows = np.zeros(n, kind)
    if layout.over is not None:
        with open(layout.over, "rb") as old:
            old.seek(at)
            rows = np.fromfile(old, kind, n)
    for name in layout.columns if layout.columns is not None else kind.names:
        if name in value:
            rows[name] = value[name]
    f.seek(at)
    f.write(rows.tobytes())


def write(rows: DataFrame, path: str, size: int, marks: Sequence[tuple[int, bytes]], layouts: Sequence[Layout], total: int) -> None:
    """The file at `path`, of `size` bytes: marks (place and bytes), and rows of `placed` by
    layouts.  `total` rows have to come."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with open(part, "wb") as f:
            f.truncate(size)
            for at, raw in marks:
                f.seek(at)
                f.write(raw)
        tasks = max(1, -(-total // ROWS))
        dealt = rows.repartitionByRange(tasks, "family", "place").sortWithinPartitions("family", "place")
        done = dealt.mapInArrow(_task(part, layouts), "n long").agg(F.sum("n")).first()[0] or 0
        if done != total:
            raise OSError(f"{done} rows of {total} were written to {path}")
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
