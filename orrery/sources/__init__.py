"""Readers and writers of snapshots.

`read` picks a format by the file itself: each reader says whether it can read a path, in
the order of `FORMATS`.  Parquet and text go through Spark's own readers; binary formats
are Python data sources whose partitions are ranges of rows (or, where rows can't be found
by their number, files), so that a snapshot of any size is read by many tasks.  The readers
of octrees, grids and folders of columns take the columns that are wanted and read no other;
those of tipsy, gadget and HDF5 files read all columns of the rows that they give."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..snapshot import Snapshot
from . import ascii_table, gadget, grafic, hdf5, nchilada, parquet, ramses, tipsy

FORMATS = {"ramses": ramses, "nchilada": nchilada, "grafic": grafic, "parquet": parquet, "gadget": gadget, "hdf5": hdf5, "ascii": ascii_table, "tipsy": tipsy}


def read(spark: SparkSession, path: str, format: str | None = None, **options) -> Snapshot:
    """A snapshot from a path; OSError if no reader knows it."""
    for name, module in FORMATS.items() if format is None else [(format, FORMATS[format])]:
        if format is not None or module.can_read(spark, path):
            return module.read(spark, path, **options)
    raise OSError(f"no reader for {path}")


def write(s: Snapshot, path: str, format: str = "parquet", **options) -> None:
    FORMATS[format].write(s, path, **options)
