"""Snapshots stored by place, so that a region reads only the files that it touches.

Rows are cut at medians into blocks of about as many rows, however they cluster, and a
file holds rows of one block only.  A small table beside them has each file's bounds and
rows.  A region becomes a list of files, found among the bounds, and a predicate for what
it cuts; Spark then reads nothing else.  The table outlives the session: other jobs open
the same store and find what any filter touches, periodic boxes and differences of
regions included.

Rows without finite coordinates are in files without bounds, which are always read: only
the predicate tells whether they belong."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.filters import Filter
from ..operators.neighbours import BLOCK_POINTS, XYZ, Cuts, cuts
from ..snapshot import ROW, Snapshot, snapshot
from ..units import as_unit
from .parquet import _fs, _unit_text

_LO, _HI = [f"lo_{c}" for c in XYZ], [f"hi_{c}" for c in XYZ]
#: Within a file rows are in order of cells of a box of 2**LEVELS cells a side, so that row
#: groups and pages have bounds of their own, which the predicate is pushed down to.
LEVELS = 7


def _block(at: Cuts):
    def number(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for xyz in parts:
            p = np.stack([c.to_numpy(float, na_value=np.nan) for c in xyz], axis=1)
            yield pd.Series(np.where(np.isfinite(p).all(axis=1), at.block(p), -1))

    return F.pandas_udf(number, T.LongType())


def _curve(at: Cuts):
    """A place's number on a curve through a box's cells, by interleaved digits."""
    lo, side = [float(v) for v in at.lo], [float(max(h - v, 1e-300)) for v, h in zip(at.lo, at.hi, strict=True)]
    out = F.lit(0).cast("long")
    for axis, c in enumerate(XYZ):
        cell = F.least(F.greatest(F.floor((F.col(c) - lo[axis]) / side[axis] * (1 << LEVELS)), F.lit(0)), F.lit((1 << LEVELS) - 1))
        for bit in range(LEVELS):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(cell, bit).bitwiseAND(F.lit(1).cast("long")), 3 * bit + axis))
    return F.coalesce(out, F.lit(-1))


def write(s: Snapshot, path: str, block_points: int = BLOCK_POINTS, columns: list[str] | None = None, mode: str = "errorifexists") -> None:
    """A snapshot's rows by block, with the table of the files' bounds.

    A block with more rows than others (rows at one place can't be cut apart) is dealt to
    several tasks, by place on a curve and by row."""
    df = s.df if columns is None else s.df.select(ROW, "family", *[c if c in s.df.columns else s.col(c).alias(c) for c in dict.fromkeys([*XYZ, *columns])])
    far = F.lit(float("inf"))
    at = cuts(df.where((F.abs("x") < far) & (F.abs("y") < far) & (F.abs("z") < far)), block_points)
    rows = df.withColumn("__block", _block(at)(*XYZ)).withColumn("__at", _curve(at))
    rows.repartitionByRange("__block", "__at", ROW).sortWithinPartitions("__block", "__at", ROW).drop("__at").write.mode(mode).partitionBy("__block").parquet(f"{path}/rows")
    # one row for each file; names are kept as they are below the store, which may be moved
    name = F.regexp_extract(F.col("_metadata.file_path"), r"(__block=[^/]*/[^/]*)$", 1)
    files = s.spark.read.schema(T.StructType([*df.schema, T.StructField("__block", T.LongType())])).parquet(f"{path}/rows").select(name.alias("file"), "__block", *XYZ).groupBy("file")
    known = F.col("__block") >= 0
    files.agg(F.count(F.lit(1)).alias("rows"), *[f(F.when(known, F.col(c))).alias(to) for f, names in ((F.min, _LO), (F.max, _HI)) for c, to in zip(XYZ, names, strict=True)]).coalesce(1).write.mode(mode).parquet(f"{path}/bounds")
    fs, p = _fs(s.spark, path)
    out = fs.create(s.spark._jvm.org.apache.hadoop.fs.Path(p, "store.json"), True)
    kept = {k: v for k, v in s.properties.items() if isinstance(v, (int, float, str))}
    out.write(json.dumps({"units": {k: _unit_text(u) for k, u in s.units.items()}, "properties": kept, "schema": json.loads(df.schema.json())}).encode())
    out.close()


class Store:
    """A snapshot stored by place."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        fs, p = _fs(spark, path)
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(p, "store.json"))
        found = json.loads(bytes(stream.readAllBytes()))
        stream.close()
        self.units = {k: as_unit(v) for k, v in found["units"].items()}
        self.properties, self.schema = found["properties"], T.StructType.fromJson(found["schema"])

    @property
    def bounds(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/bounds")

    def _open(self, files: list[str] | None) -> Snapshot:
        if files is None:
            df = self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")
        elif files:
            df = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/rows").parquet(*[f"{self.path}/rows/{f}" for f in files])
        else:
            df = self.spark.createDataFrame([], self.schema)
        return snapshot(df.select(self.schema.names), dict(self.units), dict(self.properties))

    def snapshot(self) -> Snapshot:
        """All rows."""
        return self._open(None)

    def files(self, region: Filter) -> list[str]:
        """Files that may have rows of a region: as many names as Spark would list."""
        s = self._open([])
        hit = F.coalesce(region.touches(s, tuple(map(F.col, _LO)), tuple(map(F.col, _HI))), F.lit(True))
        return sorted(r[0] for r in self.bounds.where(hit).select("file").collect())

    def where(self, region: Filter) -> Snapshot:
        """The rows of a region, read from the files that it touches."""
        return self._open(self.files(region)).where(region)

    def count_blocks(self, region: Filter) -> DataFrame:
        """Files and rows that a region touches, covers and leaves out."""
        s, lo, hi = self._open([]), tuple(map(F.col, _LO)), tuple(map(F.col, _HI))
        how = F.when(F.coalesce(region.covers(s, lo, hi), F.lit(False)), "covered").when(F.coalesce(region.touches(s, lo, hi), F.lit(True)), "touched").otherwise("left out")
        return self.bounds.groupBy(how.alias("how")).agg(F.count(F.lit(1)).alias("files"), F.sum("rows").alias("rows"))


def open_store(spark: SparkSession, path: str) -> Store:
    return Store(spark, path)
