"""Regions of snapshots whose rows are in the order of the cells of a coarse grid.

Such a snapshot has a table of its cells: for each family the cell's centre, its first row
and how many follow.  A region becomes the runs of rows of the cells that it touches, and
they become bounds on the row number, which Spark pushes to Parquet's row groups and pages:
other rows aren't read.  Runs that follow each other are one.  Where there are more runs than
`MAX_RUNS`, those with the smallest gaps between them are read as one, and what lies in the
gaps is taken out by a join on parts of the row numbers, so that the rows are the same."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.filters import Filter
from ..snapshot import ROW, Snapshot

MAX_RUNS = 256
#: Row numbers that share a key of the join, as a power of two.
KEY_ROWS = 16


def table(counts: DataFrame, by: Sequence[str] = ("family", "cell")) -> DataFrame:
    """A table of cells from counts of rows in file order: family, cell, x, y, z, n in, `first`
    row added.  The table is as small as the grid."""
    ahead = Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("first", F.coalesce(F.sum("n").over(ahead), F.lit(0)))


def touched(s: Snapshot, cells: DataFrame, region: Filter, width: float | tuple[float, float, float]) -> DataFrame:
    """The cells that a region touches; `width` is a cell's, by axis or for all."""
    sides = (width,) * 3 if isinstance(width, (int, float)) else width
    lo, hi = (tuple(F.col(c) + k * w / 2 for c, w in zip("xyz", sides, strict=True)) for k in (-1, 1))
    return cells.where(F.coalesce(region.touches(s, lo, hi), F.lit(True)) & (F.col("n") > 0))


def runs(cells: DataFrame) -> DataFrame:
    """begin and end (excluded) of the runs of rows of cells."""
    w = Window.orderBy("first")
    before = F.max(F.col("first") + F.col("n")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    # a cell that begins behind all ends so far begins a run
    marked = cells.select("first", "n", F.coalesce(F.col("first") > before, F.lit(True)).cast("long").alias("new"))
    run = marked.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("run").agg(F.min("first").alias("begin"), F.max(F.col("first") + F.col("n")).alias("end")).select("begin", "end")


def _within(bounds: Sequence[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for begin, end in bounds:
        out = out | ((F.col(ROW) >= begin) & (F.col(ROW) < end))
    return out


def take_cells(s: Snapshot, cells: DataFrame, most: int = MAX_RUNS) -> Snapshot:
    """The rows of cells of a snapshot's table."""
    parts = runs(cells)
    gap = (F.col("begin") - F.lag("end").over(Window.orderBy("begin"))).alias("gap")
    # of all gaps the widest stay; at most `most` rows come to the driver
    wide = parts.select("begin", "end", gap).where("gap IS NOT NULL").orderBy(F.desc("gap"), "begin").limit(most - 1).collect()
    ends = parts.agg(F.min("begin"), F.max("end"), F.count(F.lit(1))).first()
    if not ends[2]:
        return replace(s, df=s.df.where(F.lit(False)), base=s)
    wide = sorted((r["begin"] - r["gap"], r["begin"]) for r in wide)
    bounds = list(zip([ends[0], *[b for _, b in wide]], [*[a for a, _ in wide], ends[1]], strict=True))
    df = s.df.where(_within(bounds))
    if ends[2] > len(bounds):
        key = lambda c: F.shiftright(c, KEY_ROWS)
        keyed = parts.select("begin", "end", F.explode(F.sequence(key(F.col("begin")), key(F.col("end") - 1))).alias("__key"))
        keyed = keyed.groupBy("__key").agg(F.collect_list(F.struct("begin", "end")).alias("__runs"))
        df = df.withColumn("__key", key(F.col(ROW))).join(keyed, "__key").where(F.exists("__runs", lambda r: (F.col(ROW) >= r["begin"]) & (F.col(ROW) < r["end"]))).drop("__key", "__runs")
    return replace(s, df=df, base=s)


def take_region(s: Snapshot, cells: DataFrame, region: Filter, width: float | tuple[float, float, float], most: int = MAX_RUNS) -> Snapshot:
    """The rows of all cells that a region touches; `where(region)` leaves its own."""
    return take_cells(s, touched(s, cells, region, width), most)
