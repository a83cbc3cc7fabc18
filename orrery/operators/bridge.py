"""Bridges: joins of two snapshots by row or id, and overlaps of their groups."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..snapshot import PLACE, ROW, Snapshot, family_name


@dataclass(frozen=True)
class Bridge:
    """Two ends and the column that pairs their rows."""

    start: Snapshot
    end: Snapshot
    key: str = "iord"
    keep_family: bool = False
    families: tuple[str, ...] | None = None

    def _end(self, s: Snapshot, other: Snapshot) -> Snapshot:
        if s.ancestor() is self.start.ancestor():
            return self.end
        if s.ancestor() is self.end.ancestor():
            return self.start
        raise ValueError("the view belongs to neither end")

    def __call__(self, view: Snapshot, ordered: bool = False) -> Snapshot:
        """The rows of the other end that the view's rows pair with; others drop out.  If
        `ordered`, they are in the order of the view's rows, and repeat as these do."""
        other = self._end(view, self.start)
        if ordered:
            s = view.carried()
            on = [self.key] + (["family"] if self.keep_family else [])
            keys = self._rows(s).select(*on, F.col(s.order or ROW).alias("__at"))
            df = self._rows(other).join(keys, on).drop(PLACE).withColumnRenamed("__at", PLACE)
            return replace(other, df=df, base=other, span=None, order=PLACE)
        keys = self._rows(view).select(self.key, *(["family"] if self.keep_family else [])).distinct()
        return replace(other, df=self._rows(other).join(keys, keys.columns, "left_semi"), base=other, span=None)

    def _rows(self, s: Snapshot) -> DataFrame:
        if self.families is None:
            return s.df
        return s.df.where(F.col("family").isin(*map(family_name, self.families)))

    def pairs(self) -> DataFrame:
        """pidx of both ends: start_row, end_row."""
        on = [self.key] + (["family"] if self.keep_family else [])
        a = self._rows(self.start).select(*on, F.col(ROW).alias("start_row"))
        b = self._rows(self.end).select(*on, F.col(ROW).alias("end_row"))
        return a.join(b, on).select("start_row", "end_row")

    def overlap(self, groups_1: DataFrame, groups_2: DataFrame) -> DataFrame:
        """How many rows a group of the start shares with one of the end: g1, g2, n.
        Groups are membership frames (halo, pidx); rows of one end only don't count."""
        a = groups_1.select(F.col("halo").alias("g1"), F.col(ROW).alias("start_row"))
        b = groups_2.select(F.col("halo").alias("g2"), F.col(ROW).alias("end_row"))
        both = self.pairs().join(a, "start_row").join(b, "end_row")
        return both.groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("n"))


def one_to_one(start: Snapshot, end: Snapshot) -> Bridge:
    """Row i with row i; both ends need as many rows."""
    if start.df.count() != end.df.count():
        raise ValueError("the ends differ in length")
    return Bridge(start, end, key=ROW)


def order_bridge(start: Snapshot, end: Snapshot, key: str = "iord", allow_family_change: bool = False, only_families=None) -> Bridge:
    return Bridge(start, end, key, keep_family=not allow_family_change, families=only_families)


def repaired_id(iord: Column, mass: Column, largest_level: int) -> Column:
    """Ids that were cut to 32 bits: the low half, with the level that the mass tells in
    the high half."""
    low = F.when(F.pmod(iord, F.lit(2**32)) >= 2**31, F.pmod(iord, F.lit(2**32)) - 2**32).otherwise(F.pmod(iord, F.lit(2**32)))
    level = F.floor(F.log2(mass)) - F.lit(largest_level)
    return low + (1 + level).cast("long") * F.lit(2**32)


def match(overlap: DataFrame, sources: DataFrame, threshold: float = 0.5, missing: int = -1) -> DataFrame:
    """For each source group (column g1 of `sources`) the group that shares most with it,
    least number first; `missing` if the share is under the threshold.  Shares are of the
    rows that are in any group of the other side."""
    w = Window.partitionBy("g1")
    best = overlap.withColumn("all", F.sum("n").over(w)).groupBy("g1").agg(F.max_by(F.struct("g2", "n", "all"), F.struct("n", -F.col("g2"))).alias("b"))
    got = sources.select("g1").distinct().join(best, "g1", "left")
    share = F.col("b.n") / F.col("b.all")
    return got.select("g1", F.when(share >= threshold, F.col("b.g2")).otherwise(F.lit(missing)).alias("g2"))


def fuzzy_match(overlap: DataFrame, threshold: float = 0.01) -> DataFrame:
    """All targets with a share above the threshold: g1, g2, share, rank from 1."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("g1"))
    kept = overlap.withColumn("share", share).where(F.col("share") > threshold)
    return kept.select("g1", "g2", "share", F.row_number().over(Window.partitionBy("g1").orderBy(F.desc("share"), "g2")).alias("rank"))


def ids_to_rows(s: Snapshot, ids: DataFrame, key: str = "iord") -> DataFrame:
    """The rows (pidx) that carry ids; ids without a row have null."""
    return ids.join(s.df.select(key, ROW), key, "left")
