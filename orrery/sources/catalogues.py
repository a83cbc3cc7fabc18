"""Group catalogues from files."""

from __future__ import annotations

import glob
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.groups import Catalogue, from_column, from_ids, numbering, renumbered
from ..snapshot import ROW, Snapshot, contiguous
from . import group_files


def tags(s: Snapshot, path: str, column: str = "grp", ignore: int | None = -1) -> Catalogue:
    """Groups from a text file of the number of rows and then a group for each row, in any
    lines.  The file is split by lines, and its words are numbered through."""
    words = s.spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("w")).where("w <> ''")
    rows = contiguous(words, "at").where("at > 0").select((F.col("at") - 1).alias(ROW), F.col("w").cast("long").alias(column))
    from dataclasses import replace

    t = replace(s, df=s.df.drop(column).join(rows, ROW, "left"))
    return from_column(t, column, ignore)


def member_lists(spark: SparkSession, path: str) -> DataFrame:
    """halo (from 0) and iord from text: the number of groups, then each group's size and
    a line for each of its members, the id first; more such blocks may follow.  A first pass
    notes where lists begin, and pieces of them are read by many tasks."""
    return group_files.text_lists(spark, path)


def property_table(spark: SparkSession, path: str) -> DataFrame:
    """Properties of groups from text with a line of names such as `#ID(1) Mvir(2)`; halo
    is the line's number from 0."""
    lines = spark.read.text(path).withColumn("__i", F.monotonically_increasing_id())
    head = lines.where(F.col("value").startswith("#")).orderBy("__i").first()["value"]
    names = [w.lstrip("#").partition("(")[0] for w in head.split() if w.lstrip("#")]
    body = lines.where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    words = F.split(F.trim("value"), r"\s+")
    from ..snapshot import numbered

    cols = body.select("__i", *[F.get(words, F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)])
    return numbered(cols, "__i", "halo").drop("__i")


def from_files(s: Snapshot, members: str, properties: str | None = None, numbers: str | None = None) -> Catalogue:
    """Groups by lists of ids and, if given, a table of properties; a property `hostHalo`
    becomes the parent, by its place in the column `ID`.

    `numbers` is a numbering of `groups.numbering` (`own` takes `ID`, lengths are the
    column `npart` or else the lists'); None keeps places in the file."""
    halos = None
    if properties:
        halos = property_table(s.spark, properties)
        if {"hostHalo", "ID"} <= set(halos.columns):
            ids = halos.select(F.col("ID").alias("hostHalo"), F.col("halo").alias("parent"))
            halos = halos.join(ids, "hostHalo", "left")
    c = from_ids(s, member_lists(s.spark, members), halos)
    if numbers is None:
        return c
    known = c.halos if "npart" in c.halos.columns else c.halos.join(c.members.groupBy("halo").agg(F.count(F.lit(1)).alias("npart")), "halo", "left").na.fill(0, ["npart"])
    if numbers == "own" and "ID" not in known.columns:
        numbers = "file-order"
    return renumbered(c, numbering(known, numbers, "npart"))


def _beside(path: str, *ends: str) -> list[str]:
    """Files whose names are a path and an ending."""
    return [f for e in ends for f in sorted(glob.glob(f"{glob.escape(path)}{e}"))]


def _ahf(s: Snapshot, path: str, **options) -> Catalogue | None:
    members, halos = _beside(path, "*.AHF_particles"), _beside(path, "*.AHF_halos")
    return from_files(s, members[0], halos[0] if halos else None, **({"numbers": "own"} | options)) if members else None


def _amiga(s: Snapshot, path: str, **options) -> Catalogue | None:
    found = _beside(path, ".amiga.grp")
    return tags(s, found[0], "amiga_grp", **({"ignore": 0} | options)) if found else None


def _hop(s: Snapshot, path: str, **options) -> Catalogue | None:
    found = _beside(path, ".hop.grp")
    return tags(s, found[0], "hop_grp", **({"ignore": -1} | options)) if found else None


def _tags(s: Snapshot, path: str, **options) -> Catalogue | None:
    found = _beside(path, ".grp")
    return tags(s, found[0], **options) if found else None


def _tables(s: Snapshot, path: str, **options) -> Catalogue | None:
    """A folder `groups_015` beside a snapshot `snap_015`, or beside the folder that it is in."""
    number = path.rstrip("/").rpartition("_")[2]
    for place in (path, f"{os.path.dirname(path)}/groups_{number}", f"{os.path.dirname(os.path.dirname(path))}/groups_{os.path.basename(os.path.dirname(path)).rpartition('_')[2]}"):
        try:
            return group_files.tables(s, place, **options)
        except OSError:
            continue
    return None


def _stars(s: Snapshot, path: str, **options) -> Catalogue | None:
    stem = f"{os.path.dirname(path)}/halos"
    return group_files.stars(s, stem, **options) if group_files.star_files(stem) else None


def _bricks(s: Snapshot, path: str, **options) -> Catalogue | None:
    m = re.search(r"output_(\d{5})", path)
    if not m:
        return None
    for place in (path, f"{path}/Halos", f"{os.path.dirname(path)}/Halos"):
        if os.path.exists(file := f"{place}/tree_bricks{int(m[1]):03d}"):
            return group_files.bricks(s, file, **options)
    return None


def _column(s: Snapshot, path: str, column: str = "grp", ignore: int | None = None) -> Catalogue | None:
    return from_column(s, column, ignore) if s.has_key(column) else None


#: Kinds of catalogues in the order in which they are tried.
KINDS = {"ahf": _ahf, "subfind": _tables, "rockstar": _stars, "adaptahop": _bricks, "amiga": _amiga, "hop": _hop, "tags": _tags, "column": _column}


def halos(s: Snapshot, path: str = "", kind: str | None = None, **options) -> Catalogue:
    """The catalogue beside a snapshot's path, or of its own column `grp`; with `kind`, of
    that kind.  OSError if there is none, KeyError for a kind that isn't known."""
    for name in KINDS if kind is None else (kind,):
        if name != "column" and not path:
            continue
        found = KINDS[name](s, path, **options)
        if found is not None:
            return found
    raise OSError(f"no groups beside {path!r}" + (f" of kind {kind}" if kind else ""))
