"""Snapshots as Parquet, with a partition for each family.

Units and properties are kept in a text file beside the rows."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, snapshot
from ..units import Unit, as_unit
from ..units import parse as parse_unit


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def can_read(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return False
    return path.endswith(".parquet") or fs.isDirectory(p) and any(f.getPath().getName() in ("_SUCCESS", "_snapshot.json") or f.getPath().getName().endswith(".parquet") for f in fs.listStatus(p))


def _unit_text(u: Unit) -> str:
    return " ".join([repr(u.scale), *[f"{b}**{e}" for b, e in u.dims.items()]])


def read(spark: SparkSession, path: str, units: dict | None = None, properties: dict | None = None) -> Snapshot:
    fs, p = _fs(spark, path)
    side = spark._jvm.org.apache.hadoop.fs.Path(p, "_snapshot.json")
    found: dict = {"units": {}, "properties": {}}
    if fs.isDirectory(p) and fs.exists(side):
        stream = fs.open(side)
        found = json.loads(bytes(stream.readAllBytes()))
        stream.close()
    df = spark.read.parquet(path)
    return snapshot(df, {k: as_unit(v) for k, v in found["units"].items()} | (units or {}), found["properties"] | (properties or {}))


def write(s: Snapshot, path: str, mode: str = "errorifexists", columns: list[str] | None = None) -> None:
    """Rows in file order within each family; derived columns only if they are named."""
    df = s.df if columns is None else s.df.select(ROW, "family", *[s.col(c).alias(c) for c in columns])
    df.repartitionByRange("family", ROW).sortWithinPartitions(ROW).write.mode(mode).partitionBy("family").parquet(path)
    fs, p = _fs(s.spark, path)
    out = fs.create(s.spark._jvm.org.apache.hadoop.fs.Path(p, "_snapshot.json"), True)
    props = {k: v for k, v in s.properties.items() if isinstance(v, (int, float, str))}
    out.write(json.dumps({"units": {k: _unit_text(u) for k, u in s.units.items()}, "properties": props}).encode())
    out.close()


def write_column(s: Snapshot, name: str, path: str, overwrite: bool = False) -> None:
    """One column beside a snapshot, keyed by row; refuses to replace one unless told."""
    s.df.select(ROW, s.col(name).alias(name)).write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path.rstrip('/')}.{name}.parquet")


def read_column(s: Snapshot, name: str, path: str) -> Snapshot:
    """A snapshot with a column that was written beside it."""
    side = s.spark.read.parquet(f"{path.rstrip('/')}.{name}.parquet")
    from dataclasses import replace

    return replace(s, df=s.df.join(side.select(ROW, F.col(name)), ROW, "left"))


def read_units(text: str) -> dict[str, Unit]:
    """Units of columns from lines such as `pos: kpc a`."""
    out = {}
    for line in text.splitlines():
        name, _, value = line.partition(":")
        if value.strip() and not line.lstrip().startswith("#"):
            out[name.strip()] = parse_unit(value.strip())
    return out
