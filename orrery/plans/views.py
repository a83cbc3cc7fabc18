"""The driver's tables as particles.  The expressions are valid in Spark and in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..snapshot import Snapshot, snapshot

#: Events as particles in a box of side 500 around the origin.
EVENTS = {
    "pidx": "event_id",
    "iord": "event_id",
    "grp": "cast(user_id as bigint)",
    "family": "CASE WHEN event_id % 3 = 0 THEN 'gas' WHEN event_id % 3 = 1 THEN 'star' ELSE 'dm' END",
    "x": "value - 245e0",
    "y": "cast(event_id % 997 as double) * 5e-1 - 249e0",
    "z": "cast(user_id * 7 % 101 as double) * 5e0 - 250e0",
    "vx": "cast(event_id % 13 as double) - 6e0",
    "vy": "cast(user_id % 7 as double) - 3e0",
    "vz": "cast(event_id % 11 as double) - 5e0",
    "mass": "1e0 + cast(event_id % 5 as double)",
    "temp": "1e3 + cast(event_id % 200 as double) * 1e2",
    "rho": "1e0 + cast(event_id % 17 as double)",
    "metals": "cast(event_id % 10 as double) * 1e-3",
    "tform": "cast(event_id % 1000 as double) * 1e-2",
    "smooth": "1e1 + cast(event_id % 4 as double) * 5e0",
    "phi": "cast(event_id % 31 as double) - 4e1",
}
#: Items of orders as particles.
LINEITEM = {
    "x": "cast(l_quantity as double) - 25e0",
    "y": "cast(l_extendedprice as double) / 1e3 - 50e0",
    "z": "cast(l_discount as double) * 1e3 - 50e0",
    "mass": "cast(l_tax as double) + 1e-2",
    "family": "l_returnflag",
    "grp": "cast(l_suppkey as bigint)",
}


def _sql(cols: dict[str, str], table: str) -> str:
    return "SELECT " + ", ".join(f"{e} AS {c}" for c, e in cols.items()) + f" FROM {table}"


EVENTS_SQL = _sql(EVENTS, "events")
LINEITEM_SQL = _sql(LINEITEM, "lineitem")


def _frame(spark: SparkSession, sf_dir: str, table: str, cols: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e} AS {c}" for c, e in cols.items()])


def events(spark: SparkSession, sf_dir: str, box: bool = False) -> Snapshot:
    properties = {"a": 0.5, "h": 0.7, "time": 13.0, "omegaM0": 0.3, "omegaL0": 0.7}
    if box:
        properties["boxsize"] = 500.0
    units = {"pos": "kpc", "vel": "km s^-1", "mass": "Msol", "rho": "Msol kpc^-3", "temp": "K"}
    return snapshot(_frame(spark, sf_dir, "events", EVENTS), units, properties)


def plain_events(spark: SparkSession, sf_dir: str) -> Snapshot:
    """Without units: G counts as 1."""
    return snapshot(_frame(spark, sf_dir, "events", EVENTS), None, {"time": 13.0})


def items(spark: SparkSession, sf_dir: str) -> Snapshot:
    df = _frame(spark, sf_dir, "lineitem", LINEITEM)
    return snapshot(df.withColumn("pidx", F.monotonically_increasing_id()), {"pos": "kpc", "mass": "Msol"})
