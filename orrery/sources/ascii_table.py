"""Snapshots as text: a line of column names, then white-space separated numbers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..snapshot import ROW, Snapshot, numbered, snapshot


def can_read(spark: SparkSession, path: str) -> bool:
    return path.endswith((".txt", ".txt.gz"))


def read(spark: SparkSession, path: str, header: str | None = None, units: dict | None = None, properties: dict | None = None) -> Snapshot:
    """All rows are dark matter; `header` stands for a missing first line."""
    lines = spark.read.text(path)
    names = (header or lines.first()[0]).lstrip("# ").split()
    words = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    body = lines.select(F.monotonically_increasing_id().alias("__i"), "value")
    body = body.where((F.trim("value") != "") & ~F.ltrim("value").startswith("#"))
    if header is None:
        body = body.where(F.trim(F.regexp_replace("value", r"\s+", " ")) != " ".join(names))
    cols = body.select("__i", words.alias("w")).select("__i", *[F.get("w", F.lit(k)).try_cast("double").alias(n) for k, n in enumerate(names)])
    s = snapshot(numbered(cols, "__i", ROW).drop("__i").withColumn(ROW, F.col(ROW).cast("long")), units, properties)
    return replace(s, df=s.df)


def write(s: Snapshot, path: str, columns: list[str] | None = None) -> None:
    """One text file for each task, the first line of each with the names."""
    names = columns or s.keys()
    row = F.concat_ws(" ", *[s.col(n).cast("string") for n in names])
    lines = s.df.select(row.alias(" ".join(names)))
    lines.write.option("header", True).option("quote", "").option("sep", "\x01").csv(path)
