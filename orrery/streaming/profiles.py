"""Profiles of particles that arrive as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.profile import bin_of


def windowed_profile(stream: DataFrame, x: Column, edges: Sequence[float], time: str = "ts", window: str = "10 minutes", late: str = "1 hour", weight: Column | None = None, values: Sequence[str] = ()) -> DataFrame:
    """For each time window and bin: n, weight, and weighted means of columns.

    The state has a row for each open window and bin; windows close when the watermark
    has passed them."""
    w = F.lit(1.0) if weight is None else weight
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("bin", bin_of(x, edges)).where(F.col("bin").isNotNull())
    got = rows.groupBy(F.window(time, window), "bin").agg(F.count(F.lit(1)).alias("n"), F.sum(w).alias("weight"), *[F.sum(w * F.col(v)).alias(f"__{v}") for v in values])
    means = [F.try_divide(F.col(f"__{v}"), F.col("weight")).alias(v) for v in values]
    return got.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "bin", "n", "weight", *means)
