"""Row filter by a Bloom filter of keys, ahead of a join that decides."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .urlfilter import BlockedBloom, build_filter


def may_have(spark: SparkSession, keys: DataFrame, max_bytes: int):
    """A function from a column of 64-bit hashes to whether the hash may be among those in
    the only column of `keys`; None if the filter would exceed `max_bytes`."""
    bloom = build_filter(keys, keys.columns[0], max_bytes)
    if bloom is None:
        return None
    shared = spark.sparkContext.broadcast((bloom.blocks, bloom.bits_per_key))

    @F.pandas_udf("boolean")
    def probe(h: pd.Series) -> pd.Series:
        return pd.Series(BlockedBloom(*shared.value).may_have(h.to_numpy(np.int64)))

    return probe


def narrowed(df: DataFrame, column: str, keys: DataFrame, max_bytes: int = 64 << 20) -> DataFrame:
    """df's rows whose `column` may be among the distinct values of the only column of
    `keys`; some others, too.  All rows if the filter would exceed `max_bytes`."""
    probe = may_have(df.sparkSession, keys.select(F.xxhash64(keys.columns[0]).alias("h")), max_bytes)
    return df if probe is None else df.where(probe(F.xxhash64(column)))


def split_by(df: DataFrame, column: str, keys: DataFrame, max_bytes: int = 64 << 20) -> tuple[DataFrame, DataFrame]:
    """df's rows whose `column` (64-bit hashes, none null) may be among the distinct values
    of the only column of `keys`, and those for which it is not.  If the filter would exceed
    `max_bytes`, all rows are among the first."""
    probe = may_have(df.sparkSession, keys, max_bytes)
    return (df, df.limit(0)) if probe is None else (df.where(probe(column)), df.where(~probe(column)))
