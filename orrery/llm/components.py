"""Connected components of a graph of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import Scratch, remove, stored


def components(edges: DataFrame, scratch: Scratch | None = None, plain: bool = False) -> DataFrame:
    """node and root (its component's least node) of each node of the links (u, v).

    Every step only takes the least and greatest neighbours of each node, in partial aggregates,
    writes that, and joins it to the node's links.  Both sides of such a join are plain tables, so
    that Spark can split the many links of one node over tasks.  The same table tells when the
    links are stars, and then is the result: no step only finds that nothing changes.  Tables
    are written to the shared folder, among `scratch`'s if it is given.  `plain` links are a
    table there already and aren't written again.  Links that are null on either side are
    ignored, as are loops and repeated links."""
    spark, keep = edges.sparkSession, scratch.stored if scratch else stored
    folder = lambda df: df.inputFiles()[0].rpartition("/")[0]
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if not plain:
        e = keep(e.distinct(), "links")
    own, large = not plain, True
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        below = F.when(F.col("v") < F.col("u"), F.col("v"))
        near = keep(both.groupBy("u").agg(F.min(below).alias("low"), F.max(below).alias("high"), F.max("v").alias("top")), "least")
        # in a star a node that has a lesser neighbour has no other
        if near.where("low < high or low < u and top > u").isEmpty():
            break
        if large:
            after = both.where("v > u").join(near.select("u", F.coalesce("low", "u").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            small = e.join(near.select("u", F.col("low").alias("m")), "u")
            after = small.select("u", F.col("m").alias("v")).unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
        done, e = [near, *[e] * own], keep(after.distinct(), "links")
        own, large = True, not large
        for df in done:
            remove(spark, folder(df))
    if own and not scratch:
        remove(spark, folder(e))
    return near.select(F.col("u").alias("node"), F.coalesce("low", "u").alias("root"))
