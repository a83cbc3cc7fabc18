"""Mixing sources to target weights by weighted fair queueing.

Sources are served side by side, each at the rate of its weight: a document's virtual
finish time is the words of its source up to and with it, in shuffled order, over the
source's weight, and a source that has been served whole starts over until it has been
served `epochs` times.  Documents are put into the order of their finish times, over
ranges of virtual time, and the order is truncated where the budget, the words of all
documents, is spent; a document that is being served then is cut there.  A source thus
gets the words of its weight's share, at most `epochs` times its own words, and what it
cannot take goes to the others by weight.

The order within a source is that of the MD5 of the ids, so that reruns and other
partitionings agree; rows of one id are ordered by size, and rows that agree in id, source
and size are interchangeable.  A source's running sums are taken in buckets of the shuffled
order and carried over the buckets' totals, so that a large source is never one task's.
Only rows of one id stay together.

Null and empty texts have size 0 and take nothing.  A null source is a source, the last;
a null id is shuffled as the empty string.  An empty table gives no rows, one without
words targets of 0.  Columns of the input other than id, text and source are left out.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .textkit import annotate, chunks, documents, stored

WEIGHTS = (1, 2, 3)
EPOCHS = 3
#: Rows of a bucket of a source of average size, and of a range of virtual time.
BUCKET_ROWS = 4_000
RANGE_ROWS = 16_000


def _sizes():
    def fn(texts: pa.Array) -> list:
        out = [np.zeros(0, np.int64)]
        for c in chunks(texts):
            out.append(np.diff(c.words()[2]))
        return [pa.array(np.concatenate(out).astype(np.int64))]

    return fn


def sizes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """id, source and size (words) of each row; `skey` is the source as a string that isn't
    null, and `shuffled` the place of the id in a random order."""
    src = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").alias("__text"))
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("skey")
    return annotate(src, "__text", "size long", _sizes, ["id", "source"]).select("*", key, F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("shuffled"))


def weighted(sources: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """One row for each source (`source`, `skey`) with its weight: the weights in turn, over
    the sources by code point, null last."""
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.lit(list(weights)), (n % len(weights) + 1).cast("int")).cast("long"))


def spent_at(sources: DataFrame, epochs: int = EPOCHS) -> tuple[int, int]:
    """The virtual time at which the words of all sources are spent, as a fraction.

    `sources` has `weight` and `source_size`.  Words are shared by weight; what exceeds
    `epochs` times a source's words is shared again among the others, by aggregates over
    the sources, until none is above."""
    size, weight = F.col("source_size").cast("decimal(38,0)"), F.col("weight").cast("decimal(38,0)")
    words, rate = sources.agg(F.sum(size), F.sum(weight)).first()
    if not words:
        return 0, 1
    total = rest = int(words)
    rate, full = int(rate), 0
    while True:
        above = epochs * size * F.lit(rate) < weight * F.lit(rest)
        n, taken, left = sources.agg(F.count_if(above), F.sum(F.when(above, epochs * size)), F.sum(F.when(~above, weight))).first()
        if n == full:
            return rest, rate
        full, rest, rate = n, total - int(taken), int(left)


def schedule(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row's place in its source: id, source, skey, size, source_size, weight, target
    (double), `served` (the whole words of the target), `before` (words of the source ahead
    of the row) and `place`, which tells rows of a bucket apart, beside `bucket`."""
    slim = stored(sizes(df, id_col, text_col, source_col), "sizes")
    buckets = max(1, math.ceil(slim.count() / bucket_rows))
    slim = slim.withColumn("bucket", F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("long") * buckets / 2**32))
    sums = stored(slim.groupBy("source", "skey", "bucket").agg(F.sum("size").alias("words")), "sums")
    sources = stored(weighted(sums.groupBy("source", "skey").agg(F.sum("words").alias("source_size")), weights), "sources")
    rest, rate = spent_at(sources, epochs)
    full = F.col("weight").cast("decimal(38,0)") * F.lit(rest) > epochs * F.col("source_size").cast("decimal(38,0)") * F.lit(rate)
    cap = epochs * F.col("source_size")
    share = F.col("weight").cast("decimal(38,0)") * F.lit(rest)
    sources = sources.select(
        "skey", "source_size", "weight",
        F.when(full, cap).otherwise(F.expr(f"weight * CAST({rest} AS DECIMAL(38,0)) div {rate}")).cast("long").alias("served"),
        F.when(full, cap.cast("double")).otherwise(share.cast("double") / F.lit(float(rate))).alias("target"),
    )
    ahead = Window.partitionBy("skey").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("skey", "bucket", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("start")).join(sources, "skey")
    w = Window.partitionBy("skey", "bucket").orderBy("shuffled", F.col("id").asc_nulls_first(), "size")
    placed = slim.select("id", "source", "skey", "bucket", "size", F.row_number().over(w).alias("place"), (F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("inside"))
    return placed.join(starts, ["skey", "bucket"]).withColumn("before", F.col("start") + F.col("inside")).drop("start", "inside")


def mixture(plan: DataFrame, epochs: int = EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mix of a `schedule`: a row for each document and time that it is taken, with
    `epoch` (from 0), `finish` (virtual time, cut at the end), `words` that are taken and
    `position`, the words of the mix ahead of it.  Of what isn't taken at all there is a row
    of epoch 0 without words and position.

    Finish times are cut into ranges; a task sorts a range and sums its words, and the
    ranges' totals carry the sums on."""
    ahead = F.col("epoch") * F.col("source_size") + F.col("before")
    words = F.greatest(F.lit(0), F.least(F.col("served") - ahead, F.col("size")))
    rows = plan.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumns({"ahead": ahead, "words": words})
    rows = rows.where("words > 0 OR epoch = 0").withColumn("finish", F.when(F.col("words") > 0, (F.col("ahead") + F.col("words")) / F.col("weight")))
    last, n = plan.agg(F.max(F.col("served") / F.col("weight")), F.count(F.lit(1))).first()
    ranges = max(1, math.ceil(n / range_rows))
    slot = F.least(F.floor(F.col("finish") * (ranges / max(last or 0, 1))), F.lit(ranges - 1))
    taken, idle = rows.where("words > 0").withColumn("slot", slot), rows.where("words = 0")
    w = Window.partitionBy("slot").orderBy("finish", "skey", "ahead")
    upto = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    totals = taken.groupBy("slot").agg(F.sum("words").alias("n")).select("slot", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("carried"))
    inside = F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
    order = taken.withColumn("inside", inside).join(totals, "slot").withColumn("position", F.col("carried") + F.col("inside")).drop("slot", "carried", "inside")
    return order.unionByName(idle.withColumn("position", F.lit(None).cast("long"))).drop("ahead")


def op13_source_mix(spark, sf_dir: str) -> DataFrame:
    mix = mixture(stored(schedule(documents(spark, sf_dir)), "schedule"))
    row = ["id", "size", "source_size", "target", "skey", "bucket", "place"]
    return mix.groupBy(*row).agg(F.sum("words").alias("taken")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS m,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS ss,
    (1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::BIGINT AS w FROM d GROUP BY source),
k AS (
  SELECT *, sum(ss) OVER () - coalesce(sum(3 * ss) OVER (ORDER BY 3.0 * ss / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(w) OVER (ORDER BY 3.0 * ss / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate,
    row_number() OVER (ORDER BY 3.0 * ss / w, source) AS n FROM s),
v AS (SELECT rest::HUGEINT AS rest, rate::HUGEINT AS rate FROM k WHERE w * rest <= 3 * ss * rate ORDER BY n LIMIT 1),
t AS (
  SELECT source, ss, CASE WHEN w * rest > 3 * ss * rate THEN 3 * ss ELSE w * rest // rate END::BIGINT AS served,
    CASE WHEN w * rest > 3 * ss * rate THEN (3 * ss)::DOUBLE ELSE (w * rest)::DOUBLE / rate::DOUBLE END AS target FROM s, v),
p AS (
  SELECT doc_id, source, size, (sum(size) OVER (PARTITION BY source ORDER BY m, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS before FROM d)
SELECT p.doc_id, p.size, t.ss AS source_size, t.target,
  (greatest(0, least(served - before, size)) + greatest(0, least(served - ss - before, size)) + greatest(0, least(served - 2 * ss - before, size)))::BIGINT AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
