"""URL filter: a blocked Bloom filter ahead of an exact hash join.

Two lists can be given.  Entries of the one have a host, a path prefix and a verdict; an
entry fits a URL whose host is the entry's or a subdomain of it and whose path starts with
the entry's; of the fitting entries the longest (host and path together) wins.  The other
lists URLs, which are compared in their canonical form (`canonical`); it counts where no
entry fits.

A URL's keys are its canonical form and its host suffixes with its path cut behind each
`/`; an entry's key is its host with its path cut behind the last `/`.  No key is made with
more labels or slashes than the entries have.  The Bloom filter,
whose size grows with the lists alone, lets the few keys pass that may be listed; a hash
join with the lists removes its false positives and compares the rest of the path.  URLs
without a possible hit never reach the join, and each different URL reaches it once.

A null URL, and one without `://`, has an empty host and path, so that no entry fits.
URLs of any length are judged whole.  Repeated rows get a
verdict each.  Columns of the input with the name of an output are left out.  Empty lists or
tables give the default verdict or no rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import U64, mix, pages, stored

_WORDS = 8  # of 64 bits in a block: one cache line
#: A filter up to this size comes to the driver in one job.
AT_ONCE_BYTES = 8 << 20
OUTPUTS = ("host", "path", "rule", "verdict")


@dataclass
class BlockedBloom:
    """Bloom filter of 64-bit hashes in which all bits of a key lie in one block of 512."""

    blocks: np.ndarray
    bits_per_key: int = 8

    @classmethod
    def sized(cls, keys: int, bits: int = 12, bits_per_key: int = 8) -> BlockedBloom:
        """With `bits` bits of memory for each expected key."""
        n = max(1, math.ceil(keys * bits / (64 * _WORDS)))
        return cls(np.zeros((n, _WORDS), U64), bits_per_key)

    def _places(self, hashes: np.ndarray):
        h = np.asarray(hashes).view(U64)
        block = mix(h) % U64(len(self.blocks))
        for k in range(self.bits_per_key):
            b = mix(h + U64((0x9E3779B97F4A7C15 * (k + 1)) & (2**64 - 1)))
            yield block, (b >> U64(6)) % U64(_WORDS), U64(1) << (b & U64(63))

    def add(self, hashes: np.ndarray) -> None:
        for block, word, bit in self._places(hashes):
            np.bitwise_or.at(self.blocks, (block, word), bit)

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for block, word, bit in self._places(hashes):
            out &= (self.blocks[block, word] & bit) != 0
        return out

    @property
    def size(self) -> int:
        return self.blocks.nbytes


def build_filter(keys: DataFrame, column: str, max_bytes: int) -> BlockedBloom | None:
    """The filter of a column of 64-bit hashes; None if it would exceed `max_bytes`.

    Each task fills a filter of its own, and bitwise or merges them block by block, so
    that no task or driver gets the list itself."""
    n = keys.count()
    made = BlockedBloom.sized(n)
    if made.size > max_bytes:
        return None
    count, per_key = len(made.blocks), made.bits_per_key

    def fill(batches):
        own = BlockedBloom(np.zeros((count, _WORDS), U64), per_key)
        for pdf in batches:
            own.add(pdf[column].to_numpy(np.int64))
        at = np.flatnonzero(own.blocks.any(axis=1))
        for i in range(0, len(at), 4096):
            part = own.blocks[at[i : i + 4096]].view(np.int64)
            yield pd.DataFrame({"block": at[i : i + 4096]} | {f"w{k}": part[:, k] for k in range(_WORDS)})

    parts = keys.select(column).mapInPandas(fill, "block long, " + ", ".join(f"w{k} long" for k in range(_WORDS)))
    merged = parts.groupBy("block").agg(*[F.bit_or(f"w{k}").alias(f"w{k}") for k in range(_WORDS)])
    # at most max_bytes come to the driver, one row for each block: a small filter at once, since
    # an iterator runs a job for each partition
    for row in merged.collect() if made.size <= AT_ONCE_BYTES else merged.toLocalIterator():
        made.blocks[row[0]] = np.array(row[1:], np.int64).view(U64)
    return made


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


#: Ports that a scheme needs not name.
PORTS = {"http": "80", "https": "443", "ftp": "21"}


def _unescaped(part: Column) -> Column:
    """Escapes of letters, digits and -._~ decoded, others with capitals; a % that begins
    no escape is one itself."""

    def one(x: Column) -> Column:
        code = F.conv(F.substring(x, 1, 2), 16, 10).cast("int")
        c = F.char(code)
        ok = F.regexp_like(x, F.lit("^[0-9A-Fa-f]{2}"))
        safe = (code < 128) & F.regexp_like(c, F.lit(r"^[A-Za-z0-9._~-]$"))
        return F.when(ok & safe, F.concat(c, F.substr(x, F.lit(3)))).when(ok, F.concat(F.lit("%"), F.upper(F.substring(x, 1, 2)), F.substr(x, F.lit(3)))).otherwise(F.concat(F.lit("%25"), x))

    parts = F.split(part, "%", -1)
    return F.concat(parts[0], F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), one), ""))


def _without_dots(path: Column) -> Column:
    """A path without . and .. segments, put together from its end; `up` counts segments
    that are still to be left out."""
    segments = F.split(path, "/", -1)
    closed = F.element_at(segments, -1).isin(".", "..")
    start = F.struct(F.lit(0).alias("up"), F.when(closed, "/").otherwise("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        out = F.when(x.isin(".", "..") | (acc["up"] > 0), acc["out"]).otherwise(F.concat(F.lit("/"), x, acc["out"]))
        up = F.when(x == "..", acc["up"] + 1).when((x == ".") | (acc["up"] == 0), acc["up"]).otherwise(acc["up"] - 1)
        return F.struct(up.alias("up"), out.alias("out"))

    # the first segment is the empty one before the first /
    plain = F.aggregate(F.reverse(F.slice(segments, F.lit(2), F.size(segments))), start, step)["out"]
    return F.when(F.regexp_like(path, F.lit(r"(^|/)\.\.?(/|$)")), plain).otherwise(path)


def canonical(url: Column) -> Column:
    """The canonical form of a URL: scheme and host in small letters, no user part, no
    default or empty port, no dots behind the host, escapes in one spelling, no . and ..
    segments, a path of / if there is none, and no fragment.  Null without a scheme and host."""
    whole = r"(?s)^\s*([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"
    part = lambda k: F.regexp_extract(url, whole, k)
    scheme = F.lower(part(1))
    place = F.lower(F.regexp_replace(part(2), r"(?s)^.*@", ""))
    host, port = F.regexp_replace(F.regexp_replace(place, r":\d*$", ""), r"\.+$", ""), F.regexp_extract(place, r":(\d*)$", 1)
    usual = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PORTS.items() for x in kv]), scheme), F.lit(""))
    path = _without_dots(F.when(part(3) == "", "/").otherwise(_unescaped(part(3))))
    made = F.concat(scheme, F.lit("://"), host, F.when((port == "") | (port == usual), "").otherwise(F.concat(F.lit(":"), port)), path, _unescaped(part(4)))
    return F.when((scheme != "") & (host != ""), made)


def _slashes(path: Column) -> Column:
    return F.char_length(path) - F.char_length(F.replace(path, F.lit("/"), F.lit("")))


def _cuts(path: Column, most: int) -> Column:
    """The empty path and a path cut behind each of its first `most` slashes."""
    upto = lambda i: F.concat(F.call_function("substring_index", path, F.lit("/"), i), F.lit("/"))
    return F.transform(F.sequence(F.lit(0), F.least(_slashes(path), F.lit(most))), lambda i: F.when(i == 0, "").otherwise(upto(i)))


def _keys(host: Column, path: Column, url: Column | None, labels: int, slashes: int) -> Column:
    """Each host suffix of at most so many labels with each cut of the path behind at most so
    many slashes, and the canonical URL behind a mark."""
    dots = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit("")))
    # negative counts of substring_index take from the end
    hosts = F.transform(F.sequence(F.lit(1), F.least(dots + 1, F.lit(max(1, labels)))), lambda i: F.call_function("substring_index", host, F.lit("."), -i))
    rules = F.when(host != "", F.flatten(F.transform(hosts, lambda h: F.transform(_cuts(path, slashes), lambda p: F.concat(h, p))))).otherwise(F.array().cast("array<string>"))
    return rules if url is None else F.concat(rules, F.when(url.isNotNull(), F.array(F.concat(F.lit("="), url))).otherwise(F.array().cast("array<string>")))


def entries(spark: SparkSession, rows: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A list from (host, path, verdict)."""
    return spark.createDataFrame(list(rows), "host string, path string, verdict string")


def judge(df: DataFrame, listed: DataFrame, url_col: str = "url", default: str = "allow", keep: Sequence[str] | None = None, max_filter_bytes: int = 256 << 20, urls: DataFrame | None = None) -> DataFrame:
    """df's columns (or those in `keep`) with host, path, rule and verdict.

    `listed` has host, path and verdict, `urls` (if given) url and verdict.  rule is the
    winning entry's host and path; where none fits it is null and the verdict is that of the
    listed URL, else `default`.  If two entries or URLs are equal the least verdict counts.
    Beyond `max_filter_bytes` no filter is broadcast and all keys go to the join, which
    gives the same rows."""
    spark = df.sparkSession
    kept = [F.col(f"`{c}`") for c in (df.columns if keep is None else keep) if c.lower() not in OUTPUTS]
    host, path = F.col("host"), F.col("path")
    rules = listed.where("host is not null and path is not null").select(F.concat(host, F.regexp_extract(path, r"(?s)^.*/", 0)).alias("key"), F.concat(host, path).alias("rule"), path.alias("prefix"), "verdict")
    exact = rules
    if urls is not None:
        form = canonical(F.col("url").cast("string"))
        exact = rules.unionByName(urls.select(F.concat(F.lit("="), form).alias("key"), F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("prefix"), "verdict").where("key is not null"))
    exact = exact.groupBy("key", "rule", "prefix").agg(F.min("verdict").alias("verdict"))
    url = F.col(f"`{url_col}`").cast("string")
    src = df.select(F.struct(*kept).alias("row"), url.alias("url"), host_of(url).alias("host"), path_of(url).alias("path"))
    dots = F.char_length(host) - F.char_length(F.replace(host, F.lit("."), F.lit("")))
    most = listed.agg(F.max(dots), F.max(_slashes(path))).first()
    src = src.withColumn("keys", _keys(host, path, canonical(F.col("url")) if urls is not None else None, (most[0] or 0) + 1, most[1] or 0))
    bloom = build_filter(exact.select(F.xxhash64("key").alias("h")), "h", max_filter_bytes)
    if bloom is not None:
        shared = spark.sparkContext.broadcast((bloom.blocks, bloom.bits_per_key))

        @F.pandas_udf("array<string>")
        def possible(keys: pd.Series, hashes: pd.Series) -> pd.Series:
            if not len(keys):
                return keys
            flat = np.concatenate([*hashes, np.zeros(0, np.int64)]).astype(np.int64)
            may = np.split(BlockedBloom(*shared.value).may_have(flat), np.cumsum(hashes.map(len).to_numpy())[:-1])
            return pd.Series([k[m] for k, m in zip(keys, may, strict=True)])

        # so that filters on its result aren't moved to where Python can't be called
        possible = possible.asNondeterministic()
        src = src.withColumn("keys", possible("keys", F.transform("keys", lambda k: F.xxhash64(k))))
    # verdicts belong to URLs, of which each different one is looked up once
    wanted = src.where(F.size("keys") > 0).select("url", "path", F.explode("keys").alias("key")).distinct()
    fits = F.col("prefix").isNull() | F.startswith("path", F.col("prefix"))
    best = F.max_by(F.struct("rule", "verdict"), F.struct(F.coalesce(F.char_length("rule"), F.lit(-1)), F.col("rule")))
    hits = wanted.join(exact, "key").where(fits).groupBy("url").agg(best.alias("best")).withColumnRenamed("url", "hit")
    out = lambda d, rule, verdict: d.select("row.*", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(default)).alias("verdict"))
    none = F.lit(None).cast("string")
    free = out(src.where(F.size("keys") == 0), none, none)
    # a plain table, so that one URL's rows can be split in the join; never broadcast, since it
    # grows with the URLs
    found = src.where(F.size("keys") > 0).join(stored(hits, "hits").hint("merge"), F.col("url") == F.col("hit"), "left")
    return free.unionByName(out(found, F.col("best.rule"), F.col("best.verdict")))


#: (host, path, verdict)
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(pages(spark, sf_dir), entries(spark, RULES), keep=["page_id"])


OP7_SQL = r"""
WITH p AS (
  SELECT page_id,
    CASE WHEN contains(coalesce(url, ''), '://') THEN translate(regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*'),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
    CASE WHEN contains(coalesce(url, ''), '://') THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block'))
SELECT page_id, host, path,
  (SELECT arg_max(h || r.p, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)) AS rule,
  coalesce((SELECT arg_max(v, length(h || r.p)) FROM r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, r.p)), 'allow') AS verdict
FROM p
"""
