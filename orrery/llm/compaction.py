"""Size-tiered compaction of shards under a versioned manifest.

Arrivals are appended as small immutable Parquet shards.  A tier holds the shards whose
sizes lie within a factor of `ratio` of each other; a tier of at least `fan_in` shards is
merged into files of about `target_bytes`, and shards of half of that or more are done.
A merge reads its shards and writes them without a shuffle: partitions of the read are
joined until as many are left as files are wanted.  Nothing is changed in place: a new
manifest, which lists the shards of a version, is written beside the others and renamed
to the next number, which fails if another writer has taken it; the writer then starts
over from the newer version.  A reader sees one version whole, and what a lost executor
or writer leaves behind is in no manifest and goes with `vacuum`.

Rows are kept as they are, repeated rows and nulls included.  An empty arrival adds no
shard; a store without shards reads as an empty table of the arrival's columns.  Arrivals
may bring further columns: a version is read with the columns of all its shards.  An arrival
whose column has another type than the store's, or a name that differs from it in the case
of its letters only, is refused with a TypeError before anything is committed.  Null, empty
and long texts are values like others.
"""

from __future__ import annotations

import json
import math
import uuid
from collections import defaultdict
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import documents, fresh_dir, hadoop


class Conflict(Exception):
    """Another writer has committed the version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int


@dataclass(frozen=True)
class Manifest:
    version: int
    schema: str
    shards: tuple[Shard, ...]


def _plain(kind: T.DataType) -> str:
    """A type without what shards may differ in: nullability and comments."""
    return kind.simpleString()


def _joined(now: Manifest, new: T.StructType) -> T.StructType:
    """The columns of a version and of an arrival; TypeError if they don't go together."""
    known = T.StructType.fromJson(json.loads(now.schema)) if now.schema else T.StructType()
    there = {f.name.lower(): f for f in known}
    for f in new:
        old = there.get(f.name.lower())
        if old is not None and (old.name != f.name or _plain(old.dataType) != _plain(f.dataType)):
            raise TypeError(f"column {f.name} {_plain(f.dataType)} of the arrival is {old.name} {_plain(old.dataType)} in the store")
    return T.StructType([*known, *[f for f in new if f.name.lower() not in there]])


class ShardStore:
    """Shards below a folder that all executors reach."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = 128 << 20, fan_in: int = 4, ratio: float = 4.0):
        self.spark, self.root = spark, root.rstrip("/")
        self.target, self.fan_in, self.ratio = target_bytes, fan_in, ratio
        self.fs, _ = hadoop(spark, root)
        self._path = spark._jvm.org.apache.hadoop.fs.Path

    def _name(self, version: int) -> str:
        return f"{self.root}/manifests/{version:012d}.json"

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/manifests")
        if not self.fs.exists(at):
            return []
        return sorted(int(f.getPath().getName()[:12]) for f in self.fs.listStatus(at) if f.getPath().getName().endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """A version's manifest, by default the newest; version 0 is the empty store."""
        version = (self.versions() or [0])[-1] if version is None else version
        if not version:
            return Manifest(0, "", ())
        stream = self.fs.open(self._path(self._name(version)))
        try:
            got = json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()
        return Manifest(version, got["schema"], tuple(Shard(**s) for s in got["shards"]))

    def _commit(self, after: Manifest) -> None:
        """Makes a manifest the version that it names, or raises Conflict."""
        jvm = self.spark._jvm
        whole = self._path(self._name(after.version))
        part = self._path(f"{self.root}/manifests/.{after.version:012d}-{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        out.write(json.dumps({"version": after.version, "schema": after.schema, "shards": [asdict(s) for s in after.shards]}).encode())
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(part, whole, options)
        except Exception as e:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(after.version) from None
            raise

    def _write(self, df: DataFrame) -> list[Shard]:
        at = f"{self.root}/shards/{uuid.uuid4().hex}"
        df.write.parquet(at)
        # files without rows carry no data
        return [Shard(f.getPath().toString(), f.getLen()) for f in self.fs.listStatus(self._path(at)) if f.getPath().getName().startswith("part-")]

    def append(self, df: DataFrame) -> int:
        """Adds df's rows as shards; the new version."""
        _joined(self.manifest(), df.schema)
        shards = tuple(self._write(df))
        while True:
            now = self.manifest()
            # another writer may have brought columns meanwhile
            schema = _joined(now, df.schema)
            try:
                self._commit(Manifest(now.version + 1, schema.json(), now.shards + shards))
                return now.version + 1
            except Conflict:
                continue

    def plan(self, manifest: Manifest) -> list[list[Shard]]:
        """The tiers to merge, smallest shards first."""
        tiers: dict[int, list[Shard]] = defaultdict(list)
        for s in manifest.shards:
            if s.bytes < self.target / 2:
                tiers[int(math.log(max(1, s.bytes), self.ratio))].append(s)
        due = [t for _, t in sorted(tiers.items()) if len(t) >= self.fan_in]
        return [t for t in due if self._files(t) < len(t)]

    def _files(self, shards: list[Shard]) -> int:
        return max(1, round(sum(s.bytes for s in shards) / self.target))

    def compact(self) -> int:
        """Merges tiers until none is due; the last version."""
        while due := self.plan(now := self.manifest()):
            shards = due[0]
            merged = tuple(self._write(self._load(now, shards).coalesce(self._files(shards))))
            gone = {s.path for s in shards}
            while True:
                now = self.manifest()
                if not gone <= {s.path for s in now.shards}:
                    break  # another writer has merged some of them: what was written stays unused
                try:
                    self._commit(Manifest(now.version + 1, now.schema, tuple(s for s in now.shards if s.path not in gone) + merged))
                    break
                except Conflict:
                    continue
        return self.manifest().version

    def _load(self, manifest: Manifest, shards) -> DataFrame:
        schema = T.StructType.fromJson(json.loads(manifest.schema)) if manifest.schema else T.StructType()
        if not shards:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[s.path for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the newest."""
        m = self.manifest(version)
        return self._load(m, m.shards)

    def vacuum(self, keep: int = 1) -> int:
        """Deletes the manifests before the last `keep` and all shards that none of the
        remaining ones lists; the number of shards deleted.  No writer may be active."""
        versions = self.versions()
        for v in versions[:-keep]:
            self.fs.delete(self._path(self._name(v)), False)
        used = {s.path for v in versions[-keep:] for s in self.manifest(v).shards}
        n, at = 0, self._path(f"{self.root}/shards")
        for run in self.fs.listStatus(at) if self.fs.exists(at) else []:
            files = [f.getPath() for f in self.fs.listStatus(run.getPath()) if f.getPath().getName().startswith("part-")]
            free = [f for f in files if f.toString() not in used]
            n += len(free)
            if len(free) == len(files):
                self.fs.delete(run.getPath(), True)
            else:
                for f in free:
                    self.fs.delete(f, False)
        return n


#: Arrivals that the table comes in.
ARRIVALS = 4


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    store = ShardStore(spark, fresh_dir(spark, "store"))
    number = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(ARRIVALS))
    for k in range(ARRIVALS):
        store.append(docs.where(number == k))
        store.compact()
        store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP6_SQL = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
