"""Vectorised text primitives shared by the operators of this subpackage.

Texts arrive as Arrow string columns.  Their UTF-8 buffers are viewed as NumPy
arrays and handled in chunks of whole rows, so that the temporaries of a chunk
stay bounded however many rows a batch has.  A single row larger than the
chunk size makes a chunk of its own.
"""

from __future__ import annotations

import ctypes
import ctypes.util
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 1 << 19
#: Texts that come to a Python worker at once.
BATCH_BYTES = 4 << 20

#: Space and the five controls 0x09-0x0D.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 9, 10, 11, 12, 13]] = True

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_rng = np.random.Generator(np.random.PCG64(20240229))
#: A random odd number for each byte.
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=U64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising permutation of 64-bit integers (splitmix64)."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_pow: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each.
    Those of a usual chunk are kept, those of a longer text are not."""
    if _pow and len(_pow[0]) >= n:
        return _pow[0], _pow[1]
    made = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(max(n, CHUNK_BYTES + 1), base, U64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        made.append(p)
    if n <= CHUNK_BYTES + 1:
        _pow[:] = made
    return made[0], made[1]


class Chunk:
    """Rows of UTF-8 text: `data` holds the bytes, row i is data[offs[i]:offs[i + 1]]."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.rows = data, offs, len(offs) - 1
        self._sums: np.ndarray | None = None

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte flag over each row."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]

    def spans(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of flagged bytes that don't cross rows: starts, ends and, with
        one entry more than there are rows, the index of each row's first run."""
        n = len(inside)
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = self.offs[1:] > self.offs[:-1]
        before[self.offs[:-1][full]] = False
        after[self.offs[1:][full] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offs)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of bytes other than ASCII white space, as `spans` gives them."""
        return self.spans(~WHITE[self.data])

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte ranges; equal bytes give equal hashes in any chunk."""
        up, down = _powers(len(self.data) + 1)
        if self._sums is None:
            self._sums = np.zeros(len(self.data) + 1, U64)
            np.cumsum(_BYTE[self.data] * up[: len(self.data)], out=self._sums[1:])
        h = (self._sums[ends] - self._sums[starts]) * down[starts]
        return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """A string column in chunks of whole rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_binary())
    n = len(texts)
    if not n:
        return
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, "right")) - 1)
        yield Chunk(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


def ngram_hashes(hashes: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Order-sensitive hashes of all n consecutive items within rows, and the index of
    each window's first item.  `first` is as in `Chunk.spans`.  Rows of fewer items
    have no window."""
    m = len(hashes)
    if m < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    code = np.zeros(m - n + 1, U64)
    for k in range(n):
        code = code * U64(0xC2B2AE3D27D4EB4F) + hashes[k : m - n + 1 + k]
    ok = np.ones(m - n + 1, bool)
    # a window that starts within n - 1 items of the next row's first crosses into it
    bounds = first[1:-1]
    for k in range(1, n):
        b = bounds - k
        b = b[(b >= 0) & (b < len(ok))]
        ok[b] = False
    at = np.flatnonzero(ok)
    return mix(code[at]), at


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


Kernel = Callable[[pa.Array], list]


def _annotator(kernel: Callable[[], Kernel], names: Sequence[str], where: str | None):
    def run(batches):
        fn = None
        for batch in batches:
            fn = fn or kernel()
            texts, rest = batch.column(batch.num_columns - 1), list(batch.columns[:-1])
            made = [x if isinstance(x, pa.Array) else pa.array(x) for x in fn(texts)]
            if where is None:
                yield pa.RecordBatch.from_arrays(rest + made, names)
            else:
                yield pa.RecordBatch.from_arrays(rest, names).filter(made[0])
        # a worker outlives its task: what the kernel holds must not
        del fn
        give_back()

    return run


def give_back() -> None:
    """Returns unused memory of this process to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (libc := ctypes.util.find_library("c")) and hasattr(lib := ctypes.CDLL(libc), "malloc_trim"):
        lib.malloc_trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lets a Python worker get at most BATCH_BYTES at once (or one row), so that its
    memory doesn't depend on how long the texts of ten thousand rows are."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def annotate(df: DataFrame, text_col: str, out: str, kernel: Callable[[], Kernel], keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns `keep` (default: all) with the columns of the DDL string `out`
    that a kernel computes from whole texts, batch by batch.

    `kernel` is called once in each task and returns a function from an Arrow
    string array to one array for each column of `out`.  A kept column that has the
    name of an output is left out."""
    bound_batches(df.sparkSession)
    schema = T._parse_datatype_string(out)
    new = {f.name.lower() for f in schema}
    kept = [f for f in df.schema if (keep is None or f.name in keep) and f.name.lower() not in new]
    text = free_name(df, "__text")
    src = df.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text_col}`").cast("string").alias(text))
    full = T.StructType(kept + list(schema))
    return src.mapInArrow(_annotator(kernel, full.names, None), full)


def keep_where(df: DataFrame, text_col: str, kernel: Callable[[], Kernel]) -> DataFrame:
    """df's rows whose text the kernel marks true; all columns unchanged."""
    bound_batches(df.sparkSession)
    text = free_name(df, "__text")
    src = df.select("*", F.col(f"`{text_col}`").cast("string").alias(text))
    return src.mapInArrow(_annotator(kernel, df.columns, "keep"), df.schema)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors reach.  Where it is unset
    a local session (as in tests) gets one of its own; a cluster has to name it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + os.path.join(tempfile.gettempdir(), f"orrery-{os.getpid()}")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(at)
    return at


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def hadoop(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path as its object."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written as a table in the shared folder and read again: cuts the lineage
    and survives the loss of executors."""
    at = fresh_dir(df.sparkSession, what)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


class Scratch:
    """Tables in the shared folder that are removed when a `with` block ends, by when all
    that needs them has been written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for p in self.paths:
            remove(self.spark, p)

    def stored(self, df: DataFrame, what: str) -> DataFrame:
        at = fresh_dir(self.spark, what)
        self.paths.append(at)
        df.write.parquet(at)
        return self.spark.read.schema(df.schema).parquet(at)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")
