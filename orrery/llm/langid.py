"""Language identification with hyperdimensional profiles.

Every letter owns a random vector of +1 and -1.  A run of three letters is bound into
one vector, the product of its letters' vectors, each permuted (rolled) by its place;
what is no letter is one boundary symbol.  A document is the bundle (sum) of its runs,
a language the bundle of its training documents.  Languages are compared with a document
by cosine, after the mean direction that all languages share is taken off both sides.

Null texts and texts without a letter are `und` with score 0.  Rows with a null or empty
language are not learnt from; without a learnt language every text is `und`.  Ties go to
the least language name.  Texts are read whole.  Repeated rows are predicted each, empty
tables give empty results.  Columns of the input with the name of an output are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import U64, annotate, bound_batches, chunks, documents, give_back, mix

DIMENSIONS = 2048
#: Vectors of runs that a worker keeps.
KEPT = 24_000
#: Languages whose prototypes are brought together.
MAX_LANGUAGES = 4096
UNKNOWN = "und"


class Space:
    """Vectors of letters and of runs of three letters, as a worker needs them."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.d = dimensions
        self.index = np.full(0x110000, -1, np.int32)  # of a code point's letter; 0: no letter
        self.letters: list[int] = [0]
        self.rolled = np.zeros((3, 0, dimensions), np.int8)
        self.base = 64
        self._forget()

    def _forget(self) -> None:
        self.place = np.full(self.base**3, -1, np.int32) if self.base <= 256 else {}
        self.runs = np.zeros((KEPT, self.d), np.int8)
        self.known = 0

    def _learn_letters(self, points: np.ndarray) -> None:
        at = {p: i for i, p in enumerate(self.letters)}
        for p in np.unique(points).tolist():
            c = chr(p)
            low = ord(c.lower()[0]) if c.isalpha() else 0
            if low not in at:
                at[low] = len(self.letters)
                self.letters.append(low)
            self.index[p] = at[low]
        have = self.rolled.shape[1]
        new = np.array(self.letters[have:], np.int64)
        words = np.arange(self.d // 64, dtype=np.uint64)
        bits = mix(mix(new.astype(U64)[:, None] + U64(1)) + words[None, :] * U64(0xD1342543DE82EF95))
        signs = (np.unpackbits(bits.view(np.uint8), axis=1).astype(np.int8) * 2 - 1) if len(new) else np.zeros((0, self.d), np.int8)
        self.rolled = np.concatenate([self.rolled, np.stack([np.roll(signs, k, axis=1) for k in (2, 1, 0)])], axis=1)
        if len(self.letters) > self.base:
            while len(self.letters) > self.base:
                self.base *= 2
            self._forget()

    def codes(self, points: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the runs of all rows, bounds of the rows in them, and whether a row
        has a letter.  A row begins and ends with a boundary."""
        got = self.index[points]
        if (got < 0).any():
            self._learn_letters(points[got < 0])
            got = self.index[points]
        n, rows = len(points), len(offs) - 1
        row = np.repeat(np.arange(rows), np.diff(offs))
        line = np.zeros(n + 2 * rows, np.int32)
        line[np.arange(n) + 2 * row + 1] = got
        heads = offs[:-1] + 2 * np.arange(rows)
        keep = np.ones(len(line), bool)
        keep[1:] = (line[1:] != 0) | (line[:-1] != 0)
        keep[heads] = True
        at = np.cumsum(keep) - keep
        begin = np.append(at[heads], int(keep.sum()))
        line = line[keep].astype(np.int64)
        lettered = np.add.reduceat(line, begin[:-1]) > 0 if rows else np.zeros(0, bool)
        return (line[:-2] * self.base + line[1:-1]) * self.base + line[2:], begin, lettered

    def _places(self, codes: np.ndarray) -> np.ndarray:
        """Where the vectors of at most KEPT distinct codes are kept."""
        look = (lambda: self.place[codes]) if self.base <= 256 else (lambda: np.array([self.place.get(c, -1) for c in codes.tolist()], np.int32))
        at = look()
        new = codes[at < 0]
        if len(new):
            if self.known + len(new) > KEPT:
                self._forget()
                new = codes
            a, rest = new // (self.base * self.base), new % (self.base * self.base)
            ids = np.arange(self.known, self.known + len(new), dtype=np.int32)
            self.runs[ids] = self.rolled[0, a] * self.rolled[1, rest // self.base] * self.rolled[2, rest % self.base]
            self.known += len(new)
            if self.base <= 256:
                self.place[new] = ids
            else:
                self.place.update(zip(new.tolist(), ids.tolist(), strict=True))
            at = look()
        return at

    def bundle(self, codes: np.ndarray) -> np.ndarray:
        """Sum of the vectors of runs given by their codes."""
        if self.base <= 256:
            at = self.place[codes]
            if (at < 0).any() and self.known + len(new := np.unique(codes[at < 0])) <= KEPT:
                self._places(new)
                at = self.place[codes]
            if len(at) and at.min() >= 0:
                count = np.bincount(at)
                ids = np.flatnonzero(count)
                return self._sum(count[ids], ids)
        codes, count = np.unique(codes, return_counts=True)
        out = np.zeros(self.d, np.float32)
        for i in range(0, len(codes), 4096):
            out += self._sum(count[i : i + 4096], self._places(codes[i : i + 4096]))
        return out

    def _sum(self, count: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Sum of the kept vectors at `at`, each as often as `count` says."""
        out = np.zeros(self.d, np.float32)
        for i in range(0, len(at), 2048):
            out += count[i : i + 2048].astype(np.float32) @ self.runs[at[i : i + 2048]].astype(np.float32)
        return out


def _rows(space: Space, texts: pa.Array):
    """Row number and codes of each text (None without a letter), in order."""
    i = 0
    for c in chunks(texts):
        head = np.zeros(len(c.data) + 1, np.int64)
        np.cumsum((c.data & 0xC0) != 0x80, out=head[1:])
        points = np.frombuffer(c.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        codes, begin, lettered = space.codes(points, head[c.offs])
        for k in range(c.rows):
            yield i, codes[begin[k] : max(begin[k], begin[k + 1] - 2)] if lettered[k] else None
            i += 1


@dataclass(frozen=True)
class Profiles:
    """Prototypes: one row of `vectors` for each of `languages` (sorted)."""

    languages: tuple[str, ...]
    vectors: np.ndarray

    @property
    def dimensions(self) -> int:
        return self.vectors.shape[1]

    def compare(self, bundles: np.ndarray) -> np.ndarray:
        """Cosines of document bundles (rows) with the languages (columns)."""
        unit = self.vectors / np.maximum(np.linalg.norm(self.vectors, axis=1, keepdims=True), 1e-12)
        if len(unit) > 1:
            shared = unit.mean(axis=0)
            shared /= max(np.linalg.norm(shared), 1e-12)
            off = lambda x: x - (x @ shared)[:, None] * shared[None, :]
            unit, bundles = off(unit), off(bundles)
            unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-12)
        return bundles @ unit.T / np.maximum(np.linalg.norm(bundles, axis=1, keepdims=True), 1e-12)


def _learn(dimensions: int):
    def run(batches):
        space, total = Space(dimensions), {}
        for b in batches:
            langs, parts = b.column(0).to_pylist(), {}
            for i, codes in _rows(space, b.column(1)):
                if codes is not None:
                    parts.setdefault(langs[i], []).append(codes)
                if codes is not None and space.base > 64 and len(parts[langs[i]]) > 64:
                    parts[langs[i]] = [np.concatenate(parts[langs[i]])]
            for lang, codes in parts.items():
                total[lang] = total.get(lang, 0) + space.bundle(np.concatenate(codes))
        del space
        give_back()
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(np.rint(v).astype(np.int64))], ["lang", "k", "v"])

    return run


def learn(df: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS) -> Profiles:
    """The prototypes of all languages in df's rows.  Each task bundles its rows; only
    one vector for each task and language is shuffled."""
    bound_batches(df.sparkSession)
    lang = F.col(f"`{lang_col}`").cast("string")
    rows = df.select(lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where("lang <> '' and text is not null")
    sums = rows.mapInArrow(_learn(dimensions), "lang string, k int, v long").groupBy("lang", "k").agg(F.sum("v").alias("v"))
    got = sums.limit(MAX_LANGUAGES * dimensions + 1).toPandas()
    langs = sorted(got["lang"].unique())
    if len(langs) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    vectors = np.zeros((len(langs), dimensions))
    vectors[np.searchsorted(langs, got["lang"].to_numpy(str)) if langs else [], got["k"].to_numpy(int)] = got["v"]
    return Profiles(tuple(langs), vectors)


def _predict(profiles: Profiles):
    names = np.array([*profiles.languages, UNKNOWN], object)
    space = Space(profiles.dimensions)

    def fn(texts: pa.Array) -> list:
        best, score = np.full(len(texts), len(names) - 1), np.zeros(len(texts))
        held: list[tuple[int, np.ndarray]] = []

        def flush() -> None:
            if held:
                cos = profiles.compare(np.stack([v for _, v in held]))
                at = np.array([i for i, _ in held])
                best[at] = cos.argmax(axis=1)
                score[at] = np.clip(cos.max(axis=1), 0, 1)
                held.clear()

        for i, codes in _rows(space, texts):
            if codes is not None and len(names) > 1:
                held.append((i, space.bundle(codes)))
                if len(held) == 256:
                    flush()
        flush()
        return [pa.array(names[best].tolist(), pa.string()), pa.array(score)]

    return fn


def identify(df: DataFrame, profiles: Profiles, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns (or those in `keep`) with lang_pred and score."""
    return annotate(df, text_col, "lang_pred string, score double", partial(_predict, profiles), keep)


def remainder(id_col: str, n: int) -> Column:
    """crc32 of an id as text modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(n))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    profiles = learn(docs.where(remainder("doc_id", 4) != 2))
    out = identify(docs, profiles, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
