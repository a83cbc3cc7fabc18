"""Toxicity scores from gradient-boosted trees over dense features.

Features of a text: densities of its words and word beginnings in lexicons that were
learnt from the labels, density of a general lexicon, how near second-person pronouns
stand to such words, capitals, punctuation, and obfuscation (words with symbols or
digits between letters, and lexicon words that show once those are read as letters).
The trees boost the log-loss; isotonic regression on out-of-fold margins turns margins
into probabilities.

Training takes a bounded sample of labelled rows (`sample_rows`), dealt to `FOLDS` folds by
id.  A row's training features come from lexicons that were learnt without its fold, so that
no row is described by its own label, and from nearly as many rows as the lexicons that
texts are scored by: trees and calibration are fitted on features like those that they map.

Null and empty texts have all features 0 and get the score of such a text.  Rows without
an id or a label are not learnt from; without any labelled row all scores are 0, with
labels of one kind only they are that label.  Texts are read whole.  Repeated rows are
scored each, and of a repeated id the least text is learnt from; an empty table gives an empty result.  Columns of the input with the name
of an output are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import U64, Chunk, annotate, bound_batches, chunks, documents, keep_where, stored

SAMPLE_ROWS = 16_000
FOLDS = 5
LEXICON = 4000
THRESHOLD = 0.7

#: General lexicon: insults in four languages.
INSULTS = """
idiot idiots moron morons stupid dumb loser losers trash scum clown pathetic worthless disgusting
imbecile fool garbage vermin filth hate kill jerk bastard bitch shit fuck fucking ugly
connard connasse merde salope idiote débile abruti imbécile ordure crétin
arschloch scheiße dumm dummkopf trottel abschaum hurensohn wichser blöd
estúpido estúpida idiota imbécil mierda puta cabrón basura gilipollas inútil
""".split()
#: Second-person pronouns in the same languages.
SECOND_PERSON = "you your yours yourself u ur tu toi te ton ta tes vous votre vos du dich dir dein deine ihr euch euer tú ti contigo usted ustedes vosotros".split()

_TOKEN = np.zeros(256, bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"0123456789@$*!#%&+|")] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?.,;:'\"-()")] = True
_SHOUT = np.zeros(256, bool)
_SHOUT[list(b"!?")] = True
#: Signs that stand for letters.
_READ = bytes.maketrans(b"0134578@$!|+", b"oieastbasilt")
NEAR = 5
PREFIXES = (5, 7)
FEATURES = 26


def _hashes(words: Sequence[str]) -> np.ndarray:
    out = []
    for c in chunks(pa.array(list(words), pa.string())):
        out.append(c.hashes(c.offs[:-1], c.offs[1:]))
    return np.unique(np.concatenate(out))


def _in(values: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Index of each value in sorted_keys, -1 where it is missing."""
    if not len(sorted_keys):
        return np.full(len(values), -1)
    at = np.minimum(np.searchsorted(sorted_keys, values), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == values, at, -1)


@dataclass(frozen=True)
class Lexicon:
    """Hashes of words and of word beginnings, sorted, with their log-odds."""

    keys: tuple[np.ndarray, ...] = tuple(np.zeros(0, U64) for _ in range(1 + len(PREFIXES)))
    odds: tuple[np.ndarray, ...] = tuple(np.zeros(0) for _ in range(1 + len(PREFIXES)))


class Words:
    """Tokens of a chunk of lower-cased texts, as hashes of words and of beginnings."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.starts, self.ends, self.first = chunk.spans(_TOKEN[chunk.data])
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(chunk.rows), self.count)
        self.kinds = [chunk.hashes(self.starts, self.ends)]
        for n in PREFIXES:
            # a beginning is told from a word by its kind
            self.kinds.append(chunk.hashes(self.starts, np.minimum(self.ends, self.starts + n)))


def lowered(texts: pa.Array) -> list[str]:
    return ["" if t is None else t.lower() for t in texts.to_pylist()]


_INSULTS, _YOU = _hashes(INSULTS), _hashes(SECOND_PERSON)


def features(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """A row of FEATURES numbers for each text."""
    raw = texts.to_pylist()
    low = pa.array(["" if t is None else t.lower() for t in raw], pa.string())
    read = pa.array(["" if t is None else t.encode().translate(_READ).decode().lower() for t in raw], pa.string())
    at, n, out = 0, len(raw), np.zeros((len(raw), FEATURES), np.float32)
    for c in chunks(low):
        rows = slice(at, at + c.rows)
        out[rows, :19] = _lexical(Words(c), lexicon)
        at += c.rows
    at = 0
    for c in chunks(read):
        w = Words(c)
        hits = (_in(w.kinds[0], lexicon.keys[0]) >= 0) | (_in(w.kinds[0], _INSULTS) >= 0)
        out[at : at + c.rows, 19] = np.bincount(w.row[hits], minlength=c.rows) / np.maximum(w.count, 1)
        at += c.rows
    # hits that are there only once signs are read as letters
    out[:, 19] = np.maximum(0, out[:, 19] - out[:, 18])
    at = 0
    for c in chunks(texts.cast(pa.string())):
        d, rows = c.data, slice(at, at + c.rows)
        size = np.maximum(c.offs[1:] - c.offs[:-1], 1)
        letters = np.maximum(c.per_row(_LETTER[d]), 1)
        inner = np.zeros(len(d), bool)
        inner[1:-1] = _SYMBOL[d[1:-1]] & _LETTER[d[:-2]] & _LETTER[d[2:]]
        twice = np.zeros(len(d), bool)
        twice[2:] = (d[2:] == d[1:-1]) & (d[1:-1] == d[:-2]) & _LETTER[d[2:]]
        shout = _SHOUT[d]
        for k, v in enumerate((c.per_row(_UPPER[d]) / letters, c.per_row(_PUNCT[d]) / size, c.per_row(shout) / size, c.per_row(inner) / letters, c.per_row(twice) / letters, np.log1p(size))):
            out[rows, 20 + k] = v
        at += c.rows
    return out


def _lexical(w: Words, lexicon: Lexicon) -> np.ndarray:
    rows, count = w.chunk.rows, np.maximum(w.count, 1)
    cols = []
    strong = np.zeros(len(w.row), bool)
    for kind, keys, odds in zip(w.kinds, lexicon.keys, lexicon.odds, strict=True):
        at = _in(kind, keys)
        hit = at >= 0
        score = np.where(hit, odds[np.maximum(at, 0)] if len(odds) else 0.0, 0.0)
        best = np.zeros(rows)
        np.maximum.at(best, w.row, score)
        total = np.bincount(w.row, score, rows)
        high = hit & (score >= 2.5)
        strong |= high
        n_high = np.bincount(w.row[high], minlength=rows)
        cols += [np.bincount(w.row[hit], minlength=rows) / count, best, total / np.sqrt(count), n_high, n_high / count]
    general, you = _in(w.kinds[0], _INSULTS) >= 0, _in(w.kinds[0], _YOU) >= 0
    cols += [np.bincount(w.row[general], minlength=rows) / count, np.bincount(w.row[you], minlength=rows) / count]
    # offending words with a second-person pronoun within NEAR words of the same text
    bad = np.flatnonzero(general | strong)
    seen = np.zeros(len(w.row) + 1, np.int64)
    np.cumsum(you, out=seen[1:])
    lo = np.maximum(bad - NEAR, w.first[w.row[bad]])
    hi = np.minimum(bad + NEAR + 1, w.first[w.row[bad] + 1])
    near = seen[hi] > seen[lo]
    cols.append(np.bincount(w.row[bad[near]], minlength=rows) / count)
    cols.append(np.bincount(w.row[general | (_in(w.kinds[0], lexicon.keys[0]) >= 0)], minlength=rows) / count)
    return np.stack(cols, axis=1)


@dataclass
class Trees:
    """Gradient-boosted trees on binned features, for binary labels."""

    rounds: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 48
    ridge: float = 1.0
    least: int = 5
    edges: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    #: of each tree: feature and bin of each inner node (bin -1: no split), value of each leaf
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "right") for k, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        qs = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = []
        for k in range(x.shape[1]):
            v = x[:, k]
            some = v[v != 0]
            # most features are 0 in most rows: half of the edges are for the others
            self.edges.append(np.unique(np.concatenate([np.quantile(v, qs[::2]), np.quantile(some, qs[::2])] if len(some) else [v[:1]]).astype(np.float32)))
        b = self._bin(x)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        nb, nf = self.bins + 2, x.shape[1]
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, np.maximum(prob * (1 - prob), 1e-6)
            node = np.zeros(len(y), np.int64)
            feat, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, -1, np.int64)
            for level in range(self.depth):
                first, n = 2**level - 1, 2**level
                gain, where = np.zeros(n), np.full((n, 2), -1, np.int64)
                for k in range(nf):
                    at = (node - first) * nb + b[:, k]
                    gs, hs, cs = (np.bincount(at, w, n * nb).reshape(n, nb).cumsum(axis=1) for w in (g, h, np.ones(len(y))))
                    left = (gs[:, :-1], hs[:, :-1], cs[:, :-1])
                    right = tuple(s[:, -1:] - s[:, :-1] for s in (gs, hs, cs))
                    worth = left[0] ** 2 / (left[1] + self.ridge) + right[0] ** 2 / (right[1] + self.ridge) - gs[:, -1:] ** 2 / (hs[:, -1:] + self.ridge)
                    worth = np.where((left[2] >= self.least) & (right[2] >= self.least), worth, 0.0)
                    top = worth.argmax(axis=1)
                    better = worth[np.arange(n), top] > gain + 1e-9
                    gain[better] = worth[np.arange(n), top][better]
                    where[better] = np.stack([np.full(n, k), top], axis=1)[better]
                feat[first : first + n], cut[first : first + n] = np.maximum(where[:, 0], 0), where[:, 1]
                go = (cut[node] >= 0) & (b[np.arange(len(y)), feat[node]] > cut[node])
                node = 2 * node + 1 + go
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            f += value[leaf]
            self.trees.append((feat, cut, value))
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._bin(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feat, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                go = (cut[node] >= 0) & (b[rows, feat[node]] > cut[node])
                node = 2 * node + 1 + go
            f += value[node - (2**self.depth - 1)]
        return f


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of the non-decreasing function of x nearest to y (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order].astype(float)
    blocks: list[list[float]] = []  # sum, count, least x, greatest x
    for a, b in zip(x, y, strict=True):
        blocks.append([b, 1, a, a])
        while len(blocks) > 1 and (blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1] or blocks[-2][3] == blocks[-1][2]):
            s, c, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2], hi]
    at = np.array([v for b in blocks for v in (b[2], b[3])])
    return at, np.repeat([b[0] / b[1] for b in blocks], 2)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: Trees | None
    points: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))
    constant: float = 0.0

    def score(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.constant)
        return np.clip(np.interp(self.trees.margin(features(texts, self.lexicon)), *self.points), 0.0, 1.0)


def _count_words():
    def run(batches):
        for b in batches:
            fold, toxic = b.column(0).to_numpy(), b.column(1).to_numpy()
            low, at = pa.array(lowered(b.column(2)), pa.string()), 0
            for c in chunks(low):
                w = Words(c)
                for kind, codes in enumerate(w.kinds):
                    seen = np.unique(np.stack([w.row.astype(U64), codes], axis=1), axis=0) if len(codes) else np.zeros((0, 2), U64)
                    row = seen[:, 0].astype(np.int64) + at
                    key, back = np.unique(seen[:, 1], return_inverse=True)
                    for f in range(FOLDS):
                        mine = fold[row] == f
                        yes = np.bincount(back[mine], toxic[row[mine]], len(key)).astype(np.int64)
                        both = np.bincount(back[mine], minlength=len(key))
                        has = np.flatnonzero(both)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(has), v)) if np.isscalar(v) else pa.array(v[has]) for v in (kind, f, key.view(np.int64), yes, both)], ["kind", "fold", "key", "yes", "n"])
                at += c.rows

    return run


def _lexicons(sample: DataFrame, totals: dict[int, tuple[int, int]]) -> list[Lexicon]:
    """Lexicons without each of the folds, and of all, at most LEXICON entries of a kind."""
    counts = stored(sample.select("fold", "toxic", "text").mapInArrow(_count_words(), "kind long, fold long, key long, yes long, n long").groupBy("kind", "fold", "key").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")), "lexicon")
    out = []
    for left in range(FOLDS + 1):
        folds = [f for f in range(FOLDS) if f != left]
        pos, neg = sum(totals[f][0] for f in folds), sum(totals[f][1] for f in folds)
        odds = F.log((F.col("yes") + 0.1) / (pos + 1.0)) - F.log((F.col("n") - F.col("yes") + 0.5) / (neg + 1.0))
        own = counts.where(F.col("fold").isin(*folds)).groupBy("kind", "key").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n"))
        own = own.where("yes >= 3").withColumn("odds", odds).where("odds > 1").withColumn("weight", F.col("odds") * F.sqrt("yes"))
        keys, values = [], []
        for kind in range(1 + len(PREFIXES)):
            got = own.where(F.col("kind") == kind).orderBy(F.desc("weight"), "key").limit(LEXICON).select("key", "odds").toPandas()
            k = got["key"].to_numpy(np.int64).view(U64)
            order = np.argsort(k)
            keys.append(k[order])
            values.append(got["odds"].to_numpy(float)[order])
        out.append(Lexicon(tuple(keys), tuple(values)))
    return out


def _describe(lexicons: list[Lexicon]):
    def run(batches):
        for b in batches:
            fold = b.column(0).to_numpy()
            x = np.zeros((len(fold), FEATURES), np.float32)
            for f in np.unique(fold):
                rows = np.flatnonzero(fold == f)
                x[rows] = features(b.column(2).take(pa.array(rows)), lexicons[f])
            yield pa.RecordBatch.from_arrays([b.column(1), *[pa.array(x[:, k]) for k in range(FEATURES)]], ["toxic", *[f"x{k}" for k in range(FEATURES)]])

    return run


def train(df: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model from at most `sample_rows` labelled rows, those of least hash of the id.
    `labels` has id and label; an id with several labels counts as toxic if one says so."""
    bound_batches(df.sparkSession)
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("long")).alias("toxic"))
    h = F.xxhash64("__id", F.lit(3))
    chosen = ids.orderBy(h, "__id").limit(sample_rows).withColumn("fold", F.pmod(F.xxhash64("__id", F.lit(4)), F.lit(FOLDS)))
    # at most sample_rows rows of three integers
    sample = df.select(F.col(f"`{id_col}`").alias("__id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(chosen), "__id")
    sample = sample.groupBy("__id").agg(F.min(F.struct("text", "fold", "toxic")).alias("r")).select("r.fold", "r.toxic", "r.text")
    sample = stored(sample, "sample")
    totals = dict.fromkeys(range(FOLDS), (0, 0)) | {r[0]: (r[1], r[2]) for r in sample.groupBy("fold").agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).collect()}
    pos, neg = (sum(t[k] for t in totals.values()) for k in (0, 1))
    if not pos or not neg:
        return Model(Lexicon(), None, constant=float(pos > 0))
    lexicons = _lexicons(sample, totals)
    got = sample.mapInArrow(_describe(lexicons[:FOLDS]), "toxic long, " + ", ".join(f"x{k} float" for k in range(FEATURES))).toPandas()
    got = got.sort_values(list(got.columns), kind="stable")
    y, x = got["toxic"].to_numpy(float), got[[f"x{k}" for k in range(FEATURES)]].to_numpy(np.float32)
    part, margin = np.arange(len(y)) % 4, np.zeros(len(y))
    for k in range(4):
        fit, rest = part != k, part == k
        margin[rest] = Trees().fit(x[fit], y[fit]).margin(x[rest]) if 0 < y[fit].sum() < fit.sum() else 0.0
    return Model(lexicons[FOLDS], Trees().fit(x, y), isotonic(margin, y))


def _score(model: Model, threshold: float):
    def fn(texts: pa.Array) -> list:
        s = model.score(texts)
        return [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))]

    return fn


def _clean(model: Model, threshold: float):
    def fn(texts: pa.Array) -> list:
        return [pa.array(model.score(texts) < threshold)]

    return fn


def score(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD, keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns (or those in `keep`) with score and predicted."""
    return annotate(df, text_col, "score double, predicted int", partial(_score, model, threshold), keep)


def filter_clean(df: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows that score below the threshold; columns unchanged."""
    return keep_where(df, text_col, partial(_clean, model, threshold))


def learnt(id_col: str) -> Column:
    """Whether labels of an id may be learnt from; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(learnt("doc_id")))
    out = score(docs, model, keep=["doc_id"])
    return out.select("doc_id", F.coalesce(~learnt("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")
