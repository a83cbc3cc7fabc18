"""Quality rules as a short-circuit cascade.

A rule rejects a text by a condition on its statistics.  The order in which rules run
decides only the cost: `plan` measures each rule's seconds and rejections on a bounded
sample and orders the rules by rejections per second (equal ones by name); `Cascade` then
runs every rule only on the texts that all rules before it let pass.  What a run computes
for every text anyway costs its rules nothing, and isn't measured.  The verdict, that no
rule rejects, is the same in any order.

Null, empty and white-space texts have no word: all their counts are 0 and the base
rule rejects them.  Texts of any length are judged whole.  An empty table gives an empty result with the same columns.
Repeated rows are judged one by one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import U64, Chunk, annotate, chunks, documents, keep_where, mix, ngram_hashes

#: Characters that count as symbols.
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_ODD = U64(0x9FB21C651E98DF25)

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeats(codes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Marks the codes that another item of the same row has, too."""
    keyed = mix(codes ^ (rows.astype(U64) * _ODD))
    order = np.argsort(keyed)
    s = keyed[order]
    same = np.zeros(len(s) + 1, bool)
    same[1:-1] = s[1:] == s[:-1]
    out = np.empty(len(s), bool)
    out[order] = same[1:] | same[:-1]
    return out


class Stats:
    """Statistics of a chunk's texts, each computed when a rule first asks for it."""

    def __init__(self, chunk: Chunk):
        self.chunk = chunk
        self.starts, self.ends, self.first = chunk.words()
        self.n_words = np.diff(self.first)
        self._got: dict[str, np.ndarray] = {}

    def __getattr__(self, name: str) -> np.ndarray:
        if name.startswith("_") or not hasattr(type(self), f"_{name}"):
            raise AttributeError(name)
        if name not in self._got:
            self._got[name] = getattr(self, f"_{name}")()
        return self._got[name]

    def _word_chars(self):
        d = self.chunk.data
        white = np.zeros(256, bool)
        white[[32, 9, 10, 11, 12, 13]] = True
        return self.chunk.per_row(_HEAD[d] & ~white[d])

    def _n_symbols(self):
        return self.chunk.per_row(_SYMBOL[self.chunk.data])

    def _n_letters(self):
        return self.chunk.per_row(_LETTER[self.chunk.data])

    def _n_upper(self):
        return self.chunk.per_row(_UPPER[self.chunk.data])

    def _n_lower(self):
        return self.chunk.per_row(_LOWER[self.chunk.data])

    def _lines(self):
        """Rows and hashes of the lines that have a word."""
        c = self.chunk
        starts, ends, first = c.spans(c.data != 10)
        words = np.zeros(len(c.data) + 1, np.int64)
        words[self.starts + 1] = 1
        np.cumsum(words, out=words)
        full = words[ends] > words[starts]
        rows = np.repeat(np.arange(c.rows), np.diff(first))[full]
        return rows, c.hashes(starts[full], ends[full])

    def _n_lines(self):
        return np.bincount(self.lines[0], minlength=self.chunk.rows)

    def _n_dup_lines(self):
        rows, codes = self.lines
        keyed = mix(codes ^ (rows.astype(U64) * _ODD))
        order = np.argsort(keyed)
        s = keyed[order]
        later = np.zeros(len(s), bool)
        later[1:] = s[1:] == s[:-1]
        return np.bincount(rows[order[later]], minlength=self.chunk.rows)

    def _n_repeat_words(self):
        c = self.chunk
        codes, at = ngram_hashes(c.hashes(self.starts, self.ends), self.first, 3)
        row_of = np.repeat(np.arange(c.rows), self.n_words)
        hit = np.zeros(len(self.starts) + 2, bool)
        again = at[repeats(codes, row_of[at])] if len(at) else at
        for k in range(3):
            hit[again + k] = True
        return np.bincount(row_of[hit[: len(row_of)]], minlength=c.rows)

    def take(self, rows: np.ndarray) -> Stats:
        """The statistics of some rows only; what is known already is kept."""
        c = self.chunk
        if len(rows) == c.rows:
            return self
        parts = [c.data[c.offs[r] : c.offs[r + 1]] for r in rows]
        offs = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(p) for p in parts], out=offs[1:])
        out = Stats(Chunk(np.concatenate(parts) if parts else c.data[:0], offs))
        out._got = {k: v[rows] for k, v in self._got.items() if isinstance(v, np.ndarray)}
        return out


@dataclass(frozen=True)
class Rule:
    """`rejects` maps Stats to a boolean array, true where a text is rejected."""

    name: str
    rejects: Callable[[Stats], np.ndarray]


def _base(s: Stats) -> np.ndarray:
    return (s.n_words < 50) | (100 * s.n_repeat_words > 50 * s.n_words)


def _symbols(s: Stats) -> np.ndarray:
    return 10 * s.n_symbols > s.n_words


def _word_length(s: Stats) -> np.ndarray:
    return (s.word_chars < 2 * s.n_words) | (s.word_chars > 15 * s.n_words)


def _dup_lines(s: Stats) -> np.ndarray:
    return 100 * s.n_dup_lines > 50 * s.n_lines


def _letters(s: Stats) -> np.ndarray:
    return 2 * s.n_letters < s.word_chars


def _shouting(s: Stats) -> np.ndarray:
    return s.n_upper > 2 * s.n_lower


BASE_RULE = Rule("base", _base)
#: Rules besides the base rule: at most one symbol for ten words, 2 to 15 characters a
#: word, at most half of the lines repeated, half of the word characters letters, and
#: at most two capitals for one small letter.
RULES = (
    Rule("symbols", _symbols),
    Rule("word_length", _word_length),
    Rule("dup_lines", _dup_lines),
    Rule("letters", _letters),
    Rule("shouting", _shouting),
)


@dataclass(frozen=True)
class Measured:
    """What the sample shows of a rule."""

    name: str
    seconds_per_text: float
    rejected: float

    @property
    def worth(self) -> float:
        """Rejections per second."""
        return self.rejected / max(self.seconds_per_text, 1e-12)


#: Statistics that `judge` reports and so computes for every text.
REPORTED = ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measure(texts: Sequence[str | None], rules: Sequence[Rule] = RULES, known: Sequence[str] = ()) -> list[Measured]:
    """Cost and selectivity of each rule alone, where the statistics `known` are there
    already; without texts both are 0."""
    n, out = max(1, len(texts)), []
    parts = list(chunks(pa.array(texts, pa.string())))
    for rule in rules:
        spent = rejected = 0.0
        for c in parts:
            s = Stats(c)
            for name in known:
                getattr(s, name)
            began = time.perf_counter()
            hit = rule.rejects(s)
            spent += time.perf_counter() - began
            rejected += int(hit.sum())
        out.append(Measured(rule.name, spent / n, rejected / n))
    return out


def plan(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, sample_rows: int = 1000, sample_chars: int = 20_000, known: Sequence[str] = ()) -> tuple[list[Rule], list[Measured]]:
    """The rules by rejections per second, best first, and what was measured.

    About `sample_rows` texts, a random sample of all and never more than twice as many, are
    measured, and of each its first `sample_chars` characters: only the order of the rules
    depends on them."""
    t = F.substring(F.col(f"`{text_col}`").cast("string"), 1, sample_chars).alias("t")
    share = min(1.0, sample_rows / max(1, df.count()))
    rows = df.select(t).sample(share, seed=5).limit(2 * sample_rows).collect()
    got = measure([r["t"] for r in rows], rules, known)
    worth = {m.name: m.worth for m in got}
    return sorted(rules, key=lambda r: (-worth[r.name], r.name)), got


class Cascade:
    """Runs rules in their order, each on what the rules before it let pass."""

    def __init__(self, rules: Sequence[Rule]):
        self.rules = list(rules)

    def kept(self, stats: Stats, alive: np.ndarray | None = None) -> np.ndarray:
        keep = np.ones(stats.chunk.rows, bool) if alive is None else alive.copy()
        at, s = np.flatnonzero(keep), None
        for rule in self.rules:
            if not len(at):
                break
            s = stats.take(at) if s is None else s
            ok = ~rule.rejects(s)
            if not ok.all():
                at, s = at[ok], s.take(np.flatnonzero(ok))
        keep[:] = False
        keep[at] = True
        return keep


def _judge(rules: Sequence[Rule]):
    cascade = Cascade(rules)

    def fn(texts: pa.Array) -> list:
        out: list[list[np.ndarray]] = [[] for _ in range(7)]
        for c in chunks(texts):
            s = Stats(c)
            failed = _base(s)
            kept = cascade.kept(s, ~failed)
            for to, x in zip(out, (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words, failed, kept), strict=True):
                to.append(x)
        return [np.concatenate(x) if x else np.zeros(0, np.int64 if k < 5 else bool) for k, x in enumerate(out)]

    return fn


def _filter(rules: Sequence[Rule]):
    cascade = Cascade(rules)

    def fn(texts: pa.Array) -> list:
        kept = [cascade.kept(Stats(c)) for c in chunks(texts)]
        return [np.concatenate(kept) if kept else np.zeros(0, bool)]

    return fn


def judge(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns (or those in `keep`) with the base statistics, base_failed and kept.

    The base statistics are computed for each text; the other rules run as a cascade
    on texts that the base rule passes.  Rules default to `plan`'s order of RULES.
    Columns of df with the name of an output are left out."""
    rules = plan(df, text_col, known=REPORTED)[0] if rules is None else rules
    return annotate(df, text_col, f"{BASE}, kept boolean", partial(_judge, rules), keep)


def filter_kept(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] | None = None) -> DataFrame:
    """The rows that no rule, the base rule among them, rejects; columns unchanged.
    All rules, the base rule too, run in the order of their worth."""
    rules = plan(df, text_col, (BASE_RULE, *RULES))[0] if rules is None else rules
    return keep_where(df, text_col, partial(_filter, rules))


def op5_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir), keep=["doc_id"])


OP5_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM t),
g AS (SELECT *, list_transform(range(1, len(ws) - 1), lambda i: ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2]) AS tri,
             list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl FROM w),
h AS (SELECT doc_id, i, g FROM (SELECT doc_id, generate_subscripts(tri, 1) AS i, unnest(tri) AS g FROM g)),
r AS (SELECT doc_id, i FROM h QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
n AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
s AS (
  SELECT g.doc_id, len(ws)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines,
    coalesce(k, 0)::BIGINT AS n_repeat_words,
    len(wl) AS n_lines,
    length(regexp_replace(text, '[^A-Za-z\x{80}-\x{10FFFF}]', '', 'g')) AS n_letters,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    length(regexp_replace(text, '[^a-z]', '', 'g')) AS n_lower
  FROM g LEFT JOIN n ON g.doc_id = n.doc_id),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
  AND NOT 10 * n_symbols > n_words
  AND NOT (word_chars < 2 * n_words OR word_chars > 15 * n_words)
  AND NOT 100 * n_dup_lines > 50 * n_lines
  AND NOT 2 * n_letters < word_chars
  AND NOT n_upper > 2 * n_lower AS kept
FROM b
"""
