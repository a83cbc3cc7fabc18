"""Benchmark decontamination by one Aho-Corasick automaton.

Words are runs of ASCII letters and digits (A-Z lower-cased) and of all characters
beyond ASCII.  A benchmark item has a window for each ten consecutive words; an item of
fewer words is one window.  One automaton over the words of all items scans the
normalised words of a text once and finds where windows may lie; occurrences mark their
words, and word numbers lead back to characters of the original text.

Each task builds the automaton from the items, which are broadcast: a benchmark is a
fixed set, whose size is checked against `max_bytes` and doesn't grow with the texts.  A
larger benchmark is dealt into parts below that, each of which scans the texts once; the
marks of all parts are joined at the end.

Null and empty texts have no word and no hit; texts of any length are scanned whole.  An item without a word has no window.
A null item_id counts as the empty string.  Repeated items count once, by item_id;
repeated documents are scanned each.  Empty tables give no hits or no rows.  Columns
of the input that have the name of an output are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence
from functools import partial

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import annotate, documents, free_name, keep_where, stored

WINDOW = 10
#: Texts of a benchmark that are broadcast at once; the automaton takes up to about 25 times as much.
MAX_BYTES = 32 << 20
#: Places of pieces among the items that are compared at once.
PLACES = 1 << 16
_PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = regex.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text: str | None) -> list[bytes]:
    """The normalised words in UTF-8."""
    return (text or "").encode().translate(_PLAIN).split()


class Scanner:
    """The automaton of (item_id, text) rows.

    Words are numbered, and a number is written as `digits` characters.  The automaton's
    patterns are an item's consecutive pieces of half a window (so that every window has a
    whole piece) and the whole of each item that is shorter than a window.  A piece that
    is found is extended to both sides as far as item and text agree; a run of a window's
    length is an occurrence.  There are about as many nodes as the items' words have
    characters in this spelling, however many windows overlap."""

    def __init__(self, items: Sequence[tuple[str, str]], window: int = WINDOW):
        self.window, half = window, max(1, window // 2)
        texts = [(item, words(text)) for item, text in items]
        number: dict[bytes, int] = {}
        for _, ws in texts:
            for w in ws:
                number.setdefault(w, len(number))
        self.digits = d = max(1, math.ceil(math.log(max(2, len(number)), 64)))
        # each place has characters of its own, so that no match begins inside a word
        self.spell = {w: "".join(chr(64 * k + (n >> 6 * k) % 64) for k in range(d)) for w, n in number.items()}
        self.other = chr(64 * d) * d
        # the items' word numbers one after another, -1 between them
        ids, self.names, starts = [-1], [], []
        for item, ws in texts:
            starts.append(len(ids))
            ids.extend(map(number.__getitem__, ws))
            ids.append(-1)
            self.names.append(item)
        self.ids = np.array(ids, np.int32)
        self.item_at = np.repeat(np.arange(len(texts) + 1) - 1, np.diff([0, *starts, len(ids)])) if texts else np.array([-1])
        places: dict[str, list[int]] = {}
        for at, (_, ws) in zip(starts, texts, strict=True):
            n = len(ws)
            pieces = [(0, n)] if 0 < n < window else [(k, k + half) for k in range(0, n - half + 1, half)]
            for a, b in pieces:
                key = "".join(map(self.spell.__getitem__, ws[a:b]))
                places.setdefault(key, []).append(at + a)
        self.places = [np.array(v, np.int64) for v in places.values()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, key in enumerate(places):
            self.automaton.add_word(key, k)
        self.any = bool(places)
        if self.any:
            self.automaton.make_automaton()
        self.number, self.length = number, [len(key) // d for key in places]

    def _occurrences(self, line: np.ndarray, begin: np.ndarray, n: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which pieces are in occurrences, and the begin and end in the text of the runs
        around them.  The pieces, of n words, begin at word `begin` of the text and at `there`
        among the items' words.  A run goes at most a window beyond its piece; all windows
        around the piece lie within.  `line` has the text's word numbers, -2 for words that no item has and at its ends."""
        left, right = there - 1, there + n
        lo, hi = begin.copy(), begin + n
        for at, to, step, beside in ((left, lo, -1, 0), (right, hi, 1, 1)):
            on = np.arange(len(there))
            for _ in range(self.window):
                on = on[self.ids[at[on]] == line[to[on] + beside]]
                at[on] += step
                to[on] += step
        whole = (self.ids[left] == -1) & (self.ids[right] == -1)
        ok = (hi - lo >= self.window) | whole & (hi - lo < self.window)
        return np.flatnonzero(ok), lo[ok], hi[ok]

    def _slices(self, found: list[tuple[int, int]]) -> Iterator[tuple[np.ndarray, ...]]:
        """Numbers, text places, lengths and item places of the pieces found, for
        `_occurrences`, at most PLACES at once, however many places one piece has."""
        parts, held = [], 0
        for j, (end, k) in enumerate(found):
            size, at = self.length[k], self.places[k]
            for i in range(0, len(at), PLACES):
                there = at[i : i + PLACES]
                parts.append((np.full(len(there), j), np.full(len(there), (end + 1) // self.digits - size), np.full(len(there), size), there))
                held += len(there)
                if held >= PLACES:
                    yield tuple(map(np.concatenate, zip(*parts, strict=True)))
                    parts, held = [], 0
        if held:
            yield tuple(map(np.concatenate, zip(*parts, strict=True)))

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Number of words, hit ranges of word numbers (ends excluded, in order, none
        touching) and the items that occur."""
        ws = words(text)
        if not ws or not self.any:
            return len(ws), [], set()
        spell, other = self.spell.get, self.other
        found = list(self.automaton.iter("".join([spell(w, other) for w in ws])))
        if not found:
            return len(ws), [], set()
        line = np.array([-2, *[self.number.get(w, -2) for w in ws], -2], np.int32)
        # a piece between the same words has the same items, and the same marks around it
        first: dict[tuple[int, int, bytes], int] = {}
        once, moved = [], []
        for end, k in found:
            begin = (end + 1) // self.digits - self.length[k]
            left = max(0, begin + 1 - self.window)
            around = line[left : begin + 1 + self.length[k] + self.window].tobytes()
            j = first.setdefault((k, begin - left, around), len(once))
            if j == len(once):
                once.append((end, k))
                moved.append([0])
            else:
                moved[j].append((end - once[j][0]) // self.digits)
        marks: set[tuple[int, int]] = set()
        items = np.zeros(len(self.names), bool)
        for j, begin, n, there in self._slices(once):
            ok, lo, hi = self._occurrences(line, begin, n, there)
            items[self.item_at[there[ok]]] = True
            for piece, a, b in np.unique(np.stack([j[ok], lo, hi], axis=1), axis=0).tolist():
                marks.update((a + m, b + m) for m in moved[piece])
        return len(ws), merged(marks), {self.names[k] for k in np.flatnonzero(items)}


def merged(ranges: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def char_ranges(text: str, hits: Sequence[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges of characters of the original text from ranges of word numbers."""
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in hits]


def _digest(shared: Broadcast, window: int):
    scanner = Scanner(shared.value, window)

    def fn(texts: pa.Array) -> list:
        got = [scanner.scan(t.as_py()) for t in texts]
        hit = [sum(b - a for a, b in r) for _, r, _ in got]
        return [
            pa.array([n for n, _, _ in got], pa.int64()),
            pa.array(hit, pa.int64()),
            pa.array([len(i) for _, _, i in got], pa.int64()),
            pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in got], pa.string()),
            pa.array([h > 0 for h in hit], pa.bool_()),
        ]

    return fn


def _find(shared: Broadcast, window: int):
    scanner = Scanner(shared.value, window)
    span = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))

    def fn(texts: pa.Array) -> list:
        got = [scanner.scan(t.as_py()) for t in texts]
        found = [[{"begin": a, "end": b} for a, b in char_ranges(t.as_py(), r)] if r else [] for t, (_, r, _) in zip(texts, got, strict=True)]
        return [pa.array([n for n, _, _ in got], pa.int64()), pa.array(found, span), pa.array([sorted(i) for _, _, i in got], pa.list_(pa.string()))]

    return fn


def _clean(shared: Broadcast, window: int):
    scanner = Scanner(shared.value, window)

    def fn(texts: pa.Array) -> list:
        return [pa.array([not scanner.scan(t.as_py())[1] for t in texts], pa.bool_())]

    return fn


def _found(shared: Broadcast, window: int):
    """Hit ranges of words, with their first and last characters, and items."""
    scanner = Scanner(shared.value, window)
    span = pa.list_(pa.struct([(k, pa.int32()) for k in ("begin", "end", "first", "last")]))

    def fn(texts: pa.Array) -> list:
        got = [scanner.scan(t.as_py()) for t in texts]
        ranges = [[dict(zip(("begin", "end", "first", "last"), (*w, *c), strict=True)) for w, c in zip(r, char_ranges(t.as_py(), r), strict=True)] if r else [] for t, (_, r, _) in zip(texts, got, strict=True)]
        return [pa.array([n for n, _, _ in got], pa.int64()), pa.array(ranges, span), pa.array([sorted(i) for _, _, i in got], pa.list_(pa.string()))]

    return fn


def _share(items: DataFrame, id_col: str, text_col: str, max_bytes: int) -> list[Broadcast]:
    """The items that have a text, broadcast in parts of about max_bytes at most (or of one
    item, if that is larger); one part if all of them are below it."""
    rows = items.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    send = lambda part: items.sparkSession.sparkContext.broadcast(sorted((r[0], r[1]) for r in part.toLocalIterator()))
    if size <= max_bytes:
        return [send(rows)]
    # parts by hash differ in size: on average half of what they may have
    n = math.ceil(2 * size / max_bytes)
    return [send(rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k)) for k in range(n)]


def _in_parts(df: DataFrame, text_col: str, parts: list[Broadcast], window: int) -> tuple[DataFrame, str, Column, Column]:
    """df scanned for one part after another, and written in between, so that a worker
    holds one automaton at a time; the name of the column of word numbers, the joined ranges
    and the items of all parts."""
    hits, found, n = [], [], free_name(df, "__words")
    for shared in parts:
        hit, item, words_ = (free_name(df, f"__{what}{len(hits)}") for what in ("hits", "items", "words"))
        out = f"`{words_}` long, `{hit}` array<struct<begin:int,end:int,first:int,last:int>>, `{item}` array<string>"
        df = annotate(df, text_col, out, partial(_found, shared, window))
        df = stored(df.drop(words_) if hits else df.withColumnRenamed(words_, n), "scanned")
        shared.unpersist()
        hits.append(F.col(f"`{hit}`"))
        found.append(F.col(f"`{item}`"))

    def add(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        longer = F.struct(last["begin"].alias("begin"), F.greatest(last["end"], x["end"]).alias("end"), last["first"].alias("first"), F.greatest(last["last"], x["last"]).alias("last"))
        return F.when((F.size(acc) > 0) & (x["begin"] <= last["end"]), F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(x)))

    every = F.array_sort(F.concat(*hits))
    return df, n, F.aggregate(every, F.slice(every, 1, 0), add), F.array_sort(F.array_distinct(F.concat(*found)))


def mark(df: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: Sequence[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df's columns (or those in `keep`) with n_words, hits (character ranges of the
    original text that windows cover) and items (sorted item ids that occur)."""
    parts = _share(items, id_col, item_text_col, max_bytes)
    if len(parts) == 1:
        return annotate(df, text_col, "n_words long, hits array<struct<begin:int,end:int>>, items array<string>", partial(_find, parts[0], window), keep)
    kept = _kept(df, keep, ("n_words", "hits", "items"))
    df, n, hits, found = _in_parts(df, text_col, parts, window)
    spans = F.transform(hits, lambda x: F.struct(x["first"].alias("begin"), x["last"].alias("end")))
    return df.select(*kept, F.col(n).alias("n_words"), spans.alias("hits"), found.alias("items"))


def digest(df: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, keep: Sequence[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """df's columns (or those in `keep`) with n_words, n_hit, n_items, items_sha256 and
    contaminated (some word is hit)."""
    parts = _share(items, id_col, item_text_col, max_bytes)
    out = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    if len(parts) == 1:
        return annotate(df, text_col, out, partial(_digest, parts[0], window), keep)
    kept = _kept(df, keep, ("n_words", "n_hit", "n_items", "items_sha256", "contaminated"))
    df, n, hits, found = _in_parts(df, text_col, parts, window)
    hit = F.aggregate(hits, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    return df.select(*kept, F.col(n).alias("n_words"), hit.alias("n_hit"), F.size(found).cast("long").alias("n_items"), F.sha2(F.array_join(found, ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def _kept(df: DataFrame, keep: Sequence[str] | None, new: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns if (keep is None or c in keep) and c.lower() not in new]


def filter_clean(df: DataFrame, items: DataFrame, text_col: str = "text", id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows in whose text no window occurs; columns unchanged."""
    parts = _share(items, id_col, item_text_col, max_bytes)
    for shared in parts[:-1]:
        # a worker holds one part's automaton at a time
        df = stored(keep_where(df, text_col, partial(_clean, shared, window)), "scanned")
        shared.unpersist()
    return keep_where(df, text_col, partial(_clean, parts[-1], window))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=["doc_id"])


OP8_SQL = r"""
WITH b AS (SELECT coalesce(item_id::VARCHAR, '') AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT item, n, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT item, ws, least(10, len(ws)) AS n, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
m AS (SELECT doc_id, i, dw.n AS n, item FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN g ON d.doc_id = g.doc_id
"""
