"""Divergence audit of sources: how the terms of a source differ from others of its language.

Terms are runs of ASCII letters (A-Z lower-cased) and of all characters beyond ASCII.
`bytes.translate` lowers letters and blanks separators in one pass, `bytes.split` cuts, and
a Counter for each document gives counts and, by its keys, document frequencies.  A task
adds them up by language and source in tables of bounded size; Spark sums what they hold,
only terms that occur.  A language keeps the terms of at least `min_docs` of its documents.

A term that a source lacks still has the share that smoothing gives it.  Sums over all
kept terms are put together from those that occur: for sources i and j with shares P and
Q, and shares z where a term is absent, the sum of f(P, Q) over all terms is that of f(z, z),
corrected by the terms of i, by those of j (both from how often each count occurs), and by
the terms of both, which are compared within the list of a term's sources.

Null texts, languages and sources count as empty.  Repeated rows count each.  Texts of
any length are counted whole.  An empty table gives no rows; a source without terms is
compared like any other, and a language without kept terms has divergences of 0.  Columns
other than the three are not read.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import bound_batches, documents, give_back, stored

#: Terms of all sources that a task adds up before it hands them on.
HELD_TERMS = 200_000
SCALE = 1_000_000_000
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_COUNTED = "lang string, source string, term string, n long, docs long"


def terms(text: str | None) -> list[bytes]:
    """The terms in UTF-8, in order."""
    return (text or "").encode().translate(_TERMS).split()


def _handed(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
    langs, sources, words, n, docs = [], [], [], [], []
    for (lang, source), (count, seen) in held.items():
        langs += [lang] * len(count)
        sources += [source] * len(count)
        words += count
        n += count.values()
        docs += map(seen.__getitem__, count)
    arrays = [pa.array(langs, pa.string()), pa.array(sources, pa.string()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())]
    return pa.RecordBatch.from_arrays(arrays, ["lang", "source", "term", "n", "docs"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = defaultdict(lambda: (Counter(), Counter()))
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(k) for k in range(3)), strict=True):
            found = Counter(terms(text.as_py()))
            count, seen = held[lang.as_py(), source.as_py()]
            size -= len(count)
            count.update(found)
            seen.update(found.keys())
            size += len(count)
            if size >= HELD_TERMS:
                yield _handed(held)
                held.clear()
                size = 0
    yield _handed(held)
    held.clear()
    give_back()


def counted(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents) of each term that occurs."""
    bound_batches(df.sparkSession)
    src = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    return src.mapInArrow(_count, _COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept(counts: DataFrame, min_docs: int = 3) -> DataFrame:
    """lang, term, n and `by`, the term's sources with their n, of the terms in at least
    `min_docs` documents of a language.  A list has at most the sources of the language."""
    by = F.collect_list(F.struct("source", "n")).alias("by")
    return counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n"), by).where(F.col("docs") >= min_docs).select("lang", "term", F.col("all_n").alias("n"), "by")


def share(n: Column | int, total: Column, size: Column) -> Column:
    """1 + the whole part of SCALE * (n + 1) / (total + size), exactly."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.call_function("div", (n + 1).cast("decimal(28,0)") * F.lit(SCALE).cast("decimal(10,0)"), (total + size).cast("decimal(28,0)")) + 1


def gap(p: Column, q: Column) -> Column:
    """The whole part of (p - q)**2 / q."""
    return F.call_function("div", (p - q) * (p - q), q)


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (lang, list of a term's sources with share p and share z of an absent term):
    corrections for terms that two sources have, summed by pair."""
    f = lambda p, q: (p - q) * (p - q) // q
    for batch in batches:
        lists = batch.column(1)
        row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
        flat = lists.flatten()
        p, z = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("p", "z"))
        lang, source = batch.column(0).dictionary_encode(), flat.field("source").dictionary_encode()
        many = max(1, len(source.dictionary))
        group = lang.indices.to_numpy().astype(np.int64)[row] * many + source.indices.to_numpy()
        names, code = np.unique(group, return_inverse=True)
        keys, sums = [], []
        step = 1
        while step < len(row) and (same := np.flatnonzero(row[step:] == row[:-step])).size:
            for a, b in ((same, same + step), (same + step, same)):
                value = f(p[a], p[b]) - f(p[a], z[b]) - f(z[a], p[b]) + f(z[a], z[b])
                key = code[a] * len(names) + code[b]
                order = np.argsort(key, kind="stable")
                first = np.flatnonzero(np.diff(key[order], prepend=-1))
                keys.append(key[order][first])
                sums.append(np.add.reduceat(value[order], first))
            step += 1
        if not keys:
            continue
        key, value = np.concatenate(keys), np.concatenate(sums)
        a, b = names[key // len(names)], names[key % len(names)]
        take = lambda of, at: of.dictionary.take(pa.array(at))
        yield pa.RecordBatch.from_arrays([take(lang, a // many), take(source, a % many), take(source, b % many), pa.array(value)], ["lang", "source", "item", "value"])


def audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = 3, top: int = 200) -> DataFrame:
    """lang, source, part, item, value, rank.  Part `pair` has a source's divergence from
    each other source of its language, part `term` the `top` terms that it has more of than
    its language."""
    words = stored(kept(counted(df, text_col, lang_col, source_col), min_docs), "kept")
    each = words.select("lang", "term", F.col("n").alias("all_n"), F.explode("by").alias("s")).select("lang", "term", "all_n", "s.source", "s.n")
    occurring = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(to) for c, to in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    langs = words.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("lang_n"))
    groups = occurring.join(each.groupBy("lang", "source").agg(F.sum("n").alias("group_n")), ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["v", "lang_n", "group_n"])
    z = F.when(F.col("v") > 0, share(0, F.col("group_n"), F.col("v"))).otherwise(1)
    groups = stored(groups.withColumn("z", z), "groups")
    rows = each.join(groups, ["lang", "source"]).withColumns({"p": share(F.col("n"), F.col("group_n"), F.col("v")), "q": share(F.col("all_n"), F.col("lang_n"), F.col("v"))}).select("lang", "source", "term", "p", "q", "z")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = lambda part, x: x.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    more = rows.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))

    # terms of one source against the other's share of an absent term, by how often a share occurs
    often = rows.groupBy("lang", "source", "p", "z").agg(F.count(F.lit(1)).alias("k"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("y"))
    met = often.join(other, "lang").where("source <> item")
    f = lambda p, q: gap(F.col(p), F.col(q)).cast("decimal(38,0)")
    ours = met.groupBy("lang", "source", "item").agg(F.sum(F.col("k") * (f("p", "y") - f("z", "y"))).alias("value"))
    theirs = met.groupBy(F.col("lang"), F.col("item").alias("source"), F.col("source").alias("item")).agg(F.sum(F.col("k") * (f("y", "p") - f("y", "z"))).alias("value"))
    shared = rows.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "z")).alias("by")).where(F.size("by") > 1).select("lang", "by")
    both = shared.mapInArrow(_both, "lang string, source string, item string, value long").select("lang", "source", "item", F.col("value").cast("decimal(38,0)"))
    absent = groups.join(other, "lang").where("source <> item").select("lang", "source", "item", (F.col("v") * f("z", "y")).cast("decimal(38,0)").alias("value"))
    parts = absent.unionByName(ours).unionByName(theirs).unionByName(both)
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    return ranked("pair", pairs).unionByName(ranked("term", more).where(F.col("rank") <= top))


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
t AS (SELECT id, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS ln FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY ALL),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, ln, count(*) OVER (PARTITION BY g.lang, g.source) AS v,
    sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS gn, sum(ln) OVER (PARTITION BY g.lang, g.source) AS sn
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (gn + v)::HUGEINT AS p,
    1 + (1000000000::HUGEINT * (ln + 1)) // (sn + v)::HUGEINT AS q FROM x),
b AS (SELECT a.lang, a.source, o.source AS item, sum((a.p - o.p) * (a.p - o.p) // o.p) AS value
  FROM p a JOIN p o ON a.lang = o.lang AND a.term = o.term AND a.source <> o.source GROUP BY ALL),
r AS (
  SELECT a.lang, a.source, 'pair' AS part, o.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g o ON a.lang = o.lang AND a.source <> o.source
  LEFT JOIN b ON b.lang = a.lang AND b.source = a.source AND b.item = o.source
  UNION ALL
  SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM p WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INT AS rank
FROM r QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 200
"""
