"""Near-duplicates by BagMinHash signatures of word shingles.

A text is the multiset of its runs of five words (white-space separated; a text of one
to four words is one shingle).  Two texts are linked if the weighted Jaccard similarity
of their multisets, the sum of least counts over the sum of greatest counts, is at
least 0.8; classes are the connected components of the links.

Signatures.  Weights are counts, discretised at the integers.  A shingle owns a Poisson
process on each of the weight intervals (0, 1], (1, 2], (2, 4], (4, 8], ..., of a rate
proportional to the length.  A process is halved when its point is looked at: one half,
chosen at random, takes the point, the other goes on to a point of its own, and halves
that lie above the shingle's weight are dropped, down to intervals of one.  All choices
are hashes of shingle and interval, so that texts share the points of the weights that
they share.  Each point falls to a random slot, each slot keeps its least point, and no
process goes on beyond the greatest of the slots: two texts agree in a slot with a
probability of their weighted Jaccard similarity.

Search.  A band is five slots.  In the bucket of a band's value all texts are compared
with one pivot (as many pairs as members); pairs whose signatures agree enough are
verified on the whole texts.  In a bucket whose texts then are in several components,
all texts outside the largest are compared with all members, on the whole texts and in
blocks of bounded bytes, so that no link between candidates is lost and no bucket has to
fit into a task.  Exact copies are
one text from the start.

Null, empty and white-space texts have no shingle and are each a class of their own.
The class id is the least id of the class (null if it has no other).  Repeated rows
keep a row each.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bloom_join import narrowed
from .components import components
from .textkit import CHUNK_BYTES, U64, Chunk, Scratch, annotate, chunks, documents, free_name, give_back, mix, ngram_hashes, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 25, 5
SLOTS = BANDS * ROWS
#: Texts that a block of a bucket has, about, when its members are compared with each other.
BLOCK_BYTES = 2 << 20
_ODD = U64(0x9FB21C651E98DF25)
_OCCURRENCE = U64(0xD1342543DE82EF95)


def shingles(chunk: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of a chunk's rows, and their rows (in order)."""
    starts, ends, first = chunk.words()
    words, count = chunk.hashes(starts, ends), np.diff(first)
    codes, at = ngram_hashes(words, first, size)
    rows = np.repeat(np.arange(chunk.rows), count)[at]
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        whole = np.zeros(len(short), U64)
        for k in range(size - 1):
            more = count[short] > k
            at = np.minimum(first[short] + k, len(words) - 1)
            whole = np.where(more, whole * U64(0xC2B2AE3D27D4EB4F) + words[at], whole)
        codes = np.concatenate([codes, mix(whole + count[short].astype(U64))])
        rows = np.concatenate([rows, short])
        order = np.argsort(rows, kind="stable")
        codes, rows = codes[order], rows[order]
    return codes, rows


def bags(chunk: Chunk, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each row: rows (in order), hashes and counts."""
    codes, rows = shingles(chunk, size)
    if not len(codes):
        return rows, codes, rows
    order = np.lexsort((codes, rows))
    codes, rows = codes[order], rows[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])
    at = np.flatnonzero(new)
    return rows[at], codes[at], np.diff(np.append(at, len(codes)))


def _draw(seed: np.ndarray, length: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Exponential variates of rate `length`."""
    u = (mix(seed + salt) >> U64(11)).astype(np.float64) + 1.0
    return -np.log(u * 2.0**-53) / length


def signatures(rows: np.ndarray, codes: np.ndarray, weights: np.ndarray, n: int, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash slots of n bags given as `bags` gives them: float64, inf if empty."""
    low = np.full((n, slots), np.inf)
    flat = low.reshape(-1)
    # a process: row, seed of its shingle, weight, interval (begin, length), next point, number of the point
    top = np.ceil(np.log2(np.maximum(weights, 1))).astype(np.int64) if len(weights) else np.zeros(0, np.int64)
    which = np.repeat(np.arange(len(codes)), top + 1)
    k = np.arange(len(which)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    begin = np.where(k == 0, 0, 1 << np.maximum(k - 1, 0))
    length = np.where(k == 0, 1, begin)
    row, seed, weight = rows[which], codes[which], weights[which]
    node = lambda s, b, size: mix(s ^ (b.astype(U64) * _ODD + size.astype(U64) * _OCCURRENCE))
    own = node(seed, begin, length)
    turn = np.zeros(len(which), U64)
    x = _draw(own, length, turn)
    while len(row):
        leaf = length == 1
        if leaf.any():
            at = np.flatnonzero(leaf)
            slot = mix(own[at] ^ (turn[at] + U64(0x5851F42D4C957F2D))) % U64(slots)
            np.minimum.at(flat, row[at] * slots + slot.astype(np.int64), x[at])
            turn[at] += U64(1)
            x[at] += _draw(own[at], length[at], turn[at])
        parts = [(row[leaf], seed[leaf], weight[leaf], begin[leaf], length[leaf], own[leaf], turn[leaf], x[leaf])]
        if not leaf.all():
            at = np.flatnonzero(~leaf)
            half = length[at] // 2
            right_takes = (mix(own[at] ^ U64(0xA0761D6478BD642F)) & U64(1)).astype(bool)
            for side in (0, 1):
                b = begin[at] + side * half
                o = node(seed[at], b, half)
                t = np.zeros(len(at), U64)
                nx = np.where(right_takes == bool(side), x[at], x[at] + _draw(o, half, t))
                ok = b < weight[at]
                parts.append(tuple(v[ok] for v in (row[at], seed[at], weight[at], b, half, o, t, nx)))
        row, seed, weight, begin, length, own, turn, x = (np.concatenate(v) for v in zip(*parts, strict=True))
        on = x <= low.max(axis=1)[row]
        row, seed, weight, begin, length, own, turn, x = (v[on] for v in (row, seed, weight, begin, length, own, turn, x))
    return low


def prints(low: np.ndarray) -> np.ndarray:
    """16-bit fingerprints of slots."""
    return (mix(low.view(U64).copy()) >> U64(48)).astype(np.uint16)


def _sign(size: int):
    def fn(texts: pa.Array) -> list:
        keys, sizes, out = [], [], []
        for t in texts:
            raw = (t.as_py() or "").encode()
            keys.append(hashlib.md5(raw).digest())
            sizes.append(len(raw))
        # a text that the batch repeats is signed once
        place = {k: i for i, k in reversed(list(enumerate(keys)))}
        at = np.array(sorted(place.values()), np.int64)
        for c in chunks(texts.take(pa.array(at))):
            rows, codes, weights = bags(c, size)
            low = signatures(rows, codes, weights, c.rows)
            sig = prints(low)
            none = np.isinf(low[:, 0])
            out += [None if e else s.tobytes() for e, s in zip(none, sig, strict=True)]
        signed = {keys[i]: s for i, s in zip(at, out, strict=True)}
        return [pa.array(keys, pa.binary()), pa.array([signed[k] for k in keys], pa.binary()), pa.array(sizes, pa.int64())]

    return fn


def similarities(a: pa.Array, b: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarities of pairs of texts, from their whole multisets.
    A pair in which a text has no shingle has 0."""
    n = len(a)
    out = np.zeros(n)
    done = 0
    # the two texts of a pair side by side, so that they share a chunk
    for i in range(0, n, 64):
        x, y = a.slice(i, 64), b.slice(i, 64)
        sides = []
        for t in (x, y):
            got = [bags(c, size) for c in chunks(t)]
            rows_before = np.cumsum([0] + [c.rows for c in chunks(t)])
            rows = np.concatenate([g[0] + r for g, r in zip(got, rows_before, strict=False)])
            sides.append((rows, np.concatenate([g[1] for g in got]), np.concatenate([g[2] for g in got])))
        (ra, ca, wa), (rb, cb, wb) = sides
        m = len(x)
        keys = np.concatenate([mix(ca ^ (ra.astype(U64) * _ODD)), mix(cb ^ (rb.astype(U64) * _ODD))])
        rows, w = np.concatenate([ra, rb]), np.concatenate([wa, wb])
        order = np.argsort(keys, kind="stable")
        k, r, w2 = keys[order], rows[order], w[order]
        same = np.flatnonzero((k[1:] == k[:-1]) & (r[1:] == r[:-1]))
        least = np.bincount(r[same], np.minimum(w2[same], w2[same + 1]), m)
        total = np.bincount(rows, w, m)
        out[done : done + m] = np.where(total > 0, least / np.maximum(total - least, 1), 0.0)
        done += m
    return out


def least_agreement(similarity: float) -> float:
    """Signatures of texts of this similarity agree less with a probability of 3e-7."""
    return similarity - 5 * (similarity * (1 - similarity) / SLOTS) ** 0.5


def _verify(similarity: float, size: int):
    def run(batches):
        got = 0
        for b in batches:
            got += b.nbytes
            sim = similarities(b.column(2), b.column(3), size)
            yield pa.RecordBatch.from_arrays(list(b.columns[:2]), ["u", "v"]).filter(pa.array(sim >= similarity - 1e-12))
        # collecting garbage takes longer than the few pairs of a small task
        if got > CHUNK_BYTES:
            give_back()

    return run


def _texts_of(s: Scratch, nodes: DataFrame, signed: DataFrame, texts: DataFrame) -> DataFrame:
    """node and text of the nodes in the only column of a frame, one row for each."""
    keys = s.stored(signed.select("node", "key").join(nodes.toDF("node").distinct(), "node", "left_semi").withColumnRenamed("key", "k"), "keys")
    some = narrowed(texts, "key", keys.select("k")).join(keys, F.col("key") == F.col("k"))
    return s.stored(some.groupBy("node").agg(F.first("text").alias("text")), "texts")


def _verified(s: Scratch, pairs: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float, size: int) -> DataFrame:
    """The pairs (a, b) of texts that are similar enough, as links (u, v)."""
    some = _texts_of(s, pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))), signed, texts)
    joined = pairs.join(some.toDF("a", "text_a"), "a").join(some.toDF("b", "text_b"), "b").select("a", "b", "text_a", "text_b")
    return s.stored(joined.mapInArrow(_verify(similarity, size), "u long, v long"), "links")


def _banded(signed: DataFrame) -> DataFrame:
    """A row for each band of a text: bucket, node and bytes."""
    band = lambda k: F.xxhash64(k, F.substring("sig", k * (2 * ROWS) + 1, 2 * ROWS))
    return signed.select("node", "bytes", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), band)).alias("bucket"))


def _estimated(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose signatures agree at least so much."""
    slot = lambda sig, k: F.substring(sig, k * 2 + 1, 2)
    equal = F.filter(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: slot("sig_a", k) == slot("sig_b", k))
    sig = signed.select("node", "sig")
    out = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
    return out.where(F.size(equal) / SLOTS >= least).select("a", "b")


def _linked(similarity: float, size: int):
    """Links between a block of a bucket's stragglers and a block of its members, from
    their whole multisets; one for each straggler and other component."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[pdf["side"] == 0], pdf[pdf["side"] == 1]
        found = []
        if len(left) and len(right):
            (lr, lc, lw), (rr, rc, rw) = _bags_of(left["text"], size), _bags_of(right["text"], size)
            _, ids = np.unique(np.concatenate([lc, rc]), return_inverse=True)
            li, ri = ids[: len(lc)], ids[len(lc) :]
            weight = np.zeros(ids.max(initial=-1) + 1, np.int64)
            total, bounds = np.bincount(rr, rw, len(right)), np.searchsorted(lr, np.arange(len(left) + 1))
            nodes, roots = right["node"].to_numpy(), right["root"].to_numpy()
            for k, (node, root) in enumerate(zip(left["node"], left["root"], strict=True)):
                mine = slice(bounds[k], bounds[k + 1])
                weight[li[mine]] = lw[mine]
                least = np.bincount(rr, np.minimum(weight[ri], rw), len(right))
                weight[li[mine]] = 0
                sim = least / np.maximum(total + lw[mine].sum() - least, 1)
                seen = {root}
                for j in np.flatnonzero(sim >= similarity - 1e-12):
                    if roots[j] not in seen:
                        seen.add(roots[j])
                        found.append((node, nodes[j]))
        return pd.DataFrame(found, columns=["u", "v"])

    return run


def _bags_of(texts: pd.Series, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """`bags` of a column, however many chunks it makes."""
    parts, before = [], 0
    for c in chunks(pa.array(texts, pa.string())):
        rows, codes, weights = bags(c, size)
        parts.append((rows + before, codes, weights))
        before += c.rows
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True))


def _leftover(s: Scratch, members: DataFrame, signed: DataFrame, texts: DataFrame, similarity: float, size: int, block: int) -> DataFrame:
    """Links between texts of a bucket that are in different components.

    All components of a bucket but its largest are stragglers.  They and all members are
    cut into blocks of about `block` bytes and at most some 256 texts; a pair of blocks is
    a group of its own, so that a group has at most two blocks and a bucket's rows grow
    with its stragglers only."""
    parts = members.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("bytes").alias("size"))
    of = parts.groupBy("bucket").agg(F.sum("c").alias("n"), F.sum("size").alias("size"), F.max(F.struct("c", "root", "size")).alias("most"), F.count(F.lit(1)).alias("parts"))
    blocks = lambda c, size: F.ceil(F.greatest(c / 256, size / block)).cast("long")
    # of two members, one is the pivot and has been compared with the other
    open_ = of.where("n > 2 and parts > 1").select(
        "bucket", F.col("most.root").alias("main"), blocks(F.col("n"), F.col("size")).alias("nb"), blocks(F.col("n") - F.col("most.c"), F.col("size") - F.col("most.size")).alias("sb")
    )
    rows = s.stored(members.join(s.stored(open_, "open"), "bucket"), "rows")
    if rows.isEmpty():
        return rows.select(F.col("node").alias("u"), F.col("root").alias("v"))
    own = lambda n: F.pmod(F.xxhash64("node", F.lit(9)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    one = rows.where("root <> main").select("bucket", own("sb").alias("i"), F.explode(every("nb")).alias("j"), F.lit(0).alias("side"), "node", "root")
    two = rows.select("bucket", F.explode(every("sb")).alias("i"), own("nb").alias("j"), F.lit(1).alias("side"), "node", "root")
    with_text = one.unionByName(two).join(_texts_of(s, rows.select("node"), signed, texts), "node")
    return with_text.groupBy("bucket", "i", "j").applyInPandas(_linked(similarity, size), "u long, v long").distinct()


def _labelled(rows: DataFrame, roots: DataFrame | None, node: str, root: str) -> DataFrame:
    """rows with the root of one of its columns; a node without a link is its own."""
    if roots is None:
        return rows.withColumn(root, F.col(node))
    return rows.join(roots.toDF(node, "__root"), node, "left").withColumn(root, F.coalesce("__root", node)).drop("__root")


def signed_rows(df: DataFrame, text_col: str, keep: list[str], size: int = SHINGLE) -> DataFrame:
    """The columns `keep` of each row with key (MD5 of the text), sig (null without a
    shingle) and bytes, written to the shared folder."""
    return stored(annotate(df, text_col, "key binary, sig binary, bytes long", partial(_sign, size), keep), "signed")


def _distinct_texts(s: Scratch, rows: DataFrame, id_col: str) -> DataFrame:
    """node, key, sig, bytes and own (least id) of each different text with a shingle.
    Numbers are given once, as the table is written; joins then take them for keys."""
    got = rows.where("sig is not null").groupBy("key").agg(F.first("sig").alias("sig"), F.first("bytes").alias("bytes"), F.min(F.col(f"`{id_col}`")).alias("own"))
    return s.stored(got.withColumn("node", F.monotonically_increasing_id()), "signed")


def _roots(s: Scratch, df: DataFrame, signed: DataFrame, text_col: str, similarity: float, size: int, block: int) -> DataFrame | None:
    """node and root of all texts that are linked to another.  None if there is no link."""
    text = F.col(f"`{text_col}`").cast("string")
    texts = df.select(F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary"))).alias("key"), text.alias("text"))
    bands = _banded(signed)
    # written by itself, so that a bucket of any size can be split in the join
    pivots = s.stored(bands.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("last")).where("b <> last").select("bucket", "b"), "pivots")
    members = s.stored(bands.join(pivots, "bucket"), "buckets")
    pairs = s.stored(_estimated(members.where("node <> b").select(F.col("node").alias("a"), "b").distinct(), signed, least_agreement(similarity)), "pairs")
    links = None if pairs.isEmpty() else _verified(s, pairs, signed, texts, similarity, size)
    roots = None if links is None or links.isEmpty() else components(links, s, plain=True)
    # what still is apart though in one bucket
    apart = _labelled(members.select("bucket", "node", "bytes"), roots, "node", "root")
    left = s.stored(_leftover(s, apart, signed, texts, similarity, size, block), "links")
    if left.isEmpty():
        return roots
    if roots is None:
        return components(left, s, plain=True)
    # components of components: only they and the texts that were alone have new roots
    of = _labelled(_labelled(left, roots, "u", "root_u"), roots, "v", "root_v")
    above = components(of.select(F.col("root_u").alias("u"), F.col("root_v").alias("v")), s)
    joined = _labelled(roots.withColumnRenamed("root", "mid"), above, "mid", "root").select("node", "root")
    return s.stored(joined.unionByName(above.join(roots.select("node"), "node", "left_anti").select("node", "root")), "roots")


def text_classes(df: DataFrame, rows: DataFrame, text_col: str, id_col: str, similarity: float = SIMILARITY, size: int = SHINGLE, block: int = BLOCK_BYTES) -> DataFrame:
    """key, own (least id of the text), class_id (least id of its class) and root (a
    number of the class) of each different text with a shingle, written to the shared
    folder.  `rows` is what `signed_rows` gives for df."""
    with Scratch(df.sparkSession) as s:
        signed = _distinct_texts(s, rows, id_col)
        roots = _roots(s, df, signed, text_col, similarity, size, block)
        texts = signed.select("node", "key", "own")
        if roots is None:
            return stored(texts.select("key", "own", F.col("own").alias("class_id"), F.col("node").alias("root")), "classes")
        linked = s.stored(texts.join(roots, "node"), "linked")
        least = s.stored(linked.groupBy("root").agg(F.min("own").alias("class_id")), "least")
        linked = linked.join(least, "root").select("key", "own", "class_id", "root")
        alone = texts.join(roots.select("node"), "node", "left_anti").select("key", "own", F.col("own").alias("class_id"), F.col("node").alias("root"))
        return stored(linked.unionByName(alone), "classes")


def classes(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """id and class_id of each row; other columns of df have no effect, whatever their names."""
    df = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = signed_rows(df, "text", ["id"], size)
    keys = text_classes(df, rows, "text", "id", similarity, size).select("key", "class_id")
    out = rows.withColumn("has", F.col("sig").isNotNull()).select("id", "key", "has").join(keys, "key", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("has"), F.col("class_id")).otherwise(F.col("id")).alias("class_id"))


def filter_first(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", similarity: float = SIMILARITY, size: int = SHINGLE) -> DataFrame:
    """One row of each class, that of the least id; columns unchanged.  Of rows with
    equal ids and texts one stays, whichever.  Rows without a shingle all stay."""
    plain = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = signed_rows(plain, "text", ["id"], size)
    keys = text_classes(plain, rows, "text", "id", similarity, size)
    # texts that share the class's least id: the least key stays
    best = keys.where("own <=> class_id").groupBy("root").agg(F.min(F.struct("key", "own")).alias("w")).select("w.*")
    key, n, cid = (free_name(df, c) for c in ("__key", "__n", "__id"))
    mine = rows.where("sig is not null").groupBy(F.col("key").alias(key), F.col("id").alias(cid)).agg(F.count(F.lit(1)).alias(n))
    best = stored(mine.join(best, (F.col(key) == F.col("key")) & F.col(cid).eqNullSafe(F.col("own"))).select(key, cid, n), "kept")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keyed = df.withColumn(key, F.when(F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), F.unhex(F.md5(text.cast("binary")))))
    empty = keyed.where(F.col(key).isNull()).select(*[f"`{c}`" for c in df.columns])
    hit = keyed.join(best, key).where(F.col(f"`{id_col}`").eqNullSafe(F.col(cid)))
    once = hit.where(F.col(n) == 1)
    many = hit.where(F.col(n) > 1).dropDuplicates([key])
    return once.unionByName(many).select(*[f"`{c}`" for c in df.columns]).unionByName(empty)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(documents(spark, sf_dir))


OP9_SQL = r"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents WHERE regexp_matches(text, '[^\x20\x09-\x0D]') GROUP BY text),
w AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM t),
s AS (SELECT id, array_to_string(ws[i:i + least(5, len(ws)) - 1], chr(10)) AS g
  FROM (SELECT id, ws, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) AS i FROM w)),
c AS (SELECT id, g, count(*) AS n FROM s GROUP BY ALL),
n AS (SELECT id, sum(n) AS n FROM c GROUP BY id),
p AS (SELECT a.id AS u, b.id AS v, sum(least(a.n, b.n)) AS k FROM c a JOIN c b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.id = u JOIN n y ON y.id = v WHERE 5 * k >= 4 * (x.n + y.n - k)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r(id, c) AS (SELECT id, id FROM t UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.id),
m AS (SELECT id, min(c) AS class_id FROM r GROUP BY id)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id
FROM documents LEFT JOIN t ON documents.text = t.text LEFT JOIN m ON m.id = t.id
"""
