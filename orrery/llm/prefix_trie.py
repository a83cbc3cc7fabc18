"""Prefix trie of conversations, by ROLLUP over positional columns of turn ids.

A turn's id is a 128-bit digest of role and text.  A conversation is cut into blocks of
eight turns; a block's ids stand in eight columns beside the key of the node that the
blocks before lead to.  One ROLLUP over the columns, grouped by key, aggregates all
prefixes of all blocks together, and grouping_id tells how deep a prefix is.  A node's key
is the sum, in four lanes, of hashes of its turns' ids and depths: later blocks need not
wait for the nodes of earlier ones, and long conversations take no rounds.  A second
ROLLUP, over the nodes, sums subtrees within blocks.  What hangs below a block is added up
first, over pointers that double their reach, in as many rounds as the number of blocks
has binary digits.

Rows of a conversation are ordered by turn, null first, rows of equal turn by their
turn ids; repeated rows are turns of their own.  A null role or text counts as empty, rows
of a null conversation are left out.  Texts of any length are digested whole and leave
the plan with their digest.  An empty table has no node, not even a root.  Columns other
than the four are not read.

Ranks in conversations of more than `LONG` rows and keys of those of more than `SUPER`
blocks are found in pieces, whose totals are carried on, so that no task gets a long
conversation whole.  Copies of one conversation are one group of partial aggregates; the
digest of a node's ids is chained over their texts, joined for each 4096 ids beforehand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textkit import give_back, stored

BLOCK = 8
#: Rows of a conversation that one task ranks, and blocks whose sums one task runs over.
LONG = 1 << 16
SUPER = 1 << 10
LANES = 4
#: Ids joined to one text, as a power of two.
IDS = 12
#: The SHA-256 of nothing.
EMPTY = hashlib.sha256().hexdigest()

_KEY = [f"k{i}" for i in range(LANES)]
_NODE = ["depth", *[f"n{i}" for i in range(LANES)]]
_T = [f"t{i}" for i in range(1, BLOCK + 1)]


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, turn, id and chars (code points of the text) of each row."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, F.lit(":"), text), 256)), 1, 16)
    return df.where(F.col(f"`{conv_col}`").isNotNull()).select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("id"), F.char_length(text).cast("long").alias("chars"))


def ranked(rows: DataFrame, long: int = LONG) -> DataFrame:
    """conv_id, pos (from 1), id, chars.  Conversations of more than `long` rows are ranked
    over ranges of their order."""
    order = [F.col("turn").asc_nulls_first(), F.col("id")]
    place = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    counts = rows.groupBy("conv_id").count()
    most, total = counts.agg(F.max("count"), F.sum("count")).first()
    out = ["conv_id", "pos", "id", "chars"]
    if (most or 0) <= long:
        return rows.withColumn("pos", place("conv_id")).select(out)
    many = counts.where(F.col("count") > long).select("conv_id")
    short = rows.join(many, "conv_id", "left_anti").withColumn("pos", place("conv_id"))
    parts = max(2, -(-total // long))
    ranges = stored(rows.join(many, "conv_id", "left_semi").repartitionByRange(parts, "conv_id", *order).withColumn("part", F.spark_partition_id()), "ranges")
    ahead = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.groupBy("conv_id", "part").count().select("conv_id", "part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    spread = ranges.withColumn("inside", place("conv_id", "part")).join(before, ["conv_id", "part"]).withColumn("pos", F.col("before") + F.col("inside"))
    return short.select(out).unionByName(spread.select(out))


def whole(rows: DataFrame) -> DataFrame:
    """Input of `trie` for conversations as they are, from `ranked` rows."""
    n = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("length"))
    return rows.join(n, "conv_id").select("conv_id", "length", F.col("pos").alias("depth"), "id", "chars")


def rebuilt(rows: DataFrame, group: int = 100, shared: int = 6) -> DataFrame:
    """Input of `trie` for conversations that begin with the first turns of their group's
    first one, from `ranked` rows: h = crc32(id as text) % shared turns of conversation
    id - id % group, then the conversation's own after its first h.  A conversation without
    turns has one row, of depth 0."""
    size = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    first = rows.where((F.col("conv_id") % group == 0) & (F.col("pos") < shared))
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "id", "chars"))).alias("head"))
    h = F.crc32(F.col("conv_id").cast("string")) % shared
    convs = size.select("conv_id", "n", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % group).alias("base")).join(heads, "base", "left")
    lead = F.coalesce(F.slice("head", F.lit(1), F.col("h").cast("int")), F.expr("CAST(array() AS ARRAY<STRUCT<pos: BIGINT, id: BINARY, chars: BIGINT>>)"))
    convs = convs.withColumn("lead", lead).withColumn("length", F.size("lead") + F.greatest(F.lit(0), F.col("n") - F.col("h")))
    # each conversation's share of its group's head, or an empty row
    given = convs.select("conv_id", "length", F.explode(F.when(F.col("length") == 0, F.array(F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("id"), F.lit(0).cast("long").alias("chars")))).otherwise(F.col("lead"))).alias("t"))
    given = given.select("conv_id", "length", F.col("t.pos").alias("depth"), "t.id", "t.chars")
    own = rows.join(convs.select("conv_id", "length", "h", F.size("lead").alias("m")), "conv_id").where("pos > h")
    return given.unionByName(own.select("conv_id", "length", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "id", "chars"))


def _lanes(turn_id: Column, depth: Column) -> list[Column]:
    """Four hashes of 32 bits."""
    a, b = F.xxhash64(turn_id, depth), F.xxhash64(depth, turn_id)
    return [x for h in (a, b) for x in (h.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]


def blocks(rows: DataFrame, long: int = SUPER) -> DataFrame:
    """conv_id, length, b (block), its turns in order, its key k0.. and the key e0.. after it."""
    lanes = [F.when(F.col("depth") > 0, x).otherwise(0).alias(f"s{i}") for i, x in enumerate(_lanes(F.col("id"), F.col("depth").cast("long")))]
    b = F.when(F.col("depth") > 0, F.floor((F.col("depth") - 1) / BLOCK)).otherwise(0).cast("long").alias("b")
    turn = F.when(F.col("depth") > 0, F.struct("depth", "id", "chars"))
    each = rows.select("conv_id", F.col("length").cast("long"), b, turn.alias("turn"), *lanes).groupBy("conv_id", "length", "b").agg(F.array_sort(F.collect_list("turn")).alias("turns"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(LANES)])
    each = each.withColumn("super", F.floor(F.col("b") / long))
    upto = Window.partitionBy("conv_id", "super").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumns({f"e{i}": F.sum(f"s{i}").over(upto) for i in range(LANES)})
    ahead = Window.partitionBy("conv_id").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    far = each.where(F.col("length") > BLOCK * long).groupBy("conv_id", "super").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(LANES)])
    far = far.select("conv_id", "super", *[F.sum(f"s{i}").over(ahead).alias(f"o{i}") for i in range(LANES)])
    each = each.join(far, ["conv_id", "super"], "left").withColumns({f"e{i}": F.col(f"e{i}") + F.coalesce(F.col(f"o{i}"), F.lit(0)) for i in range(LANES)})
    return each.select("conv_id", "length", "b", "turns", *[(F.col(f"e{i}") - F.col(f"s{i}")).alias(f"k{i}") for i in range(LANES)], *[f"e{i}" for i in range(LANES)])


def _rolled(df: DataFrame, aggregates: str, where: str = "TRUE") -> DataFrame:
    """Groups of all prefixes of the columns t1.. by block and key, with their level."""
    level = f"({BLOCK} - bit_count(grouping_id()))"
    present = " + ".join(f"int({t} IS NOT NULL)" for t in _T)
    key, ids = ", ".join(["b", *_KEY]), ", ".join(_T)
    # a group whose last column is null is a prefix beyond its conversation's end
    return df.sparkSession.sql(f"SELECT {key}, {ids}, {level} AS level, {aggregates} FROM {{df}} GROUP BY {key}, ROLLUP({ids}) HAVING {present} = {level} AND {where.format(level=level)}", df=df)


def _after(short: int = 0) -> list[Column]:
    """The key of the node that a group's columns lead to; without the last `short` of them."""
    out = []
    hashes = [_lanes(F.col(f"{t}.id"), F.col("b") * BLOCK + i) for i, t in enumerate(_T, 1)]
    for lane in range(LANES):
        used = [F.when(F.col("level") >= i + short, hashes[i - 1][lane]).otherwise(0) for i in range(1, BLOCK + 1)]
        out.append(reduce(Column.__add__, used, F.col(f"k{lane}")))
    return out


def _below(nodes: DataFrame) -> DataFrame:
    """Of each block that isn't a first one, by the node above it (n0.. and depth): its
    first turns, and saved tokens and leaves of all that hangs below the node."""
    name = lambda b, k: F.concat_ws("_", b, *k)
    own = nodes.where("b > 0").groupBy("b", *_KEY).agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaves"), F.count_if(F.col("level") == 1).alias("kids"))
    edge = nodes.where(f"level = {BLOCK} AND reach > {BLOCK}")
    up = edge.select(name(F.col("b") + 1, _after()).alias("block"), F.when(F.col("b") > 0, name(F.col("b"), [F.col(k) for k in _KEY])).alias("above"))
    at = [(F.col("b") * BLOCK).alias("depth"), *[F.col(k).alias(n) for k, n in zip(_KEY, _NODE[1:], strict=True)]]
    own = own.select(name(F.col("b"), [F.col(k) for k in _KEY]).alias("block"), *at, "kids", "saved", "leaves")
    cur = stored(own.join(up, "block"), "below")
    while not cur.where("above IS NOT NULL").isEmpty():
        linked = cur.where("above IS NOT NULL")
        add = linked.groupBy(F.col("above").alias("block")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        farther = linked.select("block", "above").join(cur.select(F.col("block").alias("above"), F.col("above").alias("next")), "above").select("block", "next")
        cur = cur.join(add, "block", "left").join(farther, "block", "left")
        cur = stored(cur.select("block", *_NODE, "kids", (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), F.col("next").alias("above")), "below")
    return cur.select(*_NODE, "kids", F.col("saved").alias("more_saved"), F.col("leaves").alias("more_leaves"))


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest for each node of rows sorted by node and piece."""
    at, digest = None, None
    names = [*_NODE, "ends_sha256"]

    def rows(found):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*(k for k, _ in found), strict=True)] + [pa.array([d for _, d in found], pa.string())], names)

    for batch in batches:
        found = []
        for *key, text in zip(*(batch.column(n).to_pylist() for n in [*_NODE, "ids"]), strict=True):
            if key == at:
                digest.update(b",")
            else:
                if at:
                    found.append((at, digest.hexdigest()))
                at, digest = key, hashlib.sha256()
            digest.update(text.encode())
        if found:
            yield rows(found)
    if at:
        yield rows([(at, digest.hexdigest())])
    give_back()


def ends(parts: DataFrame) -> DataFrame:
    """The digest of the ids of the conversations that end at a node, by node."""
    last = parts.where(F.col("length") <= (F.col("b") + 1) * BLOCK)
    node = [F.col("length").alias("depth"), *[F.col(f"e{i}").alias(f"n{i}") for i in range(LANES)]]
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("ids")
    pieces = last.select("conv_id", *node, F.shiftright("conv_id", IDS).alias("piece")).groupBy(*_NODE, "piece").agg(ids)
    return pieces.repartition(*_NODE).sortWithinPartitions(*_NODE, "piece").select(*_NODE, "ids").mapInArrow(_chained, ", ".join(f"{n} long" for n in _NODE) + ", ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of conversations given as rows (conv_id, length, depth, id, chars)."""
    parts = stored(blocks(rows), "blocks")
    columns = [F.get("turns", F.lit(i)).alias(t) for i, t in enumerate(_T)]
    reach = (F.size("turns") + F.when(F.col("length") > (F.col("b") + 1) * BLOCK, 1).otherwise(0)).alias("reach")
    first = _rolled(parts.select("b", *_KEY, "conv_id", reach, *columns), "count(1) AS n_convs, min(conv_id) AS conv_id, max(reach) AS reach, min(reach) AS ends_at", "(b = 0 OR {level} > 0)")
    chars = F.coalesce(*[F.col(f"{t}.chars") for t in reversed(_T)], F.lit(0))
    nodes = stored(first.withColumns({"saved": (F.col("n_convs") - 1) * chars, "leaf": (F.col("reach") == F.col("level")).cast("long")}), "nodes")
    nothing = {"kids": F.lit(0).cast("long"), "more_saved": F.lit(0).cast("long"), "more_leaves": F.lit(0).cast("long")}
    on = f"level = {BLOCK} AND reach > {BLOCK}"
    if nodes.where(on).isEmpty():
        nodes = nodes.withColumns(nothing)
    else:
        deep = nodes.where(on).withColumns(dict(zip(_NODE, [(F.col("b") + 1) * BLOCK, *_after()], strict=True))).join(stored(_below(nodes), "below"), _NODE)
        nodes = nodes.where(f"NOT ({on})").withColumns(nothing).unionByName(deep.drop(*_NODE))
    kids = ", ".join(f"count_if(level = {i}) AS c{i}" for i in range(1, BLOCK + 1))
    sums = f"min(conv_id) AS conv_id, max(n_convs) AS n_convs, sum(saved + more_saved) AS saved_tokens, sum(leaf + more_leaves) AS n_leaves, max(kids) AS below, min(ends_at) AS ends_at, {kids}"
    trees = _rolled(nodes, sums, "(b = 0 OR {level} > 0)")
    children = F.when(F.col("level") == BLOCK, F.col("below")).otherwise(F.get(F.array(*[f"c{i}" for i in range(1, BLOCK + 1)]), F.col("level")))
    found = trees.select(
        (F.col("b") * BLOCK + F.col("level")).cast("long").alias("depth"), *[x.alias(f"n{i}") for i, x in enumerate(_after())], *[x.alias(f"p{i}") for i, x in enumerate(_after(1))],
        "conv_id", "n_convs", children.alias("n_children"), "n_leaves", "saved_tokens",
    )
    found = stored(found, "trie")
    parents = found.where("n_children > 0").select((F.col("depth") + 1).alias("depth"), *[F.col(f"n{i}").alias(f"p{i}") for i in range(LANES)], F.col("conv_id").alias("parent_conv_id"))
    up = found.join(parents, ["depth", *[f"p{i}" for i in range(LANES)]], "left")
    return up.join(ends(parts), _NODE, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def op11_prefix_trie(spark, sf_dir: str) -> DataFrame:
    return trie(rebuilt(stored(ranked(turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "ranked")))


OP11_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, id) AS pos
  FROM (SELECT conv_id, turn, length(text) AS chars, substr(sha256(strlen(role) || ':' || role || ':' || text), 1, 32) AS id FROM r)),
c AS (
  SELECT conv_id, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda a, y: list_reduce(list_prepend(xor(a, y), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda u, z: xor(u // 2, 3988292384 * (u % 2)))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM o)),
m AS (SELECT c.conv_id, h, (SELECT count(*) FROM o WHERE o.conv_id = c.conv_id - c.conv_id % 100 AND pos <= h) AS k FROM c),
t AS (
  SELECT m.conv_id, o.pos AS d, id, chars FROM m JOIN o ON o.conv_id = m.conv_id - m.conv_id % 100 AND o.pos <= h
  UNION ALL SELECT m.conv_id, pos - h + k, id, chars FROM m JOIN o ON o.conv_id = m.conv_id AND pos > h),
l AS (SELECT m.conv_id, coalesce(list(id ORDER BY d) FILTER (WHERE id IS NOT NULL), []) AS ids, coalesce(list(chars ORDER BY d) FILTER (WHERE id IS NOT NULL), []) AS cs FROM m LEFT JOIN t ON t.conv_id = m.conv_id GROUP BY m.conv_id),
p AS (SELECT conv_id, len(ids) AS n, d, sha256(array_to_string(ids[1:d], ',')) AS node, CASE WHEN d > 0 THEN sha256(array_to_string(ids[1:d - 1], ',')) END AS parent, CASE WHEN d > 0 THEN cs[d] ELSE 0 END AS chars
      FROM (SELECT *, unnest(range(len(ids) + 1)) AS d FROM l)),
g AS (
  SELECT d, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256 FROM p GROUP BY d, node),
k AS (SELECT d - 1 AS d, parent AS node, count(*) AS n_children FROM g WHERE d > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN k ON k.d = g.d AND k.node = g.node),
s AS (
  SELECT a.d, a.node, sum((w.n_children = 0)::INT) AS n_leaves, sum((w.n_convs - 1) * w.chars) AS saved_tokens
  FROM w JOIN p a ON a.conv_id = w.conv_id AND a.d <= w.d GROUP BY a.d, a.node)
SELECT w.conv_id, w.d::BIGINT AS depth, u.conv_id AS parent_conv_id, w.n_convs::BIGINT AS n_convs, w.n_children::BIGINT AS n_children,
  s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, w.ends_sha256
FROM w JOIN s ON s.d = w.d AND s.node = w.node LEFT JOIN w u ON u.d = w.d - 1 AND u.node = w.parent
"""
