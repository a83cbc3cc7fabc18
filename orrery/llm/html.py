"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree, whose nodes are the paths of block
elements (tag with its first class or id, digits left out).  Equal pages of a host count
as one.  A node knows how many pages have it, in which presentations (sequences of
children) and with which content (texts below it).  With m pages, its content's importance
is 1 minus the mean over its texts of log(pages with the text) / log(m), its presentation's
is their entropy over its greatest value; its own is content + (1 - content) (1 - 0.9^children)
presentation.  Menus, adverts and notices come with the same few presentations and texts
on all pages, so that their importance is near 0.  Few pages tell little: the importance of
a node on m pages is taken as the mean of its own with a weight of m - 1 and that of the
path on all hosts (mean over hosts, by m - 1) with a weight of `PRIOR`.  A path that no
host has on two pages has importance 1.  Branches of low importance are removed from each
page, whatever they are; the tree counts all elements, also those below.

What a tree can't tell is decided by the page: elements that are no content by their tag,
role, class or id are removed (reader comments differ from page to page).  A class or id
says so as a whole (`share-buttons`, not `share-price`).  A form that has
more than half of the page's text is a wrapper and stays, and so does an element with such a
name around the only `article` or `main`.  If text in an `article` or `main` is left, the
page's text is what these hold, whether or not branches were removed.

The text of a block is its characters with references decoded and runs of white space
made one space, trimmed; blocks are joined by line feeds in page order.  A null page is
empty; a page without text has the empty text.  Broken and truncated markup is read as
far as it goes.  A null URL, or one without a host, has the empty host.  Repeated pages
are extracted each; an empty table gives an empty result.  Texts of any length are read whole.  Columns of the input with the
name of an output are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Sequence
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bloom_join import split_by
from .textkit import Scratch, bound_batches, free_name, give_back, pages, stored
from .urlfilter import host_of

#: The least importance that stays, and the weight of what other hosts tell, in pages.
THRESHOLD = 0.2
PRIOR = 8.0
GAMMA = 0.9
#: Flags of all hosts that may be broadcast.
MAX_BROADCAST_BYTES = 8 << 20

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?>"[^"]*"|'[^']*'|[^>"']|["'])*+)>?""", re.S)
_ATTR = re.compile(r"""(?:^|[\s"'/])(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var "
              "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
#: Elements that are no part of a main text.
_NEVER = set("head nav aside noscript button select option datalist menu template svg annotation annotation-xml footer".split())
#: Words of a class or id that name such parts.
_PARTS = set(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promoted promotion sidebar sidenav comment comments disqus respond reply replies "
    "cookie cookies consent gdpr notice notices alert newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs menu nav navbar navigation "
    "navi footer popup modal overlay widget widgets login signup signin search pagination pager toolbar skip masthead topbar copyright disclaimer paywall form discussion feedback".split()
)
#: Words beside them that only say where or how such a part is shown.
_PLAIN = set(
    "container box boxes wrapper wrap list block blocks bar area section item items inner outer left right top bottom main site page button buttons btn slot unit panel group row col column "
    "content header title link links icon icons count text js wp global primary secondary module holder region zone label sticky fixed side entry post dropdown".split()
)
_ANY = lambda words: "|".join(sorted(words, key=lambda w: (-len(w), w)))
#: A name that consists of such words, one of _PARTS among them, with its separators left out.
_NAMES = re.compile(rf"(?:{_ANY(_PLAIN)})*?(?:{_ANY(_PARTS)})(?:{_ANY(_PLAIN | _PARTS)})*")
_HEADS = re.compile(rf"(?:{_ANY(_PLAIN)})*?header(?:{_ANY(_PLAIN | _PARTS)})*")
_LETTERS = re.compile(r"[\s_\-:0-9]+")
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "note"}
#: Opening one of these closes an open one of the others, up to a container.
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_HOLDS = {"ul", "ol", "dl", "table", "menu", "select"}
_DIGITS = re.compile(r"\d+")


class Node:
    """An open block element."""

    __slots__ = ("tag", "label", "path", "landmark", "named", "dropped", "children", "size")

    def __init__(self, tag: str, label: str, path: str, landmark: bool, named: bool, dropped: bool):
        self.tag, self.label, self.path = tag, label, path
        #: in a landmark; no content by its name (or a form); no content by its tag, or in such an element
        self.landmark, self.named, self.dropped = landmark, named, dropped
        self.children, self.size = [], 0


def _facts(tag: str, attrs: str, inside: bool) -> tuple[str, bool, bool, bool]:
    """Label of an element, whether it is no content by its tag, whether it is by its role,
    class or id (or is a form), and whether it is a landmark."""
    dropped, named, landmark, name = tag in _NEVER, tag == "form" or tag == "dialog" and not inside, tag in ("article", "main"), ""
    if tag == "header" and not inside:
        dropped = True
    if attrs and not attrs.isspace():
        for key, a, b, c in _ATTR.findall(attrs):
            key, value = key.lower(), a or b or c
            if key in ("class", "id"):
                whole = [_LETTERS.sub("", w).lower() for w in value.split()]
                if not (landmark and tag == "main") and any(map(_NAMES.fullmatch, whole)):
                    named = True
                if not inside and tag in ("div", "section", "table") and any(map(_HEADS.fullmatch, whole)):
                    named = True
                if value and (not name or key == "class"):
                    name = ("." if key == "class" else "#") + _DIGITS.sub("0", value.split()[0] if value.split() else "")
            elif key == "role":
                role = value.strip().lower()
                named |= role in _ROLES
                landmark |= role in ("main", "article")
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
                dropped = True
    return tag + name, dropped, named, landmark


def _end(page: str, tag: str, at: int) -> int:
    """Where an inline element that was opened before `at` ends; `at` if it never does."""
    depth = 1
    for m in re.compile(rf"<(/?){tag}\b[^>]*>", re.I).finditer(page, at):
        depth += -1 if m[1] else 1
        if not depth:
            return m.end()
    return at


Text = tuple[str, list[Node]]


def blocks(page: str) -> tuple[list[Text], list[Node]]:
    """Texts of a page in order, each with the elements it lies in, and all elements with
    their children's labels."""
    root = Node("html", "html", "", False, False, False)
    stack, texts, nodes, held = [root], [], [root], []
    at, end = 0, len(page)

    def close() -> None:
        if held:
            if text := " ".join("".join(held).split()):
                texts.append((text, stack[1:]))
                for n in stack if not stack[-1].dropped else ():
                    n.size += len(text)
            held.clear()

    def pop_to(depth: int) -> None:
        close()
        del stack[depth:]

    while at < end:
        m = _TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at:
            piece = page[at:stop]
            held.append(unescape(piece) if "&" in piece else piece)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                held.append(m[0][9:-3] if m[0].endswith("]]>") else m[0][9:])
            continue
        tag = tag.lower()
        if m[1]:
            if tag in _INLINE:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    pop_to(k)
                    break
            else:
                close()
            continue
        if tag in _RAW:
            shut = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = shut.end() if shut else end
            continue
        if tag == "br":
            held.append(" ")
            continue
        if tag in _INLINE:
            if stack[-1].dropped:
                continue
            attrs = m[3]
            if attrs and not attrs.isspace() and any(_facts(tag, attrs, True)[1:3]):
                # an inline part that is no content: skip it as a block of its own would be
                at = _end(page, tag, at)
            continue
        if tag in _VOID:
            if tag == "hr":
                close()
            continue
        close()
        if stack[-1].tag == "p":
            pop_to(len(stack) - 1)
        if tag in _SIBLINGS:
            cut = 0
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _HOLDS:
                    break
                if stack[k].tag in _SIBLINGS[tag]:
                    cut = k
            if cut:
                pop_to(cut)
        up = stack[-1]
        if tag in ("html", "body") and len(stack) == 1 and not m[3].strip():
            continue
        label, dropped, named, landmark = _facts(tag, m[3], up.landmark)
        node = Node(tag, label, f"{up.path}/{label}", landmark and not named or up.landmark, named, dropped or up.dropped)
        if tag in ("html", "body"):
            node.named, node.dropped = False, up.dropped
        up.children.append(label)
        stack.append(node)
        nodes.append(node)
    close()
    return texts, nodes


def _key(text: str) -> int:
    """A signed 64-bit hash."""
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def content(texts: list[Text], nodes: list[Node]) -> list[Text]:
    """The texts that lie in no element which is no content by its tag, role, class or id."""
    texts, nodes = [(t, inside) for t, inside in texts if not (inside and inside[-1].dropped)], [n for n in nodes if not n.dropped]
    total = nodes[0].size
    lies = lambda inside: any(n.named for n in inside)
    # without a landmark outside of such elements, those around one are wrappers
    if not any(n.landmark and not lies([m for m in inside if m is not n]) for _, inside in texts for n in inside):
        for _, inside in texts:
            for k, n in enumerate(inside):
                n.named &= not any(m.landmark for m in inside[k + 1 :])
    for n in nodes:
        n.named &= not (n.tag == "form" and 2 * n.size > total)
    return [(t, inside) for t, inside in texts if not lies(inside)]


def _tree():
    """Counts of pages by (host, path, what): kind 0 has presentations, kind 1 texts, and
    kind 2 the pages themselves."""

    def run(batches):
        for b in batches:
            count: Counter = Counter()
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                texts, nodes = blocks(page or "")
                seen = set()
                for n in nodes[1:]:
                    kinds = dict.fromkeys(n.children)
                    k = _key(n.path)
                    seen.add((host, k, 0, _key("|".join(kinds)), len(kinds)))
                    seen.add((host, k, 2, 0, 0))
                for text, inside in texts:
                    k = _key(text)
                    for n in inside:
                        seen.add((host, _key(n.path), 1, k, 0))
                count.update(seen)
                if len(count) > 200_000:
                    yield _counts(count)
                    count.clear()
            yield _counts(count)
        give_back()

    return run


def _counts(count: Counter) -> pa.RecordBatch:
    cols = list(zip(*count, strict=True)) if count else [[]] * 5
    types = (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(cols, types, strict=True)], pa.array(list(count.values()), pa.int64())], ["host", "path", "kind", "what", "wide", "n"])


def _once(s: Scratch, rows: DataFrame) -> DataFrame:
    """Each page of a host once.  Only pages that may be copies of others are shuffled, and
    of those one for each task."""
    rows = rows.withColumn("h", F.xxhash64("host", "html"))
    again = s.stored(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "copies")
    mark, unmarked = split_by(rows, "h", again)
    return unmarked.select("host", "html").unionByName(mark.dropDuplicates(["host", "h", "html"]).select("host", "html"))


def importance(df: DataFrame, url_col: str = "url", html_col: str = "html", gamma: float = GAMMA, prior: float = PRIOR) -> DataFrame:
    """host, path (hash), pages and importance of all nodes of the hosts' style trees,
    written to the shared folder.

    Counts are gathered in each task before they are shuffled, so that a host of any size
    sends one row for each of its nodes' presentations and texts."""
    bound_batches(df.sparkSession)
    with Scratch(df.sparkSession) as s:
        rows = df.select(host_of(F.col(f"`{url_col}`").cast("string")).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html")).where("html is not null")
        counts = _once(s, rows).mapInArrow(_tree(), "host string, path long, kind int, what long, wide int, n long").groupBy("host", "path", "kind", "what").agg(F.sum("n").alias("n"), F.max("wide").alias("wide"))
        # an entropy is log of the sum of n, less the sum of n log n over the sum of n
        shape = F.col("kind") == 0
        sums = counts.groupBy("host", "path").agg(
            F.sum(F.when(F.col("kind") == 2, F.col("n"))).alias("pages"),
            F.sum(F.when(shape, F.col("n"))).alias("shapes"),
            F.sum(F.when(shape, F.col("n") * F.log("n"))).alias("nlogn"),
            F.max(F.when(shape, F.col("wide"))).alias("wide"),
            F.avg(F.when(F.col("kind") == 1, F.log("n"))).alias("logn"),
        )
        log_m, log_s = F.log("pages"), F.log("shapes")
        look = (log_s - F.col("nlogn") / F.col("shapes")) / log_s
        texts = F.coalesce(1 - F.col("logn") / log_m, F.lit(0.0))
        own = texts + (1 - texts) * (1 - F.pow(F.lit(gamma), F.col("wide"))) * look
        nodes = s.stored(sums.select("host", "path", "pages", F.when(F.col("pages") > 1, own).alias("own")), "nodes")
        weight = F.col("pages") - 1
        others = s.stored(nodes.where("pages > 1").groupBy("path").agg((F.sum(F.col("own") * weight) / F.sum(weight)).alias("all")), "paths")
        mean = (F.coalesce(F.col("own") * weight, F.lit(0.0)) + F.col("all") * prior) / (weight + prior)
        return stored(nodes.join(others, "path", "left").select("host", "path", "pages", F.coalesce(mean, F.lit(1.0)).alias("importance")), "importance")


def main_text(page: str | None, low: frozenset | set | Sequence[int] = ()) -> str:
    """The text of a page without the branches whose path hashes are in `low`."""
    texts, nodes = blocks(page or "")
    flagged = {n.path for n in nodes[1:] if _key(n.path) in low} if len(low) else set()
    texts = content(texts, nodes)
    if flagged:
        texts = [(t, inside) for t, inside in texts if not any(n.path in flagged for n in inside)]
    held = [(t, inside) for t, inside in texts if inside and inside[-1].landmark]
    return "\n".join(t for t, _ in held or texts)


def _extract(names: list[str]):
    def run(batches):
        for b in batches:
            html, low = b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            texts = [main_text(h, frozenset(x or ())) for h, x in zip(html, low, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names)
        give_back()

    return run


def extract(df: DataFrame, url_col: str = "url", html_col: str = "html", keep: Sequence[str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """df's columns (or those in `keep`) with text and n_chars."""
    low = importance(df, url_col, html_col).where(F.col("importance") < threshold)
    low = stored(low.groupBy("host").agg(F.collect_set("path").alias("low")), "branches")
    size = low.agg(F.coalesce(F.sum(8 * F.size("low") + F.octet_length("host") + 32), F.lit(0))).first()[0]
    out = T._parse_datatype_string("text string, n_chars long")
    kept = [f for f in df.schema if (keep is None or f.name in keep) and f.name.lower() not in ("text", "n_chars")]
    host, html, flags = (free_name(df, c) for c in ("__host", "__html", "__low"))
    src = df.select(*[F.col(f"`{f.name}`") for f in kept], host_of(F.col(f"`{url_col}`").cast("string")).alias(host), F.col(f"`{html_col}`").cast("string").alias(html))
    low = low.toDF(host, flags)
    src = src.join(F.broadcast(low) if size <= MAX_BROADCAST_BYTES else low, host, "left").drop(host)
    full = T.StructType(kept + list(out))
    return src.mapInArrow(_extract(full.names), full)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(pages(spark, sf_dir), keep=["page_id", "url"])
