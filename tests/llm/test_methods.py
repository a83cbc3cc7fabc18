"""Methods against brute force, exact round trips and held-out accuracy."""

import base64
import hashlib
import math
import os
import random
import re
from collections import Counter, defaultdict
from xml.etree import ElementTree

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import bagminhash, bpe, catalog, components, decontam, html, langid, quality, toxicity
from orrery.llm.textkit import chunks, documents

CODEC = bpe.Codec(bpe.read_ranks(bpe.default_path()))
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=CODEC.ids, special_tokens={})
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_bpe_equals_tiktoken(text):
    ids = CODEC.encode(text)
    assert ids.tolist() == TIK.encode_ordinary(text)
    assert CODEC.decode(ids.tolist()).decode() == text
    spans, char = CODEC.offsets(text, ids)
    raw = text.encode()
    for i, (a, b), (c, d) in zip(ids.tolist(), spans.tolist(), char.tolist(), strict=True):
        assert raw[a:b] == CODEC.tokens[i]
        assert raw[a:b] in text[c:d].encode()


def test_bpe_of_all_white_space_and_symbols():
    for p in [*range(0x250), *range(0x2000, 0x2070), 0x3000, 0x1F600, 0xE000]:
        t = f"a{chr(p)}b {chr(p)}1{chr(p)}{chr(p)} x\n{chr(p)} {chr(p)}<|endoftext|>"
        assert CODEC.encode(t).tolist() == TIK.encode_ordinary(t)


def test_bpe_split_characters():
    ids = CODEC.encode("🙂é 日本").tolist()
    assert "".join(CODEC.decode_parts([[i] for i in ids])) == "🙂é 日本"


def test_bpe_round_trip_on_documents(spark, sf_dir):
    docs = documents(spark, sf_dir)
    back = bpe.decode(bpe.encode(docs, keep=["doc_id"], offsets=False))
    assert back.join(docs.withColumnRenamed("text", "t"), "doc_id").where("text <> t").count() == 0
    want = {r[0]: r[1] for r in docs.select("doc_id", F.sha2("text", 256)).collect()}
    got = catalog.QUERIES["op2_byte_bpe"](spark, sf_dir).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in got} == want


def _bag(text, size=5):
    w = WORD.findall(text or "")
    if not w:
        return Counter()
    return Counter([tuple(w)]) if len(w) < size else Counter(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def brute_classes(rows):
    bags = {i: _bag(t) for i, t in rows}
    at = defaultdict(list)
    for i, b in bags.items():
        for s in b:
            at[s].append(i)
    shared = Counter()
    for s, ids in at.items():
        for k, a in enumerate(ids):
            for b in ids[:k]:
                shared[a, b] += min(bags[a][s], bags[b][s])
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), n in shared.items():
        if 5 * n >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in bags}


def _edited(words, n, rng):
    w = list(words)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_decoding_reverses_the_byte_table(monkeypatch):
    class Crossed(dict):
        """A byte table whose reverse takes a for b."""

        def items(self):
            return [({97: 98, 98: 97}.get(b, b), c) for b, c in super().items()]

    ranks = b"\n".join(base64.b64encode(bytes([b])) + f" {b}".encode() for b in range(256))
    plain = bpe.Codec(ranks)
    assert plain.decode(plain.encode("abc \u00e9")) == "abc \u00e9".encode()
    table = bpe.byte_table()
    monkeypatch.setattr(bpe, "byte_table", lambda: Crossed(table))
    crossed = bpe.Codec(ranks)
    assert crossed.decode(crossed.encode("abc")) == b"bac"


def test_near_duplicates_equal_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for k in range(12):
        base = [f"{k}w{rng.randrange(400)}" for _ in range(rng.choice([8, 40, 200]))]
        texts += [" ".join(base)] * 3 + [_edited(base, rng.choice([0, 1, 1, 2, 3]), rng) for _ in range(25)]
    # a chain, each text like the next only
    w = [f"c{i}" for i in range(200)]
    for k in range(8):
        texts.append(" ".join(w[k * 12 : k * 12 + 100]))
    texts += ["a a a a a a a a", "a a a a a a a", "b", "b", None, "", " "]
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in bagminhash.classes(df).collect()}
    assert got == brute_classes(list(enumerate(texts)))


def test_near_duplicates_on_documents(spark, sf_dir):
    rows = [(r[0], r[1]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]
    got = {r[0]: r[1] for r in catalog.QUERIES["op9_near_duplicates"](spark, sf_dir).collect()}
    assert got == brute_classes(rows)


def test_blocks_find_every_pair(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    texts = [_edited(base, rng.choice([1, 2, 3]), rng) for _ in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # only the search in blocks, in which hardly two texts share one
    monkeypatch.setattr(bagminhash, "_estimated", lambda pairs, signed, least: pairs.where("false").select("a", "b"))
    rows = bagminhash.signed_rows(df, "text", ["doc_id"])
    got = {bytes(r["key"]): r["class_id"] for r in bagminhash.text_classes(df, rows, "text", "doc_id", block=1000).collect()}
    assert {r["doc_id"]: got[bytes(r["key"])] for r in rows.collect()} == brute_classes(list(enumerate(texts)))


def test_similar_texts_under_an_unlike_pivot(spark, monkeypatch):
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base), " ".join([*base[:99], "x"]), " ".join(f"z{i}" for i in range(100))]
    # one bucket, and no text in it that is known to be like its pivot
    monkeypatch.setattr(bagminhash, "_banded", lambda signed: signed.select("node", "bytes", F.lit(0).cast("long").alias("bucket")))
    monkeypatch.setattr(bagminhash, "_estimated", lambda pairs, signed, least: pairs.where("false").select("a", "b"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: r[1] for r in bagminhash.classes(df).collect()}
    assert got == {0: 0, 1: 0, 2: 2}


def test_near_duplicates_leave_two_tables(spark, tmp_path):
    from orrery.llm.textkit import shared_dir

    df = spark.createDataFrame([(k, " ".join(f"w{i}" for i in range(100)) + f" {k // 2}") for k in range(8)], "doc_id long, text string")
    at = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at)) if os.path.isdir(at) else set()
    assert {r["class_id"] for r in bagminhash.classes(df).collect()} == {0}
    assert sorted(x.split("-")[0] for x in set(os.listdir(at)) - before) == ["classes", "signed"]


def test_signatures_are_unbiased():
    rng = random.Random(1)
    errors = []
    a, b = [], []
    for k in range(150):
        n = rng.choice([5, 20, 60])
        x = [f"{k}t{rng.randrange(n // 2)}" for _ in range(n)]
        y = list(x)
        for _ in range(rng.randrange(n // 2)):
            y[rng.randrange(n)] = f"{k}u{rng.randrange(n)}"
        a.append(" ".join(x))
        b.append(" ".join(y))
    exact = bagminhash.similarities(pa.array(a), pa.array(b), 1)
    want = [sum((_bag(x, 1) & _bag(y, 1)).values()) / sum((_bag(x, 1) | _bag(y, 1)).values()) for x, y in zip(a, b, strict=True)]
    assert np.allclose(exact, want)
    low = []
    for t in (a, b):
        parts = []
        for c in chunks(pa.array(t)):
            parts.append(bagminhash.signatures(*bagminhash.bags(c, 1), c.rows, slots=512))
        low.append(np.concatenate(parts))
    errors = (low[0] == low[1]).mean(axis=1) - exact
    assert abs(errors.mean()) < 0.006
    assert 0.7 < np.sqrt((errors**2 / np.maximum(exact * (1 - exact) / 512, 1e-9)).mean()) < 1.3


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        u, v = find(u), find(v)
        root[max(u, v)] = min(u, v)
    want = {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert {k: v for k, v in got.items()} == want


def brute_decontam(text, items):
    def norm(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    w, hit, found = norm(text), set(), set()
    for item, t in items:
        v = norm(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(item)
    return len(w), hit, found


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "B", "b", "é", "É", "1", "-", " ", "\n", "a-b", "_"]), max_size=60), st.lists(st.lists(st.sampled_from(["a", "b", "É", "1", "."]), max_size=14), max_size=4))
def test_decontamination_equals_brute_force(parts, items):
    text = " ".join(parts)
    items = [(str(i), " ".join(t)) for i, t in enumerate(items)]
    n, ranges, found = decontam.Scanner(items).scan(text)
    want = brute_decontam(text, items)
    assert (n, {k for a, b in ranges for k in range(a, b)}, found) == want
    for (a, b), (c, d) in zip(ranges, decontam.char_ranges(text, ranges), strict=True):
        assert [w.decode() for w in decontam.words(text[c:d])] == [w.decode() for w in decontam.words(text)][a:b]


def test_decontamination_checks_the_size_of_the_benchmark(spark, sf_dir):
    docs, items = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    # beyond the bound in parts
    assert sorted(decontam.digest(docs, items, max_bytes=200_000).collect()) == sorted(decontam.digest(docs, items).collect())


def resident():
    with open("/proc/self/statm") as f:
        return int(f.read().split()[1]) * 4096


def test_the_automaton_of_a_large_benchmark_is_small():
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k:x}" for k in rng.integers(0, 1 << 30, 100_000)]
    texts = [" ".join(vocabulary[k] for k in rng.zipf(1.3, 120) % 100_000) for _ in range(5500)]
    assert sum(map(len, texts)) > 4_000_000
    before = resident()
    scanner = decontam.Scanner([(str(k), t) for k, t in enumerate(texts)])
    assert resident() - before < 300 << 20
    line = " ".join(texts[7].split()[20:40])
    n, hits, found = scanner.scan(f"x y {line} z")
    assert n == 23 and "7" in found and (2, 22) in hits


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "cc", "é", "#", "\n", " ", "\t", "a b", "\x0b"]), max_size=60))
def test_quality_equals_brute_force(parts):
    text = "".join(parts)
    (c,) = chunks(pa.array([text, "a a a"]))
    s = quality.Stats(c)
    w = WORD.findall(text)
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    assert s.n_words[0] == len(w) and s.word_chars[0] == sum(map(len, w))
    assert s.n_symbols[0] == sum(text.count(x) for x in "#*$%&|<>")
    assert s.n_dup_lines[0] == len(lines) - len(set(lines)) and s.n_repeat_words[0] == len(rep)


def test_cascade_order_changes_nothing():
    texts = pa.array([" ".join(random.Random(i).choices(["word", "###", "A!", "ein", "x" * 20], k=80)) for i in range(60)])
    (c,) = chunks(texts)
    want = ~np.any([r.rejects(quality.Stats(c)) for r in quality.RULES], axis=0)
    for order in (quality.RULES, quality.RULES[::-1]):
        assert (quality.Cascade(order).kept(quality.Stats(c)) == want).all()


def test_quality_plan_is_bounded(spark, sf_dir):
    rules, got = quality.plan(documents(spark, sf_dir), sample_rows=50)
    assert len(rules) == len(got) == len(quality.RULES)
    worth = {m.name: m.worth for m in got}
    assert [worth[r.name] for r in rules] == sorted(worth.values(), reverse=True)


def test_language_accuracy_on_held_out_documents(spark, sf_dir):
    got = catalog.QUERIES["op1_language_id"](spark, sf_dir).join(documents(spark, sf_dir).select("doc_id", "lang"), "doc_id").where("held_out")
    n, right = got.agg(F.count(F.lit(1)), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 20 and right / n > 0.95


def test_bundles_are_sums_of_bound_letters():
    s = langid.Space(256)
    points = np.frombuffer("Ab c".encode("utf-32-le"), np.uint32)
    codes, begin, lettered = s.codes(points, np.array([0, 4]))
    assert lettered[0]
    line = [0, *(s.letters.index(ord(x)) for x in "ab"), 0, s.letters.index(ord("c")), 0]
    want = sum(s.rolled[0, a].astype(int) * s.rolled[1, b] * s.rolled[2, c] for a, b, c in zip(line, line[1:], line[2:], strict=False))
    assert (s.bundle(codes[: begin[1] - 2]) == want).all()
    # as many letters as make the table of runs too large
    many = np.arange(0x4E00, 0x4E00 + 900, dtype=np.uint32)
    codes, begin, _ = s.codes(many, np.array([0, 900]))
    assert s.base == 1024 and abs(s.bundle(codes[: begin[1] - 2])).max() > 0


def test_toxicity_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    got = catalog.QUERIES["op10_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").toPandas()
    hit = got["predicted"] == 1
    assert (got["toxic"][hit] == 1).mean() > 0.9 and hit[got["toxic"] == 1].mean() > 0.5


def test_isotonic_is_monotone_and_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(size=3000)
    y = (rng.random(3000) < 1 / (1 + np.exp(-2 * x))).astype(float)
    px, py = toxicity.isotonic(x, y)
    assert (np.diff(px) >= 0).all() and (np.diff(py) >= 0).all()
    assert abs(np.interp(x, px, py).mean() - y.mean()) < 0.01
    trees = toxicity.Trees(rounds=30).fit(np.stack([x, rng.normal(size=3000)], axis=1).astype(np.float32), y)
    m = trees.margin(np.array([[-2.0, 0], [0, 0], [2.0, 0]], np.float32))
    assert m[0] < m[1] < m[2]


PAGE = "<html><body><nav><a>Home</a></nav><header>Top</header><article><h1>T &amp; {n}</h1><p><b>First {n}<br><p>Second&nbsp;{n}\n line <div class='share'>Share</div><p class='tip'>Read our terms</article><div class='x'>Ever the same</div><footer>&copy; x</footer></body>"


def test_html_main_text():
    assert html.main_text(PAGE.format(n=1)).split("\n") == ["T & 1", "First 1", "Second 1 line", "Read our terms"]
    assert html.main_text(None) == "" and html.main_text("<p>") == ""
    assert html.main_text("<p>a</p><script>var x='</p>'</script><p>b &lt;i&gt;<td>c").split("\n") == ["a", "b <i>", "c"]
    assert html.main_text("<div class=comments><p>no</div><p>yes") == "yes"
    assert html.main_text("<ol id=commentList><li>no</ol><div class='side-bar x'>no</div><div class=commentary>yes</div>") == "yes"


def test_style_tree_removes_what_all_pages_share(spark):
    same = "<body><div class='x'>Ever the same</div><div class='body'><p>Text {n} one</p><p>Text {n} two</p></div><p class='z'>Also the same</p>"
    other = "<section><h2>Only {n}</h2><ul><li>here</ul></section>"
    rows = [(i, f"http://h{i % 2}.com/{i}", same.format(n=i)) for i in range(40)]
    # copies of a page are one page; a host of one page is told by the others
    rows += [(100 + i, "http://h0.com/", same.format(n=4)) for i in range(200)] + [(99, "http://alone.com/", same.format(n=7)), (98, "http://own.com/", other.format(n=8)), (97, None, None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract(df).collect()}
    assert got[4] == got[150] == "Text 4 one\nText 4 two" and got[99] == "Text 7 one\nText 7 two"
    assert got[98] == "Only 8\nhere" and got[97] == ""
    # without the tree all of it stays
    assert html.main_text(same.format(n=4)) == "Ever the same\nText 4 one\nText 4 two\nAlso the same"
    off = {r["page_id"]: r["text"] for r in html.extract(df, threshold=0.0).collect()}
    assert off[4] == html.main_text(same.format(n=4))
    inside = [(i, "http://h.com/", PAGE.format(n=i)) for i in range(40)]
    got = html.extract(spark.createDataFrame(inside, "page_id int, url string, html string")).where("page_id = 3").first()
    assert got["text"] == "T & 3\nFirst 3\nSecond 3 line" and got["n_chars"] == len(got["text"])


def test_importances_equal_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for host, n in (("a.com", 9), ("b.com", 3), ("c.com", 1)):
        for _ in range(n):
            shape = rng.choice(["<div><p>{0}</p></div>", "<div><p>{0}</p><p>{1}</p></div>", "<div><p>{0}</p><ul><li>{1}</li></ul></div>"])
            rows.append((host, "<section>" + shape.format(rng.choice(["s", f"u{rng.random()}"]), rng.choice("xyz")) + "</section><section><h1>same</h1></section>"))
    seen, shapes, widest, pages = defaultdict(set), defaultdict(list), Counter(), Counter()
    for k, (host, page) in enumerate(sorted(set(rows))):
        looks, texts = defaultdict(set), defaultdict(set)

        def walk(e, path, looks=looks, texts=texts):
            looks[path].add(tuple(dict.fromkeys(c.tag for c in e)))
            below = ({e.text} if e.text else set()).union(*[walk(c, f"{path}/{c.tag}") for c in e])
            texts[path] |= below
            return below

        for c in ElementTree.fromstring(f"<html>{page}</html>"):
            walk(c, f"/{c.tag}")
        for path, v in looks.items():
            pages[host, path] += 1
            shapes[host, path] += v
            widest[host, path] = max(widest[host, path], *map(len, v))
            for t in texts[path]:
                seen[host, path, t].add(k)
    want, logs = {}, defaultdict(list)
    for (host, path, _), ks in seen.items():
        logs[host, path].append(math.log(len(ks)))
    for key, v in shapes.items():
        m, n = pages[key], len(v)
        if m > 1:
            entropy = -sum(c / n * math.log(c / n) for c in Counter(v).values()) / math.log(n)
            content = 1 - sum(logs[key]) / len(logs[key]) / math.log(m)
            want[key] = (m, content + (1 - content) * (1 - 0.9 ** widest[key]) * entropy)
    mean = {}
    for path in {p for _, p in want}:
        of = [(m - 1, own) for (_, p), (m, own) in want.items() if p == path]
        mean[path] = sum(w * x for w, x in of) / sum(w for w, _ in of)
    full = {}
    for host, path in shapes:
        m, own = want.get((host, path), (1, 0.0))
        full[host, html._key(path)] = ((m - 1) * own + 8 * mean[path]) / (m + 7) if path in mean else 1.0
    df = spark.createDataFrame([(f"http://{h}/", p) for h, p in rows], "url string, html string")
    got = {(r["host"], r["path"]): r["importance"] for r in html.importance(df).collect()}
    assert got == pytest.approx(full)


def test_html_parts_of_articles():
    assert html.main_text("<article><p>a <math><mi>x</mi></math> b</p></article>") == "a x b"
    assert html.main_text("<form action='x'><div><p>All of the text</p></div></form>") == "All of the text"
    assert html.main_text("<p>All of the text</p><form><p>your mail</form>") == "All of the text"
    assert html.main_text("<p><span class='ad'><span>x</span> leak</span> ok") == "ok"
    assert html.main_text("<div class='widget'><main><p>text</p></main></div><aside>no</aside>") == "text"
    assert html.main_text("<article><p>text</p><div class='comments'><article class='comment'>no</article></div></article>") == "text"
    assert html.main_text("<article><object>shown</object><dialog>too</dialog></article>") == "shown\ntoo"


def test_html_extraction_equals_template(spark, sf_dir):
    from html import unescape

    for r in catalog.QUERIES["op3_html_extraction"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        parts = re.split(r"</?(?:p|h1)>", inner)
        assert r["text"] == "\n".join(x for x in (" ".join(unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in parts) if x)


def test_pipeline_equals_its_stages_by_brute_force(spark, sf_dir):
    import corpus_pipeline

    docs = documents(spark, sf_dir)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    kept = steps["quality_rules"](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    judged = {r["doc_id"] for r in quality.judge(docs).where("kept").collect()}
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == judged
    kept = steps["toxicity"](spark, kept, sf_dir)
    ids = sorted(r["doc_id"] for r in kept.collect())
    classes = brute_classes([(i, rows[i]) for i in ids])
    kept = steps["near_dedup"](spark, kept, sf_dir)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.collect()}
    assert ids == set(classes.values())
    items = [(str(r[0]), r[1]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    scanner = decontam.Scanner(items)
    want = {i for i in ids if not scanner.scan(rows[i])[1]}
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == want


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    from tests.compare import assert_same

    assert_same(spark, sf_dir, catalog.QUERIES[name], catalog.SQL[name])


def test_toxicity_is_calibrated_on_held_out_rows(spark):
    at = "/root/testdata/sf0.01"
    if not os.path.exists(at):
        pytest.skip("no test tables here")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    got = toxicity.op10_toxicity(spark, at).join(labels, "doc_id").where("held_out").select("score", "toxic").toPandas()
    p, y = got["score"].to_numpy(), got["toxic"].to_numpy()
    assert ((p - y) ** 2).mean() < 0.05 < (y.mean() * (1 - y.mean()))
    # scores are neither all too high nor all too low
    assert abs(p.mean() - y.mean()) < 0.05
    for sure in (p < 0.1, p > 0.9):
        assert abs(p[sure].mean() - y[sure].mean()) < 0.1


def test_toxicity_learns_the_same_from_repeated_ids_in_any_order(spark, sf_dir):
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    again = docs.unionByName(docs.limit(40).withColumn("text", F.concat(F.lit("you "), "text"))).withColumn("text", F.when(F.col("doc_id") % 17 == 0, None).otherwise(F.col("text")))
    more = labels.unionByName(labels.limit(9)).unionByName(spark.createDataFrame([(None, 1, 1), (5, 1, None)], labels.schema))
    models = [toxicity.train(d, more) for d in (again, again.orderBy(F.rand(2)).repartition(5))]
    texts = pa.array(["", None, "you stupid idiot", "x" * 200_000, "🙂 ünïcödé", "YOU!!! 1d10t"])
    first, second = (m.score(texts) for m in models)
    assert first.tolist() == second.tolist() and ((0 <= first) & (first <= 1)).all()
