"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names."""

import gzip
import re

import pytest
from pyspark.sql import functions as F

from orrery.llm import bagminhash, bpe, compaction, decontam, html, langid, quality, toxicity, urlfilter, warc
from orrery.llm.textkit import Scratch, fresh_dir

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
TEXTS = [None, "", "   \n\t ", "a", "one two three", "é" * 3, "x" * 5000, LONG, "one two three", "ein Satz\nein Satz\nmit Wörtern", "🙂 �  \u00a0"]
CLASH = "doc_id long, text string, lang string, n_words string, score string, host string, kept int, ids string, key string, sig string, __text string, Predicted int, __key string, __n int, __id long, class_id string"


def table(spark, rows=None):
    rows = [(i if i != 4 else None, t, "en" if i % 2 else None) for i, t in enumerate(TEXTS)] if rows is None else rows
    return spark.createDataFrame([(*r, "7", "s", "h", 1, "i", "k", "g", "t", 3, "kk", 9, 5, "c") for r in rows], CLASH)


def items(spark, rows=((1, "one two three"), (None, "a b"), (3, None), (4, ""), (1, "one two three"))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


PROFILES = {}


def profiles(spark):
    if not PROFILES:
        df = spark.createDataFrame([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), (None, "fr"), ("...", "es")], "text string, lang string")
        PROFILES["p"] = langid.learn(df)
    return PROFILES["p"]


OPERATORS = {
    "langid": lambda df: langid.identify(df, profiles(df.sparkSession)),
    "bpe": lambda df: bpe.encode(df),
    "bpe_digest": lambda df: bpe.digest(df),
    "quality": lambda df: quality.judge(df),
    "quality_filter": lambda df: quality.filter_kept(df),
    "decontam": lambda df: decontam.mark(df, items(df.sparkSession)),
    "decontam_digest": lambda df: decontam.digest(df, items(df.sparkSession)),
    "decontam_filter": lambda df: decontam.filter_clean(df, items(df.sparkSession)),
    "near_classes": lambda df: bagminhash.classes(df),
    "near_filter": lambda df: bagminhash.filter_first(df),
    "toxicity": lambda df: toxicity.score(df, toxicity.Model(toxicity.Lexicon(), None)),
    "toxicity_filter": lambda df: toxicity.filter_clean(df, toxicity.Model(toxicity.Lexicon(), None)),
    "html": lambda df: html.extract(df.withColumn("url", F.lit("http://a.b/c")).withColumnRenamed("text", "html")),
    "url": lambda df: urlfilter.judge(df.withColumnRenamed("text", "url"), urlfilter.entries(df.sparkSession, urlfilter.RULES)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_is_answered(spark, name):
    got = OPERATORS[name](table(spark))
    assert len(set(map(str.lower, got.columns))) == len(got.columns)
    rows = got.collect()
    if name.endswith("filter"):
        assert got.columns == table(spark).columns
        assert len(rows) <= len(TEXTS)
    else:
        assert len(rows) == len(TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](table(spark, [])).count() == 0


def test_near_filter_keeps_one_of_each(spark):
    kept = [r["text"] for r in bagminhash.filter_first(table(spark)).collect()]
    assert kept.count("one two three") == 1
    # texts without a word are no copies of each other
    assert sum(t is None or not t.strip() for t in kept) == 3
    again = table(spark, [(1, "b c", None), (1, "b c", None), (2, "b c", None)])
    assert bagminhash.filter_first(again).count() == 1


def test_near_classes_of_ties(spark):
    got = {r["doc_id"]: r["class_id"] for r in bagminhash.classes(table(spark, [(9, "b c d", None), (3, "b c d", None), (3, "b c d", None), (None, "b c d", None), (7, "", None), (None, None, None)])).collect()}
    assert got[9] == 3 and got[3] == 3 and got[7] == 7


def test_quality_counts_of_nulls(spark):
    got = {r["doc_id"]: r for r in quality.judge(table(spark), keep=["doc_id"]).collect()}
    for i in (0, 1, 2):
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["base_failed"], got[i]["kept"]) == (0, 0, True, False)
    assert got[9]["n_dup_lines"] == 1


def test_langid_unknown(spark):
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(table(spark), profiles(spark), keep=["doc_id"]).collect()}
    assert got[0] == got[1] == got[2] == "und" and got[3] in ("en", "de")
    none = langid.learn(table(spark, []))
    assert none.languages == ()
    assert {r[0] for r in langid.identify(table(spark), none).select("lang_pred").collect()} == {"und"}


def test_warc_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "http://x/\r\nWARC/1.0 %41", ""), (None, "u", "p"), (3, "u", "p\r\n\r\nWARC/1.1\r\n"), (4, "u", "p\r\n\r\nWARC/1.1\r\n"), (4, "u", "é" * 99_999)], "page_id long, url string, html string")
    at = fresh_dir(spark, "warc")
    warc.write_archive(df, at, file_bytes=1)
    raw = warc.read_archive(spark, at)
    got = warc.resolve(raw)
    rows = {(r["id"], r["payload_bytes"]): r for r in got.collect()}
    assert len(rows) == 6
    assert rows[2, 0]["refers_to"] == 1 and rows[2, 0]["url"] == "http://x/\r\nWARC/1.0 %41"
    assert rows[4, 15]["refers_to"] == 3 and rows[4, 15]["payload_digest"] == rows[3, 15]["payload_digest"]
    assert rows[None, 1]["record_type"] == "response"
    again = fresh_dir(spark, "warc")
    warc.rewrite(spark, at, again)
    assert sorted(map(str, warc.resolve(warc.read_archive(spark, again)).drop("date").collect())) == sorted(map(str, got.drop("date").collect()))
    empty = fresh_dir(spark, "warc")
    warc.write_archive(df.limit(0), empty)
    assert warc.resolve(warc.read_archive(spark, empty)).count() == 0
    small = fresh_dir(spark, "warc")
    warc.write_archive(df, small, min_bytes=1)
    assert warc.read_archive(spark, small).where("record_type = 'revisit'").count() == 1


def test_warc_of_one_hot_payload(spark):
    n = 400
    df = spark.createDataFrame([(i, f"http://h/{i}", "hot" if i % 2 else f"own {i % 300}") for i in range(n)], "page_id long, url string, html string")
    want = {i: ("revisit", 1) if i % 2 and i > 1 else ("revisit", i - 300) if i >= 300 and not i % 2 else ("response", None) for i in range(n)}
    with Scratch(spark) as s:
        rows = df.select(F.col("page_id").alias("id"), F.sha1("html").alias("payload_digest"), F.octet_length("html").alias("payload_bytes"), F.col("html").alias("payload"), "url")
        for size in (1, 1 << 20):
            out = warc.decide(s, rows, max_filter_bytes=size).collect()
            assert {r["id"]: (r["record_type"], r["refers_to"]) for r in out} == want and len(out) == n
            assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in out)


def test_warc_records_are_http_responses(spark):
    at = fresh_dir(spark, "warc")
    warc.write_archive(spark.createDataFrame([(7, "http://h/a", "é"), (9, "http://h/b", "é")], "page_id long, url string, html string"), at)
    raw = b"".join(gzip.decompress(r["content"]) for r in spark.read.format("binaryFile").load(at).where("length > 0").collect())
    assert raw.count(b"WARC/1.1\r\n") == 2 and raw.count(b"HTTP/1.1 200 OK\r\n") == 1 and raw.count(b"WARC-Refers-To: <urn:uuid:") == 1
    ids = re.findall(rb"WARC-Record-ID: <urn:uuid:([0-9a-f-]{36})>", raw)
    assert len(set(ids)) == 2 and not re.search(rb"WARC-Date: (?!20\d\d-\d\d-\d\dT\d\d:\d\d:\d\dZ\r)", raw)


def test_compaction(spark):
    store = compaction.ShardStore(spark, fresh_dir(spark, "store"), target_bytes=1 << 20, fan_in=3)
    assert store.manifest().version == 0
    df = table(spark)
    for _ in range(4):
        store.append(df)
    before = store.manifest()
    last = store.compact()
    assert last > before.version and len(store.manifest().shards) < len(before.shards)
    assert store.read().count() == 4 * df.count() == store.read(before.version).count()
    wider = df.withColumn("more", F.lit(1))
    store.append(wider)
    assert store.read().where("more = 1").count() == df.count() and store.read().count() == 5 * df.count()
    store.append(df.limit(0))
    with pytest.raises(compaction.Conflict):
        store._commit(store.manifest())
    assert store.vacuum() > 0 and store.read().count() == 5 * df.count()


def test_url_rules(spark):
    urls = ["http://www.example.com/en/x", "http://example.com/en/", "http://a.b.EXAMPLE.com/en/?q", "x://fr.net/fr/1", "x://net/es/", "x://xnet/es/", "http://a.com", "http://a.com/", None, "nothing", "://", "http://a.org/#b", "x://e.com:80/en/"]
    want = ["www.example.com/en/", "example.com/en/", "example.com/en/", "net/fr/", "net/es/", None, None, "com/", None, None, None, None, None]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    rules = urlfilter.entries(spark, urlfilter.RULES)
    for size in (256 << 20, 0):  # with the filter, and beyond its bound
        got = {r["page_id"]: r for r in urlfilter.judge(df, rules, max_filter_bytes=size).collect()}
        assert [got[i]["rule"] for i in range(len(urls))] == want
        assert got[0]["verdict"] == "allow" and got[1]["verdict"] == "block" and got[8]["verdict"] == "allow"
    none = urlfilter.judge(df, rules.limit(0), default="block")
    assert {r["verdict"] for r in none.collect()} == {"block"}


CANONICAL = {
    "HTTP://Me:pw@Example.COM.:80": "http://example.com/",
    "https://example.com:443/a/./b/../c?x=%7e#frag": "https://example.com/a/c?x=~",
    "http://example.com:8080/%41%2f%2F%zz": "http://example.com:8080/A%2F%2F%25zz",
    "http://example.com/../..": "http://example.com/",
    "http://example.com/a/..": "http://example.com/",
    "http://example.com/a//b/": "http://example.com/a//b/",
    "ftp://h:21/x": "ftp://h/x",
    "http://h:/x": "http://h/x",
    "http:///x": None,
    "no url": None,
    None: None,
}


def test_canonical_urls(spark):
    df = spark.createDataFrame([(u,) for u in CANONICAL], "url string")
    got = {r["url"]: r["c"] for r in df.select("url", urlfilter.canonical(F.col("url")).alias("c")).collect()}
    assert got == CANONICAL
    again = df.where(urlfilter.canonical(F.col("url")).isNotNull()).select(urlfilter.canonical(F.col("url")).alias("c"))
    assert again.where(urlfilter.canonical(F.col("c")) != F.col("c")).count() == 0


def test_listed_urls(spark):
    listed = spark.createDataFrame([("http://bad.org:80/x%79", "block"), ("http://bad.org/xy#z", "block"), ("http://www.example.com/en/a", "block"), (None, "block")], "url string, verdict string")
    urls = ["http://BAD.org./xy", "http://u@bad.org/a/../xy?", "http://bad.org/xy/", "http://www.example.com/en/a", None, "http://bad.org./xy"] + [f"http://ok{i}.org/{i}/" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    for size in (256 << 20, 0):
        got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(df, urlfilter.entries(spark, urlfilter.RULES), urls=listed, max_filter_bytes=size).collect()}
        assert len(got) == len(urls)
        assert {i for i, v in got.items() if v[1] == "block"} == {0, 5}
        assert got[3] == ("www.example.com/en/", "allow")


def test_rules_within_a_segment(spark):
    rules = urlfilter.entries(spark, [("a.com", "/foo", "block"), ("a.com", "/foo/ba", "allow"), ("a.com", "", "allow"), ("com", "/foo/b", "block")])
    urls = ["http://a.com/foobar", "http://x.a.com/foo/bar/z", "http://a.com/fo", "http://b.com/foo/b", "http://b.com/foo/", "http://b.com/foo/b"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id int, url string")
    got = {r["page_id"]: r["rule"] for r in urlfilter.judge(df, rules).collect()}
    assert got == {0: "a.com/foo", 1: "a.com/foo/ba", 2: "a.com", 3: "com/foo/b", 4: None, 5: "com/foo/b"}


def test_bloom_has_no_false_negatives():
    import numpy as np

    keys = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 20_000)
    b = urlfilter.BlockedBloom.sized(10_000)
    b.add(keys[:10_000])
    assert b.may_have(keys[:10_000]).all()
    assert b.may_have(keys[10_000:]).mean() < 0.02
