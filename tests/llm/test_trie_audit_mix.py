"""Prefix trie, source divergence and source mixing against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from orrery.llm import divergence, mixing, prefix_trie

CONV = "conv_id long, turn long, role string, text string, id string, depth int, b string, level int, kids string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z") for r in rows], CONV)


def ordered(rows):
    """Each conversation's (role, text), in the stated order."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).digest()[:16]
            out[conv].append(((turn is not None, turn or 0), digest, (role, text)))
    return {c: [t[2] for t in sorted(v, key=lambda t: t[:2])] for c, v in out.items()}


def brute_trie(convs):
    members = defaultdict(list)
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, ms in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(ms) - 1) * len(p[-1][1]) if p else 0
    out = set()
    for p, ms in members.items():
        ends = ",".join(str(c) for c in sorted(ms) if len(convs[c]) == len(p))
        out.add((min(ms), len(p), min(members[p[:-1]]) if p else None, len(ms), kids[p], leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(own):
    out = {}
    for c, ts in own.items():
        h = crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return out


def talk(seed, convs=60, longest=30):
    rng = random.Random(seed)
    rows = []
    for k in range(convs):
        c = rng.choice([k, 100 + k, 200, 5000 + k])
        for i in range(rng.choice([1, 2, 3, 8, 9, 16, 17, longest])):
            rows.append((c, rng.choice([i, i, i // 2, None]), rng.choice(["user", "assistant", None]), rng.choice(["é", "ab", "", None]) if i < 5 else f"t{i % 7}"))
    # copies of one long conversation, and repeated rows
    rows += [(10_000 + k, i, "user", f"w{i}") for k in range(9) for i in range(20)] + rows[:20] + [(None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    rows = talk(seed)
    ranked = prefix_trie.ranked(prefix_trie.turns(conversations(spark, rows)))
    own = ordered(rows)
    assert {tuple(r) for r in prefix_trie.trie(prefix_trie.whole(ranked)).collect()} == brute_trie(own)
    got = prefix_trie.trie(prefix_trie.rebuilt(ranked)).collect()
    assert {tuple(r) for r in got} == brute_trie(rebuilt(own))
    assert len(got) == len({tuple(r) for r in got})


def test_trie_of_long_conversations_in_pieces(spark, monkeypatch):
    rows = talk(3, 20, 200) + [(7, 1, "user", "same")] * 50
    df = prefix_trie.turns(conversations(spark, rows))
    want = {tuple(r) for r in prefix_trie.ranked(df).collect()}
    pieces = prefix_trie.ranked(df, long=16)
    assert {tuple(r) for r in pieces.collect()} == want
    whole = prefix_trie.whole(pieces)
    assert sorted(prefix_trie.blocks(whole, 2).collect(), key=str) == sorted(prefix_trie.blocks(whole).collect(), key=str)
    monkeypatch.setattr(prefix_trie, "IDS", 1)
    assert {tuple(r) for r in prefix_trie.trie(whole).collect()} == brute_trie(ordered(rows))


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    none = conversations(spark, [])
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.ranked(prefix_trie.turns(none)))).count() == 0
    # conversations that lose their only turn to a group without its first one
    rows = [(c, 0, "user", "x") for c in range(101, 200) if crc32(str(c).encode()) % 6 > 0]
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.ranked(prefix_trie.turns(conversations(spark, rows))))).collect()
    assert {tuple(r) for r in got} == brute_trie(rebuilt(ordered(rows)))
    assert len(got) == 1 and got[0].n_leaves == 1


def test_trie_plan_has_one_rollup_for_all_prefixes(spark):
    rows = prefix_trie.whole(prefix_trie.ranked(prefix_trie.turns(conversations(spark, talk(4)))))
    parts = prefix_trie.blocks(rows)
    cols = [F.get("turns", F.lit(i)).alias(t) for i, t in enumerate(prefix_trie._T)]
    plan = prefix_trie._rolled(parts.select("b", *prefix_trie._KEY, "conv_id", *cols), "count(1) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1
    assert "spark_grouping_id" in plan


DOCS = "doc_id long, text string, lang string, source string, term string, size string, n int, skey string, target string, bucket int, id string"


def documents(spark, rows):
    return spark.createDataFrame([(*r, "t", "s", 1, "k", "x", 3, "i") for r in rows], DOCS)


def corpus(seed, n=150):
    rng = random.Random(seed)
    words = ["the", "Of", "ÄRGER", "straße", "x-ray", "don't", "a1b2", "日本", "zebra", "Zebra", " ", "é", "", "\t", "1"] + [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 30, 200]))) if i % 17 else None, rng.choice(["en", "en", "de", None, ""]), rng.choice(["hot", "hot", "a", "b", "ß", None])) for i in range(n)]
    rows += rows[:10] + [(None, "the the\x00the", "en", "hot"), (None, "lonely", "xx", "one"), (9999, "big " * 3000, "en", "a"), (9998, None, "yy", "one"), (9997, "1 2 3", "yy", "two")]
    return rows


def brute_audit(rows):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        ws = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
        count[lang, source].update(ws)
        docs[lang].update(set(ws))
        groups[lang].add(source)
    out = set()
    for lang, sources in groups.items():
        kept = [w for w, d in docs[lang].items() if d >= 3]
        v = len(kept)

        def shares(c, kept=kept, v=v):
            n = sum(c[w] for w in kept)
            return {w: 1 + 1_000_000_000 * (c[w] + 1) // (n + v) for w in kept}

        p = {s: shares(count[lang, s]) for s in sources}
        q = shares(sum((count[lang, s] for s in sources), Counter()))
        for s in sources:
            f = lambda a, b, w: (a[w] - b[w]) ** 2 // b[w]
            pair = [(o, sum(f(p[s], p[o], w) for w in kept)) for o in sources if o != s]
            term = [(w, f(p[s], q, w)) for w in kept if count[lang, s][w] and p[s][w] > q[w]]
            for part, items, top in (("pair", pair, None), ("term", term, 200)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, i, x, r) for r, (i, x) in enumerate(items[:top], 1)}
    return out


@pytest.mark.parametrize("held", [1, 200_000])
def test_audit_equals_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(divergence, "HELD_TERMS", held)
    rows = corpus(held)
    got = divergence.audit(documents(spark, rows)).collect()
    assert {tuple(r) for r in got} == brute_audit(rows)
    assert len(got) == len({tuple(r) for r in got})


def test_audit_of_nothing_of_one_source_and_of_many(spark):
    assert divergence.audit(documents(spark, [])).count() == 0
    assert divergence.audit(documents(spark, [(1, "a", "en", "s")])).count() == 0
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(99)] + ["all"] * 9, k=12)), "en", f"s{i % 70}") for i in range(400)]
    assert {tuple(r) for r in divergence.audit(documents(spark, rows)).collect()} == brute_audit(rows)


def test_terms_are_those_of_the_pattern():
    text = "".join(map(chr, range(256))) + " ÄÖ x A_b\x7fC" + "y" * 100_000
    assert [t.decode() for t in divergence.terms(text)] == re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate({k: k + 32 for k in range(65, 91)}))


def brute_targets(sizes, weights=(1, 2, 3), epochs=3):
    """Shares by weight, the excess over `epochs` sizes shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = total - sum(full.values())
        rate = sum(w[s] for s in names if s not in full)
        target = {s: full.get(s, Fraction(rest * w[s], rate or 1)) for s in names}
        above = {s: Fraction(epochs * sizes[s]) for s in names if s not in full and target[s] > epochs * sizes[s]}
        if not above:
            return target
        full |= above


@pytest.mark.parametrize("bucket", [3, 100_000])
def test_mix_meets_targets(spark, bucket):
    rows = corpus(7)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += words(t)
    target = brute_targets(sizes)
    plan = mixing.schedule(documents(spark, rows), bucket_rows=bucket)
    got = plan.collect()
    assert sorted((str(r.id), r.size) for r in got) == sorted((str(i), words(t)) for i, t, _, _ in rows)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(float(target[r.source]))
    mix = mixing.mixture(plan, range_rows=bucket).collect()
    taken, each = Counter(), Counter()
    for r in mix:
        taken[r.source] += r.words
        each[r.skey, r.bucket, r.place] += r.words
    assert {s: taken[s] for s in sizes} == {s: int(x) for s, x in target.items()}
    size = {(r.skey, r.bucket, r.place): r.size for r in got}
    assert len(size) == len(rows) and all(each[k] <= 3 * n for k, n in size.items())
    # one order without gaps, by finish time, within the budget
    line = sorted((r for r in mix if r.words), key=lambda r: r.position)
    assert [r.position for r in line] == [sum(x.words for x in line[:i]) for i in range(len(line))]
    assert all(a.finish <= b.finish for a, b in zip(line, line[1:], strict=False))
    assert sum(r.words for r in line) <= sum(sizes.values())


def test_mix_does_not_depend_on_partitions(spark):
    rows = corpus(8)
    df = documents(spark, rows)
    see = lambda d, b: sorted((str(r.id), str(r.source), r.size, r.epoch, r.words, r.position or 0) for r in mixing.mixture(mixing.schedule(d, bucket_rows=b), range_rows=b).collect())
    first = see(df, 100_000)
    assert see(df.repartition(7, "text"), 100_000) == first
    assert see(df.orderBy(F.rand(3)), 4) == first


def test_mix_without_words(spark):
    for rows in ([], [(1, None, "en", None), (1, "  ", "en", "a")]):
        got = mixing.mixture(mixing.schedule(documents(spark, rows))).collect()
        assert [(r.words, r.target) for r in got] == [(0, 0.0)] * len(rows)


def test_mix_of_other_weights(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "abc"[i % 3]) for i in range(300)]
    sizes = Counter()
    for i, _, _, s in rows:
        sizes[s] += 1 + i % 5
    plan = mixing.schedule(documents(spark, rows), weights=(5, 1), epochs=2)
    want = brute_targets(sizes, (5, 1), 2)
    taken = {r.source: r.n for r in mixing.mixture(plan, 2).groupBy("source").agg(F.sum("words").alias("n")).collect()}
    assert taken == {s: int(x) for s, x in want.items()}
