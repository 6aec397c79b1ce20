"""Divergence of sources against a plain computation."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from thermaline.llm import divergence

TERM = re.compile("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def plain(docs, top=200):
    docs = [tuple("" if e is None else e for e in d) for d in docs]
    count, seen = Counter(), defaultdict(set)
    for k, (lang, source, text) in enumerate(docs):
        for t in TERM.findall(text):
            t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
            count[lang, source, t] += 1
            seen[lang, t].add(k)
    out = []
    for lang in {d[0] for d in docs}:
        kept = [t for (la, t), ks in seen.items() if la == lang and len(ks) >= 3]
        sources = sorted({d[1] for d in docs if d[0] == lang})
        n = {s: {t: count[lang, s, t] for t in kept} for s in sources}
        n[None] = {t: sum(n[s][t] for s in sources) for t in kept}
        p = {s: {t: 1 + 10**9 * (c + 1) // (sum(m.values()) + len(kept)) for t, c in m.items()} for s, m in n.items()}
        f = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode()) for o in sources if o != s]
            found = [(-f(p[s][t], p[None][t]), t.encode()) for t in kept if n[s][t] > 0 and p[s][t] > p[None][t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(found)[:top])):
                out += [(lang, s, part, i.decode(), -v, r) for r, (v, i) in enumerate(items, 1)]
    return sorted(out)


def frame(spark, docs):
    return spark.createDataFrame([(n, t, la, s, "a", 1, "b") for n, (la, s, t) in enumerate(docs)],
                                 "doc_id long, text string, lang string, source string, term string, digest int, kept string")


def sample(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("lang", "source", "text").collect()
    return [tuple(r) for r in rows]


EDGES = [("en", "a", "The cat, the CAT and the d0g."), ("en", "b", "the cat sat"), ("en", None, "the ünïCÖDE ünïcÖde 日本 cat"), ("en", "a", None), (None, "x", ""),
         (None, None, None), ("fr", "only", "le le le"), ("de", "p", "eins"), ("de", "q", "zwei"), ("en", "a", "日本 ünïcÖde the\u0000end"), ("en", "b", "日本 " * 5000),
         ("en", "b", "the cat sat"), ("en", "a", "é \U0001f600 the"), ("en", "c", "123 ... !")]


def test_edges(spark):
    got = divergence.op13(frame(spark, EDGES)).collect()
    assert sorted(tuple(r) for r in got) == plain(EDGES)
    assert divergence.op13(frame(spark, EDGES).limit(0)).collect() == []


def test_small_blocks_and_ranks(spark, sf, monkeypatch):
    docs = sample(spark, sf)
    monkeypatch.setattr(divergence, "BLOCK", 300)
    monkeypatch.setattr(divergence, "PART", 3)
    monkeypatch.setattr(divergence, "CELLS", 500)
    monkeypatch.setattr(divergence, "FLUSH", 1000)
    got = divergence.audit(frame(spark, docs), top=7).collect()
    assert sorted(tuple(r) for r in got) == plain(docs, 7)


def test_equal_digests_are_split(spark, monkeypatch):
    whole = divergence.counted
    monkeypatch.setattr(divergence, "counted", lambda *a, **b: whole(*a, **b).withColumn("digest", F.col("digest") % 3))
    got = divergence.op13(frame(spark, EDGES)).collect()
    assert sorted(tuple(r) for r in got) == plain(EDGES)


def test_large_counts(spark):
    n, total, kept = 10**15, 7 * 10**15, 10**9
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(total), F.lit(kept)).alias("p"), divergence.divergence(F.lit(10**9 + 1), F.lit(1)).alias("f")).first()
    assert tuple(row) == (1 + 10**9 * (n + 1) // (total + kept), 10**18)
