"""Suffix arrays, SimHash and sentence spans against brute force."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from thermaline.llm import simhash, spans, substrings, suffix
from thermaline.llm.common import table


def test_suffix_array_and_common_prefixes():
    draw = np.random.default_rng(3)
    for trial in range(120):
        n = int(draw.integers(1, 300))
        data = draw.integers(0, int(draw.integers(1, 4)), n).astype(np.uint8) * np.uint8(draw.integers(0, 90))
        if trial % 3 == 0 and n > 60:
            data = np.concatenate([data, data[10:60], data[:40]])
        whole = data.tobytes()
        order = suffix.suffix_array(data)
        assert order.tolist() == sorted(range(len(whole)), key=lambda i: whole[i:])  # noqa: B023
        common = suffix.kasai(data, order, 20)
        for r in range(1, len(order)):
            a, b = whole[order[r - 1]:], whole[order[r]:]
            k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert common[r] == min(k, 20)


def test_search_in_sorted_windows():
    data = np.frombuffer(b"abcab\0cab\0\0x", np.uint8)
    hay = np.sort(suffix.fixed(data, np.arange(len(data) - 2), 3))
    needles = suffix.fixed(np.frombuffer(b"cab\0\0zz", np.uint8), np.arange(5), 3)
    assert [hay[i] if i >= 0 else None for i in suffix.found_in(needles, hay)] == [b"cab\x01", b"ab\0\x01", b"b\0\0\x01", None, None]


def brute_bytes(docs: list[tuple[int, str]], width: int) -> dict[int, tuple]:
    seen, out = set(), {}
    for doc, text in sorted(docs):
        data = text.encode()
        cover = bytearray(len(data))
        for i in range(len(data) - width + 1):
            part = data[i:i + width]
            if part in seen:
                cover[i:i + width] = b"\1" * width
            seen.add(part)
        kept = bytes(c for c, v in zip(data, cover, strict=True) if not v)
        out[doc] = (len(data), sum(cover), len(re.findall(b"\1+", bytes(cover))), hashlib.sha256(kept).hexdigest())
    return out


def check_bytes(df, width: int, shard_rows: int) -> None:
    want = brute_bytes([(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()], width)
    got = {r["doc_id"]: tuple(r)[1:] for r in substrings.remove_repeats(df, width=width, shard_rows=shard_rows).drop("kept").collect()}
    assert got == want


def test_op1_whole_table(spark, sf):
    check_bytes(table(spark, sf, "documents"), 100, substrings.SHARD_ROWS)


def test_shards_that_split_an_anchor(spark):
    """One anchor gram with many contents goes over several shards, which binary search merges."""
    draw, core = np.random.default_rng(1), "The shared middle of every document is forty bytes."
    say = lambda n: "".join(draw.choice(list("abcdefgh "), n))
    tails = [say(60) for _ in range(7)]
    rows = [(k, say(30) + core + tails[k % 7] + (say(20) if k % 3 else core * 3)) for k in range(60)]
    rows += [(100, "a" * 700), (101, "b" + "a" * 400), (102, "ab" * 300), (103, rows[5][1])]
    check_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 100, 4)


def test_many_texts_under_one_id_stay_apart(spark):
    """Null ids are one id; 900 texts of different lengths under it are told apart, also where 16 bits of their hashes agree."""
    draw = np.random.default_rng(12)
    say = lambda n: "".join(draw.choice(list("abcdefgh "), n))
    shared = [say(130) for _ in range(20)]
    texts = [say(10 + k % 300) + shared[k % 20] + say(k % 7) for k in range(900)]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").repartition(5)
    order = {r["text"]: r["th"] for r in df.withColumn("th", F.xxhash64("text")).collect()}
    short = [r["h"] for r in df.select(F.expr("pmod(hash(text), 65536)").alias("h")).collect()]
    assert len(set(order.values())) == 900 > len(set(short))
    want = brute_bytes([(order[t], t) for t in texts], 100)
    assert sorted(tuple(r)[1:] for r in substrings.op1(df).collect()) == sorted(want.values())


def test_regions_hold_every_string_once(monkeypatch):
    """Also where a text goes over several blocks; equal strings have equal anchors."""
    monkeypatch.setattr(substrings, "_BLOCK_BITS", 10)
    draw = np.random.default_rng(2)
    text = "".join(draw.choice(list("abcdefghij klm"), 3000)).encode()
    texts, seen, anchor = [text, b"short", b"xyz" + text[200:2900], b"a" * 150, b""], [], {}
    for slices, data, edges in substrings._blocks(texts, 100):
        for akey, _, who, start, strings in zip(*substrings.regions(data, edges, 100), strict=True):
            doc, low = slices[who]
            for at in range(start + low, start + low + strings):
                seen.append((doc, at))
                assert anchor.setdefault(texts[doc][at:at + 100], akey) == akey
    assert sorted(seen) == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 99)]


def brute_simhash(texts: dict[int, str]) -> tuple[dict, dict]:
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    prints = {}
    for doc, text in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", text.translate(low))
        parts = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in texts:
        for b in texts:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return prints, {d: find(d) for d in texts}


def check_simhash(df) -> None:
    prints, roots = brute_simhash({r["doc_id"]: r["text"] for r in df.collect()})
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in simhash.op2(df).collect()}
    assert got == {d: (prints[d], roots[d]) for d in prints}


def test_op2_whole_table(spark, sf):
    check_simhash(table(spark, sf, "documents").select("doc_id", "text"))


@pytest.mark.parametrize("tile", [2, 2048])
def test_links_join_all_neighbours(spark, tile):
    """A chain of one-bit steps and random values; every link within two bits must be in the forest."""
    draw = np.random.default_rng(4)
    chain = [0]
    for k in draw.permutation(60):
        chain.append(chain[-1] ^ (1 << int(k)))
    values = sorted({*chain, *map(int, draw.integers(0, 2**62, 80)), *(1 << k for k in range(64))})
    signed = [v - 2**64 if v >= 2**63 else v for v in values]
    root = {v: v for v in signed}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for r in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), tile=tile).collect():
        root[find(r["a"])] = find(r["b"])
    for a, x in zip(values, signed, strict=True):
        for b, y in zip(values, signed, strict=True):
            if (a ^ b).bit_count() <= 2:
                assert find(x) == find(y)


def test_representatives_keep_one_of_each_group(spark):
    text = " ".join(f"w{k}" for k in range(300))
    rows = [(5, text), (3, text), (9, text + " tail"), (1, "something else entirely, with its own words"), (3, text)]
    out = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 3]


def brute_spans(texts: list[tuple[int, str]]) -> dict[int, str]:
    first, out = {}, {}
    for doc, text in sorted(texts):
        pieces = spans.split(text)
        assert "".join(pieces) == text
        for i in range(len(pieces)):
            j = i + 2
            while j < len(pieces) and sum(len(p.split()) for p in pieces[i:j]) < 12:
                j += 1
            if j <= len(pieces) and pieces[i].split() and sum(len(p.split()) for p in pieces[i:j]) >= 12:
                first.setdefault(" | ".join(" ".join(p.split()) for p in pieces[i:j]), (doc, i))
    for doc, text in texts:
        pieces = spans.split(text)
        gone = set()
        for i in range(len(pieces)):
            for j in range(i + 2, len(pieces) + 1):
                if sum(len(p.split()) for p in pieces[i:j]) >= 12:
                    if pieces[i].split() and first[" | ".join(" ".join(p.split()) for p in pieces[i:j])] < (doc, i):
                        gone.update(range(i, j))
                    break
        out[doc] = "".join(p for i, p in enumerate(pieces) if i not in gone)
    return out


def test_op8_whole_table(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", "text")
    want = brute_spans([(r["doc_id"], r["text"]) for r in df.collect()])
    assert {r["doc_id"]: r["text"] for r in spans.op8(df).collect()} == want


def test_passage_inside_other_sentences_goes(spark):
    passage = "one two three four five six, seven eight nine ten eleven twelve. " * 1 + "Alpha beta gamma delta epsilon zeta eta theta, iota kappa lambda mu nu xi. And the last sentence of it ends here."
    rows = [(k, f"Own start {k} of {k * 7} things and {passage} own end {k} with words {k + 1}.") for k in range(6)]
    out = {r["doc_id"]: r["text"] for r in spans.op8(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0] == rows[0][1]
    assert all("Alpha beta" not in out[k] and f"Own start {k}" in out[k] and f"own end {k}" in out[k] for k in range(1, 6))


def test_span_without_punctuation_is_cut_alike():
    draw = np.random.default_rng(8)
    run = [f"w{int(x)}" for x in draw.integers(0, 10**6, 120)]
    cut = [p.strip() for p in spans.split(" ".join(["lead", "in", *run]))]
    other = [p.strip() for p in spans.split(" ".join(["something", "else", "before", *run, "after"]))]
    assert len(set(cut[1:-1]) & set(other)) >= len(cut) - 2 > 3


def test_equal_hashes_under_null_ids_neither_mix_nor_lose_documents(spark, monkeypatch):
    """Two unlike texts without an id whose hashes are the same (forced): nothing foreign is removed, and both stay."""
    from thermaline.llm import common

    same = lambda i, t: [common.ident(i, t)[0], F.lit(7).cast("long").alias("th")]
    monkeypatch.setattr(spans, "ident", same)
    monkeypatch.setattr(simhash, "ident", same)
    a = "The harbour was quiet that morning, and nobody had expected the ferry to come in before noon. "
    b = "A tall clerk wrote the numbers down, then closed the ledger and put it away for the winter months. "
    c = "Seven children ran across the bridge to see the kites, which the wind had carried over the river. "
    rows = [(1, a + b), (None, a + b + c + "And more."), (None, "Nothing at all here is said twice, so all of these words have to stay where they are, every one.")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["text"] for r in spans.op8(docs).where("doc_id is null").collect()}
    assert rows[2][1] in out and any(t.startswith(c.strip()[:20]) for t in out)
    assert {r["text"] for r in simhash.representatives(docs).collect()} >= {rows[1][1], rows[2][1]}
