"""Held-out accuracy, recall and round trips of the operators that no SQL expresses."""

from __future__ import annotations

import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from thermaline.llm import hashing_index, language, packing, pieces, toxicity
from thermaline.llm.common import table

BIG = "/root/testdata/sf0.01"


def test_op3_recall_and_scores(spark):
    df = table(spark, BIG, "embeddings")
    rows = sorted((r["vec_id"], r["embedding"]) for r in df.collect())
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    got: dict[int, list] = {}
    for r in hashing_index.op3(df).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r)
    assert set(got) == {int(i) for i in ids if i % 20 == 0}
    hits = 0
    for q, found in got.items():
        row = score[np.flatnonzero(ids == q)[0]]
        assert [r["rank"] for r in found] == list(range(1, 21))
        assert all(abs(r["score"] - row[np.flatnonzero(ids == r["vec_id"])[0]]) < 1e-12 for r in found)
        assert found == sorted(found, key=lambda r: (-r["score"], r["vec_id"]))
        hits += len({r["vec_id"] for r in found} & set(ids[np.argsort(-row)[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(got)


def test_probing_retrieves_every_code_within_the_radius():
    draw = np.random.default_rng(0)
    codes = draw.integers(0, 2**16, (500, 8)).astype(np.uint16)
    q = codes[:40] ^ (np.uint16(1) << draw.integers(0, 16, (40, 8)).astype(np.uint16))
    block = hashing_index.Block(np.arange(500), np.zeros((500, 2)), codes)
    for radius in (8, 13, 55):
        reach, rest = divmod(radius, 8)
        hit = np.zeros((40, 500), bool)
        for s in range(8):
            hit |= block.probe(s, q[:, s], reach if s <= rest else reach - 1)
        near = hashing_index.distance(q, codes) <= radius
        assert near.any() and hit[near].all()


@pytest.mark.parametrize("spread", [0.0, 0.01])
def test_a_cluster_of_small_ids_does_not_hide_neighbours(spark, spread):
    """The first third are copies or a tight group, and some queries lie far from all rows; each finds its 20 nearest."""
    draw = np.random.default_rng(11)
    x = draw.normal(size=(1800, 32))
    x[:600] = draw.normal(size=32) + spread * draw.normal(size=(600, 32))
    x[1780:] = -x[0] + 0.3 * x[1780:]
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got: dict[int, set] = {}
    for r in hashing_index.op3(df).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    asked = range(600, 1800, 20)
    assert all(len(got[q]) == 20 for q in range(0, 1800, 20))
    assert sum(len(got[q] & set(np.argsort(-score[q])[:20].tolist())) for q in asked) >= 0.95 * 20 * len(asked)


def test_inner_product_of_unequal_norms(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(1500, 12)) * draw.uniform(0.5, 2.0, (1500, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    score = x @ x.T
    np.fill_diagonal(score, -np.inf)
    hits = sum(r["vec_id"] in set(np.argsort(-score[r["query_id"]])[:20].tolist()) for r in hashing_index.op3(df).collect())
    assert hits >= 0.9 * 20 * 75


def test_op4_ids_and_places(spark, sf):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(packing.tokenizer_path())
    df = table(spark, sf, "documents").select("doc_id", "text").union(spark.createDataFrame(
        [(-1, None), (-2, ""), (-3, "two  spaces \n and\ttabs \x1c ² <|endoftext|> _x_"), (-4, " lead"), (-5, "ünï ça 漢字 \U0001f600 it's 12 34")], "doc_id long, text string"))
    ids = {r["doc_id"]: np.array([*plain.encode(r["text"] or "", add_special_tokens=False).ids, 2], "<u4") for r in df.collect()}
    bins: dict[int, list] = {}
    lengths = dict.fromkeys(ids, 0)
    for r in packing.op4(df).collect():
        part = ids[r["doc_id"]][r["start"]:r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
        lengths[r["doc_id"]] += r["length"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert lengths == {d: len(x) for d, x in ids.items()}
    for parts in bins.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= 1.02 * sum(lengths.values()) / 1024 + 1


def test_plan_holds_every_piece_and_pairs_large_ones():
    draw = np.random.default_rng(6)
    for _ in range(40):
        capacity = int(draw.integers(9, 64))
        histogram = {int(k): int(draw.integers(0, 30)) for k in draw.integers(1, capacity + 1, 12)}
        count = dict.fromkeys(histogram, 0)
        for bins, pattern in packing.plan(histogram, capacity):
            assert bins > 0 and sum(x * c for x, c in pattern) <= capacity
            assert sum(c for x, c in pattern if 3 * x > capacity) <= 2
            for x, c in pattern:
                count[x] += bins * c
        assert count == histogram


def test_sequences_are_gapless(spark):
    docs = spark.createDataFrame([(k, "word " * (k * 37 % 900)) for k in range(60)], "doc_id long, text string")
    packed = packing.pack_documents(docs, packing.tokenizer_path(), capacity=256, with_ids=True)
    total = packed.agg(F.sum("length")).first()[0]
    sizes = [len(r["ids"]) for r in packing.sequences(packed).collect()]
    assert sum(sizes) == total and max(sizes) <= 256


def test_op5_held_out_accuracy(spark):
    df = table(spark, BIG, "documents")
    out = {r["doc_id"]: r for r in language.op5(df).collect()}
    hits = [out[r["doc_id"]]["lang_pred"] == r["lang"] for r in df.collect() if out[r["doc_id"]]["held_out"]]
    assert all(out[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in out)
    assert sum(hits) >= 0.95 * len(hits) and all(0 <= r["score"] <= 1 for r in out.values())


def test_gradients_are_those_of_the_loss():
    draw = np.random.default_rng(9)
    net = language.Network.fresh(["a", "b"], 3, 1)
    x, y = draw.integers(97, 100, (7, 4)).astype(np.uint16), np.array([0, 1, 1, 0])
    x[5:, 1] = 256
    _, params, grads = net.gradients(x, y)
    for p, g in zip(params, grads, strict=True):
        for _ in range(6):
            at = tuple(draw.integers(0, n) for n in p.shape)
            if p.shape[0] == 257:
                at = (int(draw.integers(97, 100)), at[1])
            keep, step = p[at], 1e-2
            p[at] = keep + step
            up = net.gradients(x, y)[0]
            p[at] = keep - step
            down = net.gradients(x, y)[0]
            p[at] = keep
            assert abs((up - down) / (2 * step) - g[at]) < 2e-3


def test_op6_held_out(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    marks = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    out = [r for r in toxicity.op6(docs, labels).collect() if r["doc_id"] in marks]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in out) >= 0.95 * len(out)
    held = [r for r in out if r["held_out"]]
    assert sum(r["predicted"] == marks[r["doc_id"]] for r in held) >= 0.93 * len(held)


def test_obfuscated_words_are_restored(spark):
    model = toxicity.CharModel.of(toxicity.count_characters(table(spark, BIG, "documents")))
    reader = toxicity.Restorer(model)
    for written in ("1d10t", "i d i o t", "idiiiiiot", "!d!ot", "i.d.i.o.t", "id10t", "i-d-i-o-t"):
        assert "idiot" in reader.words(f"the {written} and"), written
    assert reader.words("The clean words of 42 days, and stay.") == ["the", "clean", "words", "of", "days", "and", "stay"]


def test_words_set_apart_keep_their_bounds_and_ends_are_decoded(spark):
    model = toxicity.CharModel.of(toxicity.count_characters(table(spark, BIG, "documents")))
    reader = toxicity.Restorer(model)
    for written in ("you are a i d i o t", "a  i d i o t", "idi07", "1di0t!"):
        assert "idiot" in reader.words(f"the {written} and"), written
    words = CHARS.split()
    small = toxicity.Restorer(toxicity.CharModel.of(toxicity.count_characters(spark.createDataFrame([(CHARS * 50,)], "text string"))))
    for written, said in (("i d i o t s c u m", ["idiot", "scum"]), ("a i d i o t", ["a", "idiot"]), ("whor3", ["whore"]), ("losr5 whor3", ["losrs", "whore"])):
        assert small.words(f"the {written} and") == ["the", *said, "and"], written
    assert small.words("and the words! (of) days $ 42 scum2 really!") == ["and", "the", "words", "of", "days", "scum", "really"] and "scum" in words


CHARS = "you are a idiot and the scum of a whore. the words and days of losers losrs really are scum of the idiot. "


@pytest.fixture(scope="module")
def model():
    return pieces.Model(pieces.model_path())


def unigram(path: str):
    """The same model file with its type set to unigram, in the library."""
    import sentencepiece

    raw, out, i = Path(path).read_bytes(), b"", 0

    def varint(at):
        n = shift = 0
        while True:
            n |= (raw[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if raw[at - 1] < 128:
                return n, at

    while i < len(raw):
        tag, at = varint(i)
        size, at = varint(at)
        body = raw[at:at + size]
        if tag >> 3 == 2:
            body += b"\x18\x01"  # model_type = UNIGRAM; the last value of a field counts
            head, n = b"", len(body)
            while n > 127:
                head, n = head + bytes([n & 127 | 128]), n >> 7
            out += bytes([tag]) + head + bytes([n]) + body
        else:
            out += raw[i:at + size]
        i = at + size
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_encoding_equals_the_library(model, spark, sf):
    """On words, by the library's best path of its lattice; with equal sums either path will do. The library adds in single precision."""
    sp = unigram(pieces.model_path())
    words = {w for r in table(spark, sf, "documents").select("text").limit(60).collect() for w in r["text"].split()}
    for text in sorted(words)[:3000] + ["ünï漢字x", "a" * 40, "", " "]:
        ids, best = np.frombuffer(model.encode(text), "<u4").tolist(), sp.nbest_encode_as_ids(text, 2)
        sums = [sum(sp.get_score(i) for i in x) for x in [ids, *best]]
        assert ids == best[0] or sums[0] == sums[1] == sums[2] or not text, repr(text)


def test_chunks_equal_one_pass(model):
    draw = np.random.default_rng(11)
    letters = list("aeiounrst") * 3 + list("  \n漢é▁")
    for trial in range(25):
        text = pieces.normal("".join(draw.choice(letters if trial % 3 else list("aeiounrst"), int(draw.integers(60, 400)))))
        best, back = model.forward(text, [0], len(text))
        want = model.ids(text, pieces.trace(back, len(text)))
        for size in (16, 23, 64):
            cut = [pieces.part(model, t, n) for t, n in pieces.chunks(model, text, size)]
            matrices = [pieces.transfer(model, p) for p in cut]
            rows = [r.tolist() for r in pieces.entries(matrices)]
            total = matrices[0]
            for m in matrices[1:]:
                total = pieces.product(total, m)
            assert total[0, 0] == best[len(text)]
            exits, at = [], 0
            for p, row in zip(reversed(cut), reversed(rows), strict=True):
                exits.append(at)
                at = pieces.entry_of(model, p, row)[at]
            assert at == 0
            got = b"".join(pieces.chunk_ids(model, p, row, e) for p, row, e in zip(cut, rows, reversed(exits), strict=True))
            assert np.frombuffer(got, "<u4").tolist() == want, (trial, size)


def test_op7_round_trip(spark, sf, model):
    df = table(spark, sf, "documents").select("doc_id", "text")
    out = pieces.decode(pieces.encode(df, pieces.model_path(), chunk=700), pieces.model_path()).collect()
    assert len(out) == df.count() and max(r["n_chunks"] for r in out) > 3
    assert all(r["decoded"] == r["text"] and bytes(r["ids"]) == model.encode(r["text"]) for r in out)
    assert all(r["round_trip"] for r in pieces.op7(df).collect())


