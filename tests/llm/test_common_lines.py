"""A line that many documents share among ever new words: its anchor grams exceed a shard."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from test_dedup import check_bytes

from thermaline.llm import substrings


def said(draw, n: int) -> str:
    return "".join(draw.choice(list("abcdefgh "), n))


def test_split_anchors_move_in_small_rows(spark, monkeypatch):
    """No row holds all strings of a part (here about 16 regions of 69 strings of 101 bytes), and the result is that of all strings."""
    draw = np.random.default_rng(6)
    line, ends = said(draw, 130), [said(draw, 3 + 2 * k) for k in range(8)]
    rows = [(k, said(draw, 40 + k % 50) + ends[k % 8] + line + ends[k % 7] + said(draw, 60 + k % 40)) for k in range(300)]
    rows += [(k + 1000, said(draw, 80) + line[:70] + said(draw, 80)) for k in range(60)]
    sizes, staged = [], substrings.staged

    def kept(df, *sort):
        out = staged(df, *sort)
        if "strings" in out.columns:
            sizes.extend(r[0] for r in out.where("strings is not null").select(F.length("strings")).collect())
        return out

    monkeypatch.setattr(substrings, "staged", kept)
    check_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 100, 16)
    assert 0 < max(sizes) < 16 * 8 * 101


def test_narrowed_regions_hold_every_string_once(spark):
    """Equal strings stay under one key, also where an anchor repeats and at the ends of texts."""
    draw = np.random.default_rng(7)
    line = said(draw, 120)
    texts = [said(draw, k % 60) + line + said(draw, 45) + line[40:] for k in range(40)] + ["a" * 300, "ab" * 200, line, line + "x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "did long, text string").withColumn("th", F.lit(0).cast("long"))
    rows = [(r["akey"], r["did"], 0, r["at"], texts[r["did"]].encode()[r["at"] >> 8:(r["at"] >> 8) + (r["at"] & 0xFF) + 99])
            for r in substrings.anchored(docs, 100).where("rkey is not null").collect()]
    strings = sorted((d, s) for _, d, _, at, _ in rows for s in range(at >> 8, (at >> 8) + (at & 0xFF)))
    cuts = substrings.narrowed(spark.createDataFrame(rows, "akey long, did long, th long, at long, bytes binary"), 100).collect()
    seen, key = [], {}
    for r in cuts:
        start, n = r["at"] >> 8, r["at"] & 0xFF
        text = texts[r["did"]].encode()
        assert n <= substrings.CELL and bytes(r["bytes"]) == text[start:start + n + 99]
        for s in range(start, start + n):
            seen.append((r["did"], s))
            if r["rkey"] is not None:
                assert key.setdefault(text[s:s + 100], r["akey"]) == r["akey"]
    assert sorted(seen) == strings
