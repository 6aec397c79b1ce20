"""Substring de-duplication over sliding sentence spans.

A text is cut into sentences and clauses (after `.!?;:,` before white space, and after line ends; a piece of over 24 words without
such a mark is cut after words chosen by their hash, so that equal passages are cut alike). From each piece starts one span: the
shortest run of at least `min_pieces` pieces with at least `min_words` words. All spans are hashed to 128 bits, white space
normalised, and compared over the whole corpus. Each piece covered by a span that also occurs earlier (smaller id, or earlier in the
document) is removed.

Null text counts as empty and stays null. Null ids come last in the order. Repeated rows are one document; different texts under
one id are told apart by a 64-bit hash and their length. An empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.common import ident

MIN_PIECES = 2
MIN_WORDS = 12
LONG_PIECE = 24

_END = re.compile(r"[.!?;:,]+\s+|\n\s*")
_WORD = re.compile(r"\S+\s*")


def split(text: str) -> list[str]:
    """The pieces of a text; joined they are the text."""
    out, last = [], 0
    for m in _END.finditer(text):
        out.append(text[last:m.end()])
        last = m.end()
    if last < len(text):
        out.append(text[last:])
    if not any(len(p) > 2 * LONG_PIECE for p in out):
        return out
    cut = []
    for p in out:
        if len(p) <= 2 * LONG_PIECE or p.count(" ") < LONG_PIECE:
            cut.append(p)
            continue
        at = 0
        for m in _WORD.finditer(p):
            if zlib.crc32(m.group().strip().encode("utf-8", "surrogatepass")) % 8 == 0 and m.end() < len(p):
                cut.append(p[at:m.end()])
                at = m.end()
        cut.append(p[at:])
    return cut


def runs(pieces: list[str], min_pieces: int, min_words: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Normalised pieces, and (first, end) of the span that starts at each piece, where one does."""
    parts = [p.split() for p in pieces]
    total = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])
    first = np.arange(len(pieces))
    end = np.maximum(np.searchsorted(total, total[:-1] + min_words, side="left"), first + min_pieces)
    fits = (end <= len(pieces)) & (np.diff(total) > 0)
    return [" ".join(p) for p in parts], first[fits], end[fits]


def without(text: str, starts: np.ndarray, min_pieces: int = MIN_PIECES, min_words: int = MIN_WORDS) -> tuple[str, int, int]:
    """The text without the pieces that the spans at `starts` cover, the number of pieces and of removed ones."""
    pieces = split(text)
    if not len(starts):
        return text, len(pieces), 0
    _, first, end = runs(pieces, min_pieces, min_words)
    edge = np.zeros(len(pieces) + 1, dtype=np.int64)
    hit = np.isin(first, starts)
    np.add.at(edge, first[hit], 1)
    np.add.at(edge, end[hit], -1)
    gone = np.cumsum(edge[:-1]) > 0
    return "".join(p for p, g in zip(pieces, gone, strict=True) if not g), len(pieces), int(gone.sum())


def span_hashes(docs: DataFrame, min_pieces: int, min_words: int) -> DataFrame:
    """(h1, h2, did, th, n, at) of each span; n: characters of the document's text, at: piece. Spans that repeat an earlier one of the same batch get null hashes: they
    are decided, and a span that many documents share leaves each batch once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_128_intdigest

        low = 2**64 - 1
        for batch in batches:
            batch = batch.sort_values(["did", "th", "n"], kind="stable")
            high, rest, did, ths, sizes, at = [], [], [], [], [], []
            for d, th, n, text in zip(batch["did"].tolist(), batch["th"].tolist(), batch["n"].tolist(), batch["text"], strict=True):
                norm, first, end = runs(split(text or ""), min_pieces, min_words)
                found = [xxh3_128_intdigest("\n".join(norm[a:b]).encode("utf-8", "surrogatepass")) for a, b in zip(first.tolist(), end.tolist(), strict=True)]
                high += [x >> 64 for x in found]
                rest += [x & low for x in found]
                did.append(np.full(len(found), d))
                ths.append(np.full(len(found), th))
                sizes.append(np.full(len(found), n, np.int32))
                at.append(first.astype(np.int32))
            if not high:
                continue
            out = pd.DataFrame({"h1": np.array(high, np.uint64).view(np.int64), "h2": np.array(rest, np.uint64).view(np.int64),
                                "did": np.concatenate(did), "th": np.concatenate(ths), "n": np.concatenate(sizes), "at": np.concatenate(at)}).drop_duplicates()
            known = out.duplicated(["h1", "h2"])
            out["h2"] = out["h2"].astype("Int64").mask(known)
            out["h1"] = out["h1"].mask(known, out["did"] * 1_000_003 + out["th"] + out["at"])  # spreads the decided rows
            yield out

    return docs.mapInPandas(run, "h1 long, h2 long, did long, th long, n int, at int")


def repeated(docs: DataFrame, min_pieces: int, min_words: int) -> DataFrame:
    """(did, th, n, starts) of the spans that occur earlier; one row per document that has any."""
    spans = span_hashes(docs, min_pieces, min_words)
    nth = F.dense_rank().over(Window.partitionBy("h1", "h2").orderBy("did", "th", "n", "at"))
    later = spans.withColumn("nth", nth).where((F.col("nth") > 1) | F.col("h2").isNull())
    return later.groupBy("did", "th", "n").agg(F.collect_list("at").alias("starts"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_pieces: int = MIN_PIECES,
                   min_words: int = MIN_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, text without repeated spans, n_pieces and n_removed of each row of `docs`, and its columns `keep` in a struct `kept`."""
    size = F.coalesce(F.char_length(text_col), F.lit(0)).alias("n")
    read = docs.select(*ident(id_col, text_col), size, F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"))
    spans = repeated(read.select("did", "th", "n", "text"), min_pieces, min_words)

    @F.pandas_udf("text string, n_pieces long, n_removed long")
    def cut(text: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [without(t or "", np.asarray(s if s is not None else [], dtype=np.int64), min_pieces, min_words) for t, s in zip(text, starts, strict=True)]
        out = pd.DataFrame(rows, columns=["text", "n_pieces", "n_removed"])
        out["text"] = out["text"].where(text.notna().to_numpy(), None)
        return out

    found = read.join(spans, ["did", "th", "n"], "left").withColumn("cut", cut("text", "starts"))
    return found.select(F.col("id").alias(id_col), F.col("cut.text").alias(text_col), "cut.n_pieces", "cut.n_removed", "kept")


def op8(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
