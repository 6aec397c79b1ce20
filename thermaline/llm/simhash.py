"""Near-duplicates by SimHash, found by tiled exact comparison.

A fingerprint bit is set when it is set in over half of the hashes of a document's word shingles. Distinct fingerprints are laid
into tiles by the population counts of their four 16-bit words; a pair of tiles is skipped when these counts differ by more than
the radius in sum, since then no two fingerprints can link. The pairs that remain are compared whole with numpy. Per pair of tiles
only a spanning forest of its links is returned, so a large group costs as many rows as it has members, and components join it.

Null text counts as empty, with fingerprint zero. Null ids come after all others; a component of null ids only has a null id.
Repeated rows are linked as copies. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise, product, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import NO_ID, ident, staged
from thermaline.llm.components import components

RADIUS = 2
SHINGLE = 3
#: Fingerprints of a tile, on average at most.
TILE = 2_048
#: Shingles that are turned into bits at once.
_BLOCK = 1 << 18


def shingles(text: str, k: int = SHINGLE) -> list[bytes]:
    """Runs of k lower-cased words, repeats included; the whole sequence if it is shorter."""
    parts = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z are lowered, only ASCII white space separates
    if len(parts) <= k:
        return [b" ".join(parts)] if parts else []
    whole = b" ".join(parts)
    at = np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).tolist()
    return [whole[a:b - 1] for a, b in zip(at, at[k:], strict=False)]


def majority(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """uint64 fingerprints of consecutive runs of hashes; a run of none gives zero."""
    size = np.asarray(sizes, dtype=np.int64)
    edge = np.concatenate([[0], np.cumsum(size)])
    counts = np.zeros((len(size), 64), dtype=np.int64)
    for lo, hi in pairwise([*range(0, len(hashes), _BLOCK), len(hashes)]):
        a, b = np.searchsorted(edge, lo, side="right") - 1, np.searchsorted(edge, hi, side="left")
        owners = np.arange(a, b)[size[a:b] > 0]
        starts = np.maximum(edge[owners], lo) - lo
        block = hashes[lo:hi]
        for bit in range(64):
            counts[owners, bit] += np.add.reduceat(((block >> np.uint64(bit)) & np.uint64(1)).astype(np.int64), starts)
    return ((2 * counts > size[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """did, th, fp (the 64 bits as a long) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh64_intdigest

        for batch in batches:
            out, hashes, sizes, held = [], [], [], 0
            for text in batch["text"]:
                parts = shingles(text or "", k)
                hashes.append(np.fromiter(map(xxh64_intdigest, parts, repeat(42)), dtype=np.uint64, count=len(parts)))
                sizes.append(len(parts))
                held += len(parts)
                if held > 8 * _BLOCK:
                    out.append(majority(np.concatenate(hashes), sizes))
                    hashes, sizes, held = [], [], 0
            if sizes:
                out.append(majority(np.concatenate(hashes), sizes))
            if out:
                yield pd.DataFrame({"did": batch["did"], "th": batch["th"], "fp": np.concatenate(out).view(np.int64)})

    return docs.select(*ident(id_col, text_col), F.col(text_col).alias("text")).mapInPandas(run, "did long, th long, fp long")


def forest(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) for the graph of edges i-j over n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    node = np.flatnonzero(label != np.arange(n))
    return node, label[node]


def links(fps: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b): a spanning forest, per pair of tiles, of the links among the distinct values of column fp."""
    part = [F.bit_count(F.shiftrightunsigned("fp", 16 * w).bitwiseAND(0xFFFF)) for w in range(4)]
    cells = staged(fps.select("fp").distinct().withColumns({f"c{w}": p for w, p in enumerate(part)}))
    names = [f"c{w}" for w in range(4)]
    sizes = cells.groupBy(*names).agg(F.ceil(F.count("*") / F.lit(tile)).alias("chunks"))  # at most 17^4 rows
    sizes = F.broadcast(staged(sizes))
    dealt = cells.join(sizes, names).withColumn("chunk", F.pmod(F.xxhash64("fp"), "chunks"))
    tiles = staged(dealt.groupBy(*names, "chunk").agg(F.collect_list("fp").alias("fps")))
    # each unordered pair of cells once: offsets whose first non-zero part is positive, and zero
    ball = [d for d in product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius and next((x for x in d if x), 0) >= 0]
    near = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"d{w}") for w, x in enumerate(d)]) for d in ball])).alias("d")
    pairs = tiles.select(*names, "chunk", near).select(*[F.col(n).alias("a" + n) for n in names], F.col("chunk").alias("achunk"),
                                                       *[(F.col(n) + F.col(f"d.d{w}")).alias(n) for w, n in enumerate(names)])
    same = F.expr(" AND ".join(f"a{n} = {n}" for n in names))
    pairs = pairs.join(sizes, names).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk")).where(~same | (F.col("chunk") >= F.col("achunk")))
    left = tiles.select(*[F.col(n).alias("a" + n) for n in names], F.col("chunk").alias("achunk"), F.col("fps").alias("xs"))
    both = pairs.join(tiles, [*names, "chunk"]).join(left, [*["a" + n for n in names], "achunk"])
    both = both.select("xs", "fps", (same & (F.col("chunk") == F.col("achunk"))).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for xs, ys, own in zip(batch["xs"], batch["fps"], batch["own"], strict=True):
                x, y = np.asarray(xs, np.int64).view(np.uint64), np.asarray(ys, np.int64).view(np.uint64)
                i, j = np.nonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= radius)
                if own:
                    i, j = i[i < j], j[i < j]
                    nodes = x
                else:
                    j = j + len(x)
                    nodes = np.concatenate([x, y])
                if len(i) > len(nodes):
                    i, j = forest(len(nodes), i, j)
                if len(i):
                    found.append(np.stack([nodes[i], nodes[j]]))
            if found:
                a, b = np.concatenate(found, axis=1).view(np.int64)
                yield pd.DataFrame({"a": a, "b": b})

    return both.mapInPandas(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """did, th, fp, and of the document's component the smallest (did, th) as `root`, for every row of `docs`."""
    prints = staged(fingerprints(docs, id_col, text_col))
    own = prints.groupBy("fp").agg(F.min(F.struct("did", "th")).alias("own"))
    joined = staged(components(links(prints, radius)))
    tops = joined.select(F.col("a").alias("fp"), F.col("b").alias("top"))
    labelled = own.join(tops, "fp", "left").select("fp", "own", F.coalesce("top", "fp").alias("top"))
    labelled = staged(labelled)
    roots = labelled.groupBy("top").agg(F.min("own").alias("root"))
    return prints.join(labelled.join(roots, "top").select("fp", "root"), "fp")


def op2(docs: DataFrame) -> DataFrame:
    no_id = lambda c: F.when(c != NO_ID, c)
    return near_duplicates(docs).select(no_id(F.col("did")).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        no_id(F.col("root.did")).alias("component_id"))


def first_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of `docs` that `found` (did, th, root) names as roots; repeated rows stay once. Texts are compared whole
    before one of two rows of one id goes as a repetition, so documents of equal hashes stay."""
    kept = found.where((F.col("root.did") == F.col("did")) & (F.col("root.th") == F.col("th"))).select("did", "th").distinct()
    did, th = ident(id_col, text_col)
    inner = docs.select(did.alias("did"), th.alias("th"), F.col(text_col).alias("text"), F.struct(*docs.columns).alias("row"))
    return inner.join(kept, ["did", "th"], "left_semi").dropDuplicates(["did", "th", "text"]).select("row.*")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without all but the first document of each component."""
    return first_of_each(docs, near_duplicates(docs, id_col, text_col), id_col, text_col)
