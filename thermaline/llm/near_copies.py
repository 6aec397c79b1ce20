"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found by wide SimHash fingerprints.

Each document has 256 bits, each set when over half of its distinct shingles' hashes set it. Documents of one shingle set are one node. Nodes are
dealt into tiles by the logarithm of their number of shingles; tiles whose sizes or population counts rule a link out are skipped, the others are
compared whole by exclusive-or and bit counts: one word first, within its own radius, then all four. The radii are wide: a pair of similarity
0.8 lies 39 bits apart on average (48 for the shortest texts) and random pairs 128, so 80 bits lose no such pair in practice and let few
others in; `tests/llm/test_near_copies.py` measures both. Tile pairs return spanning forests, their components are the groups of candidates.

Within each group the shingle sets are then compared exactly. A group above `GROUP` shingles is dealt into blocks that meet pairwise in
tasks of their own, and a pair already joined by verified links is not compared again. So a link is never reported on fingerprints alone,
and a group of copies costs rows in the order of its members.

The tiles' work grows with the square of the number of distinct documents of like size; the rest is linear but for groups of distinct near
copies above GROUP shingles, whose blocks meet pairwise.

Texts of under five words have one shingle, the whole sequence; texts without a word (null, empty, white space) are copies of each other. Null
ids come after all others. Repeated rows are copies. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import ident, staged
from thermaline.llm.components import components
from thermaline.llm.simhash import first_of_each, forest, shingles

SHINGLE = 5
SIMILARITY = 0.8
#: Differing bits among all 256, and among the first 64 of documents of at least and under `FEW` shingles.
RADIUS = 80
FIRST = 22
FIRST_FEW = 30
FEW = 64
#: Nodes of a tile, on average at most, and shingles of a block of a candidate group.
TILE = 4_096
GROUP = 1 << 18
#: Size bands between a size and its `SIMILARITY`-th part.
BANDS = 4
_BLOCK = 1 << 16
_RUNS = 64
_ROWS = 256
_STEP = 512
_LOOSE = np.uint64([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9])


def shingle_set(text: str, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles."""
    from xxhash import xxh64_intdigest

    parts = shingles(text, k)
    return np.unique(np.fromiter(map(xxh64_intdigest, parts, repeat(42)), dtype=np.uint64, count=len(parts)))


def _mixed(h: np.ndarray, salt: np.uint64) -> np.ndarray:
    """Further independent bits of hashes."""
    x = (h ^ salt) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def wide(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, 4) words of 64 bits: the majorities over each set; an empty one gives zeros.

    Bits are spread over bytes and added eight bytes at a time, in runs of at most 255 hashes, so no byte overflows.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    counts = np.zeros((len(sets), 256), dtype=np.int64)
    runs = [(at, s[lo:lo + 255]) for at, s in enumerate(sets) for lo in range(0, len(s), 255)]
    for lo in range(0, len(runs), _RUNS):
        part = runs[lo:lo + _RUNS]
        block = np.concatenate([s for _, s in part])
        words = np.stack([block, *[_mixed(block, salt) for salt in _LOOSE]], axis=1)
        lanes = np.unpackbits(words.view(np.uint8), axis=1).view(np.uint64)
        starts = np.concatenate([[0], np.cumsum([len(s) for _, s in part])[:-1]])
        np.add.at(counts, [at for at, _ in part], np.add.reduceat(lanes, starts, axis=0).view(np.uint8))
    return np.packbits(2 * counts > size[:, None], axis=1).view(np.uint64).reshape(len(sets), 4)


def near(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, similarity: float = SIMILARITY) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, distance) of the pairs within the radii whose sizes allow the similarity, for `_ROWS` rows of x at a time."""
    wide_x, wide_y = (np.where(n < FEW, FIRST_FEW, FIRST).astype(np.uint8) for n in (nx, ny))
    for at in range(0, len(x), _ROWS):
        rows = slice(at, at + _ROWS)
        i, j = np.nonzero(np.bitwise_count(x[rows, None, 0] ^ y[None, :, 0]) <= np.maximum(wide_y[None, :], wide_x[rows, None]))
        i += at
        fits = np.minimum(nx[i], ny[j]) >= similarity * np.maximum(nx[i], ny[j]) - 1e-9
        i, j = i[fits], j[fits]
        d = np.bitwise_count(x[i] ^ y[j]).sum(axis=1, dtype=np.int64)
        hit = d <= RADIUS
        yield i[hit], j[hit], d[hit]


def close(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray, similarity: float = SIMILARITY) -> tuple[np.ndarray, ...]:
    """All pairs of `near` at once."""
    out = list(near(x, nx, y, ny, similarity))
    return tuple(np.concatenate(part) for part in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


def prints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """did, th, node (hash of the shingle set), n (its size), fp (32 bytes) of every row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            nodes, sizes, fps, held, waiting = [], [], [], 0, []
            for text in batch["text"]:
                s = shingle_set(text or "", k)
                nodes.append(xxh3_64_intdigest(s.tobytes()))
                sizes.append(len(s))
                waiting.append(s)
                held += len(s)
                if held > 8 * _BLOCK:
                    fps += [w.tobytes() for w in wide(waiting)]
                    held, waiting = 0, []
            fps += [w.tobytes() for w in wide(waiting)]
            yield pd.DataFrame({"did": batch["did"], "th": batch["th"], "node": np.array(nodes, np.uint64).view(np.int64), "n": np.array(sizes, np.int64), "fp": fps})

    return docs.select(*ident(id_col, text_col), F.col(text_col).alias("text")).mapInPandas(run, "did long, th long, node long, n long, fp binary")


def candidates(nodes: DataFrame, similarity: float = SIMILARITY, tile: int = TILE) -> DataFrame:
    """(a, b): per pair of tiles a spanning forest of the nodes within the radii. `nodes`: node, n, fp."""
    step = -math.log(similarity) / BANDS
    dealt = nodes.where("n > 0").withColumn("band", F.floor(F.log("n") / F.lit(step)))
    sizes = F.broadcast(staged(dealt.groupBy("band").agg(F.ceil(F.count("*") / F.lit(tile)).alias("chunks"))))  # one row per band: some hundred
    dealt = dealt.join(sizes, "band").withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    tiles = staged(dealt.groupBy("band", "chunk").agg(F.collect_list(F.struct("node", "n", "fp")).alias("rows")))
    reach = F.explode(F.sequence(F.col("band"), F.col("band") + BANDS + 1)).alias("other")
    pairs = tiles.select(F.col("band").alias("aband"), F.col("chunk").alias("achunk"), reach).join(sizes.withColumnRenamed("band", "other"), "other")
    pairs = pairs.select("aband", "achunk", F.col("other").alias("band"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    pairs = pairs.where((F.col("band") > F.col("aband")) | (F.col("chunk") >= F.col("achunk")))
    left = tiles.select(F.col("band").alias("aband"), F.col("chunk").alias("achunk"), F.col("rows").alias("xs"))
    both = pairs.join(tiles.withColumnRenamed("rows", "ys"), ["band", "chunk"]).join(left, ["aband", "achunk"])
    both = both.select("xs", "ys", ((F.col("band") == F.col("aband")) & (F.col("chunk") == F.col("achunk"))).alias("own"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for xs, ys, own in zip(batch["xs"], batch["ys"], batch["own"], strict=True):
                (a, na, x, px), (b, nb, y, py) = _columns(xs), _columns(ys)
                if min(na.max(), nb.max()) < similarity * max(na.min(), nb.min()) - 1e-9 or max(px.min(), py.min()) - min(px.max(), py.max()) > RADIUS:
                    continue
                names = a if own else np.concatenate([a, b])
                shift = 0 if own else len(a)
                label = np.arange(len(names))
                for i, j, _ in near(x, na, y, nb, similarity):  # a tile pair of copies never holds its pairs at once
                    u, v = label[i], label[j + shift]
                    node, root = forest(len(names), u[u != v], v[u != v])
                    onto = np.arange(len(names))
                    onto[node] = root
                    label = onto[label]
                node = np.flatnonzero(label != np.arange(len(names)))
                if len(node):
                    yield pd.DataFrame({"a": names[node], "b": names[label[node]]})

    return both.mapInPandas(run, "a long, b long")


def _columns(rows) -> tuple[np.ndarray, ...]:
    """node, n, words and population counts of a tile."""
    words = np.frombuffer(b"".join(r["fp"] for r in rows), np.uint64).reshape(len(rows), 4)
    return (np.array([r["node"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64), words, np.bitwise_count(words).sum(axis=1, dtype=np.int64))


def verified(xs, ys, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of nodes, of the links of the similarity among xs (ys None) or between xs and ys."""
    a, na, x, _ = _columns(xs)
    b, nb, y, _ = (a, na, x, None) if ys is None else _columns(ys)
    sets = [np.frombuffer(r["hashes"], np.uint64) for rows in ((xs,) if ys is None else (xs, ys)) for r in rows]
    names = a if ys is None else np.concatenate([a, b])
    shift = 0 if ys is None else len(a)
    label = np.arange(len(sets))
    out = []
    for i, j, d in near(x, na, y, nb, similarity):
        order = np.argsort(d, kind="stable")
        i, j = i[order], j[order] + shift
        while len(i):
            apart = label[i] != label[j]
            i, j = i[apart], j[apart]
            for p, q in zip(i[:_STEP].tolist(), j[:_STEP].tolist(), strict=True):
                if label[p] == label[q]:
                    continue
                s, t = sets[p], sets[q]
                both = len(np.intersect1d(s, t, assume_unique=True))
                if both >= similarity * (len(s) + len(t) - both) - 1e-9:
                    label[label == label[q]] = label[p]
                    out.append((int(names[p]), int(names[q])))
            i, j = i[_STEP:], j[_STEP:]
    return out


def links(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, k: int, similarity: float, group: int = GROUP) -> DataFrame:
    """(a, b): links of the similarity that connect what all such links connect. `nodes`: node, n, fp, own (did, th of one document)."""
    found = staged(components(candidates(nodes, similarity)))
    tops = found.select(F.col("a").alias("node"), F.col("b").alias("top")).union(found.select("b", "b").distinct())
    wanted = staged(nodes.join(tops, "node").select("node", "n", "fp", "top", "own.did", "own.th"))
    chunks = wanted.groupBy("top").agg(F.ceil(F.sum("n") / F.lit(group)).alias("chunks"))
    wanted = wanted.join(chunks, "top")
    texts = docs.select(*ident(id_col, text_col), F.col(text_col).alias("text")).join(wanted, ["did", "th"])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from xxhash import xxh3_64_intdigest

        for batch in batches:
            sets = [shingle_set(t or "", k).tobytes() for t in batch["text"]]
            mine = np.array([xxh3_64_intdigest(s) for s in sets], np.uint64).view(np.int64) == batch["node"].to_numpy()
            yield batch.drop(columns="text").assign(hashes=sets)[mine]

    kinds = "node long, n long, fp binary, top long, chunks long, hashes binary"
    sets = texts.select("node", "n", "fp", "top", "chunks", "text").mapInPandas(read, kinds)
    sets = sets.dropDuplicates(["node"]).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    blocks = staged(sets.groupBy("top", "chunks", "chunk").agg(F.collect_list(F.struct("node", "n", "fp", "hashes")).alias("rows")))

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([e for xs in batch["xs"] for e in verified(xs, None, similarity)], columns=["a", "b"], dtype="int64")

    def between(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([e for xs, ys in zip(batch["xs"], batch["ys"], strict=True) for e in verified(xs, ys, similarity)], columns=["a", "b"], dtype="int64")

    own = blocks.select(F.col("rows").alias("xs")).where(F.size("xs") > 1).mapInPandas(within, "a long, b long")
    many = blocks.where("chunks > 1")
    left = many.where(F.col("chunk") < F.col("chunks") - 1).select("top", F.col("chunk").alias("i"), F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1)).alias("j"), F.col("rows").alias("xs"))
    right = many.where("chunk > 0").select("top", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunk") - 1)).alias("i"), F.col("chunk").alias("j"), F.col("rows").alias("ys"))
    return own.union(left.join(right, ["top", "i", "j"]).select("xs", "ys").mapInPandas(between, "a long, b long"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, similarity: float = SIMILARITY,
                group: int = GROUP) -> DataFrame:
    """did, th, and of the document's group the smallest (did, th) as `root`, for every row of `docs`."""
    found = staged(prints(docs, id_col, text_col, k))
    nodes = staged(found.groupBy("node", "n", "fp").agg(F.min(F.struct("did", "th")).alias("own")))
    joined = staged(components(links(docs, nodes, id_col, text_col, k, similarity, group)))
    tops = joined.select(F.col("a").alias("node"), F.col("b").alias("top"))
    labelled = staged(nodes.join(tops, "node", "left").select("node", "n", "own", F.coalesce("top", "node").alias("top")))
    roots = labelled.groupBy("top").agg(F.min("own").alias("root"))
    return found.join(labelled.join(roots, "top").select("node", "n", "root"), ["node", "n"]).select("did", "th", "root")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` without all but the first document of each group of near copies; repeated rows stay once."""
    return first_of_each(docs, near_copies(docs, id_col, text_col), id_col, text_col)
