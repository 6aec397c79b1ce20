"""Best-fit packing of tokenised documents by matching of large items.

Lengths are whole numbers up to the capacity, so the plan is made on the histogram of lengths (at most `capacity` numbers,
whatever the corpus) and consists of bin patterns with multiplicities. Pieces above one third of the capacity share a bin with at
most one other such piece and are matched greedily, the longest first with the longest that still fits; shorter pieces, the
longest first, go to the smallest gap that holds them. A piece finds its place by its rank among the pieces of its length.

Null or empty text is the end token alone. Null ids, repeated ids and repeated rows are packed as documents of their own. An empty
table gives no rows. Other columns of the input are ignored.
"""

from __future__ import annotations

import bisect
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.common import staged

CAPACITY = 1024
END_ID = 2
#: Groups that the pieces of one length are dealt over, and pieces for each further group.
RANK_SALTS, RANK_ROWS = 64, 20_000
#: Entries of a worker's memo of encoded words; it starts again when it is full.
MEMO = 800_000

#: Cutting at single spaces leaves the pre-tokens of byte-level BPE as they are, unless a space has white space around it or the
#: text holds the only special token.
_UNSAFE = re.compile(r"\s \s|\s \Z|  |<\|endoftext\|>")


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level BPE files write bytes: printable ones stand for themselves, the others follow from U+0100."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder(dict):
    """Token ids of texts as little-endian unsigned 32-bit bytes; as a dict, the memo of the words after single spaces.

    The tokenizer file is read by `tokenizers`, which also encodes texts that can't be cut at spaces. Words that the memo misses are
    merged by `tiktoken` with the same vocabulary, whose ids are in the order of the merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, letters = Tokenizer.from_file(path), _byte_letters()
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(map(letters.__getitem__, t)): i for t, i in self.tokenizer.get_vocab().items() if t not in special}
        self.merge = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        ids = self[word] = np.array(self.merge(" " + word), dtype="<u4").tobytes()
        return ids

    def encode(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        head, *rest = text.split(" ")
        return np.array(self.merge(head), dtype="<u4").tobytes() + b"".join(map(self.__getitem__, rest))


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: whole capacities, a shorter one only at the front."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 and, if asked for, the ids themselves."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, tail = Encoder(tokenizer), np.asarray([end_id], dtype="<u4").tobytes()
        for batch in batches:
            out = []
            for key, text in zip(batch["key"], batch["text"], strict=True):
                ids = encoder.encode(text or "") + tail
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    part = ids[4 * start:4 * (start + length)]
                    out.append((key, k, start, length, zlib.crc32(part)) + ((np.frombuffer(part, "<u4").astype(np.int64),) if with_ids else ()))
            yield pd.DataFrame(out, columns=names)

    names = ["key", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    schema = "key string, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    read = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType
    return read.mapInPandas(run, schema).withColumn("key", F.col("key").cast(kind)).withColumnRenamed("key", id_col)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bin patterns as (number of bins, [(length, copies), ...]) that hold exactly the histogram's pieces."""
    left = {k: v for k, v in histogram.items() if v > 0}
    gaps: dict[int, list[tuple[int, list]]] = {}
    large = sorted(k for k in left if 3 * k > capacity)
    while large:
        a = large[-1]
        at = bisect.bisect_right(large, capacity - a) - 1
        b = large[at] if at >= 0 else None
        if b is None:
            n, pattern = left[a], [(a, 1)]
            left[a] = 0
        elif b == a:
            n, pattern = (left[a] // 2, [(a, 2)]) if left[a] > 1 else (1, [(a, 1)])
            left[a] -= n * pattern[0][1]
        else:
            n, pattern = min(left[a], left[b]), [(a, 1), (b, 1)]
            left[a] -= n
            left[b] -= n
        gaps.setdefault(capacity - sum(x * c for x, c in pattern), []).append((n, pattern))
        large = [k for k in large if left[k]]
    order = sorted(gaps)

    def put(gap: int, n: int, pattern: list) -> None:
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((n, pattern))

    for s in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        c = left[s]
        while c:
            at = bisect.bisect_left(order, s)
            if at == len(order):
                k = capacity // s
                if c >= k:
                    put(capacity - k * s, c // k, [(s, k)])
                if c % k:
                    put(capacity - c % k * s, 1, [(s, c % k)])
                break
            gap = order[at]
            n, pattern = gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap], order[at]
            k = gap // s
            full = min(c // k, n)
            c -= full * k
            if full:
                put(gap - k * s, full, pattern + [(s, k)])
            if full < n and c:
                put(gap - c * s, 1, pattern + [(s, c)])
                full, c = full + 1, 0
            if full < n:
                put(gap, n - full, pattern)
    return [x for gap in order for x in gaps[gap]]


def _slots(patterns: list, shift: int) -> dict[str, np.ndarray]:
    """Runs of ranks of one length that go to one pattern, sorted by (length, first rank)."""
    rows, used, base = [], {}, 0
    for bins, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            first = used.get(length, 0)
            used[length] = first + bins * copies
            rows.append(((length << shift) + first, length, copies, base, offset))
            offset += length * copies
        base += bins
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("key", "length", "copies", "base", "offset"))}


def ranked(rows: DataFrame, length: str, order: list[str], total: int) -> DataFrame:
    """`rank` from 0 within each length. Each length is dealt over salted groups, so a frequent length is no hot group."""
    salts = RANK_SALTS + total // RANK_ROWS
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy(length, "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy(length).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(length, "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy(length, "salt").orderBy(*order))
    return salted.withColumn("at", within).join(sizes, [length, "salt"]).withColumn("rank", F.col("before") + F.col("at") - 1).drop("salt", "at", "before")


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds `sequence_id` and `offset` to pieces (columns piece, length and others); sequences are gapless from offset 0."""
    cut_pieces = staged(cut_pieces)
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # <= capacity rows
    total, shift = sum(histogram.values()), 42
    slots = _slots(plan(histogram, capacity), shift)

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        length, rank = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        key = (length << shift) + rank
        at = np.searchsorted(slots["key"], key, side="right") - 1
        nth, copies = key - slots["key"][at], slots["copies"][at]
        return pd.DataFrame({"sequence_id": slots["base"][at] + nth // copies, "offset": slots["offset"][at] + nth % copies * length})

    order = [c for c in cut_pieces.columns if c not in ("length", "ids")]
    placed = ranked(cut_pieces, "length", order, total).withColumn("place", place("length", "rank"))
    return placed.select(*cut_pieces.columns, "place.sequence_id", "place.offset")


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """The packed sequences themselves: sequence_id, ids. A sequence never exceeds the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", ids)))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select("sequence_id", F.flatten(F.col("parts")[ids]).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id",
                   text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Tokenises, cuts and packs `docs`."""
    return pack(pieces(docs, tokenizer, capacity, end_id, id_col, text_col, with_ids), capacity)


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4(docs: DataFrame) -> DataFrame:
    out = pack_documents(docs, tokenizer_path())
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


__all__ = ["Encoder", "cut", "op4", "pack", "pack_documents", "pieces", "plan", "sequences", "tokenizer_path"]
