"""Exact substring de-duplication of bytes with sharded suffix arrays.

Removes each byte that a string of `width` bytes covers which also starts earlier: in a document of smaller id, or earlier in the
same one. Documents are never compared in pairs:

1. *Regions.* Each string of `width` bytes has one anchor, its rightmost least-hashed 32-byte gram. Strings that follow each other and
   share their anchor form a region of up to 2 * width bytes. Equal strings have equal anchors, so only regions with equal anchor
   grams can hold equal strings. A region is known by 128 bits of two hashes (anchor gram, whole content).
2. *Pre-aggregation.* A region whose content occurs earlier is removed whole. Copies among the documents at hand are settled there, so
   a passage that very many documents share leaves them once.
3. *Shards.* Where an anchor gram has several contents, the first region of each content goes to a shard of bounded size. There a
   suffix array (Larsson-Sadakane, Kasai) over the shard's regions finds the equal strings.
4. *Narrowing.* Regions of an anchor gram that exceeds a shard are cut where the anchor's place in the string enters another cell of
   eight places. Equal strings have equal places, so they share the bytes that all strings of a cell have around the anchor; the cuts
   are known by those and pre-aggregated as in 2. A common line among ever new words leaves the comparison here.
5. *Merging.* Only what still exceeds a shard is split over several. Their sorted strings are dealt by a hash of the string, and the
   pieces that meet are merged by binary search. Each string moves once, and rows and tasks have a bounded size.

Null text counts as empty. Null ids come last in the order. Repeated rows are one document; different texts under one id are told
apart by 64 bits of their hash and ordered by them. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermaline.llm.common import ident, staged
from thermaline.llm.suffix import fixed, found_in, window_classes

WIDTH = 100
GRAM = 32
#: Regions of a shard, on average at most.
SHARD_ROWS = 8_192
#: Places of the anchor in the string that a cut of a narrowed region holds.
CELL = 8
#: Bytes that are hashed at once; positions must fit the low bits of a key.
_BLOCK_BITS = 20
#: Characters of the documents whose regions are held at once, unless one document has more.
_SLICE = 6_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53], dtype=np.uint64)


def _stir(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(31))) * _MIX[4]


def _grams(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the 32 bytes from each position on."""
    eight = np.ndarray(len(data) - 7, dtype="<u8", buffer=data, strides=(1,))
    sixteen = _stir(eight[:-8] * _MIX[0] + _stir(eight[8:] * _MIX[1]))
    return _stir(sixteen[:-16] * _MIX[2] + _stir(sixteen[16:] * _MIX[3]))


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` keys."""
    step = 1
    out = key
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    return out if step == width else np.minimum(out[:len(key) - width + 1], out[width - step:])


def _hashed(grams: np.ndarray, seed: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of a seed and the `length` bytes (64 to 192) from each start on."""
    out = _stir(seed.astype(np.uint64) * _MIX[5])
    last = length - GRAM
    for k, off in enumerate((0 * length, 0 * length + GRAM, np.minimum(2 * GRAM, last), np.minimum(3 * GRAM, last), last - GRAM, last)):
        out = _stir(out ^ (grams[start + off] * _MIX[k]))
    return out.view(np.int64)


def regions(data: np.ndarray, edges: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """(akey, rkey, slice, start, strings) of the regions of the slices that `edges` bounds in `data`; start within its slice."""
    n = len(data)
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < width:
        return none
    grams, mask = _grams(data), np.uint64((1 << _BLOCK_BITS) - 1)
    top = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    anchor = (mask - (_least(top, width - GRAM + 1) & mask)).astype(np.int64)
    at = np.arange(len(anchor))
    owner = np.searchsorted(edges, at, side="right") - 1
    inside = at + width <= edges[owner + 1]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])])
    at, owner, new, anchor = at[inside], owner[inside], new[inside], anchor[inside]
    if not len(at):
        return none
    new[0] = True
    first = np.flatnonzero(new)
    strings = np.diff(np.concatenate([first, [len(at)]]))
    start, who, gram = at[first], owner[first], anchor[first]
    content = _hashed(grams, strings, start, strings + width - 1)
    return grams[gram].view(np.int64), content, who, start - edges[who], strings


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _blocks(texts: list[bytes], width: int) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray]]:
    """Slices of texts, put together up to the block size: [(text, its offset)], data, edges."""
    size = (1 << _BLOCK_BITS) - 1
    parts, slices, held = [], [], 0

    def block():
        return slices, np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])])

    for k, text in enumerate(texts):
        for lo in range(0, max(len(text) - width + 1, 0), size - width):
            part = text[lo:lo + size - 1]
            if held + len(part) >= size:
                yield block()
                parts, slices, held = [], [], 0
            parts.append(part)
            slices.append((k, lo))
            held += len(part)
    if parts:
        yield block()


def _known(rows: pd.DataFrame) -> pd.DataFrame:
    """`rows` in their order with a null rkey where an earlier one has the same content: it is decided."""
    known = rows.duplicated(["akey", "rkey"])
    rows["rkey"] = rows["rkey"].astype("Int64").mask(known)
    rows["akey"] = rows["akey"].mask(known, rows["did"] * 1_000_003 + rows["th"] + rows["at"])  # spreads the decided rows
    return rows


def anchored(docs: DataFrame, width: int) -> DataFrame:
    """(akey, rkey, did, th, at) of all regions; at = start << 8 | strings. rkey is null where an earlier region at hand has
    the same content: it is decided."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch = batch.sort_values(["did", "th"], kind="stable")
            part = batch["text"].str.len().fillna(0).cumsum() // _SLICE  # what is held at once follows text, not rows
            for _, rows in batch.groupby(part.to_numpy(), sort=True):
                yield from found(rows)

    def found(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        did, th = batch["did"].to_numpy(np.int64), batch["th"].to_numpy(np.int64)
        out = []
        for slices, data, edges in _blocks([_utf8(t) for t in batch["text"]], width):
            akey, rkey, who, start, strings = regions(data, edges, width)
            text, low = np.array(slices, np.int64)[who].T if len(who) else (who, who)
            out.append((akey, rkey, did[text], th[text], ((start + low) << 8) | strings))
        if out:
            rows = pd.DataFrame(dict(zip(("akey", "rkey", "did", "th", "at"), map(np.concatenate, zip(*out, strict=True)), strict=True)))
            yield _known(rows.drop_duplicates(["did", "th", "at"]))

    return docs.mapInPandas(run, "akey long, rkey long, did long, th long, at long")


def narrowed(regions_: DataFrame, width: int) -> DataFrame:
    """(akey, rkey, did, th, at, bytes): the regions cut where the anchor's place in the string enters another cell. akey is that of
    the bytes which all strings of the cell have around the anchor; rkey as in `anchored`."""
    last = width - GRAM

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            batch = batch.sort_values(["did", "th", "at"], kind="stable")
            texts = batch["bytes"].tolist()
            edge = np.concatenate([[0], np.cumsum([len(t) for t in texts])])[:-1]
            grams, low = _grams(np.frombuffer(b"".join(texts), np.uint8)), np.uint64(_BLOCK_BITS)
            akey, at = batch["akey"].to_numpy(np.int64).view(np.uint64), batch["at"].to_numpy(np.int64)
            same = (grams[edge[:, None] + np.arange(last + 1)] >> low) == (akey >> low)[:, None]
            place = last - np.argmax(same[:, ::-1], axis=1)  # of the anchor in the first string: the rightmost least gram
            least = place - (at & 0xFF) + 1  # in the last string
            many = place // CELL - least // CELL + 1
            row = np.repeat(np.arange(len(many)), many)
            cell = place[row] // CELL - (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many))
            lo, hi = cell * CELL, np.minimum(cell * CELL + CELL - 1, last)
            first = place[row] - np.minimum(hi, place[row])
            strings = place[row] - np.maximum(lo, least[row]) - first + 1
            size = strings + width - 1
            rows = pd.DataFrame({"akey": _hashed(grams, cell, edge[row] + place[row] - lo, lo + width - hi),
                                 "rkey": _hashed(grams, strings, edge[row] + first, size),
                                 "did": batch["did"].to_numpy(np.int64)[row], "th": batch["th"].to_numpy(np.int64)[row],
                                 "at": (((at >> 8)[row] + first) << 8) | strings})
            rows["bytes"] = [texts[r][a:a + n] for r, a, n in zip(row.tolist(), first.tolist(), size.tolist(), strict=True)]
            yield _known(rows)

    return regions_.select("akey", "did", "th", "at", "bytes").mapInPandas(cut, "akey long, rkey long, did long, th long, at long, bytes binary")


def judged(found: DataFrame) -> DataFrame:
    """Regions that are repeats (`gone`) or whose akey has other contents too: akey, did, th, at, gone, and further columns."""
    whole = Window.partitionBy("akey").orderBy("rkey", "did", "th", "at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    copies = Window.partitionBy("akey", "rkey").orderBy("did", "th", "at")
    found = found.withColumn("lo", F.min("rkey").over(whole)).withColumn("hi", F.max("rkey").over(whole))
    found = found.withColumn("gone", F.col("rkey").isNull() | (F.dense_rank().over(copies) > 1))
    return found.where(F.col("gone") | (F.col("lo") != F.col("hi"))).drop("rkey", "lo", "hi")


def _runs(did: np.ndarray, th: np.ndarray, start: np.ndarray) -> pd.DataFrame:
    """(did, th, at) for the runs of consecutive starts, at most 127 strings each."""
    by = np.lexsort((start, th, did))
    did, th, start = did[by], th[by], start[by]
    new = np.concatenate([[True], (did[1:] != did[:-1]) | (th[1:] != th[:-1]) | (start[1:] != start[:-1] + 1)])[:len(did)]
    nth = np.arange(len(did)) - np.flatnonzero(new)[np.cumsum(new) - 1] if len(did) else did
    head = np.flatnonzero(nth % 127 == 0)
    strings = np.diff(np.concatenate([head, [len(did)]]))
    return pd.DataFrame({"did": did[head], "th": th[head], "at": (start[head] << 8) | strings})


def contested(docs: DataFrame, regions_: DataFrame, width: int, shard_rows: int) -> DataFrame:
    """(did, th, at) of the repeated strings in first regions that share an anchor gram but not their content. What exceeds a shard is
    narrowed, what still does is split and merged."""
    lists = regions_.groupBy("did", "th").agg(F.collect_list(F.struct("akey", "at")).alias("list"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zstandard import ZstdDecompressor

        unzip = ZstdDecompressor()
        for batch in batches:
            out = []
            for did, th, packed, rows in zip(batch["did"].tolist(), batch["th"].tolist(), batch["packed"], batch["list"], strict=True):
                text = unzip.decompress(packed)
                for r in rows:
                    start = r["at"] >> 8
                    out.append((r["akey"], did, th, r["at"], text[start:start + (r["at"] & 0xFF) + width - 1]))
            yield pd.DataFrame(out, columns=["akey", "did", "th", "at", "bytes"])

    pulled = staged(docs.join(lists, ["did", "th"]).mapInPandas(cut, "akey long, did long, th long, at long, bytes binary").distinct())

    def dealt(pulled: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Regions by shard; those of akeys that exceed a shard with their number n, None if there are none."""
        # the akeys that have a shard each, written since a table of known size is broadcast, or joined with its skew split
        many = staged(pulled.groupBy("akey").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows // 8))
        most, buckets = many.agg(F.max("n")).first()[0] or 0, max(1, -(-pulled.count() // shard_rows))
        counted = pulled.join(many, "akey", "left")
        shard = F.when(F.col("n").isNull(), F.pmod(F.xxhash64("akey"), F.lit(buckets))).otherwise(F.col("akey"))
        whole = counted.where(F.col("n").isNull() | (F.col("n") <= shard_rows)).withColumn("shard", shard)
        return whole, counted.where(F.col("n") > shard_rows) if most > shard_rows else None

    def one(rows: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """In suffix order: class, did, th, start, data, positions of the strings."""
        texts = rows["bytes"].tolist()
        size = np.array([len(t) for t in texts])
        data, edge = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum(size)])
        where = np.arange(len(data))
        owner = np.searchsorted(edge, where, side="right") - 1
        at, label = window_classes(data, where + width <= edge[owner + 1], width)
        who = owner[at]
        packed = rows["at"].to_numpy(np.int64)[who]
        return label, rows["did"].to_numpy(np.int64)[who], rows["th"].to_numpy(np.int64)[who], (packed >> 8) + at - edge[who], data, at

    def later(label, did, th, start) -> np.ndarray:
        by = np.lexsort((start, th, did, label))
        first = np.ones(len(by), bool)
        first[1:] = label[by][1:] != label[by][:-1]
        out = np.ones(len(by), bool)
        out[by[first]] = False
        return out

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        label, did, th, start, _, _ = one(rows)
        gone = later(label, did, th, start)
        return _runs(did[gone], th[gone], start[gone])

    def sorted_part(rows: pd.DataFrame) -> pd.DataFrame:
        label, did, th, start, data, at = one(rows)
        gone = later(label, did, th, start)
        first = np.flatnonzero(~gone)  # one per class, and classes are in suffix order
        first = first[np.argsort(label[first], kind="stable")]
        piece = (_hashed(_grams(data), 0 * first, at[first], 0 * first + width).view(np.uint64) % np.uint64(rows["subs"].iloc[0])).astype(np.int64)
        first = first[np.argsort(piece, kind="stable")]  # in suffix order within a piece
        pieces, ends = np.unique(np.sort(piece), return_index=True)
        cuts = np.split(first, ends[1:])
        best = pd.DataFrame({"piece": pieces, "did": -1, "th": -1, "at": -1, "strings": [fixed(data, at[c], width).tobytes() for c in cuts],
                             "firsts": [np.stack([did[c], th[c], start[c]]).tobytes() for c in cuts]})
        out = pd.concat([_runs(did[gone], th[gone], start[gone]).assign(piece=-1, strings=None, firsts=None), best]).assign(akey=rows["akey"].iloc[0])
        return out[["akey", "piece", "did", "th", "at", "strings", "firsts"]]

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        strings = np.concatenate([np.frombuffer(s, f"S{width + 1}") for s in rows["strings"]])
        firsts = np.concatenate([np.frombuffer(f, np.int64).reshape(3, -1) for f in rows["firsts"]], axis=1)
        gone = later(found_in(strings, np.unique(strings)), *firsts)
        return _runs(*firsts[:, gone])

    spans = "did long, th long, at long"
    whole, split = dealt(pulled)
    found = whole.groupBy("shard").applyInPandas(shard, spans)
    if split is None:
        return found
    narrow = staged(judged(narrowed(split, width)).withColumn("bytes", F.when(~F.col("gone"), F.col("bytes"))))
    whole, split = dealt(narrow.where("not gone").drop("gone"))
    found = found.union(narrow.where("gone").select("did", "th", "at")).union(whole.groupBy("shard").applyInPandas(shard, spans))
    if split is None:
        return found
    split = split.withColumn("subs", F.ceil(F.col("n") / shard_rows)).withColumn("sub", F.pmod(F.xxhash64("did", "th", "at"), F.col("subs")))
    # one column of both: grouped by the pair, all parts of an anchor would stay in the task that the join has put them in
    parts = staged(split.withColumn("part", F.concat_ws(":", "akey", "sub")).groupBy("part").applyInPandas(
        sorted_part, "akey long, piece long, did long, th long, at long, strings binary, firsts binary"))
    merged = parts.where("strings is not null").groupBy("akey", "piece").applyInPandas(merge, spans)
    return found.union(parts.where("strings is null").select("did", "th", "at")).union(merged)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and `kept` (the remaining bytes) of every row of `docs`."""
    did, _ = ident(id_col, text_col)
    read = docs.select(did, F.xxhash64(F.col(text_col)).alias("th"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found = staged(judged(anchored(read.select("did", "th", "text"), width)))

    @F.pandas_udf("binary")
    def pack(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from zstandard import ZstdCompressor

        zip_ = ZstdCompressor(level=1)
        for text in texts:
            yield text.map(lambda t: zip_.compress(_utf8(t)))

    packed = read.select("id", "did", "th", pack("text").alias("packed"))
    small = contested(packed.drop("id"), found.where("not gone").drop("gone"), width, shard_rows)
    gone = found.where("gone").select("did", "th", "at").union(small).groupBy("did", "th").agg(F.collect_list("at").alias("gone"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from zstandard import ZstdDecompressor

        unzip = ZstdDecompressor()
        for batch in batches:
            out, held = [], 0
            for key, data, at in zip(batch["id"], batch["packed"], batch["gone"], strict=True):
                text = unzip.decompress(data)
                edge = np.zeros(len(text) + 1, np.int64)
                at = np.asarray(at if at is not None else [], np.int64)
                start = at >> 8
                np.add.at(edge, start, 1)
                np.add.at(edge, start + (at & 0xFF) + width - 1, -1)
                cover = np.cumsum(edge[:-1]) > 0
                kept = np.frombuffer(text, np.uint8)[~cover].tobytes()
                spans = int(cover[:1].sum() + (cover[1:] & ~cover[:-1]).sum())
                out.append((key, len(text), int(cover.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
                held += len(kept)
                if held > 1 << 25:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    names = ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
    joined = packed.withColumn("id", F.col("id").cast("string")).join(gone, ["did", "th"], "left")
    out = joined.mapInPandas(finish, "id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *names[1:])


def op1(docs: DataFrame) -> DataFrame:
    return remove_repeats(docs).drop("kept")
