"""SentencePiece encoding and decoding by a max-plus parallel scan.

The pieces and scores of a public model are used as a unigram model: a text is cut into the pieces with the largest sum of scores,
ties going to the longer last piece at each place, and what no piece covers becomes bytes. Spaces are written as U+2581, one is put
in front.

A piece never goes beyond a word, so the words of ordinary texts are encoded one by one with a memo. A giant document is cut into
chunks that Spark deals to tasks. A piece may cross a chunk's end by up to L - 1 characters, L being the longest piece; these offsets
are the boundary states. Each chunk yields its transfer matrix of best scores from entry to exit state; max-plus products of these
matrices, which are associative, give the scores at which each chunk is entered. With them every chunk finds, on its own, its entry
state for each exit state; composing these maps from the end fixes the exit states, from which each chunk is traced back alone. The
result is exactly that of one sequential pass.

Null text stays null, empty text has no ids. Null ids and repeated rows give a row each. An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import staged

SPACE = "▁"
#: Characters of a chunk; longer documents are scanned in parallel.
CHUNK = 16_384
MEMO = 600_000
#: Less than every sum of scores.
_NONE = -(2**62)
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


class Model:
    """Vocabulary of a SentencePiece model file, with whole-number scores."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(i) for i in range(size)]
        self.is_byte = [sp.is_byte(i) for i in range(size)]
        self.special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i)}
        usable = [i for i in range(size) if i not in self.special and not self.is_byte[i] and not sp.is_unused(i)]
        self.known = {self.pieces[i]: (round(sp.get_score(i)), i) for i in usable}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if self.is_byte[i]}
        self.unknown = min(s for s, _ in self.known.values()) - 10
        #: Score of each piece, and None for what only begins a longer one.
        self.table: dict[str, int | None] = {p[:k]: None for p in self.known for k in range(1, len(p))} | {p: s for p, (s, _) in self.known.items()}
        self.longest = max(map(len, self.known))
        #: The pieces as a tree: by character the score of the piece that ends there (None: none) and what goes on (None: nothing).
        self.tree: dict[str, list] = {}
        for p, (s, _) in self.known.items():
            at = self.tree
            for c in p[:-1]:
                node = at.setdefault(c, [None, None])
                at = node[1] = node[1] or {}
            at.setdefault(p[-1], [None, None])[0] = s
        if any(SPACE in p.lstrip(SPACE) for p in self.known):
            raise ValueError("pieces that go beyond a word are not supported")
        self.scores = np.zeros(size, np.int64)
        for value, i in self.known.values():
            self.scores[i] = value
        for byte, i in self.byte.items():
            self.scores[i] = 0 if 0x80 <= byte < 0xC0 else self.unknown
        self.memo = _Memo(self)

    def forward(self, text: str, entry: list[int], stop: int) -> tuple[list[int], list[int]]:
        """Best score and first best start of the last piece at each place; pieces start before `stop`. entry: scores at the first
        places. A character that is no piece is unknown."""
        size, table, unknown = len(text), self.table, self.unknown
        best, back = entry + [_NONE] * (size + 1 - len(entry)), [-1] * (size + 1)
        for at in range(min(stop, size)):
            own = best[at]
            if own == _NONE:
                continue
            score = table.get(text[at])
            value = own + (unknown if score is None else score)
            if value > best[at + 1]:
                best[at + 1], back[at + 1] = value, at
            for end in range(at + 2, size + 1):
                score = table.get(text[at:end], 1)  # scores are never above 0
                if score is None:
                    continue
                if score == 1:
                    break
                value = own + score
                if value > best[end]:
                    best[end], back[end] = value, at
        return best, back

    def ids(self, text: str, cuts: list[int]) -> list[int]:
        out = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            hit = self.known.get(text[a:b])
            out += [hit[1]] if hit else [self.byte[x] for x in text[a:b].encode("utf-8", "surrogatepass")]
        return out

    def word(self, text: str) -> tuple[bytes, int]:
        """Ids (little-endian, 32 bits) and score of a word that starts with spaces or follows none."""
        size, tree, unknown = len(text), self.tree, self.unknown
        best, back = [0] + [_NONE] * size, [-1] * (size + 1)
        for at in range(size):  # as `forward` does; each place is reached
            own, node = best[at], tree.get(text[at])
            value = own + (unknown if node is None or node[0] is None else node[0])
            if value > best[at + 1]:
                best[at + 1], back[at + 1] = value, at
            end = at + 1
            while node and node[1] and end < size:
                node = node[1].get(text[end])
                end += 1
                if node and node[0] is not None and (value := own + node[0]) > best[end]:
                    best[end], back[end] = value, at
        return array("I", self.ids(text, trace(back, size))).tobytes(), best[size]

    def words(self, text: str) -> bytes:
        """Ids of a text that starts at a word."""
        if len(self.memo) >= MEMO:
            self.memo.clear()
        return b"".join(map(self.memo.__getitem__, _WORD.findall(text)))  # a memo may grow by the words of one text beyond its limit

    def score(self, ids: bytes) -> int:
        """Sum of the scores of the pieces `ids`; of the bytes of an unknown character only the first counts."""
        return int(self.scores[np.frombuffer(ids, "<u4")].sum())

    def encode(self, text: str) -> bytes:
        return self.words(normal(text)) if text else b""


@lru_cache(maxsize=1)
def model_of(path: str) -> Model:
    """The model, kept with its memo by a worker for the tasks that follow."""
    return Model(path)


@lru_cache(maxsize=1)
def byte_strings(path: str) -> list[bytes]:
    """What each id of the model stands for, with spaces as such."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    made = []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        made.append(bytes([int(p[3:5], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) or sp.is_unknown(i) else p.replace(SPACE, " ").encode())
    return made


def text_of(ids: bytes, strings: list[bytes]) -> str:
    out = b"".join(map(strings.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    text = out.decode("utf-8", "surrogatepass").replace(SPACE, " ")
    return text[1:] if text.startswith(" ") else text


class _Memo(dict):
    """Ids of the words seen so far; long ones are not kept."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, text: str) -> bytes:
        ids, _ = self.model.word(text)
        if len(text) < 64:
            self[text] = ids
        return ids


def normal(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def trace(back: list[int], end: int, floor: int = 0) -> list[int]:
    """Places of the cuts from the entry to `end`; places without a start before them are entries."""
    cuts = [end]
    while cuts[-1] > floor and back[cuts[-1]] >= 0:
        cuts.append(back[cuts[-1]])
    return cuts[::-1]


def edge_words(text: str, size: int, reach: int) -> tuple[int, int] | None:
    """First and last word start that every path passes, behind all entry states and not behind the chunk's end."""
    first = next((m.start() for m in re.finditer(f"(?<!{SPACE}){SPACE}", text) if m.start() >= reach), None)
    if first is None or first > size:
        return None
    last = first
    at = text.rfind(SPACE, first, min(size + 1, len(text)))
    while at > first:
        if text[at - 1] != SPACE:
            last = at
            break
        at -= 1
    return first, last


class Part(NamedTuple):
    """A chunk as it travels: the text up to the first word start that every path passes, the ids of the words from there to the last one,
    and the text from there on, of which `size` characters are the chunk's. Without such word starts `first` is -1 and `head` the whole text."""

    head: str
    first: int
    middle: bytes
    tail: str
    size: int


def part(model: Model, text: str, size: int) -> Part:
    words = edge_words(text, size, model.longest - 1)
    if words is None:
        return Part(text, -1, b"", "", size)
    first, last = words
    return Part(text[:first], first, model.words(text[first:last]), text[last:], size - last)


def transfer(model: Model, p: Part) -> np.ndarray:
    """(L, L) best scores from entry offset to exit offset of a chunk."""
    n = model.longest
    out = np.full((n, n), _NONE, np.int64)
    if p.first < 0:
        for a in range(min(n, p.size)):
            best, _ = model.forward(p.head, [_NONE] * a + [0], p.size)
            exits = best[p.size:p.size + n]
            out[a, :len(exits)] = exits
        for a in range(p.size, n):  # a piece that goes over the whole chunk
            out[a, a - p.size] = 0
        return out
    tail, _ = model.forward(p.tail, [0], p.size)
    exits, middle = np.array(tail[p.size:p.size + n]), model.score(p.middle)
    for a in range(n):
        head, _ = model.forward(p.head, [_NONE] * a + [0], p.first)
        if head[p.first] > _NONE:
            out[a, :len(exits)] = np.where(exits > _NONE, head[p.first] + middle + exits, _NONE)
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus product; b may be a matrix, a a matrix or a row."""
    out = (a[..., :, None] + np.maximum(b, _NONE // 2)).max(axis=-2)
    return np.where(out < _NONE // 4, _NONE, out)


def entries(matrices: list[np.ndarray]) -> list[np.ndarray]:
    """Scores of the entry states of each chunk, the best of each being 0."""
    n = matrices[0].shape[0]
    row = np.where(np.arange(n) == 0, 0, _NONE).astype(np.int64)
    out = []
    for m in matrices:
        out.append(row)
        row = product(np.maximum(row, _NONE // 2), m)
        row = np.where(row > _NONE, row - row.max(), _NONE)
    return out


def entry_of(model: Model, p: Part, entry: list[int]) -> list[int]:
    """For each exit state the entry state that the trace back reaches; -1 where there is none."""
    n = model.longest
    if p.first >= 0:  # every path passes the first word start
        _, back = model.forward(p.head, entry, p.first)
        return [trace(back, p.first)[0]] * n
    best, back = model.forward(p.head, entry, p.size)
    return [trace(back, p.size + b)[0] if p.size + b < len(best) and best[p.size + b] > _NONE else -1 for b in range(n)]


def ends(model: Model, p: Part, entry: list[int], exit_: int) -> tuple[bytes, bytes]:
    """Ids of the pieces that start in the chunk before and behind its middle, traced back from its exit state."""
    packed = lambda text, back, at: np.array(model.ids(text, trace(back, at)), "<u4").tobytes()
    if p.first < 0:
        _, back = model.forward(p.head, entry, p.size)
        return packed(p.head, back, p.size + exit_), b""
    _, before = model.forward(p.head, entry, p.first)
    _, behind = model.forward(p.tail, [0], p.size)
    return packed(p.head, before, p.first), packed(p.tail, behind, p.size + exit_)


def chunk_ids(model: Model, p: Part, entry: list[int], exit_: int) -> bytes:
    """Ids of the pieces that start in the chunk."""
    front, back = ends(model, p, entry, exit_)
    return front + p.middle + back


def chunks(model: Model, text: str, size: int) -> list[tuple[str, int]]:
    """(text with what follows, size) of the chunks of a normalised text."""
    return [(text[a:a + size + model.longest - 1], min(size, len(text) - a)) for a in range(0, len(text), size)]


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, verify: bool = False) -> DataFrame:
    """id, text, ids (little-endian 32-bit numbers) and n_chunks of every row of `docs`; with `verify`, also round_trip: whether the ids
    decode to the text. The words of small texts are decoded where they were encoded, and don't travel for it."""
    kind = docs.schema[id_col].dataType
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    giant = F.char_length("text") >= chunk

    @F.pandas_udf("ids binary, round_trip boolean")
    def whole(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model, strings = model_of(model_path), byte_strings(model_path) if verify else []
        for texts in batches:
            ids = [None if t is None else model.encode(t) for t in texts]
            same = [i is None or text_of(i, strings) == t for i, t in zip(ids, texts, strict=True)] if verify else None
            yield pd.DataFrame({"ids": ids, "round_trip": same})

    small = read.where(F.coalesce(~giant, F.lit(True))).select("id", "text", whole("text").alias("made"))
    small = small.select("id", "text", "made.ids", F.lit(1).alias("n_chunks"), "made.round_trip")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = model_of(model_path)
        for batch in batches:
            for text, doc in zip(batch["text"], batch["doc"], strict=True):
                made = [part(model, t, n) for t, n in chunks(model, normal(text), chunk)]
                rows = [(doc, k, *p, transfer(model, p).tobytes()) for k, p in enumerate(made)]
                yield pd.DataFrame(rows, columns=["doc", "chunk", *Part._fields, "matrix"])

    # equal giant texts are encoded once
    large = read.where(giant).withColumn("doc", F.sha2("text", 256))
    parts = staged(large.groupBy("doc").agg(F.first("text").alias("text")).mapInPandas(cut, "doc string, chunk int, head string, first int, middle binary, tail string, size int, matrix binary"))

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        n = int((len(rows["matrix"].iloc[0]) // 8) ** 0.5)
        row = entries([np.frombuffer(m, np.int64).reshape(n, n) for m in rows["matrix"]])
        return pd.DataFrame({"doc": rows["doc"], "chunk": rows["chunk"], "entry": [r.tolist() for r in row]})

    row = parts.select("doc", "chunk", "matrix").groupBy("doc").applyInPandas(scan, "doc string, chunk int, entry array<long>")
    # the middles, most of the volume, travel once, when the ids are put together
    edges = parts.select("doc", "chunk", F.struct(*[F.lit(b"").alias(c) if c == "middle" else F.col(c) for c in Part._fields]).alias("part"))
    entered = staged(edges.join(row, ["doc", "chunk"]))

    @F.pandas_udf("array<int>")
    def maps(batches: Iterator[tuple[pd.DataFrame, pd.Series]]) -> Iterator[pd.Series]:
        model = model_of(model_path)
        for parts_, entry in batches:
            yield pd.Series([entry_of(model, Part(*p), list(e)) for p, e in zip(parts_.itertuples(index=False), entry, strict=True)])

    def compose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk", ascending=False)
        exit_, out = 0, []
        for back in rows["back"]:
            out.append(exit_)
            exit_ = int(back[exit_])
        return pd.DataFrame({"doc": rows["doc"], "chunk": rows["chunk"], "exit": out})

    backs = entered.select("doc", "chunk", maps("part", "entry").alias("back"))
    exits = backs.groupBy("doc").applyInPandas(compose, "doc string, chunk int, exit int")

    @F.pandas_udf("front binary, back binary")
    def traced(batches: Iterator[tuple[pd.DataFrame, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        model = model_of(model_path)
        for parts_, entry, exit_ in batches:
            rows = [ends(model, Part(*p), list(e), x) for p, e, x in zip(parts_.itertuples(index=False), entry, exit_, strict=True)]
            yield pd.DataFrame(rows, columns=["front", "back"])

    @F.pandas_udf("binary")
    def joined(lists: pd.Series) -> pd.Series:
        return lists.map(b"".join)

    done = entered.join(exits, ["doc", "chunk"]).select("doc", "chunk", traced("part", "entry", "exit").alias("ids"))
    three = done.select("doc", "chunk", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("ids.front").alias("ids")), F.struct(F.lit(2).alias("side"), F.col("ids.back").alias("ids")))).alias("p"))
    three = three.select("doc", F.struct("chunk", "p.side", "p.ids").alias("p")).union(parts.select("doc", F.struct("chunk", F.lit(1).alias("side"), F.col("middle").alias("ids")).alias("p")))
    ids = three.groupBy("doc").agg(F.array_sort(F.collect_list("p")).alias("p"))
    ids = ids.select("doc", joined("p.ids").alias("ids"), F.floor(F.size("p") / 3).cast("int").alias("n_chunks"))
    large = large.join(ids, "doc").select("id", "text", "ids", "n_chunks")
    same = F.col("decoded").eqNullSafe(F.col("text")) if verify else F.lit(None).cast("boolean")
    large = (decode(large, model_path) if verify else large).select("id", "text", "ids", "n_chunks", same.alias("round_trip"))
    out = small.union(large).select(F.col("id").cast(kind).alias(id_col), F.col("text").alias(text_col), "ids", "n_chunks", "round_trip")
    return out if verify else out.drop("round_trip")


def decode(encoded: DataFrame, model_path: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Adds the text that the ids stand for."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        strings = byte_strings(model_path)
        for ids in batches:
            yield ids.map(lambda x: None if x is None else text_of(x, strings))

    return encoded.withColumn(to, run(ids_col))


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op7(docs: DataFrame) -> DataFrame:
    out = encode(docs, model_path(), verify=True)
    return out.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "n_chunks", "round_trip")
