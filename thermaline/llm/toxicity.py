"""Toxicity of whole texts through a noisy channel.

Obfuscated stretches (look-alike symbols in words or at their ends, letters repeated three times or more, letters set apart) are
decoded first: a lattice holds what each character may stand for, and the Viterbi path under a character trigram model of the whole corpus
replaces the stretch. Elsewhere the lattice has one path, the text itself. The restored words and their stems are then looked up in
a lexicon learned from labelled documents, and a logistic regression turns the hits into a score.

A word's evidence is the number of different words before it in toxic documents, so that copies of a document count once. Null and
empty texts get the score of a text without hits. Null ids and repeated rows give a row each. An empty table gives no rows; without
labelled rows every score is 0. Other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermaline.llm.common import hash_sample, staged

#: What a symbol may stand for. Fixed values.
LOOKALIKES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i",
              "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou", "#": "aeiou"}
#: Log costs of the channel: a symbol for its letter, a symbol for itself, a repeated letter dropped, a separator or a symbol dropped.
SUBSTITUTE, KEEP, DROP_REPEAT, DROP_GAP, DROP_SYMBOL = -1.0, -4.0, -0.7, -0.2, -12.0
#: A separator that ends a word, one of several in a row, and one of these dropped; behind the last letter a symbol is punctuation, or a
#: digit no part of the word.
END_GAP, END_WIDE, DROP_WIDE, END_SYMBOL, END_DIGIT = -4.0, -0.5, -3.0, 0.0, -4.0
#: A letter that so often is a word of its own among the words it starts may be one at the start of letters set apart.
ALONE = math.log(0.05)
STEM = 5
#: A lexicon entry needs so many different words before it and so much more frequency in toxic documents.
MIN_EVIDENCE, MIN_LIFT = 4, 5.0
#: Entries of the lexicon, the strongest first, and labelled documents to learn from, those of smallest id hash, at most.
LEXICON, FIT_ROWS = 20_000, 40_000

#: Characters whose trigrams are counted at once, and tokens that a worker remembers.
_COUNTED, _MEMO = 2_000_000, 400_000
_ALPHABET = "^abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïñòóôõöøùúûüýÿœ0"
_SIZE = len(_ALPHABET) + 1  # the last symbol is any other letter
_SYMBOL = {c: i for i, c in enumerate(_ALPHABET)}
_MARKS = re.escape("".join(c for c in LOOKALIKES if not c.isdigit()))
#: Stretches with more than one path: letters set apart, and words with look-alikes inside or at an end, or tripled letters.
_SPREAD = re.compile(r"(?<!\w)[^\W_](?:[ .\-_*]{1,2}[^\W_]){2,}(?!\w)")
_MIXED = re.compile(rf"(?<![\w{_MARKS}])(?=[\w{_MARKS}]*[^\W\d_][\w{_MARKS}]*)(?:[{_MARKS}\d]+[^\W\d_]|[^\W\d_]+[{_MARKS}\d]+)[\w{_MARKS}]*|\w*([^\W\d_])\1\1\w*")
_WORDS = re.compile(r"[^\W\d_]+")
#: What may end a word and stands for no letter, separates no letters and belongs to none.
_PLAIN_END = ".,;:?&"
_TRIPLE = re.compile(r"(.)\1\1")
_APART = re.compile(r"(?<!\S)\S[.\-_*]?\s\S[.\-_*]?\s\S[.\-_*]?(?!\S)")


@dataclass
class CharModel:
    """Log probabilities of a character after two others, interpolated with shorter contexts."""

    log: np.ndarray

    @staticmethod
    def of(counts: dict[int, int]) -> CharModel:
        n = np.zeros(_SIZE**3)
        if counts:
            n[np.fromiter(counts.keys(), np.int64)] = np.fromiter(counts.values(), np.float64)
        three = n.reshape(_SIZE, _SIZE, _SIZE)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + _SIZE)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        return CharModel(np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)))

    @cached_property
    def rows(self) -> list[list[list[float]]]:
        """`log` as lists, whose single numbers are read faster."""
        return self.log.tolist()

    @cached_property
    def tails(self) -> dict[tuple[int, int, str], str]:
        """The best readings of symbols and digits behind a word, by the word's last two symbols."""
        return {}


def symbols(text: str) -> np.ndarray:
    """Symbol of each character of a lower-cased text; what isn't a letter or digit is a word boundary."""
    return _TABLE[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), len(_TABLE) - 1)]


def _table() -> np.ndarray:
    out = np.zeros(0x3000, np.int64)
    for k in range(len(out)):
        c = chr(k)
        out[k] = _SYMBOL["0"] if c.isdigit() else _SYMBOL.get(c, _SIZE - 1 if c.isalpha() else 0)
    return out


_TABLE = _table()


def count_characters(docs: DataFrame, text_col: str = "text") -> dict[int, int]:
    """Trigram counts of all texts; there are at most as many as triples of symbols."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(_SIZE**3, np.int64)
        for batch in batches:
            texts = batch["text"].dropna()
            for _, part in texts.groupby((texts.str.len().cumsum() // _COUNTED).to_numpy()):
                s = symbols(f"  {'  '.join(part).lower()} ")
                code = ((s[:-2] * _SIZE + s[1:-1]) * _SIZE + s[2:])[(s[1:-1] > 0) | (s[2:] > 0)]
                total += np.bincount(code, minlength=len(total))
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"code": hit, "n": total[hit]})

    counted = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "code long, n long")
    return {r["code"]: r["n"] for r in counted.groupBy("code").agg(F.sum("n").alias("n")).collect()}


def decode(stretch: str, model: CharModel) -> str:
    """The best reading of an obfuscated stretch. States are the last two symbols with the reading so far."""
    low, log = stretch.lower(), model.rows
    last = max((i for i, c in enumerate(low) if c.isalpha()), default=-1)
    repeats = not low[:last + 1].lstrip("".join(LOOKALIKES)).isalpha() or _TRIPLE.search(low) is not None  # a plain word before symbols keeps its double letters
    a = b = plain = 0
    total = 0.0
    for c in low:  # up to the first symbol, digit or letter that may be a repeat there is one path
        if not c.isalpha() or repeats and low[:plain].endswith(c):
            break
        s = _SYMBOL.get(c, _SIZE - 1)
        total += log[a][b][s]
        a, b, plain = b, s, plain + 1
    tail = (a, b, low[plain:]) if plain > last else None  # without a letter behind it the word's reading is settled
    if tail in model.tails:
        return low[:plain] + model.tails[tail]
    beam: dict[tuple[int, int], tuple[float, str]] = {(a, b): (0.0, "") if tail else (total, low[:plain])}
    for i, c in enumerate(low[plain:], plain):
        gap = c in " .-_*" and i < last
        end, drop = None, DROP_GAP if c in " .-_" else DROP_SYMBOL
        if gap:  # a word may end at it
            wide = i > 0 and (low[i - 1] in " .-_" or low[i + 1] in " .-_")
            end, drop = (END_WIDE, DROP_WIDE) if wide else (END_GAP, drop)
        elif i > last:
            end = END_DIGIT if any(map(str.isalnum, low[i:])) else END_SYMBOL
        after: dict[tuple[int, int], tuple[float, str]] = {}
        known = _SYMBOL.get(c, _SIZE - 1 if c.isalpha() else 0)
        if c.isdigit():
            known = _SYMBOL["0"]
        options = [(c, known, 0.0 if c.isalpha() else KEEP)] if c.isalnum() else []
        options += [(x, _SYMBOL[x], SUBSTITUTE) for x in LOOKALIKES.get(c, "")]
        for (a, b), (score, said) in beam.items():
            ways = [((b, s), score + cost + log[a][b][s], said + x) for x, s, cost in options]
            if repeats and said.endswith(c) and c.isalpha():
                ways.append(((a, b), score + DROP_REPEAT, said))
            if not c.isalnum():
                ways.append(((a, b), score + (0.0 if gap and not b else drop), said))
            if end is not None and b:
                ways.append(((b, 0), score + end + log[a][b][0], said + " " if gap else said))
            elif end is not None and i > last:
                ways.append(((a, b), score + end, said))
            for state, value, reading in ways:
                if state not in after or (value, reading) > after[state]:
                    after[state] = (value, reading)
        beam = after
    best = max((score + (log[a][b][0] if b else 0.0), said) for (a, b), (score, said) in beam.items())[1]
    if tail is None:
        return best
    if len(model.tails) >= _MEMO:
        model.tails.clear()
    model.tails[tail] = best
    return low[:plain] + best


def apart(stretch: str, model: CharModel) -> str:
    """The best reading of letters set apart; where the first may be a word of its own, also that of the letters behind it."""
    first, tail = _SYMBOL.get(stretch[0].lower(), 0), stretch[1:].lstrip(" .-_*")
    said = decode(stretch, model)
    if first and model.rows[0][first][0] > ALONE and said[1:2] != " ":
        said += " " + decode(tail, model)
    return said


class Restorer(dict):
    """Reads texts with the obfuscated stretches decoded. As a dict it remembers the words of tokens (runs without white space); a token
    without look-alikes, tripled letters or letters set apart has one path and is read as it is."""

    def __init__(self, model: CharModel):
        self.model = model

    def restore(self, stretch: str) -> str:
        stretch = _SPREAD.sub(lambda m: apart(m.group(), self.model), stretch)
        return _MIXED.sub(lambda m: decode(m.group(), self.model), stretch)

    def read(self, token: str) -> list[str]:
        core = token.rstrip(_PLAIN_END)
        return [core] if core.isalpha() and not _TRIPLE.search(core) else _WORDS.findall(self.restore(token))

    def __missing__(self, token: str) -> list[str]:
        if len(self) >= _MEMO:
            self.clear()
        found = self[token] = self.read(token)
        return found

    def tokens(self, text: str | None) -> list[str]:
        """Tokens of a text; letters that white space sets apart are read together first."""
        text = (text or "").lower()
        if _APART.search(text):
            text = _SPREAD.sub(lambda m: apart(m.group(), self.model), text)
        return text.split()

    def words(self, text: str | None) -> list[str]:
        return [w for t in self.tokens(text) for w in self[t]]


def _features(word: str) -> tuple[str, ...]:
    return (word, word[:STEM] + "~") if len(word) > STEM else (word,)


def _evidence(labelled: DataFrame, model: CharModel) -> DataFrame:
    """feature, clean (documents without the label) or before (a word before it in a toxic one, as a hash)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Restorer(model)
        for batch in batches:
            clean, toxic = Counter(), set()
            for text, bad in zip(batch["text"], batch["toxic"], strict=True):
                if bad:
                    words = reader.words(text)
                    toxic.update((f, before) for before, w in zip(["", *words], words, strict=False) for f in _features(w))
                else:
                    clean.update({f for t in set(reader.tokens(text)) for w in reader[t] for f in _features(w)})
            yield pd.DataFrame([(f, None, n) for f, n in clean.items()] + [(f, b, 0) for f, b in toxic], columns=["feature", "before", "clean"])

    return labelled.mapInPandas(run, "feature string, before string, clean long")


_NOTHING: dict[str, float] = {}


class Entries(dict):
    """Remembers the lexicon entries of tokens."""

    def __init__(self, weights: dict[str, float], reader: Restorer):
        self.weights, self.reader = weights, reader

    def __missing__(self, token: str) -> dict[str, float]:
        if len(self) >= _MEMO:
            self.clear()
        found = self[token] = {f: self.weights[f] for w in self.reader.read(token) for f in _features(w) if f in self.weights} or _NOTHING
        return found


@dataclass
class Judge:
    """Lexicon weights and the regression over (sum of weights, largest weight, different hits, hits per square root of words)."""

    model: CharModel
    weights: dict[str, float]
    beta: np.ndarray | None

    def reader(self) -> Entries:
        return Entries(self.weights, Restorer(self.model))

    def hits(self, known: Entries, text: str | None) -> list[float]:
        """The regression's inputs for a text."""
        tokens, seen = known.reader.tokens(text), {}
        found = list(filter(None, map(known.__getitem__, tokens)))
        for entries in found:
            seen |= entries
        return [sum(seen.values()), max(seen.values(), default=0.0), float(len(seen)), len(found) / math.sqrt(len(tokens) + 1)]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.beta is None:
            return np.zeros(len(x))
        return 1 / (1 + np.exp(-np.clip(np.column_stack([np.ones(len(x)), x]) @ self.beta, -30, 30)))


def regress(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 30) -> np.ndarray:
    """Logistic regression with an intercept by Newton steps."""
    a = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ beta, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(hess, a.T @ (y - p) - ridge * beta)
    return beta


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Judge:
    """Learns from the documents that `labels` (id, label) marks, at most FIT_ROWS; the character model reads all of `docs`."""
    model = CharModel.of(count_characters(docs, text_col))
    marks = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("key")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    marks = F.broadcast(hash_sample(marks, FIT_ROWS, "key"))  # at most FIT_ROWS pairs of numbers
    read = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    labelled = staged(read.join(marks, "key").select("text", "toxic"))
    n_toxic, n_clean = labelled.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    if not n_toxic or not n_clean:
        return Judge(model, {}, None)
    evidence = _evidence(labelled, model)
    pairs = evidence.groupBy("feature", "before").agg(F.sum("clean").alias("clean"))  # each word before counts once
    lift = (F.col("toxic") / F.lit(n_toxic)) / ((F.col("clean") + 0.5) / F.lit(n_clean))
    table = (pairs.groupBy("feature").agg(F.count("before").alias("toxic"), F.sum("clean").alias("clean"))
             .where((F.col("toxic") >= MIN_EVIDENCE) & (lift >= MIN_LIFT)).select("feature", F.log(lift).alias("w"), "toxic")
             .orderBy(F.desc(F.col("w") * F.sqrt("toxic")), "feature").limit(LEXICON))
    judge = Judge(model, {r["feature"]: float(r["w"]) for r in table.collect()}, None)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = judge.reader()
        for b in batches:
            yield pd.DataFrame({"x": [judge.hits(known, t) for t in b["text"]], "toxic": b["toxic"]})

    rows = labelled.mapInPandas(measure, "x array<double>, toxic int").collect()
    judge.beta = regress(np.array([r["x"] for r in rows]), np.array([r["toxic"] for r in rows], float))
    return judge


def score(judge: Judge, text_col: str = "text"):
    """Column with the score of a text."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = judge.reader()
        for texts in batches:
            yield pd.Series(judge.score(np.array([judge.hits(known, t) for t in texts]).reshape(len(texts), 4)))

    return run(text_col)


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row (struct of the columns of `docs`), held_out and score; labels of held-out documents are never read."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    judge = fit(docs, labels.where(~held_out).select("doc_id", "toxic"))
    return docs.select(F.struct(*docs.columns).alias("row"), held_out.alias("held_out"), score(judge).alias("score"))


def op6(docs: DataFrame, labels: DataFrame) -> DataFrame:
    out = scored(docs, labels).select("row.doc_id", "held_out", "score")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
