"""Language of whole texts by a bidirectional gated recurrent network over bytes.

A text is cut into windows of bytes; over each the network runs forwards and backwards and labels every position, and a document's
probabilities are the mean of all its positions' ones. Training is back-propagation through time in numpy, on a bounded sample of
labelled rows; prediction runs on Spark with many windows side by side.

Null text, or text without letters, is `und` with score 0. Null ids and repeated rows give a row each. An empty table gives no
rows, and without any labelled row every text is `und`. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a window; states start anew in each.
WINDOW = 128
HIDDEN = 8
#: Labelled documents of each language to train on, at most, and windows taken from each.
SAMPLE_DOCS = 600
SAMPLE_WINDOWS = 4
STEPS = 500
BATCH = 96
UNKNOWN = "und"
#: Windows that run side by side.
_LANES = 4_096
_NAMES = ("E", "U", "C")


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


@dataclass
class Network:
    """p: by direction the byte table E (bytes x 3H: update, reset, candidate), recurrences U (H x 2H) and C (H x H); V, b: labels."""

    labels: list[str]
    p: list[dict[str, np.ndarray]]
    v: np.ndarray
    b: np.ndarray

    @staticmethod
    def fresh(labels: list[str], hidden: int, seed: int) -> Network:
        draw = np.random.default_rng(seed)
        new = lambda *shape: (draw.normal(size=shape) * 0.3).astype(np.float32)
        return Network(labels, [{"E": new(257, 3 * hidden), "U": new(hidden, 2 * hidden), "C": new(hidden, hidden)} for _ in range(2)],
                       new(2 * hidden, len(labels)), np.zeros(len(labels), np.float32))

    def states(self, x: np.ndarray, way: int, keep: bool = False) -> tuple[np.ndarray, list]:
        """Hidden states at each step (T, lanes, H) of windows x (T, lanes); byte 256 is padding and leaves the state as it is."""
        p, h_size = self.p[way], self.p[way]["C"].shape[0]
        steps = range(len(x)) if way == 0 else range(len(x) - 1, -1, -1)
        out, h, tape = np.empty((*x.shape, h_size), np.float32), np.zeros((x.shape[1], h_size), np.float32), []
        for t in steps:
            e = p["E"][x[t]]
            g = _sigmoid(e[:, :2 * h_size] + h @ p["U"])
            z, r = g[:, :h_size] * (x[t] < 256)[:, None], g[:, h_size:]
            c = np.tanh(e[:, 2 * h_size:] + (r * h) @ p["C"])
            if keep:
                tape.append((t, h, g[:, :h_size], r, c))
            h = h + z * (c - h)
            out[t] = h
        return out, tape

    def label(self, both: np.ndarray) -> np.ndarray:
        y = both @ self.v + self.b
        y = np.exp(y - y.max(axis=-1, keepdims=True))
        return y / y.sum(axis=-1, keepdims=True)

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Per lane, the sum over positions of the label probabilities."""
        ahead, back = self.states(x, 0)[0], self.states(x, 1)[0]
        total = np.zeros((x.shape[1], len(self.labels)), np.float64)
        for lo in range(0, len(x), 16):
            prob = self.label(np.concatenate([ahead[lo:lo + 16], back[lo:lo + 16]], axis=-1))
            total += (prob * (x[lo:lo + 16] < 256)[..., None]).sum(axis=0)
        return total

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray], list[np.ndarray]]:
        """Mean cross-entropy over positions, the parameters and their gradients by back-propagation through time."""
        runs = [self.states(x, way, True) for way in range(2)]
        both, mask = np.concatenate([r[0] for r in runs], axis=-1), (x < 256)
        prob, n = self.label(both), max(int(mask.sum()), 1)
        lanes = np.arange(x.shape[1])
        loss = float(-(np.log(prob[:, lanes, y] + 1e-9) * mask).sum() / n)
        d = prob.copy()
        d[:, lanes, y] -= 1
        d *= (mask / n)[..., None].astype(np.float32)
        params, grads = [self.v, self.b], [np.einsum("tlh,tlk->hk", both, d), d.sum(axis=(0, 1))]
        d_both = d @ self.v.T
        for way, (_, tape) in enumerate(runs):
            p = self.p[way]
            size = p["C"].shape[0]
            g = {k: np.zeros_like(v) for k, v in p.items()}
            dh = np.zeros((x.shape[1], size), np.float32)
            for t, h, z, r, c in reversed(tape):
                dh = dh + d_both[t, :, way * size:(way + 1) * size]
                on = mask[t][:, None]
                dz, dc = dh * (c - h) * on * z * (1 - z), dh * z * on * (1 - c * c)
                drh = dc @ p["C"].T
                dr = drh * h * r * (1 - r)
                gates = np.concatenate([dz, dr], axis=1)
                np.add.at(g["E"], x[t], np.concatenate([gates, dc], axis=1))
                g["U"] += h.T @ gates
                g["C"] += (r * h).T @ dc
                dh = dh * (1 - z * on) + drh * r + gates @ p["U"].T
            for k in _NAMES:
                params.append(p[k])
                grads.append(g[k])
        return loss, params, grads


def train(windows: np.ndarray, labels: np.ndarray, names: list[str], hidden: int = HIDDEN, steps: int = STEPS, batch: int = BATCH, rate: float = 0.02,
          seed: int = 5) -> Network:
    """Adam on batches that hold every label equally often. windows: (n, WINDOW) of uint16."""
    net, draw = Network.fresh(names, hidden, seed), np.random.default_rng(seed)
    by_label = [np.flatnonzero(labels == k) for k in range(len(names))]
    first: list[np.ndarray] = []
    second: list[np.ndarray] = []
    for step in range(1, steps + 1):
        y = draw.integers(len(names), size=batch)
        rows = np.array([draw.choice(by_label[k]) for k in y])
        _, params, grads = net.gradients(windows[rows].T.copy(), y)
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        if not first:
            first, second = [np.zeros_like(g) for g in grads], [np.zeros_like(g) for g in grads]
        now = rate * (1 - step / (steps + 1))
        for p, g, a, b in zip(params, grads, first, second, strict=True):
            g = g * min(1.0, 1.0 / (size + 1e-9))
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= (now * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def windows_of(data: bytes, size: int = WINDOW) -> np.ndarray:
    """(n, size) windows that cover all bytes; the last is padded with 256."""
    n = -(-len(data) // size)
    out = np.full(n * size, 256, np.uint16)
    out[:len(data)] = np.frombuffer(data, np.uint8)
    return out.reshape(n, size)


def _utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fit(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Trains on about `sample_docs` texts of each label, those of smallest id hash; windows are taken from all over a text."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(label_col).alias("label"), F.xxhash64(id_col).alias("h"))
    rows = rows.where("text is not null and label is not null and length(text) > 0")
    # hashes alone find the bound of each label, and windows are cut before anything is collected
    nth = F.row_number().over(Window.partitionBy("label").orderBy("h"))
    last = rows.select("label", "h").withColumn("nth", nth).where(F.col("nth") <= sample_docs).groupBy("label").agg(F.max("h").alias("h")).collect()
    if not last:
        return None
    cut = F.pandas_udf(lambda texts: texts.map(_cuts), "array<binary>")
    taken = reduce(lambda a, b: a | b, [(F.col("label") == r["label"]) & (F.col("h") <= r["h"]) for r in last])
    sample = rows.where(taken).limit(2 * sample_docs * len(last)).select("label", cut("text").alias("cuts"))
    got = sorted((r["label"], bytes(c)) for r in sample.collect() for c in r["cuts"])
    names = sorted({label for label, _ in got})
    return train(np.concatenate([windows_of(c) for _, c in got]), np.array([names.index(label) for label, _ in got]), names)


def _cuts(text: str) -> list[bytes]:
    data = _utf8(text)
    last = max(len(data) - WINDOW, 0)
    return [data[a:a + WINDOW] for a in sorted({last * k // max(SAMPLE_WINDOWS - 1, 1) for k in range(SAMPLE_WINDOWS)})]


def predict(net: Network | None, text: Column) -> Column:
    """Struct of `lang_pred` and `score` (mean probability of that label over all positions)."""

    @F.pandas_udf("lang_pred string, score double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            total, count = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts))
            held, owner, n = [], [], 0

            def flush():
                nonlocal held, owner, n
                if n:
                    x, who = np.concatenate(held), np.concatenate(owner)
                    for lo in range(0, n, _LANES):
                        np.add.at(total, who[lo:lo + _LANES], net.pooled(np.ascontiguousarray(x[lo:lo + _LANES].T)))
                    np.add.at(count, who, (x < 256).sum(axis=1))
                held, owner, n = [], [], 0

            for k, text in enumerate(texts):
                data = _utf8(text)
                for lo in range(0, len(data), WINDOW * _LANES):
                    rows = windows_of(data[lo:lo + WINDOW * _LANES])
                    held.append(rows)
                    owner.append(np.full(len(rows), k))
                    n += len(rows)
                    if n >= _LANES:
                        flush()
            flush()
            prob = total / np.maximum(count, 1)[:, None]
            best = prob.argmax(axis=1)
            yield pd.DataFrame({"lang_pred": np.array(net.labels, object)[best], "score": np.clip(prob[np.arange(len(prob)), best], 0, 1)})

    none = F.struct(F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    if net is None:
        return none
    return F.when(F.coalesce(text.rlike("\\p{L}"), F.lit(False)), run(text)).otherwise(none)


def op5(docs: DataFrame) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    net = fit(docs.where(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), predict(net, F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
