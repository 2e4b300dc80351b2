"""What the classifiers share: bounded samples, Adam, calibration, and hashed word features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._text import U64, Words, mix


def smallest(rows: DataFrame, key: str, most: int) -> DataFrame:
    """The `most` rows whose 64-bit `key` is smallest. Rows are counted first, and keys past a few times the expected rank are left
    where they are, so what tasks hand on for the last sort doesn't grow with the number of tasks."""
    n, times = rows.count(), 2
    while times * most < n:
        near = rows.filter(F.col(key) < int(times * most / n * 2.0**64) - (1 << 63))
        if near.count() >= most:
            rows = near
            break
        times *= 8  # ids that repeat may lie anywhere
    return rows.orderBy(*[key, *(c for c in rows.columns if c != key)]).limit(most)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text (whole) and y of at most `most` labelled rows, drawn by the hash of their ids. Rows without id or label aren't drawn.

    Of documents with one id, the smallest text counts."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).alias("y"), F.xxhash64("doc_id").alias("h"))
    few = smallest(known, "h", most).select("doc_id", "y")
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return texts.join(F.broadcast(few), "doc_id")


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> tuple[list[str], np.ndarray]:
    """The whole texts and labels of such rows, on the driver."""
    rows = labelled(docs, labels, label, most).toPandas().sort_values(["doc_id", "text", "y"])
    return rows["text"].tolist(), rows["y"].to_numpy()


def column(texts: list[str]) -> pa.Array:
    return pa.array(texts, pa.string())


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.001 * (g * g - self.v[k])
            self.params[k] -= (rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-8)).astype(self.params[k].dtype)


def sigmoid(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def calibrate(logits: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(temperature, bias) that make sigmoid(logit / temperature + bias) likeliest on held-out labels; the bias is shrunk to 0."""
    a, b = 1.0, 0.0
    for _ in range(300):
        p = sigmoid(a * logits + b)
        a = float(np.clip(a - 0.5 * (np.mean((p - y) * logits) / max(1e-6, np.mean(logits**2)) * 4), 0.05, 20))
        b = float(b - 0.5 * (np.mean(p - y) + 0.02 * b))
    return 1 / a, b


def unique_words(w: Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct words, an occurrence of each, and for each word which of them it is)."""
    return np.unique(h, return_index=True, return_inverse=True)


def byte_grams(w: Words, which: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index into which) of all n-byte sequences of the chosen words, begun and ended by a mark each."""
    length = w.length[which]
    size = length + 2
    at = np.cumsum(size) - size
    codes = np.zeros(int(size.sum()) + n, dtype=np.uint64)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    codes[np.repeat(at + 1, length) + inner] = w.buf[np.repeat(w.start[which], length) + inner].astype(np.uint64) + U64(1)
    m = np.maximum(size - n + 1, 0)
    pos = np.repeat(at, m) + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    key = np.full(len(pos), U64(seed), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            key = key * U64(257) + codes[pos + j]
    return mix(key), np.repeat(np.arange(len(which)), m)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows first[i]:first[i + 1]; empty ones are 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), dtype=values.dtype)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        out[some] = np.add.reduceat(values, first[some], axis=0)
    return out
