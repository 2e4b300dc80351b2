"""Language identification by a convolutional network over bytes.

A text is cut into windows of WINDOW bytes (with the next few bytes, so that no filter loses a seam). Filters
of widths 2, 3 and 4 slide over the bytes, the largest response of each filter in a window is kept, and a
softmax layer gives the window's languages; a document has the mean of its windows' logits, by their bytes. A
filter over bytes is a sum of table rows, so two bytes are looked up at once in tables of 65,536 rows.

Training is in numpy with Adam, on windows of at most MOST_ROWS labelled texts that are chosen by the hash of
doc_id: of each text WINDOWS_OF_A_TEXT windows that lie evenly over the whole of it. Scoring reads whole texts, in
batches of windows of one length.

Defined results: `und` with score 0 where the text is null or has no letter, or if nothing was learned;
languages that are null and rows without doc_id are not learned; rows may repeat; other columns are ignored or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Carried, map_batches
from ._text import pieces, text_buffers
from ._train import Adam, smallest

MOST_ROWS, WINDOW, WIDTHS, FILTERS, WINDOWS_OF_A_TEXT = 2000, 128, (2, 3, 4), 12, 6
TAIL = max(WIDTHS) - 1


class Model:
    def __init__(self, langs: list[str]):
        self.langs = langs
        rng = np.random.default_rng(5)
        f = FILTERS
        self.params = {f"t{k}{j}": rng.normal(0, 0.3, (256, f)).astype(np.float32) for k in WIDTHS for j in range(k)}
        self.params |= {"w": rng.normal(0, 0.1, (f * len(WIDTHS), len(langs))).astype(np.float32), "b": np.zeros(len(langs), np.float32)}
        self._pairs = None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def forward(self, x: np.ndarray):
        """x: windows of WINDOW + TAIL bytes. The pooled responses and where they were."""
        pooled, where = [], []
        for k in WIDTHS:
            r = sum(self.params[f"t{k}{j}"][x[:, j : j + WINDOW]] for j in range(k))
            where.append(r.argmax(axis=1))
            pooled.append(np.take_along_axis(r, where[-1][:, None], axis=1)[:, 0])
        return np.maximum(np.concatenate(pooled, axis=1), 0), where

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int) -> None:
        adam, rng = Adam(self.params, 0.01), np.random.default_rng(8)
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for lo in range(0, len(y), 64):
                i = order[lo : lo + 64]
                h, where = self.forward(x[i])
                z = h @ self.params["w"] + self.params["b"]
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(i)), y[i]] -= 1
                p /= len(i)
                grads = {"w": h.T @ p, "b": p.sum(axis=0)}
                back = (p @ self.params["w"].T) * (h > 0)
                for n, k in enumerate(WIDTHS):
                    own = back[:, n * FILTERS : (n + 1) * FILTERS]
                    for j in range(k):
                        g = np.zeros((256, FILTERS), dtype=np.float32)
                        byte = np.take_along_axis(x[i].astype(np.int64), where[n] + j, axis=1)
                        np.add.at(g, (byte, np.arange(FILTERS)[None, :]), own)
                        grads[f"t{k}{j}"] = g
                adam.step(grads)

    def pairs(self) -> list[list[np.ndarray]]:
        """For each width, tables by two bytes (and a last one by one byte where the width is odd)."""
        if self._pairs is None:
            self._pairs = []
            for k in WIDTHS:
                own = [(self.params[f"t{k}{j}"][:, None, :] + self.params[f"t{k}{j + 1}"][None, :, :]).reshape(65536, FILTERS) for j in range(0, k - 1, 2)]
                self._pairs.append([*own, *([self.params[f"t{k}{k - 1}"]] if k % 2 else [])])
        return self._pairs

    def window_logits(self, x: np.ndarray) -> np.ndarray:
        two = x[:, :-1].astype(np.int32) << 8
        two |= x[:, 1:]
        pooled = []
        for k, tables in zip(WIDTHS, self.pairs(), strict=True):
            r = np.take(tables[0], two[:, :WINDOW], axis=0)
            for n, t in enumerate(tables[1:], 1):
                r += np.take(t, (two if len(t) > 256 else x)[:, 2 * n : 2 * n + WINDOW], axis=0)
            pooled.append(r.max(axis=1))
        return np.maximum(np.concatenate(pooled, axis=1), 0) @ self.params["w"] + self.params["b"]

    def logits(self, texts: pa.Array) -> np.ndarray:
        """Mean logits of each text; texts must not be empty."""
        x, size, first = cut(texts)
        z = np.concatenate([self.window_logits(x[i : i + 512]) for i in range(0, len(x), 512)]) if len(x) else np.zeros((0, len(self.langs)), np.float32)
        total, weight = np.add.reduceat(z * size[:, None], first, axis=0), np.add.reduceat(size, first)
        return total / weight[:, None]


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows with the bytes behind them, 0 where there are none; bytes in each; first window of each text)."""
    buf, offs = text_buffers(texts)
    size = np.maximum(np.diff(offs), 0)
    n = np.maximum(-(-size // WINDOW), 1)
    first = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), n)
    lo = offs[:-1][of] + (np.arange(len(of)) - first[of]) * WINDOW
    left = offs[1:][of] - lo
    pos = lo[:, None] + np.arange(WINDOW + TAIL)
    x = np.concatenate((buf, np.zeros(1, np.uint8)))[np.minimum(pos, len(buf))]
    x[np.arange(WINDOW + TAIL)[None, :] >= left[:, None]] = 0
    return x, np.clip(left, 1, WINDOW), first


def spread(n: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of at most `most` windows of each text, in the middle of as many equal parts of it."""
    m = np.minimum(n, most)
    of = np.repeat(np.arange(len(n)), m)
    k = np.arange(len(of)) - np.repeat(np.cumsum(m) - m, m)
    return of, (2 * k + 1) * n[of] // (2 * m[of])


def fit_windows(x: np.ndarray, langs: list[str], epochs: int = 12) -> Model | None:
    """x: windows; langs: of each."""
    names = sorted(set(langs))
    if not names:
        return None
    model = Model(names)
    if len(names) > 1:
        at = {v: i for i, v in enumerate(names)}
        model.fit(x, np.array([at[v] for v in langs]), epochs)
    return model


def fit(docs: DataFrame, most: int = MOST_ROWS, text: str = "text", lang: str = "lang") -> Model | None:
    """Learns from at most `most` rows, less those without a letter; the driver gets their chosen windows alone.

    Rows are chosen by doc_id and lang, so only the chosen texts leave the scan."""
    known = docs.filter(F.col(lang).isNotNull() & F.col("doc_id").isNotNull()).select(F.xxhash64("doc_id").alias("h"), F.col(text).alias("t"), F.col(lang).alias("l"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    few = smallest(known, "h", most).filter("letter")

    def choose(batches):
        for batch in batches:
            for part in pieces(batch, "t"):
                x, _, first = cut(part.column("t"))
                of, k = spread(np.diff(np.append(first, len(x))), WINDOWS_OF_A_TEXT)
                yield pa.RecordBatch.from_arrays([part.column("l").take(pa.array(of)), pa.array([w.tobytes() for w in x[first[of] + k]], pa.binary())], names=["l", "x"])

    rows = map_batches(few.select("l", "t"), choose, "l string, x binary").toPandas().sort_values(["l", "x"])
    return fit_windows(np.frombuffer(b"".join(rows["x"]), dtype=np.uint8).reshape(len(rows), WINDOW + TAIL), rows["l"].tolist())


def predict(docs: DataFrame, model: Model | None, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, lang_pred and score."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_scan", 1 << 18):
                letter = part.column("_letter").to_numpy(zero_copy_only=False)
                name, p = np.full(part.num_rows, "und", dtype=object), np.zeros(part.num_rows)
                if model is not None and letter.any():
                    z = model.logits(part.column("_scan").filter(pa.array(letter))).astype(np.float64)
                    e = np.exp(z - z.max(axis=1, keepdims=True))
                    e /= e.sum(axis=1, keepdims=True)
                    name[letter], p[letter] = np.array(model.langs, dtype=object)[e.argmax(axis=1)], e.max(axis=1)
                yield [*part.columns[:-2], pa.array(name, pa.string()), pa.array(p)]

    return Carried(docs, keep, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter"), F.col(text).alias("_scan")).run(run, "lang_pred string, score double")
