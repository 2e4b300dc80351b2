"""A quality classifier: random-indexing word vectors, pooled for each document, and a two-layer network.

Every context has a sparse ternary index vector, made from its hash. A word's vector is the sum of the index
vectors of the contexts it was met in: the words up to two places beside it anywhere in the documents, and its own
beginnings, ends and shape. The sums are gathered from all documents in Spark (a word that a task met once is
handed on as its contexts, others as their sums), scaled to length 1 and kept as sorted hash arrays in the shared
folder, which workers map. A document is the mean of its words' vectors, the mean likeness of neighbours and how much
the mean is kept by one direction (repeated words). The network (tanh, logistic) is trained in numpy with Adam, and
its logits are divided by a temperature that is fitted on rows the training didn't see.

The network is fitted on at most MOST_ROWS labelled rows, chosen by the hash of doc_id, of which the driver gets the
pooled vectors; fitting and scoring read whole texts.

Defined results: null and empty texts have the score of a document without words; without any label the score
is 0.5; rows may repeat; rows without doc_id are scored and not learned from; other columns are ignored or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Carried, array_folder, map_batches, map_groups, n_buckets, save_array
from ._store import Sorted, bucket_of
from ._text import NOT_SPACE, U64, combine, mix, pieces, words
from ._train import Adam, calibrate, labelled, sigmoid, sums, unique_words

MOST_ROWS, DIM, HIDDEN, INDEX_ROWS, NONZERO, BESIDE = 3000, 40, 24, 4096, 6, 2
#: Words that a task gathers before it hands them on.
HELD = 2_000_000


def _index_vectors() -> np.ndarray:
    rng = np.random.default_rng(11)
    out = np.zeros((INDEX_ROWS, DIM), dtype=np.float32)
    for r in out:
        at = rng.choice(DIM, NONZERO, replace=False)
        r[at] = rng.choice([-1.0, 1.0], NONZERO)
    return out


TERNARY = _index_vectors()
INDEX = TERNARY / np.float32(np.sqrt(NONZERO))
#: As a context, no word; its vector is 0.
NO_WORD = INDEX_ROWS
_WITH_NONE = np.concatenate((TERNARY, np.zeros((1, DIM), np.float32))).astype(np.int32)


def _kinds() -> np.ndarray:
    """Bytes as lower-case letter, upper-case letter, digit, mark, or part of a longer character."""
    out = np.full(256, 3, dtype=np.int64)
    out[97:123], out[65:91], out[48:58], out[128:] = 0, 1, 2, 4
    return out


KIND = _kinds()


def own_contexts(w, which: np.ndarray) -> list[np.ndarray]:
    """Hashed contexts that a word has by itself: its first and last bytes, the kinds of its ends, its length."""
    s, n = w.start[which], w.length[which]
    end = s + n - 1
    b = w.buf
    last = lambda k: b[np.maximum(end - k, s)].astype(np.uint64)
    first = lambda k: b[np.minimum(s + k, end)].astype(np.uint64)
    shape = [KIND[b[s]], KIND[b[np.minimum(s + 1, end)]], KIND[b[np.maximum(end - 1, s)]], KIND[b[end]], np.minimum(n, 12)]
    return [
        combine([first(0), first(1)], seed=1),
        combine([last(0), last(1)], seed=2),
        combine([last(0), last(1), last(2)], seed=3),
        combine([x.astype(np.uint64) for x in shape], seed=4),
        combine([x.astype(np.uint64) for x in shape[:4]], seed=5),
    ]


def contexts(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each word the index rows of the words beside it in its document."""
    own = (mix(h) % U64(INDEX_ROWS)).astype(np.uint16)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    out = np.full((len(h), 2 * BESIDE), NO_WORD, dtype=np.uint16)
    for d in range(1, min(BESIDE, len(h) - 1) + 1):
        same = owner[d:] == owner[:-d]
        out[:-d, 2 * d - 2][same] = own[d:][same]
        out[d:, 2 * d - 1][same] = own[:-d][same]
    return out


def add_rows(total: np.ndarray, row: np.ndarray, values, step: int = 1 << 15) -> None:
    """Adds values(which) to these rows of total, so many at a time."""
    order = np.argsort(row, kind="stable")
    for lo in range(0, len(order), step):
        own = order[lo : lo + step]
        r = row[own]
        cut = np.flatnonzero(np.diff(r, prepend=-1))
        total[r[cut]] += np.add.reduceat(values(own), cut, axis=0)


def _blob(names: np.ndarray, body: np.ndarray) -> bytes:
    """names and the rows of body, whose numbers are packed by columns and bytes, small ones of either sign first: most sums are small."""
    if body.dtype == np.int32:
        body = ((body << 1) ^ (body >> 31)).view(np.uint32)
    data = names.tobytes() + np.ascontiguousarray(np.ascontiguousarray(body.T).view(np.uint8).reshape(-1, body.dtype.itemsize).T).tobytes()
    return np.array([len(names)], "<u4").tobytes() + pa.compress(data, codec="zstd", asbytes=True)


def _unblob(blob: bytes, kind, width: int) -> tuple[np.ndarray, np.ndarray]:
    n, item = int(np.frombuffer(blob, "<u4", 1)[0]), np.dtype(kind).itemsize
    data = pa.decompress(blob[4:], n * (8 + width * item), codec="zstd", asbytes=True)
    body = np.ascontiguousarray(np.frombuffer(data, np.uint8, n * width * item, 8 * n).reshape(item, -1).T)
    if kind is np.int32:
        body = body.view(np.uint32)[:, 0] if n else np.empty(0, np.uint32)
        body = (body >> 1).astype(np.int32) ^ -(body & 1).astype(np.int32)
    else:
        body = body.view(kind)[:, 0] if n else np.empty(0, kind)
    return np.frombuffer(data, np.uint64, n), body.reshape(width, n).T


def word_vectors(docs: DataFrame, text: str = "text") -> Sorted:
    """Sorted hashes of all words of docs, with their vectors (`vec`, 127 for length 1)."""
    spark = docs.sparkSession
    n, folder = n_buckets(spark, 2), array_folder(spark, "word-vectors")

    def gather(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            h, c = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(h, kind="stable")
            h = h[order]
            c = c[order]
            del order
            cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(h)), bool), h[1:] != h[:-1])))
            times, bucket = np.diff(np.append(cut, len(h))), bucket_of(h[cut], n)
            cuts = np.searchsorted(bucket, np.arange(n + 1))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                at, k = cut[cuts[b] : cuts[b + 1]], times[cuts[b] : cuts[b + 1]]
                lo, hi = int(at[0]), int(at[-1] + k[-1])
                total = np.zeros((len(at), DIM), dtype=np.int32)
                for j in range(2 * BESIDE):
                    total += np.add.reduceat(_WITH_NONE[c[lo:hi, j]], at - lo, axis=0)
                once = k == 1
                yield b, _blob(h[at[once]], c[at[once]]), _blob(h[at[~once]], total[~once])

        def rows():
            out = list(flush())
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[i] for x in out], pa.binary()) for i in (1, 2))], names=["_b", "once", "more"])

        for batch in batches:
            for part in pieces(batch):
                w = words(part.column("text"), NOT_SPACE)
                h = w.hashes(0)
                held.append((h, contexts(h, w.first)))
                size += len(h)
                if size > HELD:
                    yield rows()
                    size = 0
        if size:
            yield rows()

    def merge(group: pa.Table) -> pa.Table:
        b = group.column("_b")[0].as_py()
        once = [_unblob(x.as_py(), np.uint16, 2 * BESIDE) for x in group.column("once")]
        more = [_unblob(x.as_py(), np.int32, DIM) for x in group.column("more")]
        names, row = np.unique(np.concatenate([k for k, _ in once + more]), return_inverse=True)
        total, at = np.zeros((len(names), DIM), dtype=np.int32), 0
        for k, c in once:
            add_rows(total, row[at : at + len(k)], lambda i, c=c: sum(_WITH_NONE[c[i, j]] for j in range(2 * BESIDE)))
            at += len(k)
        for k, t in more:
            add_rows(total, row[at : at + len(k)], lambda i, t=t: t[i])
            at += len(k)
        size = np.sqrt((total.astype(np.float32) ** 2).sum(axis=1, keepdims=True))
        save_array(f"{folder}/{b}.key.npy", names)
        save_array(f"{folder}/{b}.vec.npy", np.rint(total * (127 / np.maximum(size, 1))).astype(np.int8))
        return pa.table({"b": pa.array([b], pa.int32()), "n": pa.array([len(names)], pa.int64())})

    rows = map_batches(docs.select(F.col(text).alias("text")), gather, "_b int, once binary, more binary")
    sizes = np.zeros(n, dtype=np.int64)
    for r in map_groups(rows, "_b", merge, "b int, n long").collect():  # one row for each bucket
        sizes[r["b"]] = r["n"]
    return Sorted(folder, sizes, {})


class Model:
    def __init__(self, store: Sorted | None = None):
        self.store = store
        self.mean, self.scale, self.params, self.temperature, self.bias = None, None, None, 1.0, 0.0

    def word_vectors(self, w, names: np.ndarray, which: np.ndarray) -> np.ndarray:
        v = np.zeros((len(which), DIM), dtype=np.float32)
        for c in own_contexts(w, which):
            v += INDEX[(c % U64(INDEX_ROWS)).astype(np.int64)]
        if self.store is not None:
            found, bucket, place = self.store.places(names)
            for b in np.unique(bucket[found]).tolist():
                own = np.flatnonzero(found & (bucket == b))
                v[own] += self.store.part(b, "vec")[place[own]].astype(np.float32) / 127
        return v

    def features(self, texts: pa.Array) -> np.ndarray:
        w = words(texts, NOT_SPACE)
        n = np.diff(w.first).astype(np.float32)
        names, which, back = unique_words(w, w.hashes(0))
        v = self.word_vectors(w, names, which)
        norm = (v**2).sum(axis=1)
        tokens = v[back]
        mean = sums(tokens, w.first) / np.maximum(n, 1)[:, None]
        alike = np.zeros(len(w) + 1, dtype=np.float32)
        if len(w) > 1:
            alike[1:-1] = (tokens[1:] * tokens[:-1]).sum(axis=1)
        inner = w.first[:-1][n > 0]
        alike[inner] = 0
        some = np.maximum(n, 1)
        square = sums(norm[back], w.first) / some
        near = sums(alike[:-1], w.first) / some
        one = (mean**2).sum(axis=1)
        rest = np.stack((square, near, one, one / np.maximum(square, 1e-6), np.log1p(n), n == 0), axis=1)
        return np.concatenate((mean, rest.astype(np.float32)), axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.params
        return (np.tanh(((x - self.mean) / self.scale) @ p["a"] + p["b"]) @ p["c"] + p["d"])[:, 0]

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.params is None:
            return np.full(len(texts), 0.5)
        return sigmoid(self.logits(self.features(texts)).astype(np.float64) / self.temperature + self.bias)


def fit_network(model: Model, x: np.ndarray, y: np.ndarray, epochs: int = 40) -> Model:
    """x: a row of features for each label."""
    y = y.astype(np.float32)
    if not len(y):
        return model
    model.mean, model.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    rng = np.random.default_rng(3)
    order = rng.permutation(len(y))
    aside, fit_on = np.split(order, [len(y) // 5])
    p = {"a": rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), "b": np.zeros(HIDDEN), "c": rng.normal(0, 1 / np.sqrt(HIDDEN), (HIDDEN, 1)), "d": np.zeros(1)}
    model.params = {k: v.astype(np.float32) for k, v in p.items()}
    adam = Adam(model.params, 0.005)
    p = model.params
    z = (x - model.mean) / model.scale
    for _ in range(epochs):
        for lo in range(0, len(fit_on), 64):
            i = fit_on[lo : lo + 64]
            h = np.tanh(z[i] @ p["a"] + p["b"])
            g = (sigmoid((h @ p["c"] + p["d"])[:, 0]) - y[i])[:, None] / len(i)
            back = (g @ p["c"].T) * (1 - h**2)
            adam.step({"a": z[i].T @ back + 1e-4 * p["a"], "b": back.sum(axis=0), "c": h.T @ g + 1e-4 * p["c"], "d": g.sum(axis=0)})
        fit_on = rng.permutation(fit_on)
    if len(aside) > 20:
        model.temperature, model.bias = calibrate(model.logits(x[aside]).astype(np.float64), y[aside])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MOST_ROWS) -> Model:
    """Word vectors of all docs; the network from at most `most` labelled ones."""
    model = Model(word_vectors(docs))
    few = labelled(docs, labels, label, most)

    def pooled(batches):
        for batch in batches:
            for part in pieces(batch, "text", 1 << 19):
                x = model.features(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("y"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "y", "x"])

    kinds = dict(few.dtypes)
    rows = map_batches(few.select("doc_id", "y", "text"), pooled, f"doc_id {kinds['doc_id']}, y {kinds['y']}, x binary").toPandas().sort_values(["doc_id", "x", "y"])
    x = np.frombuffer(b"".join(rows["x"]), dtype=np.float32).reshape(len(rows), -1) if len(rows) else np.zeros((0, 1), np.float32)
    return fit_network(model, x, rows["y"].to_numpy())


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and score."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_scan", 1 << 19):
                yield [*part.columns[:-1], pa.array(model.scores(part.column("_scan")), pa.float64())]

    return Carried(docs, keep, F.col(text).alias("_scan")).run(run, "score double")
