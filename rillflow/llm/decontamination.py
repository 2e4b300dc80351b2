"""Benchmark decontamination as a prefix-filtered set join.

An item window (13 words, or a whole shorter item) is a set of word shingles; it occurs in a document only if
all of them do, so one shingle is a necessary prefix. Shingles are ordered by rarity, counted over all
documents, and each window is represented by its rarest; a shingle that no document has rules its windows out. A
document shingle that meets a window's rarest one must leave room for the window before and behind it (positional and
length bounds), and then the window's words are compared in full, over 128-bit word hashes.

The benchmark's shingles and windows lie in sorted arrays in the shared folder, in ranges of shingle hashes, which
workers map into memory: nothing is broadcast, and a piece of text opens only the ranges that its shingles fall in.
Windows that are equal word by word are one, with the list of their items. The documents are read twice (to count, to
match) and never shuffled; counting tasks hold the benchmark shingles that they have met, a bounded number at a time.

Defined results: null and empty texts have no words; a null item_id is the empty string; items that repeat
count once by item_id; other columns are ignored or carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Carried, array_folder, map_batches, map_groups, save_array
from ._store import Open, bucket_col, bucket_of, write_sorted
from ._text import ALNUM, combine, pieces, signed, words

SHINGLE = 3
#: Windows of one range of shingle hashes, about; benchmark shingles that a task counts at once.
RANGE_WINDOWS, HELD = 200_000, 2_000_000


def shingle_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word sequences inside a document, and where each begins."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(owner[: len(h) - n + 1] == owner[n - 1 :])
    return combine([h[at + k] for k in range(n)], seed=n), at


def windows_of(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, first word, words) of each window."""
    n = np.diff(first)
    m = np.where(n == 0, 0, np.maximum(n - size + 1, 1))
    item = np.repeat(np.arange(len(n)), m)
    start = first[:-1][item] + np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
    return item, start, np.minimum(n[item], size)


class Ranges:
    """The windows by ranges of their rarest shingle, on a worker."""

    def __init__(self, folder: str, sizes: np.ndarray):
        self.folder, self.sizes, self.open = folder, sizes, Open()

    def get(self, b: int, name: str) -> np.ndarray:
        return self.open.get(f"{self.folder}/{b}.{name}.npy")

    def names(self, b: int, window: np.ndarray) -> list[list[str]]:
        """The items of each window."""
        first, item, at, data = (self.get(b, x) for x in ("item_first", "item", "name_at", "name"))
        return [[data[at[i] : at[i + 1]].tobytes().decode() for i in item[first[w] : first[w + 1]].tolist()] for w in window.tolist()]


class Index:
    """The benchmark's windows. size: words in a window."""

    def __init__(self, benchmark: DataFrame, size: int, item_id: str = "item_id", text: str = "text"):
        self.size = size
        self.items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), F.col(text).alias("text"))

        def shingles(batches):
            for batch in batches:
                for part in pieces(batch):
                    w = words(part.column("text"), ALNUM, lower=True)
                    h, n = w.hashes(0), np.diff(w.first)
                    for k in range(1, SHINGLE + 1):
                        g, at = shingle_hashes(h, w.first, k)
                        if k < SHINGLE:  # only items that short are represented by shorter shingles
                            g = g[n[np.searchsorted(w.first, at, side="right") - 1] == k]
                        g = np.unique(g)
                        yield pa.RecordBatch.from_arrays([pa.array(signed(g)), pa.array(np.full(len(g), k, np.int64))], names=["h", "k"])

        found = map_batches(self.items.select("text"), shingles, "h long, k long").distinct()
        self.sizes = sorted(r["k"] for r in found.select("k").distinct().collect())  # three at most
        self.keys = write_sorted(found.select("h"), "benchmark-shingles")

    def rarity(self, docs: DataFrame, text: str) -> None:
        """Counts the benchmark's shingles in all documents and keeps the windows by their rarest one."""
        keys, sizes, size, spark = self.keys, self.sizes, self.size, docs.sparkSession

        def count(batches):
            held, total = [], 0

            def flush():
                h, n = np.unique(np.concatenate(held), return_counts=True)
                return pa.RecordBatch.from_arrays([pa.array(signed(h)), pa.array(n, pa.int64())], names=["h", "n"])

            for batch in batches:
                for part in pieces(batch):
                    w = words(part.column("text"), ALNUM, lower=True)
                    h = w.hashes(0)
                    for k in sizes:
                        g, _ = shingle_hashes(h, w.first, k)
                        g = g[keys.lookup(g)[0]]
                        held.append(g)
                        total += len(g)
                    if total > HELD:
                        yield flush()
                        held, total = [], 0
            if total:
                yield flush()

        often = write_sorted(map_batches(docs.select(F.col(text).alias("text")), count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")), "shingle-counts")

        def choose(batches):
            for batch in batches:
                for part in pieces(batch):
                    w = words(part.column("text"), ALNUM, lower=True)
                    h0, h1 = w.hashes(0), w.hashes(1)
                    item, start, length = windows_of(w.first, size)
                    best, which, offset = np.full(len(start), np.iinfo(np.int64).max), np.zeros(len(start), np.uint64), np.zeros(len(start), np.int64)
                    for k in sizes:
                        g, at = shingle_hashes(h0, w.first, k)
                        hit, got = often.lookup(g)
                        n, own = np.zeros(len(h0) + 1, np.int64), np.zeros(len(h0) + 1, np.uint64)
                        n[at[hit]], own[at] = got["n"], g
                        for off in range(max(1, size - k + 1)):
                            ok = np.flatnonzero((length == k) & (off == 0) if k < SHINGLE else off + k <= length)
                            c = n[start[ok] + off]
                            less = c < best[ok]
                            x = ok[less]
                            best[x], which[x], offset[x] = c[less], own[start[x] + off], off
                    live = np.flatnonzero(best > 0)
                    blobs = [h0[s : s + n].tobytes() + h1[s : s + n].tobytes() for s, n in zip(start[live].tolist(), length[live].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(signed(which[live])), pa.array(offset[live]), pa.array(length[live]), pa.array(blobs, pa.binary()), part.column("item").take(pa.array(item[live]))], names=["prefix", "off", "n", "words", "item"])

        rows = map_batches(self.items, choose, "prefix long, off long, n long, words binary, item string")
        n_ranges = max(1, -(-self.keys.size // RANGE_WINDOWS))
        folder = array_folder(spark, "benchmark")

        def build(group: pa.Table) -> pa.Table:
            b = group.column("_b")[0].as_py()
            prefix, off, n = (group.column(c).to_numpy() for c in ("prefix", "off", "n"))
            blobs, items = group.column("words").to_pylist(), group.column("item").to_pylist()
            names = sorted(set(items))
            number = {x: i for i, x in enumerate(names)}
            of: dict[tuple, set] = {}
            row: dict[tuple, int] = {}
            for i, key in enumerate(zip(prefix.view(np.uint64).tolist(), blobs, strict=True)):
                of.setdefault(key, set()).add(number[items[i]])
                row.setdefault(key, i)
            keys_ = sorted(of)
            at = np.array([row[k] for k in keys_], dtype=np.int64)
            length = n[at]
            h = [np.frombuffer(k[1], dtype=np.uint64) for k in keys_]
            data = [x.encode() for x in names]
            for name, a in (
                ("prefix", prefix.view(np.uint64)[at]), ("off", off[at]), ("n", length), ("start", np.cumsum(length) - length),
                ("h0", np.concatenate([x[: len(x) // 2] for x in h])), ("h1", np.concatenate([x[len(x) // 2 :] for x in h])),
                ("item_first", np.cumsum([0, *(len(of[k]) for k in keys_)])), ("item", np.array([i for k in keys_ for i in sorted(of[k])], dtype=np.int64)),
                ("name_at", np.cumsum([0, *map(len, data)])), ("name", np.frombuffer(b"".join(data), dtype=np.uint8)),
            ):
                save_array(f"{folder}/{b}.{name}.npy", a)
            return pa.table({"b": pa.array([b], pa.int32()), "n": pa.array([len(keys_)], pa.int64())})

        found = np.zeros(n_ranges, dtype=np.int64)
        for r in map_groups(rows.withColumn("_b", bucket_col(F.col("prefix"), n_ranges)), "_b", build, "b int, n long").collect():  # one row for each range
            found[r["b"]] = r["n"]
        self.ranges = Ranges(folder, found)

    def scan(self, docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
        """The kept columns, then n_words, n_hit, items (sorted item_ids that occur), spans (start and end word of each hit run) and contaminated (at least a twentieth of the words is hit)."""
        ranges, sizes, size = self.ranges, self.sizes, self.size
        n_ranges = len(ranges.sizes)

        def match(b: int, g: np.ndarray, at: np.ndarray, first: np.ndarray, h0: np.ndarray, h1: np.ndarray):
            """(document, first word, words, window) of each occurrence of the range's windows."""
            prefix = ranges.get(b, "prefix")
            lo, hi = np.searchsorted(prefix, g), np.searchsorted(prefix, g, side="right")
            hit = np.flatnonzero(hi > lo)
            n = (hi - lo)[hit]
            win = np.repeat(lo[hit], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            offset, start, length, g0, g1 = (ranges.get(b, x) for x in ("off", "start", "n", "h0", "h1"))
            begin = np.repeat(at[hit], n) - offset[win]
            doc = np.searchsorted(first, np.repeat(at[hit], n), side="right") - 1
            fits = (begin >= first[doc]) & (begin + length[win] <= first[doc + 1])
            begin, win, doc = begin[fits], win[fits], doc[fits]
            same = np.ones(len(win), dtype=bool)
            for j in range(size):
                t = np.flatnonzero(same & (j < length[win]))
                p, q = begin[t] + j, start[win[t]] + j
                same[t] = (h0[p] == g0[q]) & (h1[p] == g1[q])
            return doc[same], begin[same], length[win[same]], win[same]

        def run(batches):
            for batch in batches:
                for part in pieces(batch, "_scan"):
                    w = words(part.column("_scan"), ALNUM, lower=True)
                    h0, h1 = w.hashes(0), None
                    mark = np.zeros(len(w) + 1, dtype=np.int32)
                    found: dict[int, set] = {}
                    for k in sizes:
                        g, at = shingle_hashes(h0, w.first, k)
                        own = bucket_of(g, n_ranges)
                        for b in np.flatnonzero((np.bincount(own, minlength=n_ranges) > 0) & (ranges.sizes > 0)).tolist():
                            rows = slice(None) if n_ranges == 1 else np.flatnonzero(own == b)
                            h1 = w.hashes(1) if h1 is None else h1
                            doc, begin, n, win = match(b, g[rows], at[rows], w.first, h0, h1)
                            np.add.at(mark, begin, 1)
                            np.add.at(mark, begin + n, -1)
                            pair = np.unique(np.stack((doc, win)), axis=1)
                            for d, names in zip(pair[0].tolist(), ranges.names(b, pair[1]), strict=True):
                                found.setdefault(d, set()).update(names)
                    hit = np.cumsum(mark[:-1]) > 0
                    total = np.concatenate(([0], np.cumsum(hit)))
                    n_hit = total[w.first[1:]] - total[w.first[:-1]]
                    spans = [[] for _ in range(part.num_rows)]
                    for d in found:
                        own = np.concatenate(([0], hit[w.first[d] : w.first[d + 1]].astype(np.int8), [0]))
                        spans[d] = np.flatnonzero(np.diff(own)).tolist()
                    yield [*part.columns[:-1], pa.array(np.diff(w.first), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(found.get(d, ())) for d in range(part.num_rows)], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.int32())), pa.array((n_hit > 0) & (20 * n_hit >= np.diff(w.first)))]

        return Carried(docs, keep, F.col(text).alias("_scan")).run(run, "n_words long, n_hit long, items array<string>, spans array<int>, contaminated boolean")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 13, text: str = "text", keep: list[str] | None = None, item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The kept columns (doc_id), then n_words, n_hit, items, spans and contaminated."""
    index = Index(benchmark, size, item_id, item_text)
    index.rarity(docs, text)
    return index.scan(docs, text, keep or ["doc_id"])


def items_digest(items) -> F.Column:
    return F.sha2(F.array_join(items, ","), 256)


def sha(ids: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


__all__ = ["Index", "decontaminate", "items_digest"]
