"""Substring deduplication with a compressed FM-index for each shard.

Every window of `size` words picks as its anchor the occurrence of the smallest hashed k-word sequence inside
it. Equal windows pick equal anchors, so the words around an anchor whose windows all pick it (a segment) need
comparing only with segments of the same anchor: those go to one shard, and texts that occur once go nowhere.
Segments that are equal word by word are one row with the smallest doc_id before anything is shuffled on, so a
passage in a third of all documents is as cheap as one in two. A short phrase in a third of all documents would be
the anchor of as many different segments; so a sketch of fixed size counts the k-word sequences of all documents
first, and sequences whose count stands out are picked only by windows that have no other: those lie wholly in
repeated text, and have few different segments.

A shard's segments are indexed together. What stays of the index is the Burrows-Wheeler transform as a wavelet
matrix of bit vectors with rank counts, one byte a word for the prefix that neighbouring rows share, and the smallest
doc_id of each interval at the threshold; the suffix array is dropped when these are made. The segments are streamed
through it in batches, each from right to left: backward search extends every match by one word, a match that would
outgrow the threshold drops its last word, one that can't be extended shrinks until it can (both by the nearest
rows whose shared prefix is shorter). The matches that reach the threshold are reported as intervals with the
smallest doc_id that has them.

Intervals are kept as sorted arrays in the shared folder, and a last pass over the documents looks up its
segments and removes the words that windows of documents with smaller ids cover. The texts are read four
times and never shuffled.

Defined results: null and empty texts have no words; a null doc_id counts as larger than any other but 2**63 - 1,
which it ties with; rows that repeat with one doc_id aren't copies of each other; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import free_shuffles, map_batches, map_groups, n_buckets, table
from ._store import bucket_col, write_sorted
from ._text import NOT_SPACE, Words, combine, mix, pieces, signed, words

NO_ID = (1 << 63) - 1
#: Counters of the sketch, in parts; a sequence stands out that is counted so much oftener than the mean.
SLOTS, PART, STANDS_OUT = 1 << 20, 1 << 16, 64
#: Segments that are streamed through an index at once.
QUERIES = 4096


class WaveletMatrix:
    """Ranks of symbols below 2**bits in a sequence: a bit vector for each bit, with counts every 64 positions."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits, self.levels, self.n = bits, [], len(values)
        v = values
        for k in range(bits - 1, -1, -1):
            bit = ((v >> k) & 1).astype(np.uint8)
            pad = np.zeros(-(-(len(bit) + 1) // 64) * 64, dtype=np.uint8)
            pad[: len(bit)] = bit
            word = np.packbits(pad, bitorder="little").view(np.uint64)
            ones = np.concatenate(([0], np.cumsum(np.bitwise_count(word), dtype=np.int64)))[:-1].astype(np.int32)
            zeros = int(len(bit) - bit.sum())
            self.levels.append((word, ones, zeros))
            v = np.concatenate((v[bit == 0], v[bit == 1]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many of the symbol stand before each position (vectors)."""
        lo, hi = np.zeros_like(at), at.copy()
        for k, (word, ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            one = ((symbol >> k) & 1).astype(bool)
            both = np.concatenate((lo, hi))
            w = both >> 6
            r = ones[w] + np.bitwise_count(word[w] & ((np.uint64(1) << (both & 63).astype(np.uint64)) - np.uint64(1)))
            r1, r2 = r[: len(lo)], r[len(lo) :]
            lo, hi = np.where(one, zeros + r1, lo - r1), np.where(one, zeros + r2, hi - r2)
        return hi - lo


class FMIndex:
    """Over several word sequences: what backward search needs, and nothing else. Matches are followed up to `depth` words."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, sigma: int, depth: int, owners: np.ndarray | None = None):
        """symbols: all sequences one after another, from 1 to sigma - 1, without separators; owners: a number for each sequence."""
        n = len(symbols) + len(lengths)
        text = np.zeros(n, dtype=np.int64)
        ends = np.cumsum(lengths + 1) - 1
        inner = np.ones(n, dtype=bool)
        inner[ends] = False
        text[inner] = symbols
        self.n, self.depth, self.words = n, depth, len(symbols)
        room = np.repeat(ends, lengths + 1) - np.arange(n)  # words up to the separator; a suffix compares as far as that
        ranks, rank, d = [(1, text.astype(np.int32))], text.copy(), 1
        while d < depth:
            after = np.zeros(n, dtype=np.int64)
            after[:-d] = np.where(room[:-d] >= d, rank[d:], 0) if n > d else 0
            key = rank * (n + sigma + 1) + after
            order = np.argsort(key, kind="stable")
            rank = np.zeros(n, dtype=np.int64)
            rank[order] = np.concatenate(([0], np.cumsum(np.diff(key[order]) != 0)))
            d *= 2
            ranks.append((d, rank.astype(np.int32)))
        sa = np.argsort(rank, kind="stable")
        # words that each row shares with the next one
        a, b, shared = sa[:-1], sa[1:], np.zeros(n - 1, dtype=np.int64)
        for d, r in reversed(ranks):
            x, y = a + shared, b + shared
            ok = (x < n) & (y < n)
            ok[ok] = r[x[ok]] == r[y[ok]]
            shared[ok] += d
        shared = np.minimum(np.minimum(shared, depth), np.minimum(room[a], room[b]))
        self.shared = shared.astype(np.min_scalar_type(depth))
        self.bits = max(1, int(sigma - 1).bit_length())
        self.wavelet = WaveletMatrix(np.where(sa > 0, text[sa - 1], 0), self.bits)
        self.before = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))[:-1]
        # the smallest owner of each interval at full depth
        self.cuts = self.borders(depth)
        self.least = np.minimum.reduceat(np.repeat(owners, lengths + 1)[sa], self.cuts[:-1]) if owners is not None else None

    def nbytes(self) -> int:
        """What the index takes."""
        return sum(w.nbytes + o.nbytes for w, o, _ in self.wavelet.levels) + self.shared.nbytes + self.before.nbytes + self.cuts.nbytes + (self.least.nbytes if self.least is not None else 0)

    def borders(self, depth: int) -> np.ndarray:
        """Where intervals of rows that share `depth` words begin, and the end."""
        return np.concatenate(([0], np.flatnonzero(self.shared < depth) + 1, [self.n])).astype(np.int32)

    def least_owner(self, row: np.ndarray) -> np.ndarray:
        return self.least[np.searchsorted(self.cuts, row, side="right") - 1]

    def extend(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the rows of the pattern with one more word in front."""
        m = len(lo)
        r = self.wavelet.rank(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        base = self.before[symbol]
        return base + r[:m], base + r[m:]

    def matching(self, queries: list[np.ndarray], threshold: int):
        """Matching statistics of all queries at once, capped at threshold: yields (query, position, length, low row, end row) vectors, position by position from the right.

        A length is that of the longest match that begins at the position, up to threshold, which is the index's depth at most. Symbols that the
        index doesn't have are 0.
        """
        if threshold > self.depth:
            raise ValueError(f"the index follows {self.depth} words, not {threshold}")
        q = len(queries)
        size = np.array([len(x) for x in queries], dtype=np.int64)
        at = np.concatenate(([0], np.cumsum(size)))
        flat = np.concatenate(queries).astype(np.int64) if q else np.empty(0, np.int64)
        lo, hi, length = np.zeros(q, np.int64), np.full(q, self.n, np.int64), np.zeros(q, np.int64)
        borders: dict[int, np.ndarray] = {}

        def shrink(rows: np.ndarray) -> None:
            length[rows] -= 1
            for d in np.unique(length[rows]).tolist():
                own = rows[length[rows] == d]
                if not d:
                    lo[own], hi[own] = 0, self.n
                    continue
                cuts = borders.get(d)
                if cuts is None:
                    cuts = borders[d] = self.borders(d)
                i = np.searchsorted(cuts, lo[own], side="right")
                lo[own], hi[own] = cuts[i - 1], cuts[i]

        for step in range(int(size.max(initial=0))):
            rows = np.flatnonzero(size > step)
            symbol = flat[at[rows] + size[rows] - 1 - step]
            full = rows[length[rows] == threshold]
            if len(full):
                shrink(full)
            todo, want = rows, symbol
            while len(todo):
                new_lo, new_hi = self.extend(lo[todo], hi[todo], want)
                ok = (new_hi > new_lo) & (want > 0)
                lo[todo[ok]], hi[todo[ok]] = new_lo[ok], new_hi[ok]
                length[todo[ok]] += 1
                todo, want = todo[~ok], want[~ok]
                open_ = length[todo] > 0
                shut = todo[~open_]
                lo[shut], hi[shut] = 0, self.n
                todo, want = todo[open_], want[open_]
                if len(todo):
                    shrink(todo)
            yield rows, size[rows] - 1 - step, length[rows].copy(), lo[rows].copy(), hi[rows].copy()


def sequences(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word sequences, those that cross from one document to the next with them."""
    return mix(combine([h[i : len(h) - k + 1 + i] for i in range(k)], seed=77)) if len(h) >= k else np.empty(0, np.uint64)


def slots(g: np.ndarray) -> np.ndarray:
    return (g & np.uint64(SLOTS - 1)).astype(np.int64)


def frequent(docs: DataFrame, k: int) -> np.ndarray:
    """A bit for each slot of the sketch: is it counted much oftener than the mean? docs: text. What tasks and driver hold has a fixed size."""

    def count(batches):
        total, held = np.zeros(SLOTS, dtype=np.int64), []
        for batch in batches:
            for part in pieces(batch):
                w = words(part.column("text"), NOT_SPACE)
                if not len(w):
                    continue
                g, owner = sequences(w.hashes(0), k), w.doc()
                held.append(slots(g[owner[: len(g)] == owner[len(w) - len(g) :]]) if len(g) else np.empty(0, np.int64))
                if sum(map(len, held)) > SLOTS:
                    total += np.bincount(np.concatenate(held), minlength=SLOTS)
                    held = []
        if held:
            total += np.bincount(np.concatenate(held), minlength=SLOTS)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(SLOTS // PART), pa.int32()), pa.array([_pack(total[i : i + PART]) for i in range(0, SLOTS, PART)], pa.binary())], names=["part", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = np.zeros(PART, dtype=np.int64)
        for blob in group.column("n"):
            total += _unpack(blob.as_py())
        return pa.table({"part": group.column("part")[:1], "n": pa.array([_pack(total)], pa.binary())})

    # a group gets a thousand tasks' parts at most, then as many groups' sums
    rows = map_batches(docs.select("text"), count, "part int, n binary").withColumn("g", F.concat_ws(" ", "part", (F.spark_partition_id() / 1024).cast("int")))
    sums = map_groups(map_groups(rows, "g", add, "part int, n binary"), "part", add, "part int, n binary")
    total = np.zeros(SLOTS, dtype=np.int64)
    for r in sums.collect():  # SLOTS / PART rows
        total[r["part"] * PART : (r["part"] + 1) * PART] = _unpack(bytes(r["n"]))
    mean = total.mean()
    return np.packbits(total > mean + 8 * np.sqrt(mean) + STANDS_OUT)


def _pack(x: np.ndarray) -> bytes:
    """Counts by their bytes: the upper ones are 0 and pack to nothing."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes(), codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> np.ndarray:
    data = np.frombuffer(pa.decompress(blob, 8 * PART, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(data.reshape(8, PART).T).view(np.int64)[:, 0]


def segments(w: Words, h: np.ndarray, size: int, k: int, often: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(anchor hash, document, first word, windows) of each run of windows that pick the same anchor. often: frequent()'s bits."""
    n = len(h)
    out = [np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3]
    if n < size:
        return tuple(out)
    g = sequences(h, k)
    rank = g >> np.uint64(1)
    if often is not None:
        s = slots(g)
        rank |= ((often[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(63)
    m = size - k + 1  # k-word sequences in a window
    # the leftmost smallest in each window, by doubling: ties go to the left
    best, val, d = np.arange(len(g)), rank, 1
    while d < m:
        s = min(d, m - d)
        right_v, right_p = val[s:], best[s:]
        left_v, left_p = val[: len(right_v)], best[: len(right_p)]
        less = right_v < left_v
        val, best = np.where(less, right_v, left_v), np.where(less, right_p, left_p)
        d += s
    owner = w.doc()
    starts = np.flatnonzero(owner[: n - size + 1] == owner[size - 1 :])
    pick = best[starts]
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (np.diff(starts) != 1)
    cut = np.flatnonzero(new)
    count = np.diff(np.append(cut, len(starts)))
    return g[pick[cut]], owner[starts[cut]], starts[cut], count


def content(h: np.ndarray, h2: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each word sequence."""
    if not len(start):
        return np.empty(0, np.uint64), np.empty(0, np.uint64)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    at, cut, out = np.repeat(start, length) + inner, np.cumsum(length) - length, []
    with np.errstate(over="ignore"):
        for x, seed in ((h, 5), (h2, 11)):
            turn = mix(inner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)
            out.append(mix(np.add.reduceat(x[at] * turn, cut) + length.astype(np.uint64)))
    return out[0], out[1]


def joined(w: Words, keep: np.ndarray) -> pa.Array:
    """Of each document the words that stay, joined by one space."""
    at = np.flatnonzero(keep)
    length, doc = w.length[at], w.doc()[at]
    lead = np.ones(len(at), dtype=np.int64)
    lead[np.flatnonzero(np.diff(doc, prepend=-1))] = 0
    end = np.cumsum(length + lead)
    out = np.full(int(end[-1]) if len(end) else 0, 32, dtype=np.uint8)
    inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(end - length, length) + inner] = w.buf[np.repeat(w.start[at], length) + inner]
    ends = np.concatenate(([0], end))[np.searchsorted(doc, np.arange(len(w.first) - 1), side="right")]
    return pa.LargeStringArray.from_buffers(len(w.first) - 1, pa.py_buffer(np.concatenate(([0], ends)).astype(np.int64).tobytes()), pa.py_buffer(out.tobytes())).cast(pa.string())


def _tokens(part: pa.RecordBatch, size: int, k: int, often: np.ndarray | None):
    w = words(part.column("text"), NOT_SPACE)
    h, h2 = w.hashes(0), w.hashes(1)
    anchor, doc, start, count = segments(w, h, size, k, often)
    key, check = content(h, h2, start, count + size - 1)
    return w, h, anchor, doc, start, count, combine([anchor, key]), check


def repeats(docs: DataFrame, size: int, k: int, often: np.ndarray):
    """Sorted arrays of the segments that repeat: key, check and runs (first window, end window, smallest doc_id: int64 triples)."""
    spark = docs.sparkSession
    shards = n_buckets(spark, 16)

    def find(batches):
        for batch in batches:
            for part in pieces(batch):
                ids = part.column("rank").to_numpy()
                _, _, anchor, doc, start, count, key, check = _tokens(part, size, k, often)
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), pa.array(signed(key)), pa.array(signed(check)), pa.array(ids[doc])], names=["anchor", "key", "check", "id"])

    found = map_batches(docs, find, "anchor long, key long, check long, id long")
    # one row for each distinct segment, then those whose anchor has more than one document
    distinct = found.groupBy("anchor", "key", "check").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    distinct = table(distinct, "segments")
    shared = distinct.groupBy("anchor").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a < b").select("anchor")
    free_shuffles(spark)
    wanted = write_sorted(distinct.join(shared, "anchor").select("key", "check", "low"), "wanted")

    def fetch(batches):
        for batch in batches:
            for part in pieces(batch):
                ids = part.column("rank").to_numpy()
                w, h, anchor, doc, start, count, key, check = _tokens(part, size, k, often)
                hit, got = wanted.lookup(key)
                own = np.flatnonzero(hit)
                own = own[(got["low"] == ids[doc[own]]) & (got["check"] == signed(check[own]))]
                _, once = np.unique(key[own], return_index=True)
                own = own[once]
                blobs = [h[start[i] : start[i] + count[i] + size - 1].tobytes() for i in own]
                yield pa.RecordBatch.from_arrays([pa.array(signed(anchor[own])), pa.array(signed(key[own])), pa.array(signed(check[own])), pa.array(ids[doc[own]]), pa.array(blobs, pa.binary())], names=["anchor", "key", "check", "id", "words"])

    def match(group: pa.Table) -> pa.Table:
        keys, at = np.unique(group.column("key").to_numpy(), return_index=True)  # a repeated row may have sent a segment twice
        ids, check = group.column("id").to_numpy()[at], group.column("check").to_numpy()[at]
        blobs = group.column("words").to_pylist()
        seqs = [np.frombuffer(blobs[i], dtype=np.uint64) for i in at]
        length = np.array([len(s) for s in seqs])
        names, symbols = np.unique(np.concatenate(seqs), return_inverse=True)
        symbols = symbols.astype(np.int64) + 1
        index = FMIndex(symbols, length, len(names) + 1, size, ids)
        bounds = np.cumsum(length)
        best = np.full(len(symbols), NO_ID, dtype=np.int64)
        for lo in range(0, len(seqs), QUERIES):
            own = slice(lo, min(lo + QUERIES, len(seqs)))
            first = (bounds - length)[own]
            for rows, pos, got, row, _ in index.matching([symbols[f : f + n] for f, n in zip(first.tolist(), length[own].tolist(), strict=True)], size):
                full = got == size
                best[first[rows[full]] + pos[full]] = index.least_owner(row[full])
        runs = []
        for i in range(len(keys)):
            m = best[bounds[i] - length[i] : bounds[i] - size + 1]
            new = np.flatnonzero(np.diff(m, prepend=m[0] - 1))
            runs.append(np.stack((new, np.append(new[1:], len(m)), m[new]), axis=1).astype(np.int64).tobytes())
        return pa.table({"key": keys, "check": check, "runs": pa.array(runs, pa.binary())})

    parts = map_batches(docs, fetch, "anchor long, key long, check long, id long, words binary").withColumn("_b", bucket_col(F.col("anchor"), shards))
    return write_sorted(map_groups(parts, "_b", match, "key long, check long, runs binary"), "runs")


def substring_dedup(docs: DataFrame, size: int = 50, k: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words that stay, joined by one space) and spans (first and end word of each removed run)."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ranked = docs.withColumn("rank", F.coalesce("doc_id", F.lit(NO_ID)))
    often = frequent(docs, k)
    runs = repeats(ranked.select("rank", "text"), size, k, often)

    def remove(batches):
        for batch in batches:
            for part in pieces(batch):
                ids = part.column("rank").to_numpy()
                w, _, _, doc, start, count, key, check = _tokens(part, size, k, often)
                hit, got = runs.lookup(key, ["check"])
                own = np.flatnonzero(hit)
                own = own[got["check"] == signed(check[own])]
                mark = np.zeros(len(w) + 1, dtype=np.int64)
                for i in own:
                    r = np.frombuffer(runs.blobs(key[i], "runs"), dtype=np.int64).reshape(-1, 3)
                    r = r[r[:, 2] < ids[doc[i]]]
                    np.add.at(mark, start[i] + r[:, 0], 1)
                    np.add.at(mark, start[i] + r[:, 1] + size - 1, -1)
                gone = np.cumsum(mark[:-1]) > 0
                before = np.concatenate(([0], np.cumsum(gone)))
                removed = before[w.first[1:]] - before[w.first[:-1]]
                spans = [[] for _ in removed]
                for d in np.flatnonzero(removed).tolist():
                    spans[d] = np.flatnonzero(np.diff(gone[w.first[d] : w.first[d + 1]].astype(np.int8), prepend=0, append=0)).tolist()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.first), pa.int64()), pa.array(removed, pa.int64()), joined(w, ~gone), pa.array(spans, pa.list_(pa.int32()))], names=["doc_id", "n_words", "n_removed", "kept", "spans"])

    return map_batches(ranked, remove, "doc_id long, n_words long, n_removed long, kept string, spans array<int>")


def sha(words_: list[str]) -> str:
    return hashlib.sha256(" ".join(words_).encode()).hexdigest()
