"""An interpolated modified Kneser-Ney n-gram model, counted in Spark and kept as sorted hash arrays.

Tokens are lower-cased (A-Z) words and one end per text; a text is padded in front with order - 1 begins. Each
task counts its n-grams with sorts and deals them, packed as numbers of its words, by the hash of their context, so a
bucket has all continuations of its contexts: it writes two sorted arrays to the shared folder (n-gram hash with its count,
context hash with total and numbers of continuations seen once, twice and more) and hands on its distinct
n-grams, from which the next lower order counts continuations. An order is counted in ROUNDS passes, each over its share of
the buckets, so that the shuffle on disk is that part of the whole; what a pass has shuffled goes before the next. The
discounts come from the counts of counts, of which there are four an order. Workers map the arrays into memory and look sorted
hashes up in them; what a machine holds doesn't grow with the corpus.

A context that was seen once isn't kept: it is an n-gram of the order below, whose array has it, and its total and its number of
continuations seen once are 1. (One of begins alone is in no array below and is always kept.)

Buckets are as large as a task can merge, so their number follows the corpus. Once all are written, the arrays of neighbouring buckets
are put one after another into SHELVES files at most for each kind, and hashes of all of a file's buckets are searched together: what it costs to
look up a piece of text doesn't grow with the number of buckets.

In an array a hash is kept as 40 bits behind the few first ones, which a directory has, and values as one byte: the
number of one of the 255 commonest, or a mark for one in a list of the others.

P(w | c) = (max(n(cw) - D, 0) + (D1 N1 + D2 N2 + D3 N3)(c) P(w | c')) / n(c), and below one word the uniform
1 / (V + 1), so an unknown token has a share.

Defined results: null text is empty and has one token, its end; texts to learn from may repeat; with nothing
to learn from every probability is the uniform one; an n-gram that wasn't seen is taken for a seen one with a
probability of about 2**-36 (16 hashes of a directory's cell, 40 bits); other columns are ignored or carried.
"""

from __future__ import annotations

import os
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Carried, array_folder, drop_table, free_shuffles, load_array, map_batches, map_groups, n_buckets, save_array, table
from ._store import Open, bucket_of
from ._text import NOT_SPACE, U64, combine, mix, pieces, words

END, BEGIN = U64(0xE4D0E4D0E4D0E4D1), U64(0xBE61BE61BE61BE61)
#: N-grams that a task counts at once.
HELD = 3_000_000
#: Passes over the texts, or over the order above, in which an order is counted.
ROUNDS = 2
#: Files that hold the arrays of one kind.
SHELVES = 16
#: N-grams of one row that is handed on.
MOST_PACKED = 1 << 18
_STATS = "k int, at int, n1 long, n2 long, n3 long, n4 long, grams long, total long"


def tokens(part: pa.RecordBatch, order: int, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes with order - 1 begins before and one end after each text, where each text's own tokens begin, how many they are)."""
    w = words(part.column(text), NOT_SPACE, lower=True)
    h, n = w.hashes(0), np.diff(w.first)
    size = n + order
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), dtype=np.uint64)
    for j in range(order - 1):
        out[at + j] = BEGIN
    out[at + size - 1] = END
    inner = np.arange(len(h)) + np.repeat(at + order - 1 - w.first[:-1], n)
    out[inner] = h
    return out, at + order - 1, n + 1


def windows(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Positions of all tokens that are predicted."""
    return np.arange(int(n.sum())) + np.repeat(start - (np.cumsum(n) - n), n)


def count_unique(cols: list[np.ndarray], n: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows, in the order of their hashes, with their numbers."""
    key = cols[0] if len(cols) == 1 else combine(cols, seed=22)
    order = np.argsort(key)
    key = key[order]
    cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    counts = np.diff(np.append(cut, len(order))) if n is None else np.add.reduceat(n[order], cut) if len(cut) else n[:0]
    return [c[order[cut]] for c in cols], counts.astype(np.int64)


def planes(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones and so on: those that are mostly 0 pack to nothing."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def pack(words: np.ndarray, ids: list[np.ndarray], c: np.ndarray) -> bytes:
    """N-grams as numbers of words, with the hashes of the words that they have and their counts."""
    if len(words) < 8 * len(c):
        seen = np.zeros(len(words), dtype=bool)
        for i in ids:
            seen[i] = True
        own, place = np.flatnonzero(seen), np.cumsum(seen) - 1
        small = [place[i] for i in ids]
    else:  # few n-grams of many words
        own = np.unique(np.concatenate(ids))
        small = [np.searchsorted(own, i) for i in ids]
    body = b"".join([words[own].tobytes(), *(planes(i) for i in small), planes(c)])
    return np.array([len(own), len(c)], "<u4").tobytes() + pa.compress(body, codec="zstd", asbytes=True)


def unpack_grams(blobs: list[bytes], k: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The k columns of hashes of such n-grams, and their counts."""
    out: list[list[np.ndarray]] = [[] for _ in range(k + 1)]
    for blob in blobs:
        m, n = np.frombuffer(blob, "<u4", 2).tolist()
        body = pa.decompress(blob[8:], 8 * m + 4 * n * (k + 1), codec="zstd", asbytes=True)
        words = np.frombuffer(body, np.uint64, m)
        for j in range(k + 1):
            x = np.ascontiguousarray(np.frombuffer(body, np.uint8, 4 * n, 8 * m + 4 * n * j).reshape(4, n).T).view("<u4")[:, 0]
            out[j].append(words[x] if j < k else x)
    *cols, c = (np.concatenate(x) if x else np.empty(0, np.uint64) for x in out)
    return cols, c.astype(np.int64)


def deal(h: np.ndarray, at: np.ndarray, k: int, n: int, times: np.ndarray | None = None, which: int | None = None) -> pa.RecordBatch:
    """Rows (bucket, blob): the distinct k-grams that end at these places of h, with their numbers, dealt by context; with which, only of the buckets of that round."""
    words, back, often = np.unique(h, return_inverse=True, return_counts=True)
    by = np.argsort(-often)  # frequent words have small numbers
    words, rank = words[by], np.empty(len(by), np.uint32)
    rank[by] = np.arange(len(by), dtype=np.uint32)
    ids = rank[back]
    del back, by, rank, often
    bits = max(1, int(len(words)).bit_length())
    if bits * k < 64:
        whole = np.zeros(len(at), dtype=np.uint64)
        for j in range(k):
            whole = whole << U64(bits) | ids[at - k + 1 + j].astype(np.uint64)
        if times is None:
            whole.sort()
        else:
            order = np.argsort(whole)
            whole, times = whole[order], times[order]
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(whole)), bool), whole[1:] != whole[:-1])))
        size = len(whole)
        whole = whole[cut]
        cols = [(whole >> U64(bits * (k - 1 - j)) & U64((1 << bits) - 1)).astype(np.uint32) for j in range(k)]
    else:
        cols = [ids[at - k + 1 + j] for j in range(k)]
        order = np.lexsort(cols[::-1])
        cols, size = [c[order] for c in cols], len(order)
        times = times[order] if times is not None else None
        new = np.zeros(size, dtype=bool)
        new[:1] = True
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(new)
        cols = [c[cut] for c in cols]
    c = np.diff(np.append(cut, size)) if times is None else np.add.reduceat(times, cut) if len(cut) else times[:0]
    bucket = bucket_of(context([words[x] for x in cols] if k > 1 else [words[cols[0]]]), n)
    order = np.arange(len(bucket)) if which is None else np.flatnonzero(bucket % ROUNDS == which)
    order = order[np.argsort(bucket[order].astype(np.min_scalar_type(n)), kind="stable")]
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    b, blobs = [], []
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        for lo in range(int(cuts[i]), int(cuts[i + 1]), MOST_PACKED):
            rows = order[lo : min(lo + MOST_PACKED, int(cuts[i + 1]))]
            b.append(i)
            blobs.append(pack(words, [x[rows] for x in cols], c[rows]))
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blobs, pa.binary())], names=["_b", "blob"])


def context(cols: list[np.ndarray]) -> np.ndarray:
    """Hash of all but the last word; of nothing, the word's own, to deal unigrams evenly."""
    return combine(cols[:-1], seed=21) if len(cols) > 1 else mix(cols[0])


_KINDS = ("<u4", "<u4", "u1", "u1", "<i8", "<u4", "<i8")


def table_bytes(keys: np.ndarray, *values: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes with one or more values each, in one file: directory, the hashes' next 32 bits and last 8, codes, common values, places and values of the others."""
    n, w = len(keys), len(values)
    d = max(0, n.bit_length() - 4)
    first = np.searchsorted(keys >> U64(64 - d), np.arange((1 << d) + 1, dtype=np.uint64)) if d else np.array([0, n])
    rest = keys >> U64(24 - d) & U64((1 << 40) - 1)
    one = combine([v.astype(np.uint64) for v in values]) if w > 1 else values[0].astype(np.uint64)
    _, at, back, often = np.unique(one, return_index=True, return_inverse=True, return_counts=True)
    by = np.argsort(-often, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    code = np.minimum(rank[back], 255).astype(np.uint8)
    other = np.flatnonzero(code == 255)
    rows = np.stack(values, axis=1).astype(np.int64)
    parts = [first, rest >> U64(8), rest & U64(0xFF), code, rows[at[by[:255]]].ravel(), other, rows[other].ravel()]
    parts = [np.ascontiguousarray(x.astype(k)) for x, k in zip(parts, _KINDS, strict=True)]
    size = [-(-x.nbytes // 8) * 8 for x in parts]
    head = np.array([w, d, *(x for p, o in zip(parts, np.cumsum([0, *size[:-1]]), strict=True) for x in (int(o), len(p)))], dtype=np.int64)
    return np.frombuffer(head.tobytes() + b"".join(x.tobytes() + bytes(s - x.nbytes) for x, s in zip(parts, size, strict=True)), dtype=np.uint8)


def save_table(path: str, keys: np.ndarray, *values: np.ndarray) -> None:
    save_array(path, table_bytes(keys, *values))


def table_parts(data: np.ndarray) -> tuple[int, int, list[np.ndarray]]:
    """(values of a hash, bits of the directory, arrays) of such a table."""
    head = data[: 8 * (2 + 2 * len(_KINDS))].view(np.int64)
    at = len(head) * 8
    return int(head[0]), int(head[1]), [data[at + o : at + o + n * np.dtype(k).itemsize].view(k) for k, o, n in zip(_KINDS, head[2::2].tolist(), head[3::2].tolist(), strict=True)]


def join_tables(tables: list[np.ndarray], path: str) -> None:
    """One file of such tables of as many values. Its head: values of a hash, tables, place and length of each array, and of each table the
    bits of its directory, where that begins, and where its common values do. Written array by array, so tables may outgrow memory."""
    parsed = [table_parts(t) for t in tables]
    n = np.array([[len(x) for x in p] for _, _, p in parsed], dtype=np.int64)
    base, w = np.cumsum(n, axis=0) - n, parsed[0][0]
    size = [-(-int(x) * np.dtype(k).itemsize // 8) * 8 for x, k in zip(n.sum(axis=0), _KINDS, strict=True)]
    starts = 8 * (2 + 2 * len(_KINDS) + 3 * len(tables)) + np.cumsum([0, *size])
    head = np.array([w, len(tables), *(x for o, m in zip(starts.tolist(), n.sum(axis=0).tolist(), strict=False) for x in (o, m)), *(d for _, d, _ in parsed), *base[:, 0].tolist(), *(base[:, 4] // w).tolist()], dtype=np.int64)
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    out = np.lib.format.open_memmap(aside, mode="w+", dtype=np.uint8, shape=(int(starts[-1]),))
    out[: head.nbytes] = head.view(np.uint8)
    for j, k in enumerate(_KINDS):
        whole = out[starts[j] : starts[j] + int(n[:, j].sum()) * np.dtype(k).itemsize].view(k)
        for i, (_, _, p) in enumerate(parsed):
            to = whole[base[i, j] : base[i, j] + n[i, j]]
            to[:] = p[j]
            if j in (0, 5):  # places among the table's hashes
                to += np.dtype(k).type(base[i, 1])
    out.flush()
    del out, whole, to
    os.replace(aside, path)


def lookup(data: np.ndarray, keys: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The values of each hash in its table (which) of such a file, a column each; 0 where it isn't there."""
    m = 2 + 2 * len(_KINDS)
    w, tables = data[:16].view(np.int64).tolist()
    head = np.frombuffer(data[: 8 * (m + 3 * tables)].tobytes(), dtype=np.int64)
    first, high, low, code, common, other, rare = (data[o : o + n * np.dtype(k).itemsize].view(k) for k, o, n in zip(_KINDS, head[2:m:2].tolist(), head[3:m:2].tolist(), strict=True))
    out = np.zeros((len(keys), w), dtype=np.int64)
    if not len(high) or not len(keys):
        return out
    bits, begin, usuals = head[m:].reshape(3, tables)
    d = bits.astype(np.uint64)[which]
    cell = (keys >> U64(1) >> (U64(63) - d)).astype(np.int64) + begin[which]
    want, last = (keys >> (U64(32) - d)).astype(np.uint32), (keys >> (U64(24) - d)).astype(np.uint8)
    i, end = first[cell].astype(np.int64), first[cell + 1].astype(np.int64)
    for bit in range(int((end - i).max()).bit_length() - 1, -1, -1):  # all cells at once, in halving steps
        probe = i + ((1 << bit) - 1)
        i += ((high.take(probe, mode="clip") < want) & (probe < end)).astype(np.int64) << bit
    hit = np.flatnonzero((high.take(i, mode="clip") == want) & (i < end))
    place = i[hit]
    while (off := np.flatnonzero(low[place] != last[hit])).size:  # hashes that differ in their last bits alone
        place[off] += 1
        more = np.ones(len(hit), dtype=bool)
        more[off] = (place[off] < end[hit[off]]) & (high.take(place[off], mode="clip") == want[hit[off]])
        hit, place = hit[more], place[more]
    c = code[place]
    usual = c < 255
    out[hit[usual]] = common.reshape(-1, w)[usuals[which[hit[usual]]] + c[usual]]
    if not usual.all():
        out[hit[~usual]] = rare.reshape(-1, w)[np.searchsorted(other, place[~usual].astype(other.dtype))]
    return out


def shelve(spark, folder: str, n: int, kind: str, width: int, written: frozenset) -> None:
    """Joins the files of a kind's buckets into its shelves; buckets that nothing was written for are empty. The buckets' files then go."""
    each = -(-n // SHELVES)
    empty = np.empty(0, np.int64)

    def run(batches):
        for batch in batches:
            for s in batch.column("id").to_pylist():
                own = range(s * each, min(n, s * each + each))
                join_tables([load_array(f"{folder}/{kind}.{b}.npy") if b in written else table_bytes(empty.astype(np.uint64), *[empty] * width) for b in own], f"{folder}/{kind}.shelf{s}.npy")
            yield batch

    shelves = -(-n // each)
    map_batches(spark.range(0, shelves, 1, shelves), run, "id long").count()
    for b in written:
        os.remove(f"{folder}/{kind}.{b}.npy")


class Model:
    def __init__(self, folder: str, n: int, order: int, stats: dict[int, tuple], vocabulary: int, total: int):
        self.folder, self.n, self.order, self.vocabulary, self.total, self.open = folder, n, order, vocabulary, total, Open()
        self.discounts, self.unigrams = {}, 0
        for k in range(1, order + 1):
            n1, n2, n3, n4, _, mass = stats.get(k, (0,) * 6)
            self.discounts[k] = discounts(n1, n2, n3, n4)
            if k == 1:
                self.unigrams = mass
                self.once = tuple(stats.get(1, (0,) * 6)[:2])
                self.kinds = stats.get(1, (0,) * 6)[4]

    def find(self, kind: str, bucket: np.ndarray, keys: np.ndarray, width: int = 1) -> list[np.ndarray]:
        """The values of each key, 0 where it isn't there."""
        out, each = np.zeros((len(keys), width), dtype=np.int64), -(-self.n // SHELVES)
        order = np.argsort(keys)  # a table is read in its own order
        order = order[np.argsort(bucket[order].astype(np.min_scalar_type(self.n)), kind="stable")]
        cuts = np.searchsorted(bucket[order], np.arange(0, self.n + each, each))
        for s in np.flatnonzero(np.diff(cuts)).tolist():
            rows = order[cuts[s] : cuts[s + 1]]
            out[rows] = lookup(self.open.get(f"{self.folder}/{kind}.shelf{s}.npy"), keys[rows], bucket[rows] - s * each)
        return list(out.T)

    def probabilities(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(model's probability, training count) of the tokens at these positions."""
        word, back = np.unique(h[at], return_inverse=True)
        own = bucket_of(mix(word), self.n)
        (raw,) = self.find("raw", own, word)
        uniform = 1 / (self.vocabulary + 1)
        if self.unigrams:
            (c,) = self.find("g1", own, word)
            d = self.discounts[1]
            gamma = sum(x * y for x, y in zip(d[1:], (self.once[0], self.once[1], self.kinds - sum(self.once)), strict=True)) / self.unigrams
            p = (np.maximum(c - d[np.minimum(c, 3)], 0) / self.unigrams + gamma * uniform)[back]
        else:
            c, p = np.zeros(len(word), dtype=np.int64), np.full(len(at), uniform)
        first, c = h[at - 1] == BEGIN, c[back]
        for k in range(2, self.order + 1):
            cols = [h[at - k + 1 + j] for j in range(k)]
            ctx = context(cols)
            before = np.zeros(len(at), dtype=bool)
            before[1:] = c[:-1] > 0  # the context ends the text's last token, so it's known if that one's words are
            known = np.flatnonzero(first | before)
            ctx, cols = ctx[known], [x[known] for x in cols]
            one, back_ctx = np.unique(ctx, return_inverse=True) if k == 2 else (ctx, slice(None))
            total, n1, n2, n3 = (v[back_ctx] for v in self.find(f"c{k}", bucket_of(one, self.n), mix(one), 4))
            once = (total == 0) & ~first[known]
            total, n1 = total + once, n1 + once
            c = np.zeros(len(at), dtype=np.int64)
            (c[known],) = self.find(f"g{k}", bucket_of(ctx, self.n), combine(cols, seed=22))
            known, c_known = known[total > 0], c[known][total > 0]
            total, n1, n2, n3 = (v[total > 0] for v in (total, n1, n2, n3))
            d = self.discounts[k]
            p[known] = (np.maximum(c_known - d[np.minimum(c_known, 3)], 0) + (d[1] * n1 + d[2] * n2 + d[3] * n3) * p[known]) / total
        return p, raw[back]


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """D of counts 0, 1, 2 and 3 or more, from the counts of counts; where those don't give any, a half of each step."""
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 1.0, 1.5])
    y = n1 / (n1 + 2 * n2)
    d = np.array([0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(d, [0, 0.05, 0.1, 0.15], [0, 1, 2, 3])


def fit(docs: DataFrame, order: int = 3, text: str = "text") -> Model:
    """Counts all texts of docs."""
    spark = docs.sparkSession
    n, folder = n_buckets(spark), array_folder(spark, "ngrams")

    def count(batches, which: int):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            starts = np.cumsum([0, *(len(h) for h, _ in held)])
            h = np.concatenate([x for x, _ in held])
            at = np.concatenate([x + s for (_, x), s in zip(held, starts[:-1].tolist(), strict=True)])
            held.clear()
            yield deal(h, at, order, n, which=which)
            if which:
                return
            out = deal(h[at], np.arange(len(at)), 1, n)
            yield pa.RecordBatch.from_arrays([pa.array(out.column(0).to_numpy() + n, pa.int32()), out.column(1)], names=["_b", "blob"])

        for batch in batches:
            for part in pieces(batch):
                h, start, m = tokens(part, order)
                at = windows(h, start, m)
                held.append((h, at))
                size += len(at)
                if size > HELD:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    def merge(k: int):
        def run(group: pa.Table) -> pa.Table:
            b = group.column("_b")[0].as_py()
            blobs = group.column("blob").to_pylist()
            del group
            if b >= n:  # how often each token occurs, for the base and for what is known
                (w,), c = count_unique(*unpack_grams(blobs, 1))
                save_table(f"{folder}/raw.{b - n}.npy", w, c)
                return stats_row(0, b - n, c)
            cols, c = unpack_grams(blobs, k)
            del blobs
            cols, c = count_unique(cols, c)
            save_table(f"{folder}/g{k}.{b}.npy", combine(cols, seed=22) if k > 1 else cols[0], c)
            out = stats_row(k, b, c)
            if k > 1:
                ctx = context(cols)
                key = mix(ctx)
                by = np.argsort(key)
                x, cc = key[by], c[by]
                cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
                sums = [np.add.reduceat(v.astype(np.int64), cut) for v in (cc, cc == 1, cc == 2, cc > 2)] if len(cut) else [c[:0]] * 4
                told = (sums[0] > 1) | (cols[-2][by[cut]] == BEGIN)
                save_table(f"{folder}/c{k}.{b}.npy", x[cut][told], *(v[told] for v in sums))
                del ctx, key, by, x, cc, sums
                h = np.stack(cols[1:], axis=1).ravel()
                del cols
                rows = deal(h, np.arange(k - 2, len(h), k - 1), k - 1, n)
                out = pa.concat_tables([out, pa.table({"k": pa.array([None] * rows.num_rows, pa.int32()), "at": pa.array([None] * rows.num_rows, pa.int32()), **{x: pa.array([None] * rows.num_rows, pa.int64()) for x in ("n1", "n2", "n3", "n4", "grams", "total")}, "_b": rows.column(0), "blob": rows.column(1)})])
            return out

        return run

    stats: dict[int, tuple] = {}
    written: dict[int, set] = {}
    docs, above = docs.select(F.col(text).alias("text")), []
    for k in range(order, 0, -1):
        parts = []
        for which in range(ROUNDS):
            if k == order:
                rows = map_batches(docs, lambda it, which=which: count(it, which), "_b int, blob binary")
            else:
                rows = above[0]
                for x in above[1:]:
                    rows = rows.union(x)
                rows = rows.filter("k is null").select("_b", "blob").filter(F.pmod("_b", F.lit(ROUNDS)) == which)
            parts.append(table(map_groups(rows, "_b", merge(k), f"{_STATS}, _b int, blob binary"), f"order{k}"))
            del rows
            free_shuffles(spark)
            names = ("n1", "n2", "n3", "n4", "grams", "total")
            for r in parts[-1].filter("k is not null").select("k", "at", *names).collect():  # one row for each bucket
                stats[r["k"]] = tuple(x + r[y] for x, y in zip(stats.get(r["k"], (0,) * 6), names, strict=True))
                written.setdefault(r["k"], set()).add(r["at"])
        for x in above:
            drop_table(x)
        above = parts
    for x in above:
        drop_table(x)
    _, _, _, _, vocabulary, total = stats.get(0, (0,) * 6)
    for k in range(order, -1, -1):  # one kind at a time, so that only that one is on disk twice
        for kind, width in ([("raw", 1)] if k == 0 else [("g1", 1)] if k == 1 else [(f"c{k}", 4), (f"g{k}", 1)]):
            shelve(spark, folder, n, kind, width, frozenset(written.get(k, ())))
    return Model(folder, n, order, stats, vocabulary, total)


def stats_row(k: int, b: int, c: np.ndarray) -> pa.Table:
    n = [int((c == j).sum()) for j in (1, 2, 3, 4)]
    return pa.table({"k": pa.array([k], pa.int32()), "at": pa.array([b], pa.int32()), **{f"n{j + 1}": pa.array([n[j]], pa.int64()) for j in range(4)}, "grams": pa.array([len(c)], pa.int64()), "total": pa.array([int(c.sum())], pa.int64()), "_b": pa.array([None], pa.int32()), "blob": pa.array([None], pa.binary())})


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of the texts) and perplexity (per token)."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_scan", 1 << 19):
                h, start, n = tokens(part, model.order, "_scan")
                at = windows(h, start, n)
                p, raw = model.probabilities(h, at)
                cut = np.cumsum(n) - n
                known = np.add.reduceat((raw > 0).astype(np.int64), cut)
                logp = np.add.reduceat(np.log10(p), cut)
                base = np.add.reduceat(np.log10((raw + 0.1) / (model.total + 0.1 * (model.vocabulary + 1))), cut)
                yield [*part.columns[:-1], pa.array(n, pa.int64()), pa.array(known), pa.array(np.full(len(n), model.total, np.int64)), pa.array(base), pa.array(logp), pa.array(10 ** np.minimum(-logp / n, 300))]

    return Carried(docs, keep, F.col(text).alias("_scan")).run(run, "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


__all__ = ["Model", "discounts", "fit", "score"]
