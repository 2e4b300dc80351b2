"""Line deduplication by a segment-partition edit join.

A line of at least `least` characters goes if an earlier line (by doc_id, then by place) is within `most` edits;
a shorter one goes, with `short`, if an equal line is earlier and it isn't blank, and stays otherwise. Equal lines are one line with its earliest place. A line is split into most + 1 segments;
two lines within `most` edits share at least one segment whole, at a place that the number of edits bounds. So
segments are indexed by (length of the line, which segment, its text), and a line probes, for each length from
its own down to its own less `most`, only the substrings whose place fits both ends of the edits (the
multi-match-aware selection). Index and probes meet by hash in buckets. Pairs that meet must have character
counts that so few edits can bring together, and are then verified with a banded bit-parallel edit distance.

Candidates' texts come from sorted arrays in the shared folder, where only lines that met another are kept, and
a last pass over the documents looks its lines up there: texts are read three times and never shuffled.

Defined results: null text has no lines, empty text has one, the empty one; a null doc_id ranks last; a line
that is repeated in one document goes there too; rows that repeat keep their lines only if the id is the
earliest (of rows with the same id, all do); other columns are ignored or passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Carried, free_shuffles, map_batches, map_groups, n_buckets, table
from ._store import bucket_of, write_sorted
from ._text import pieces, signed
from .jaccard_join import _chunks, unpack

NO_ID = (1 << 63) - 1
MOST, LEAST = 2, 24


def parts(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the segments of a line of n characters; the longer ones are last."""
    k = most + 1
    short, more = divmod(n, k)
    out, at = [], 0
    for i in range(k):
        size = short + (i >= k - more)
        out.append((at, size))
        at += size
    return out


def probes(n: int, m: int, most: int) -> list[tuple[int, int, int]]:
    """(segment, start, length): the substrings of a line of n characters to look up among lines of m <= n."""
    gap, out = n - m, []
    for i, (p, size) in enumerate(parts(m, most)):
        # edits before the segment number at most i if it's the first whole one from the left, and so from the right
        lo = max(0, p - i, p + gap - (most - i))
        hi = min(n - size, p + i, p + gap + (most - i))
        out += [(i, s, size) for s in range(lo, hi + 1)]
    return out


def within(a: str, b: str, most: int) -> bool:
    """Is the edit distance at most `most`? Banded and bit-parallel: of each column only 2 * most + 1 cells, as bits of vertical differences."""
    if abs(len(a) - len(b)) > most:
        return False
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return len(a) + len(b) <= most
    if len(a) > len(b):
        a, b = b, a
    m, width = len(a), 2 * most + 1
    if m <= most:  # no band to speak of
        row = list(range(m + 1))
        for j, c in enumerate(b, 1):
            last, row[0] = row[0], j
            for i, x in enumerate(a, 1):
                last, row[i] = row[i], min(row[i] + 1, row[i - 1] + 1, last + (x != c))
        return row[m] <= most
    top, full = 1 << (width - 1), (1 << width) - 1
    where: dict[str, list[int]] = {}
    for i, c in enumerate(a):
        where.setdefault(c, []).append(i)
    # bit k of column j is row j - most + k (from 1), the top bit row j + most; the score is that of the top row, and of row m once it's passed
    pv, mv, score = full & ~((1 << most) - 1), 0, most
    for j, c in enumerate(b, 1):
        eq = 0
        for i in where.get(c, ()):
            k = i - j + most + 1
            if 0 <= k < width:
                eq |= 1 << k
        d0 = ((((eq & pv) + pv) ^ pv) | eq | mv) & full
        hp, hn = (mv | ~(d0 | pv)) & full, d0 & pv
        if j + most <= m:
            score += not d0 & top
        else:
            k = m - j + most
            score += (hp >> k & 1) - (hn >> k & 1)
        pv, mv = (hn | ~((d0 >> 1) | hp)) & full, (d0 >> 1) & hp
        if score > 3 * most:
            return False  # what is left of the row can't bring it down again
    return score <= most


def _hash(x: str | bytes) -> int:
    return xxhash.xxh3_64_intdigest(x)


def line_keys(lines: list[str]) -> np.ndarray:
    return np.fromiter((_hash(x) for x in lines), dtype=np.uint64, count=len(lines))


def counts(line: str) -> np.ndarray:
    """How many characters of each of eight classes a line has, modulo 256: an edit changes two of them by one at most."""
    return np.bincount(np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32) & 7, minlength=8).astype(np.uint8)


def near_counts(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Rows whose counts allow `most` edits."""
    d = (a - b).astype(np.int64)
    return np.minimum(d, 256 - d).sum(axis=1) <= 2 * most


def is_compared(line: str, least: int, short: bool) -> bool:
    return len(line) >= least or (short and bool(line.strip()))


def line_lows(docs: DataFrame, most: int, least: int, short: bool = False):
    """Sorted arrays: key of each compared line that repeats or has a near one, and the earliest place (id, pos) of it or of them."""
    spark = docs.sparkSession
    n_b = n_buckets(spark)

    def lines(batch, short: bool = False):
        for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if t:
                for pos, x in enumerate(t.split("\n")):
                    if is_compared(x, least, short):
                        yield d, pos, x

    def places(batches):
        for batch in batches:
            first: dict[int, list] = {}
            for d, pos, x in lines(batch, short):
                k = _hash(x)
                e = first.get(k)
                if e is None:
                    first[k] = [d, pos, 1]
                else:
                    e[2] += 1
                    if (d, pos) < (e[0], e[1]):
                        e[0], e[1] = d, pos
            k = np.fromiter(first, dtype=np.uint64, count=len(first))
            e = np.array(list(first.values()), dtype=np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([pa.array(signed(k)), *(pa.array(np.ascontiguousarray(e[:, j])) for j in range(3))], names=["k", "id", "pos", "n"])

    def segments(batches):
        seen: set[int] = set()
        for batch in batches:
            keys, ids, shapes, times = [], [], [], []
            if len(seen) > 1_000_000:
                seen = set()
            for _, _, x in lines(batch):
                own = _hash(x)
                if own in seen:
                    continue
                seen.add(own)
                n, before = len(x), len(keys)
                for i, (s, size) in enumerate(parts(n, most)):
                    keys.append(_hash(f"{n} {i} {x[s : s + size]}"))
                    ids.append(own << 1)
                for m in range(max(least, n - most), n + 1):
                    for i, s, size in probes(n, m, most):
                        keys.append(_hash(f"{m} {i} {x[s : s + size]}"))
                        ids.append(own << 1 | 1)
                shapes.append(counts(x))
                times.append(len(keys) - before)
            if keys:
                k = np.array(keys, dtype=np.uint64)
                both = np.array([v >> 1 for v in ids], dtype=np.uint64)
                side = np.fromiter((v & 1 for v in ids), dtype=np.uint8, count=len(ids))
                shape = np.ascontiguousarray(np.repeat(np.stack(shapes), times, axis=0)).view(np.uint64)[:, 0]
                yield _chunks(bucket_of(k, n_b), [k, both, shape, side], n_b)

    def meet(group: pa.Table) -> pa.Table:
        k, own, shape, side = unpack(group.column("blob").to_pylist(), [np.uint64, np.uint64, np.uint64, np.uint8])
        shape = np.ascontiguousarray(shape).view(np.uint8).reshape(-1, 8)
        order = np.lexsort((own, shape[:, 0], side, k))
        k, own, shape, side = k[order], own[order], shape[order], side[order]
        once = np.ones(len(k), dtype=bool)
        once[1:] = (k[1:] != k[:-1]) | (side[1:] != side[:-1]) | (own[1:] != own[:-1])
        k, own, shape, side = k[once], own[once], shape[once], side[once]
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(k)), bool), k[1:] != k[:-1])))
        end = np.append(cut[1:], len(k))
        probe_at = np.add.reduceat((side == 0).astype(np.int64), cut) + cut if len(cut) else cut
        a, b = [], []
        for lo, mid, hi in zip(cut.tolist(), probe_at.tolist(), end.tolist(), strict=True):
            if mid > lo and hi > mid and (mid - lo > 1 or hi - mid > 1 or own[lo] != own[mid]):
                # a line is compared with those whose first count is near, a bounded number of pairs at a time
                step = max(1, 500_000 // (mid - lo))
                for at in range(mid, hi, step):
                    rows = np.arange(at, min(at + step, hi))
                    if mid - lo < 64:
                        x, y = np.tile(np.arange(lo, mid), len(rows)), np.repeat(rows, mid - lo)
                    else:
                        first, c = shape[lo:mid, 0].astype(np.int64), shape[rows, 0].astype(np.int64)
                        left, right = np.searchsorted(first, c - 2 * most), np.searchsorted(first, c + 2 * most, side="right")
                        wraps = (c < 2 * most) | (c > 255 - 2 * most)
                        left, right = np.where(wraps, 0, left), np.where(wraps, mid - lo, right)
                        n = right - left
                        y = np.repeat(rows, n)
                        x = lo + np.repeat(left, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    ok = (own[x] != own[y]) & near_counts(shape[x], shape[y], most)
                    x, y = own[x[ok]], own[y[ok]]
                    a.append(np.minimum(x, y))
                    b.append(np.maximum(x, y))
        pair = np.unique(np.stack((np.concatenate(a), np.concatenate(b)), axis=1), axis=0) if a else np.empty((0, 2), np.uint64)
        return pa.table({"a": signed(np.ascontiguousarray(pair[:, 0])), "b": signed(np.ascontiguousarray(pair[:, 1]))})

    at = table(map_batches(docs, places, "k long, id long, pos long, n long").groupBy("k").agg(F.min(F.struct("id", "pos")).alias("p"), F.sum("n").alias("n")).select("k", "p.id", "p.pos", "n"), "places")
    pairs = table(map_groups(map_batches(docs, segments, "_b int, blob binary"), "_b", meet, "a long, b long").distinct(), "met")
    wanted = write_sorted(pairs.select("a").union(pairs.select("b")).distinct(), "met-lines")

    def texts(batches):
        for batch in batches:
            found: dict[int, str] = {}
            own = list(lines(batch))
            keys = line_keys([x for _, _, x in own])
            hit = wanted.lookup(keys)[0] if len(keys) else []
            for (_, _, x), k, h in zip(own, keys.tolist(), hit, strict=True):
                if h:
                    found[k] = x
            yield pa.RecordBatch.from_arrays([pa.array(signed(np.fromiter(found, dtype=np.uint64, count=len(found)))), pa.array([x.encode() for x in found.values()], pa.binary())], names=["k", "line"])

    store = write_sorted(map_batches(docs, texts, "k long, line binary").dropDuplicates(["k"]), "line-texts")

    def verify(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                s, t = (store.blobs(np.uint64(v & ((1 << 64) - 1)), "line").decode() for v in (x, y))
                ok.append(within(s, t, most))
            yield batch.filter(pa.array(ok, pa.bool_()))

    near = table(map_batches(pairs.repartition(n_b, "a"), verify, "a long, b long"), "near")
    both = near.union(near.select("b", "a")).toDF("k", "other")
    places_of = at.select(F.col("k").alias("other"), F.col("id").alias("oid"), F.col("pos").alias("opos"))
    other = both.join(places_of, "other").groupBy("k").agg(F.min(F.struct(F.col("oid").alias("id"), F.col("opos").alias("pos"))).alias("q"))
    low = at.join(other, "k", "left").filter("n > 1 or q is not null").select("k", F.least(F.struct("id", "pos"), F.col("q")).alias("p")).select("k", "p.id", "p.pos")
    return write_sorted(low, "line-lows")


def line_dedup(docs: DataFrame, most: int = MOST, least: int = LEAST, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, short: bool = False) -> DataFrame:
    """doc_id (or the kept columns), n_lines, n_removed and kept (the text of the lines that stay; null for null)."""
    names = keep or [doc_id]
    own = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col(text).alias("text"))
    lows = line_lows(own, most, least, short)
    def remove(batches):
        for batch in batches:
            for part in pieces(batch, "_scan", 1 << 20):
                split = [t.split("\n") if t is not None else [] for t in part.column("_scan").to_pylist()]
                ids = part.column("_id").to_pylist()
                at = [(d, p) for d, ls in enumerate(split) for p, x in enumerate(ls) if is_compared(x, least, short)]
                keys = line_keys([split[d][p] for d, p in at])
                gone: list[set] = [set() for _ in split]
                if len(at):
                    hit, got = lows.lookup(keys)
                    for i, low_id, low_pos in zip(np.flatnonzero(hit).tolist(), got["id"].tolist(), got["pos"].tolist(), strict=True):
                        d, p = at[i]
                        if (low_id, low_pos) < (ids[d], p):
                            gone[d].add(p)
                kept = [None if t is None else t if not g else "\n".join(x for p, x in enumerate(ls) if p not in g) for t, ls, g in zip(part.column("_scan").to_pylist(), split, gone, strict=True)]
                yield [*part.columns[:-2], pa.array([len(x) for x in split], pa.int64()), pa.array([len(x) for x in gone], pa.int64()), pa.array(kept, pa.string())]

    return Carried(docs, names, F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text).alias("_scan")).run(remove, "n_lines long, n_removed long, kept string")
