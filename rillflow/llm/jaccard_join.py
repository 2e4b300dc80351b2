"""N-gram Jaccard join in the metric space of shingle sets.

Jaccard distance (1 - similarity) and the symmetric difference of sets are metrics. Two documents link when
their distance is at most t = 0.1.

1. Documents with equal sets become one point, so copies cost nothing more.
2. Nearly all points are at distance 1 from any pivot, where pivots tell nothing. So points first fall into groups that
   can't have links between them: a point's shingles are ordered (those that many points share go last, the commonest at the end,
   then by hash); two neighbours must share at least l of their first n - ceil(0.9 n) + l. Pairs that do, or that are among the many holders of
   one such shingle, are in one group; a point in no group has no neighbour and leaves. No link is taken from this step.
   Holders are counted over all points, by 24 bits of a shingle in its bucket: what order comes out is the same for all points,
   and how many points share a shingle doesn't change with the size of the input or of a task. So a shingle that many hold is among the first
   ones of a point only if it has hardly any rarer ones.
3. A group is a region. A region of more than REGION points is cut by pivots drawn from it: a point goes to the Voronoi region of its
   nearest pivot, and is replicated to that of any other pivot which is farther by 2t at most; by the triangle inequality
   a neighbour of a point in a region is in it or replicated to it. This is done again, by Spark over all large regions at
   once, until regions are small; a task then joins each small region in the same way, recursively, down to LEAF points, which are
   compared with each other.
4. A region that its pivots don't cut is dense. The ball around its pivot is linked already and isn't joined with itself; the other
   points lie in rings of width t around the pivot, and by the triangle inequality neighbours are in one ring or in adjoining
   ones, so each ring is replicated to the next one only. Rings are dealt in cells of bounded size.
5. Links make components.

Sets of the points that are left lie as sorted arrays in the shared folder; no text is ever shuffled. Every link is verified by the
sizes of the sets and of their intersection.

Defined results: a null or empty text has an empty set, links with nothing and is its own component; a null
doc_id takes part but is never a component's id, unless all of its ids are null; rows may repeat; other columns
are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import components, drop_table, free_shuffles, map_batches, map_groups, n_buckets, table
from ._store import bucket_of, write_sorted
from ._text import NOT_SPACE, U64, combine, mix, pieces, signed, words

#: Shingles in common that candidates must have among their first ones.
COMMON = 3
#: Holders of a shingle of which all pairs are counted; more of them are in one group without counting.
COUNTED = 128
#: Points of a region that one task joins; pivots that cut a region; points that are compared with each other; points of a cell of a ring.
REGION, PIVOTS, LEAF, CELL = 400, 8, 24, 400
#: Regions are worth cutting if the squares of their sizes then sum to so much of what they were at most; so each cut makes less to compare.
CUTS = 0.8
#: Shingles that so many points have go last, by their numbers of holders. It doesn't grow with the input, as holders of one shingle do.
FREQUENT = 8
#: Shingles that a task counts at once; bits by which a bucket tells them apart; buckets for each file of the frequent ones.
HELD, CELL_BITS, BUCKETS_A_FILE = 4_000_000, 24, 16


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of these links to keep so that they join the same nodes: never more than nodes."""
    nodes, back = np.unique(np.concatenate((a, b)), return_inverse=True)
    parent, keep = list(range(len(nodes))), np.zeros(len(a), dtype=bool)

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, (x, y) in enumerate(zip(back[: len(a)].tolist(), back[len(a) :].tolist(), strict=True)):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep[i] = True
    return keep


class Threshold:
    """links when den * |intersection| >= num * |union|, as whole numbers."""

    def __init__(self, num: int = 90, den: int = 100):
        self.num, self.den = num, den

    def least(self, n):
        """Fewest shingles that a set of n shares with a neighbour."""
        return -(-self.num * n // self.den)

    def links(self, common, a, b):
        return self.den * common >= self.num * (a + b - common)

    def sizes(self, a, b):
        """Can sets of these sizes be neighbours?"""
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)


def shingle_sets(part: pa.RecordBatch, n: int, text: str = "text") -> list[np.ndarray]:
    """The set of each document: sorted distinct hashes of n-word sequences; of all words where they are fewer."""
    w = words(part.column(text), NOT_SPACE, lower=True)
    h = w.hashes(0)
    g = combine([h[i : len(h) - n + 1 + i] for i in range(n)], seed=3) if len(h) >= n else np.empty(0, U64)
    out = []
    for d in range(part.num_rows):
        lo, hi = int(w.first[d]), int(w.first[d + 1])
        if hi - lo >= n:
            out.append(np.unique(g[lo : hi - n + 1]))
        elif hi > lo:
            out.append(combine([h[i : i + 1] for i in range(lo, hi)], seed=100 + hi - lo))
        else:
            out.append(np.empty(0, U64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """64 bits of each set."""
    with np.errstate(over="ignore"):
        return np.array([mix(np.array([mix(s ^ U64(0x5555)).sum(dtype=np.uint64) + U64(len(s))], dtype=np.uint64))[0] if len(s) else U64(0) for s in sets], dtype=np.uint64)


def _chunks(bucket: np.ndarray, columns: list[np.ndarray], n: int, most: int = 1 << 17):
    """Rows (bucket, blob): the columns' bytes one after another, in rows of bounded size."""
    order = np.argsort(bucket, kind="stable")
    columns = [c[order] for c in columns]
    cuts = np.searchsorted(bucket[order], np.arange(n + 1))
    b, blobs = [], []
    for i in np.flatnonzero(np.diff(cuts)).tolist():
        for lo in range(int(cuts[i]), int(cuts[i + 1]), most):
            hi = min(lo + most, int(cuts[i + 1]))
            b.append(i)
            blobs.append(b"".join(c[lo:hi].tobytes() for c in columns))
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blobs, pa.binary())], names=["_b", "blob"])


def cells_of(h: np.ndarray, n: int) -> np.ndarray:
    """(bucket of n, cell in it) of shingles, as one number."""
    return bucket_of(h, n).astype(np.uint64) << U64(CELL_BITS) | (h & U64(0xFFFFFFFF)) >> U64(32 - CELL_BITS)


def pack_cells(cells: np.ndarray, n: int) -> pa.RecordBatch:
    """Rows (bucket, blob): a bucket's sorted cells as steps from one to the next, first bytes first; one that is met again is a step of 0."""
    cells = np.sort(cells)
    cuts = np.searchsorted(cells, np.arange(n + 1, dtype=np.uint64) << U64(CELL_BITS))
    b = np.flatnonzero(np.diff(cuts))
    blobs = []
    for i in b.tolist():
        own = (cells[cuts[i] : cuts[i + 1]] & U64((1 << CELL_BITS) - 1)).astype(np.uint32)
        step = np.diff(own, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
        blobs.append(np.array([len(own)], "<u4").tobytes() + pa.compress(np.ascontiguousarray(step[:, : -(-CELL_BITS // 8)].T).tobytes(), codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(blobs, pa.binary())], names=["_b", "blob"])


def unpack_cells(blobs: list[bytes]) -> np.ndarray:
    """All cells of such blobs of a bucket, sorted."""
    out, width = [np.empty(0, np.uint32)], -(-CELL_BITS // 8)
    for blob in blobs:
        n = int(np.frombuffer(blob, "<u4", 1)[0])
        step = np.zeros((n, 4), np.uint8)
        step[:, :width] = np.frombuffer(pa.decompress(blob[4:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
        out.append(np.cumsum(step.view("<u4")[:, 0], dtype=np.uint32))
    return np.sort(np.concatenate(out))


def unpack(blobs, dtypes: list) -> list[np.ndarray]:
    """The columns of such rows."""
    width = sum(np.dtype(d).itemsize for d in dtypes)
    cols = [[] for _ in dtypes]
    for blob in blobs:
        n, at = len(blob) // width, 0
        for c, d in zip(cols, dtypes, strict=True):
            c.append(np.frombuffer(blob, dtype=d, count=n, offset=at))
            at += n * np.dtype(d).itemsize
    return [np.concatenate(c) if c else np.empty(0, d) for c, d in zip(cols, dtypes, strict=True)]


def overlaps(a: list[np.ndarray], b: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of two cells, as products of incidence matrices over the shingles that both sides have."""
    fa, fb = np.concatenate(a), np.concatenate(b)
    shared = np.intersect1d(fa, fb)
    out = np.zeros((len(a), len(b)), dtype=np.float32)
    ra, rb = np.repeat(np.arange(len(a)), [len(x) for x in a]), np.repeat(np.arange(len(b)), [len(x) for x in b])
    if not len(shared):
        return out
    ca, cb = np.minimum(np.searchsorted(shared, fa), len(shared) - 1), np.minimum(np.searchsorted(shared, fb), len(shared) - 1)
    ka, kb = shared[ca] == fa, shared[cb] == fb
    ra, ca, rb, cb = ra[ka], ca[ka], rb[kb], cb[kb]
    for lo in range(0, len(shared), columns):
        m = []
        for r, c, n in ((ra, ca, len(a)), (rb, cb, len(b))):
            own = (c >= lo) & (c < lo + columns)
            x = np.zeros((n, min(columns, len(shared) - lo)), dtype=np.float32)
            x[r[own], c[own] - lo] = 1
            m.append(x)
        out += m[0] @ m[1].T
    return out


def distances(common: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of sets of these sizes with so much in common."""
    return 1 - common / np.maximum(a + b - common, 1)


def join_region(sets: list[np.ndarray], own: np.ndarray, limit: "Threshold") -> list[tuple[int, int, float]]:
    """Links (i, j, distance) in a region, those between two replicas (not own) left out; of a ball that its pivot holds together, only those to the pivot."""
    size, t, out = np.array([len(x) for x in sets]), 1 - limit.num / limit.den, []

    def compare(x: np.ndarray, y: np.ndarray, ok: np.ndarray) -> None:
        """Pairs of x and y where ok."""
        common = overlaps([sets[i] for i in x], [sets[i] for i in y]).astype(np.int64)
        hit = ok & limit.links(common, size[x][:, None], size[y][None, :])
        for i, j in zip(*np.nonzero(hit), strict=True):
            out.append((int(x[i]), int(y[j]), float(distances(common[i, j], size[x[i]], size[y[j]]))))

    todo = [(np.arange(len(sets)), own)]
    while todo:
        at, mine = todo.pop()
        n = len(at)
        if n < 2 or not mine.any():
            continue
        if n <= LEAF:
            compare(at, at, np.triu(np.ones((n, n), dtype=bool), 1) & (mine[:, None] | mine[None, :]))
            continue
        # pivots as far from each other as the region allows
        pivots, d = [0], np.empty((PIVOTS, n))
        for k in range(PIVOTS):
            p = at[pivots[k]]
            common = overlaps([sets[p]], [sets[i] for i in at])[0].astype(np.int64)
            d[k] = distances(common, size[p], size[at])
            hit = limit.links(common, size[p], size[at]) & (at != p)
            out += [(int(p), int(i), float(x)) for i, x in zip(at[hit], d[k][hit], strict=True)]
            far = int(d[: k + 1].min(axis=0).argmax())
            if k + 1 == PIVOTS or d[: k + 1, far].min() <= t:
                break
            pivots.append(far)
        d = d[: len(pivots)]
        nearest, least = d.argmin(axis=0), d.min(axis=0)
        inside = [d[k] - least <= 2 * t + 1e-9 for k in range(len(pivots))]
        if sum(int(x.sum()) ** 2 for x in inside) <= CUTS * n * n:
            todo += [(at[x], (mine & (nearest == k))[x]) for k, x in enumerate(inside)]
            continue
        # dense: what a pivot's ball holds is linked with the pivot; the others are compared with all
        k = int((d <= t + 1e-9).sum(axis=1).argmax())
        rest = np.flatnonzero(~limit.links(np.rint((1 - d[k]) * (size[at[pivots[k]]] + size[at]) / (2 - d[k])).astype(np.int64), size[at[pivots[k]]], size[at]))
        place = np.full(n, n)
        place[rest] = np.arange(len(rest))
        for lo in range(0, len(rest), CELL):
            x = rest[lo : lo + CELL]
            for hi in range(0, n, CELL):
                y = np.arange(hi, min(hi + CELL, n))
                near = np.abs(d[k][x][:, None] - d[k][y][None, :]) <= t + 1e-9
                compare(at[x], at[y], near & (mine[x][:, None] | mine[y][None, :]) & (place[x][:, None] < place[y][None, :]))
    return out


def jaccard_links(docs: DataFrame, shingle: int = 3, limit: Threshold | None = None, text: str = "text", doc_id: str = "doc_id", spanning: bool = True):
    """(points: doc_id, node, n_shingles of each row; links: a, b nodes and d, their distance).

    Of a pivot's ball only the links to the pivot are given; with spanning, of two cells only as many as join the same points.
    """
    limit = limit or Threshold()
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    n_b = n_buckets(spark)

    def make(batches):
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part, shingle)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(signed(signatures(sets))), pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "node", "n_shingles"])

    points = table(map_batches(docs, make, "doc_id long, node long, n_shingles long"), "points")
    # the row that speaks for a point; an id that is null still needs one
    speaker = write_sorted(points.filter("n_shingles > 0").groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit((1 << 63) - 1))).alias("id")), "speakers")

    def own(part: pa.RecordBatch, sets: list[np.ndarray], seen: set | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(which rows speak for their points, all signatures)."""
        sig = signatures(sets)
        ids = part.column("doc_id").fill_null((1 << 63) - 1).to_numpy()
        hit, got = speaker.lookup(sig)
        at = np.flatnonzero(hit)
        at = at[got["id"] == ids[at]]
        _, once = np.unique(sig[at], return_index=True)
        return at[np.sort(once)], sig

    def count(batches):
        held, total = [], 0
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part, shingle)
                at, _ = own(part, sets)
                held.extend(cells_of(sets[i], n_b) for i in at)
                total += sum(len(sets[i]) for i in at)
                if total > HELD:
                    yield pack_cells(np.concatenate(held), n_b)
                    held, total = [], 0
        if held:
            yield pack_cells(np.concatenate(held), n_b)

    def many(group: pa.Table) -> pa.Table:
        b = group.column("_b")[0].as_py()
        cell = unpack_cells(group.column("blob").to_pylist())
        cut = np.flatnonzero(np.concatenate((np.ones(min(1, len(cell)), bool), cell[1:] != cell[:-1])))
        n = np.diff(np.append(cut, len(cell)))
        cell, n = cell[cut[n >= FREQUENT]], n[n >= FREQUENT]
        return pa.table({"h": signed(mix(U64(b << CELL_BITS) | cell.astype(np.uint64))), "n": n.astype(np.int64)})

    often = write_sorted(map_groups(map_batches(docs, count, "_b int, blob binary"), "_b", many, "h long, n long"), "frequent", -(-n_b // BUCKETS_A_FILE))

    def prefixes(batches):
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for part in pieces(batch):
                sets = shingle_sets(part, shingle)
                at, sig = own(part, sets)
                if not len(at):
                    continue
                flat = np.concatenate([sets[i] for i in at])
                hit, got = often.lookup(mix(cells_of(flat, n_b)))
                holders = np.zeros(len(flat), np.int64)
                holders[hit] = got["n"]
                lo = 0
                for i in at:
                    s, n = sets[i], len(sets[i])
                    late = np.argsort(holders[lo : lo + n], kind="stable")
                    lo += n
                    least = int(limit.least(n))
                    first = s[late[: n - least + min(COMMON, least)]]
                    keys.append(first)
                    nodes.append(np.full(len(first), sig[i]))
                    sizes.append(np.full(len(first), n, dtype=np.int32))
            if keys:
                k = np.concatenate(keys)
                yield _chunks(bucket_of(mix(k), n_b), [k, np.concatenate(nodes), np.concatenate(sizes)], n_b)

    def block(group: pa.Table) -> pa.Table:
        key, node, size = unpack(group.column("blob").to_pylist(), [np.uint64, np.uint64, np.int32])
        order = np.lexsort((node, key))
        key, node, size = key[order], node[order], size[order].astype(np.int64)
        once = np.ones(len(key), dtype=bool)
        once[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1])
        key, node, size = key[once], node[once], size[once]
        cut = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.empty(0, np.int64)
        n = np.diff(np.append(cut, len(key)))
        of = np.repeat(np.arange(len(cut)), n)
        small = (n <= COUNTED)[of] & (n > 1)[of]
        a, b = [], []
        idx = np.flatnonzero(small)
        d = 1
        while len(idx):
            idx = idx[idx + d < len(key)]
            idx = idx[of[idx + d] == of[idx]]
            ok = idx[limit.sizes(size[idx], size[idx + d])]
            a.append(ok)
            b.append(ok + d)
            d += 1
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        pair = np.stack((node[a], node[b], size[a].astype(np.uint64), size[b].astype(np.uint64)), axis=1)
        pair, times = np.unique(pair, axis=0, return_counts=True) if len(pair) else (pair, np.empty(0, np.int64))
        # many holders of a shingle: each with the first one, as if they had enough in common
        large = np.flatnonzero((n > COUNTED)[of])
        star = np.stack((node[cut[of[large]]], node[large], size[cut[of[large]]].astype(np.uint64), size[large].astype(np.uint64)), axis=1)
        star = np.unique(star[star[:, 0] != star[:, 1]], axis=0)
        both = np.concatenate((pair, star)) if len(pair) else star
        return pa.table({
            **{k: signed(np.ascontiguousarray(both[:, i])) for i, k in enumerate(("a", "b", "na", "nb"))},
            "times": np.concatenate((times.astype(np.int64), np.full(len(star), COMMON, np.int64))),
        })

    blocks = table(map_groups(map_batches(docs, prefixes, "_b int, blob binary"), "_b", block, "a long, b long, na long, nb long, times long"), "blocks")
    low = F.least(F.lit(COMMON), F.ceil(F.least("na", "nb") * limit.num / limit.den))
    pairs = blocks.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.sum("times").alias("times"), F.min(F.least("na", "nb")).alias("na"), F.max(F.greatest("na", "nb")).alias("nb")).filter(F.col("times") >= low).select("a", "b")
    group = components(pairs)
    regions = table(group.select("node", F.col("component").alias("region")).union(group.select(F.col("component").alias("node"), F.col("component").alias("region")).distinct()).distinct(), "groups")
    drop_table(blocks)
    wanted = write_sorted(regions.select("node").distinct(), "points")
    free_shuffles(spark)

    def fetch(batches):
        for batch in batches:
            for part in pieces(batch):
                sets = shingle_sets(part, shingle)
                at, sig = own(part, sets)
                if len(at):
                    at = at[wanted.lookup(sig[at])[0]]
                yield pa.RecordBatch.from_arrays([pa.array(signed(sig[at])), pa.array([sets[i].tobytes() for i in at], pa.binary())], names=["node", "shingles"])

    store = write_sorted(map_batches(docs, fetch, "node long, shingles binary"), "sets")

    def of(node) -> np.ndarray:
        return np.frombuffer(store.blobs(np.uint64(int(node) & ((1 << 64) - 1)), "shingles"), dtype=np.uint64)

    t = 1 - limit.num / limit.den
    links: list[DataFrame] = []
    dense: list[DataFrame] = []
    regions = regions.withColumn("own", F.lit(True))
    small = []
    while True:
        sized = regions.join(regions.groupBy("region").agg(F.count(F.lit(1)).alias("n")), "region")
        small.append(sized.filter(F.col("n") <= REGION).select("region", "node", "own"))
        large = table(sized.filter(F.col("n") > REGION), "large")
        if large.isEmpty():
            break
        drawn = [F.min(F.when(F.col("own"), F.struct(F.xxhash64("node", F.lit(i)).alias("h"), F.col("node").alias("p")))).alias(f"p{i}") for i in range(PIVOTS)]
        pivots = large.groupBy("region").agg(*drawn).select("region", F.array_sort(F.array_distinct(F.array(*[F.col(f"p{i}.p") for i in range(PIVOTS)]))).alias("p"))
        pivots = write_sorted(pivots.select("region", F.unhex(F.array_join(F.transform("p", lambda x: F.lpad(F.hex(x), 16, "0")), "")).alias("p")), "pivots")

        def assign(batches, pivots=pivots):
            held: dict = {}
            for batch in batches:
                region, node, mine, count = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("region", "node", "own", "n"))
                rows = {k: [] for k in ("region", "node", "own", "d", "a", "n", "of")}
                for r in np.unique(region):
                    at = np.flatnonzero(region == r)
                    if r not in held:
                        if len(held) > 64:
                            held.clear()
                        names = np.frombuffer(pivots.blobs(np.uint64(int(r) & ((1 << 64) - 1)), "p"), dtype=">i8").astype(np.int64)
                        held[r] = names, [of(x) for x in names]
                    names, own_sets = held[r]
                    for lo in range(0, len(at), 512):
                        x = at[lo : lo + 512]
                        sets = [of(v) for v in node[x]]
                        common = overlaps(own_sets, sets).astype(np.int64)
                        size, sizes = np.array([len(v) for v in own_sets])[:, None], np.array([len(v) for v in sets])[None, :]
                        d = distances(common, size, sizes)
                        nearest, least = d.argmin(axis=0), d.min(axis=0)
                        for k, p in enumerate(names.tolist()):
                            to = np.flatnonzero(d[k] - least <= 2 * t + 1e-9)
                            new = signed(combine([np.array([r], np.int64).view(np.uint64), np.array([p], np.int64).view(np.uint64)], seed=5))[0]
                            for key, v in (("region", np.full(len(to), new)), ("node", node[x][to]), ("own", (mine[x] & (nearest == k))[to]), ("d", d[k][to]), ("a", np.full(len(to), p)), ("n", count[x][to]), ("of", np.full(len(to), r))):
                                rows[key].append(v)
                            hit = np.flatnonzero(limit.links(common[k], size[k], sizes[0]) & (node[x] != p))
                            for key, v in (("region", np.zeros(len(hit), np.int64)), ("node", node[x][hit]), ("own", np.zeros(len(hit), bool)), ("d", d[k][hit]), ("a", np.full(len(hit), p)), ("n", np.zeros(len(hit), np.int64)), ("of", np.full(len(hit), r))):
                                rows[key].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(v)) for v in rows.values()], names=list(rows))

        made = table(map_batches(large.repartition(n_b, "region", F.pmod(F.xxhash64("node"), F.lit(n_b))), assign, "region long, node long, own boolean, d double, a long, n long, of long"), "regions")
        links.append(made.filter("n = 0").select("a", F.col("node").alias("b"), "d"))
        parts = made.filter("n > 0")
        sizes = table(parts.groupBy("of", "region").agg(F.count(F.lit(1)).alias("m"), F.max("n").alias("n")), "sizes")
        worth = sizes.groupBy("of").agg((F.sum(F.col("m").cast("double") * F.col("m")) <= CUTS * F.max(F.col("n").cast("double") * F.col("n"))).alias("worth"))
        kept = sizes.join(worth, "of").select("region", (~F.col("worth") & (F.col("m") > REGION)).alias("stuck"))
        parts = table(parts.join(kept, "region"), "cut")
        dense.append(parts.filter("stuck").select(F.col("region").alias("a"), F.col("node").alias("b"), "d", (F.col("d") <= t + 1e-9).alias("ok")))
        regions = parts.filter("not stuck").select("region", "node", "own")

    def join(group: pa.Table) -> pa.Table:
        region, node, mine = (group.column(c).to_numpy() for c in ("region", "node", "own"))
        order = np.argsort(region, kind="stable")
        region, node, mine = region[order], node[order], mine[order]
        a, b, d = [], [], []
        for lo, hi in zip(*(lambda c: (c, np.append(c[1:], len(region))))(np.flatnonzero(np.diff(region, prepend=~region[:1]))), strict=True):
            found = join_region([of(x) for x in node[lo:hi]], mine[lo:hi], limit)
            if found:
                i, j, x = (np.array(v) for v in zip(*found, strict=True))
                i, j = node[lo:hi][i], node[lo:hi][j]
                keep = forest(i, j) if spanning else np.ones(len(i), bool)
                a.append(i[keep]), b.append(j[keep]), d.append(x[keep])
        empty = [np.empty(0, np.int64)] * 2 + [np.empty(0)]
        return pa.table(dict(zip("abd", (np.concatenate(x) if x else e for x, e in zip((a, b, d), empty, strict=True)), strict=True)))

    few = small[0]
    for x in small[1:]:
        few = few.union(x)
    met = map_groups(few.withColumn("_b", F.pmod(F.xxhash64("region"), F.lit(8 * n_b))), "_b", join, "a long, b long, d double")
    if not dense:
        return points, table(met, "links")
    spread = dense[0]
    for x in dense[1:]:
        spread = spread.union(x)
    spread = table(spread.select("a", "b", "d", F.when(F.col("ok"), 0).otherwise(F.greatest(F.lit(1), F.ceil(F.col("d") / t - 1e-9) - 1)).cast("int").alias("ring")), "spread")
    # cells: a ring's points are dealt by hash, and two cells meet in one task if their rings are one or adjoin
    dealt = spread.join(spread.groupBy("a", "ring").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("m")), ["a", "ring"]).withColumn("c", F.pmod(F.xxhash64("b"), F.col("m")).cast("int"))
    rings = dealt.select("a", "ring", "m").distinct()
    beyond = rings.select("a", (F.col("ring") - 1).alias("ring"), F.col("m").alias("next"))
    before = rings.select("a", (F.col("ring") + 1).alias("ring"), F.col("m").alias("prev"))
    dealt = dealt.join(beyond, ["a", "ring"], "left").join(before, ["a", "ring"], "left")
    one = F.filter(F.sequence(F.lit(0), F.col("m") - 1), lambda k: F.col("ring") > 0)
    inside = F.transform(one, lambda k: F.struct(F.col("ring").alias("r"), F.least("c", k).alias("i"), F.col("ring").alias("s"), F.greatest("c", k).alias("j")))
    up = F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda k: F.struct(F.col("ring").alias("r"), F.col("c").alias("i"), (F.col("ring") + 1).alias("s"), k.alias("j")))
    down = F.transform(F.sequence(F.lit(0), F.col("prev") - 1), lambda k: F.struct((F.col("ring") - 1).alias("r"), k.alias("i"), F.col("ring").alias("s"), F.col("c").alias("j")))
    none = F.array().cast("array<struct<r:int,i:int,s:int,j:int>>")
    tasks = dealt.select("a", "b", "ring", "c", F.explode(F.concat(inside, F.coalesce(up, none), F.coalesce(down, none))).alias("x")).select("a", "b", "ring", "c", "x.*")

    def cells(group: pa.Table) -> pa.Table:
        r, i, s, j = (group.column(k)[0].as_py() for k in "risj")
        ring, c, node = (group.column(k).to_numpy() for k in ("ring", "c", "b"))
        left, right = np.unique(node[(ring == r) & (c == i)]), np.unique(node[(ring == s) & (c == j)])
        out_a, out_b, out_d = [], [], []
        if len(left) and len(right):
            sets_l, sets_r = [of(x) for x in left], [of(x) for x in right]
            na, nb = np.array([len(x) for x in sets_l]), np.array([len(x) for x in sets_r])
            common = overlaps(sets_l, sets_r).astype(np.int64)
            x, y = np.nonzero(limit.links(common, na[:, None], nb[None, :]))
            keep = left[x] != right[y]
            x, y = x[keep], y[keep]
            if spanning:
                keep = forest(left[x], right[y])
                x, y = x[keep], y[keep]
            out_a, out_b, out_d = left[x], right[y], 1 - common[x, y] / (na[x] + nb[y] - common[x, y])
        return pa.table({"a": pa.array(out_a, pa.int64()), "b": pa.array(out_b, pa.int64()), "d": pa.array(out_d, pa.float64())})

    met = met.union(tasks.groupBy("a", "r", "i", "s", "j").applyInArrow(cells, "a long, b long, d double"))
    for x in links:
        met = met.union(x)
    return points, table(met, "links")


def jaccard_components(docs: DataFrame, shingle: int = 3, limit: Threshold | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable)."""
    points, links = jaccard_links(docs, shingle, limit, text, doc_id)
    comp = components(links.select("a", "b"))
    low = points.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("low"))
    joined = low.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node"))
    ids = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    nodes = joined.join(ids, "component").select("node", "component_id")
    return points.join(nodes, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
