"""Exact deduplication with a cuckoo-filter index of live digests.

A row's digest is 64 bits of its text. The filter answers whether a digest may be live; a hit is verified
against the content that is kept in the digest's bucket: the SHA-256 and the length of the text. When a row
with a larger doc_id arrives, the live one's digest is deleted and the new one's inserted. A filter that
overflows is rebuilt at twice the size from the keys that the index has stored.

Each task first runs an index over its own rows, so a text with a third of all rows costs one row for each
task; the tasks' survivors are dealt by digest to shards, which run the same index.

Defined results: null text counts as empty; a null doc_id loses to any other (keep_id is null if all are
null); rows repeated with the same id and text are all marked kept; other columns are ignored.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import bucket_col
from ._spark import map_batches, map_groups, n_buckets

SLOTS, MAX_KICKS = 4, 200
_M = (1 << 64) - 1


class CuckooFilter:
    """Partial-key cuckoo hashing: 16-bit fingerprints, four to a bucket, two buckets for each digest."""

    def __init__(self, capacity: int):
        n = 2
        while n * SLOTS * 0.9 < capacity:
            n *= 2
        self.n, self.size, self._rng = n, 0, random.Random(n)
        self.buckets: list[list[int]] = [[] for _ in range(n)]

    def _place(self, digest: int) -> tuple[int, int]:
        """Fingerprint and bucket, of bits that are mixed anew: a shard's digests have their first bits in common."""
        x = (digest ^ (digest >> 33)) * 0xFF51AFD7ED558CCD & _M
        x = (x ^ (x >> 33)) * 0xC4CEB9FE1A85EC53 & _M
        x ^= x >> 33
        return (x >> 48) or 1, x & (self.n - 1)

    def _other(self, i: int, print_: int) -> int:
        return i ^ (((print_ * 0x5BD1E995) >> 3) & (self.n - 1))

    def __contains__(self, digest: int) -> bool:
        p, i = self._place(digest)
        return p in self.buckets[i] or p in self.buckets[self._other(i, p)]

    def insert(self, digest: int) -> bool:
        """False if it has no room; the filter then misses a fingerprint and must be rebuilt."""
        p, i = self._place(digest)
        j = self._other(i, p)
        for k in (i, j):
            if len(self.buckets[k]) < SLOTS:
                self.buckets[k].append(p)
                self.size += 1
                return True
        k = self._rng.choice((i, j))
        for _ in range(MAX_KICKS):
            at = self._rng.randrange(SLOTS)
            p, self.buckets[k][at] = self.buckets[k][at], p
            k = self._other(k, p)
            if len(self.buckets[k]) < SLOTS:
                self.buckets[k].append(p)
                self.size += 1
                return True
        return False

    def delete(self, digest: int) -> bool:
        p, i = self._place(digest)
        for k in (i, self._other(i, p)):
            if p in self.buckets[k]:
                self.buckets[k].remove(p)
                self.size -= 1
                return True
        return False


class CuckooIndex:
    """Live texts: the filter in front, and for each digest a bucket of (content, value)."""

    def __init__(self, capacity: int = 64):
        self.filter, self.content, self.resizes = CuckooFilter(capacity), {}, 0

    def find(self, digest: int, content):
        if digest not in self.filter:
            return None
        return next((e for e in self.content.get(digest, ()) if e[0] == content), None)

    def insert(self, digest: int, content, value) -> None:
        self.content.setdefault(digest, []).append([content, value])
        if not self.filter.insert(digest):
            self.resizes += 1
            self._rebuild(2 * self.filter.n * SLOTS)

    def _rebuild(self, capacity: int) -> None:
        while True:
            self.filter = CuckooFilter(capacity)
            # equal digests share fingerprint and buckets: more than eight can't be held, and one answers for all
            if all(self.filter.insert(d) for d, bucket in self.content.items() for _ in bucket[: 2 * SLOTS - 1]):
                return
            capacity *= 2

    def delete(self, digest: int, content) -> bool:
        bucket = self.content.get(digest, [])
        entry = next((e for e in bucket if e[0] == content), None)
        if entry is None:
            return False
        bucket.remove(entry)
        if not bucket:
            del self.content[digest]
        if len(bucket) < 2 * SLOTS - 1:
            self.filter.delete(digest)
        return True

    def offer(self, digest: int, content, value: tuple) -> None:
        """value: (rank, id, copies). The larger rank stays live and takes over the count."""
        live = self.find(digest, content)
        if live is None:
            self.insert(digest, content, value)
            return
        n = live[1][2] + value[2]
        if value[:1] > live[1][:1]:
            self.delete(digest, content)
            self.insert(digest, content, (*value[:2], n))
        else:
            live[1] = (*live[1][:2], n)

    def live(self):
        for digest, bucket in self.content.items():
            for content, value in bucket:
                yield digest, content, value


SCHEMA = "digest long, text_sha256 string, n_bytes long, keep_id long, copies long"
_ARROW = pa.schema([("digest", pa.int64()), ("text_sha256", pa.string()), ("n_bytes", pa.int64()), ("keep_id", pa.int64()), ("copies", pa.int64())])
#: Live texts that a task's own index holds before it hands them on and starts anew.
LOCAL_KEYS = 200_000


def _rows(index: CuckooIndex) -> pa.RecordBatch:
    out = [(d - (1 << 64) if d >> 63 else d, sha, n, i, copies) for d, (sha, n), (_, i, copies) in index.live()]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out) if out else [[]] * 5, _ARROW, strict=True)], schema=_ARROW)


def _run(batches, most: int | None):
    index, n = CuckooIndex(), 0
    for batch in batches:
        for d, sha, size, i, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            index.offer(d & _M, (sha, size), (-1 << 63 if i is None else i, i, copies))
        if most and len(index.content) > most:
            yield _rows(index)
            index = CuckooIndex()
    yield _rows(index)


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each distinct text: digest, text_sha256, n_bytes, keep_id, copies."""
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.xxhash64(t).alias("digest"), F.sha2(t, 256).alias("text_sha256"), F.octet_length(t).cast("long").alias("n_bytes"), F.col(doc_id).cast("long").alias("keep_id"), F.lit(1).cast("long").alias("copies"))
    local = map_batches(rows, lambda it: _run(it, LOCAL_KEYS), SCHEMA)
    n = n_buckets(docs.sparkSession)

    def shard(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_run(group.drop_columns(["_b"]).to_batches(), None)), schema=_ARROW)

    return map_groups(local.withColumn("_b", bucket_col(F.col("digest"), n)), "_b", shard, SCHEMA)


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    groups = exact_groups(docs, text, doc_id).select("text_sha256", "keep_id", F.col("copies").alias("group_size"))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
    out = rows.join(groups, "text_sha256")
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
