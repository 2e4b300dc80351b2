"""Sorted hash arrays in the shared folder, one file for each range of hashes, mapped into memory by workers.

A worker pages in what it looks up and nothing else, so such a table may outgrow any machine's memory;
unlike a broadcast it is never copied to the driver or whole to the executors. The driver keeps how many
keys each range has; a file that should be there and isn't is an error, never an empty answer.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import array_folder, load_array, map_groups, n_buckets, save_array

#: Files that a worker holds open at once.
MOST_OPEN = 512


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """Which of n equal ranges of 64-bit hashes."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int32)


def bucket_col(key, n: int):
    return (F.shiftrightunsigned(key, 32) * F.lit(n) / F.lit(1 << 32)).cast("int")


class Open:
    """The files that a worker holds open, the longest unused ones closed first. Goes to workers empty."""

    def __init__(self):
        self._files: OrderedDict[str, np.ndarray] = OrderedDict()

    def __getstate__(self):
        return {}

    def __setstate__(self, _):
        self._files = OrderedDict()

    def get(self, path: str) -> np.ndarray:
        a = self._files.get(path)
        if a is None:
            a = self._files[path] = load_array(path)
            if len(self._files) > MOST_OPEN:
                self._files.popitem(last=False)
        else:
            self._files.move_to_end(path)
        return a


def write_sorted(df: DataFrame, what: str, buckets: int | None = None) -> "Sorted":
    """df: key long, and any number of long or binary columns. One row of a key is kept where there are several."""
    folder, n, names = array_folder(df.sparkSession, what), buckets or n_buckets(df.sparkSession), df.columns[1:]
    kinds = dict(df.dtypes)

    def write(group: pa.Table) -> pa.Table:
        b = group.column("_b")[0].as_py()
        key = group.column("_k").to_numpy().view(np.uint64)
        key, at = np.unique(key, return_index=True)
        save_array(f"{folder}/{b}.key.npy", key)
        for c in names:
            col = group.column(c).combine_chunks()
            if kinds[c] == "binary":
                col = col.cast(pa.large_binary()).take(pa.array(at))
                offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
                save_array(f"{folder}/{b}.{c}.at.npy", offs - offs[0])
                save_array(f"{folder}/{b}.{c}.npy", np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offs[0] : offs[-1]])
            else:
                save_array(f"{folder}/{b}.{c}.npy", col.to_numpy()[at])
        return pa.table({"b": pa.array([b], pa.int32()), "n": pa.array([len(key)], pa.int64())})

    rows = df.withColumnRenamed(df.columns[0], "_k").withColumn("_b", bucket_col(F.col("_k"), n))
    sizes = np.zeros(n, dtype=np.int64)
    for r in map_groups(rows, "_b", write, "b int, n long").collect():  # one row for each bucket
        sizes[r["b"]] = r["n"]
    return Sorted(folder, sizes, {c: kinds[c] == "binary" for c in names})


class Sorted:
    """A reader; goes to workers by its few fields. sizes: the keys of each bucket."""

    def __init__(self, folder: str, sizes: np.ndarray, columns: dict[str, bool]):
        self.folder, self.sizes, self.columns, self.open = folder, sizes, columns, Open()
        self.n, self.size = len(sizes), int(sizes.sum())

    def part(self, b: int, name: str = "key") -> np.ndarray:
        return self.open.get(f"{self.folder}/{b}.{name}.npy")

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, bucket, row in the bucket) of each key."""
        found, bucket, place = np.zeros(len(keys), dtype=bool), bucket_of(keys, self.n), np.zeros(len(keys), dtype=np.int64)
        order = np.argsort(keys)
        cuts = np.searchsorted(bucket[order], np.arange(self.n + 1))
        for b in np.flatnonzero((np.diff(cuts) > 0) & (self.sizes > 0)):
            own = self.part(int(b))
            rows = order[cuts[b] : cuts[b + 1]]
            at = np.minimum(np.searchsorted(own, keys[rows]), len(own) - 1)
            found[rows], place[rows] = own[at] == keys[rows], at
        return found, bucket, place

    def lookup(self, keys: np.ndarray, columns: list[str] | None = None) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """(found, values): values of the long columns at the found keys, in their order."""
        want = [c for c in (columns if columns is not None else self.columns) if not self.columns[c]]
        found, bucket, place = self.places(keys)
        at = np.flatnonzero(found)
        values = {c: np.zeros(len(at), dtype=np.int64) for c in want}
        if want:
            b = bucket[at]
            for x in np.unique(b).tolist():
                rows = np.flatnonzero(b == x)
                for c in want:
                    values[c][rows] = self.part(x, c)[place[at[rows]]]
        return found, values

    def blobs(self, key: np.uint64, column: str) -> bytes:
        """The binary value of a key that is there."""
        b = int(bucket_of(np.array([key], dtype=np.uint64), self.n)[0])
        own = self.part(b)
        i = int(np.searchsorted(own, key))
        if i == len(own) or own[i] != key:
            raise KeyError(f"{int(key)} is not in {self.folder}")
        at = self.part(b, f"{column}.at")
        return self.part(b, column)[at[i] : at[i + 1]].tobytes()
