"""Byte-level tokenising and hashing, vectorised over Arrow string columns.

All word classes used here are bounded by ASCII bytes, so UTF-8 text can be split on its bytes.
Word hashes are 64-bit polynomial hashes over randomly tabulated bytes, finished with a mixer;
callers that need certainty carry two of them (128 bits).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
_rng = np.random.default_rng(20240229)
BYTE_CODES = _rng.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1)
#: Largest piece of text, in bytes, that is tokenised at once (one document at least).
CHUNK_BYTES = 1 << 18


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(out, dtype=np.uint64)


_POWERS = [_powers(b, 4096) for b in _BASES]


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser; x is not changed."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def table(pattern_bytes: set[int], invert: bool = True) -> np.ndarray:
    """256 booleans: which bytes belong to words. With invert, the given ones don't."""
    out = np.zeros(256, dtype=bool)
    out[list(pattern_bytes)] = True
    return ~out if invert else out


#: [^\x20\x09-\x0D]+
NOT_SPACE = table({0x20, *range(0x09, 0x0E)})
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ , after A-Z went to lower case
ALNUM = table({*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


@dataclass
class Words:
    """Words of some documents: starts and lengths in buf; first[d]:first[d + 1] are those of document d."""

    buf: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    def __len__(self) -> int:
        return len(self.start)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, which: int = 0) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, dtype=np.uint64)
        longest = int(self.length.max())
        if longest > len(_POWERS[which]):
            _POWERS[which] = _powers(_BASES[which], 2 * longest)
        at = np.concatenate(([0], np.cumsum(self.length)[:-1]))
        inner = np.arange(int(self.length.sum())) - np.repeat(at, self.length)
        codes = BYTE_CODES[which][self.buf[inner + np.repeat(self.start, self.length)]]
        with np.errstate(over="ignore"):
            codes *= _POWERS[which][inner]
            sums = np.add.reduceat(codes, at)
            return mix(sums + self.length.astype(np.uint64))

    def bytes_of(self, i: int) -> bytes:
        s = int(self.start[i])
        return self.buf[s : s + int(self.length[i])].tobytes()


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls have no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0 or offsets is None:
        return np.empty(0, dtype=np.uint8), np.zeros(n + 1, dtype=np.int64)
    offs = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, dtype=np.uint8)
    return buf, offs - offs[0]


def words(column: pa.Array, kind: np.ndarray = NOT_SPACE, lower: bool = False) -> Words:
    buf, offs = text_buffers(column)
    if lower:
        buf = LOWER[buf]
    n = len(buf)
    inside = kind[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = inside[:-1]
    before &= ~edge[:n]
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, dtype=bool)
    after[:-1] = inside[1:]
    after &= ~edge[1:]
    end = np.flatnonzero(inside & ~after) + 1
    return Words(buf, start, end - start, np.searchsorted(start, offs))


def pieces(batch: pa.RecordBatch, text: str = "text", most: int = CHUNK_BYTES):
    """Slices of a batch of at most so many bytes of text, or of one row."""
    n = batch.num_rows
    if not n:
        return
    _, offs = text_buffers(batch.column(batch.schema.get_field_index(text)))
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield batch.slice(i, j - i)
        i = j


def combine(parts: list[np.ndarray], seed: int = 0) -> np.ndarray:
    """One hash of each tuple of hashes."""
    with np.errstate(over="ignore"):
        out = np.full(len(parts[0]), 0x243F6A8885A308D3 + seed, dtype=np.uint64)
        for p in parts:
            out = (out * U64(0x9E3779B97F4A7C15)) ^ p
            out = mix(out)
    return out


def grams(h: np.ndarray, first: np.ndarray, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word sequences that lie in one document, and the word each begins at."""
    if len(h) < n:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    ok = np.ones(len(h) - n + 1, dtype=bool)
    for cut in first[1:-1]:
        ok[max(0, cut - n + 1) : cut] = False
    at = np.flatnonzero(ok)
    return combine([h[at + k] for k in range(n)], seed), at


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
