"""SentencePiece BPE encoding and decoding with a prefix table.

A sequence of pieces is the merge result of its text exactly if each two neighbours are the merge result of
theirs: a merge across a seam would also happen with only the two pieces beside it. So for every prefix of a
word there is one last piece: among the pieces that end there (an Aho-Corasick automaton finds them), the one
that is compatible with the last piece of the prefix before it. The table holds that piece for every prefix;
the ids are read off backwards. No merges are replayed over the text, so the time is linear in it.

Texts are cut where no piece of the vocabulary reaches across: before a space mark that follows another
character, and around characters that the vocabulary doesn't have, which become byte pieces.

Defined results: null text is empty, and gives the begin and end ids alone; rows may repeat; other columns are ignored or carried.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Carried
from ._text import pieces

SPACE = "▁"
FAR = float("inf")


class Codec:
    """One for each worker. path: a .model file of the BPE kind with byte fallback and identity normaliser."""

    #: Words whose ids are kept (two such generations), and pairs of pieces whose compatibility is: about 50 MB each.
    MOST_WORDS, MOST_PAIRS = 100_000, 400_000
    #: Words that stay from task to task, about 8 MB.
    KEPT_WORDS = 30_000

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bos, self.eos, self.size = sp.bos_id(), sp.eos_id(), n
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        self.normal = {p: i for i, p in enumerate(self.pieces) if not (sp.is_control(i) or sp.is_byte(i) or sp.is_unknown(i))}
        self.rank = {i: -sp.get_score(i) for i in self.normal.values()}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        byte_of = {i: b for b, i in self.byte_id.items()}
        self.out = [b"" if sp.is_control(i) else bytes([byte_of[i]]) if i in byte_of else self.pieces[i].replace(SPACE, " ").encode() for i in range(n)]
        for i in range(n):
            if sp.is_unknown(i):
                self.out[i] = " ⁇ ".encode()
        self.out_len = np.array([len(b) for b in self.out], dtype=np.int64)
        self.out_at = np.concatenate(([0], np.cumsum(self.out_len)))[:-1]
        self.out_all = np.frombuffer(b"".join(self.out), dtype=np.uint8)
        self.known = {c for p in self.normal for c in p}
        assert all(SPACE not in p.lstrip(SPACE) for p in self.normal), "a piece reaches over a space"
        self.auto = ahocorasick.Automaton()
        for p, i in self.normal.items():
            self.auto.add_word(p, (i, len(p)))
        self.auto.make_automaton()
        self.cut = re.compile(f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n")
        self.pairs: dict[int, bool] = {}
        self.histories: dict = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merge(self, text: str) -> tuple[list[int], list[tuple[float, str, str]]]:
        """Merges replayed step by step, of single pieces only: the ids, and for each merge its rank and what then stands first and last."""
        parts, steps = list(text), []
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = self.normal.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.rank[i] < best):
                    best, at = self.rank[i], k
            if best is None:
                return [self.normal.get(p, -1) for p in parts], steps
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            steps.append((best, parts[0], parts[-1]))

    def history(self, i: int):
        """(merges of piece i, first and last character), or None if its own text doesn't merge to it."""
        if i not in self.histories:
            text = self.pieces[i]
            ids, steps = self.merge(text)
            self.histories[i] = (steps, text[0], text[-1]) if ids == [i] else None
        return self.histories[i]

    def compatible(self, a: int, b: int) -> bool:
        """Does a's text followed by b's give just a and b? a: -1 for the start of a word.

        The merges of the two run side by side, the better rank first; they are compatible if no merge
        across the seam is ever the best at hand.
        """
        own = self.history(b)
        if own is None or a < 0:
            return own is not None
        left, right = self.histories[a], own
        steps_a, steps_b, last, first = left[0], right[0], left[2], right[1]
        n, m, i, j, get, rank = len(steps_a), len(steps_b), 0, 0, self.normal.get, self.rank
        while True:
            next_a = steps_a[i][0] if i < n else FAR
            next_b = steps_b[j][0] if j < m else FAR
            seam = get(last + first)
            if seam is not None and (r := rank[seam]) < next_a and r <= next_b:
                return False
            if i == n and j == m:
                return True
            if next_a <= next_b:
                last = steps_a[i][2]
                i += 1
            else:
                first = steps_b[j][1]
                j += 1

    def word_ids(self, word: str) -> list[int]:
        n = len(word)
        last, back = [-1] * (n + 1), [0] * (n + 1)  # of each prefix: its last piece, and that piece's length
        back[0] = 1
        end, size_of, pairs = 0, self.size, self.pairs
        for at, (i, size) in self.auto.iter(word):
            at += 1
            if at > end + 1:
                back[end + 1 : at] = [b or 1 for b in back[end + 1 : at]]  # characters the vocabulary doesn't have
            end = at - 1
            if back[at] or not back[at - size]:
                continue
            key = (last[at - size] + 1) * size_of + i
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = self.compatible(last[at - size], i)
            if ok:
                last[at], back[at] = i, size
        ids = []
        while n:
            i = last[n]
            if i < 0:
                ids.extend(self.byte_id[b] for b in reversed(word[n - 1].encode()))
                n -= 1
            else:
                ids.append(i)
                n -= back[n]
        ids.reverse()
        return ids

    def encode_bytes(self, text: str) -> bytes:
        """The ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if len(self.words) > self.MOST_WORDS:  # the words of the last generation stay at hand
            self.old, self.words = self.words, {}
        if len(self.pairs) > self.MOST_PAIRS:
            self.pairs.clear()
        words, get, old = self.words, self.words.get, self.old.get
        out = []
        for w in self.cut.findall(SPACE + text.replace(" ", SPACE)):
            got = get(w)
            if got is None:
                got = old(w)
                if got is None:
                    got = array("I", self.word_ids(w)).tobytes()
                if len(w) <= 40:
                    words[w] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> np.ndarray:
        ids = np.frombuffer(self.encode_bytes(text or ""), dtype="<u4")
        return np.concatenate(([self.bos] * begin, ids, [self.eos] * end)).astype("<u4")

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        size = self.out_len[ids]
        total = int(size.sum())
        if not total:
            return b""
        at = np.repeat(self.out_at[ids] - np.concatenate(([0], np.cumsum(size)[:-1])), size)
        at += np.arange(total)
        out = self.out_all[at].tobytes()
        first = ids[np.flatnonzero(size)[0]]
        return out[1:] if self.pieces[first][:1] == SPACE else out  # the space that encoding put in front

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def forget(path: str) -> None:
    """Most words that a codec has learned from texts go; those met first, which are frequent ones, and its tables stay for the worker's next task."""
    if path in _codecs:
        _codecs[path].words, _codecs[path].old = dict(islice(_codecs[path].words.items(), Codec.KEPT_WORDS)), {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


ENCODED = "ids binary, n_tokens long, decoded string"


def encode_decode(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, then ids (little-endian unsigned 32-bit, begin and end with them), n_tokens and decoded."""

    def run(batches):
        c = codec(model)
        try:
            for batch in batches:
                for part in pieces(batch, "_text", 1 << 20):
                    ids = [c.encode(t) for t in part.column("_text").to_pylist()]
                    yield [*part.columns[:-1], pa.array([i.tobytes() for i in ids], pa.binary()), pa.array([len(i) for i in ids], pa.int64()), pa.array([c.decode(i) for i in ids], pa.string())]
        finally:
            forget(model)

    return Carried(docs, list(keep), F.col(text).alias("_text")).run(run, ENCODED)


def digests(encoded: DataFrame) -> DataFrame:
    return encoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()
