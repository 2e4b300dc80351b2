"""Toxicity by a bidirectional gated recurrent network with attention pooling, over character and word inputs.

A word's input is a learned vector of its hash and what a network over its characters gives: filters slide over the
sequence of its bytes (with a mark before and behind) and the largest response of each is kept. Two gated recurrent
layers read a window of WINDOW words in either direction, attention pools their states, and a logistic unit scores
the window. Windows begin every STRIDE words, so they overlap, and the last one ends with the text: every expression
of up to WINDOW - STRIDE + 1 words lies whole in a window. A document has the logit of its most toxic window,
calibrated on documents that the training didn't see.

Training is in numpy (back-propagation through time, Adam), on at most MOST_ROWS labelled documents chosen by
the hash of doc_id, whose whole texts the driver reads. Labels are of documents. So the inputs are first trained by
themselves: one linear unit over the sum of a document's distinct words' inputs has to give its label. Then a document
stands for its highest scored windows, first those that the linear unit scores highest and then, chosen anew in every
round, those of the network. When scoring, inputs are projected once for each distinct word of a batch.

Defined results: null and empty texts have one window without words; without any label the score is 0; rows
without doc_id are scored and not learned from; rows may repeat; other columns are ignored or carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import Carried
from ._text import NOT_SPACE, U64, pieces, words
from ._train import Adam, calibrate, column, sample, sigmoid, unique_words

MOST_ROWS, WINDOW, STRIDE, HIDDEN = 3000, 24, 12, 8
#: Steps of word vectors while the inputs are trained by themselves, and after.
FIRST_RATE, RATE = 0.5, 0.3
#: Size of a word's learned vector, filters over characters and their width, hashed rows of word vectors.
DIM, FILTERS, WIDTH, WORD_ROWS = 8, 16, 4, 1 << 16
_BEGIN, _END, _SYMBOLS = 256, 257, 258


class Inputs:
    """The words of some texts: distinct ones with their characters, and windows over them."""

    def __init__(self, texts: pa.Array):
        w = words(texts, NOT_SPACE, lower=True)
        names, which, back = unique_words(w, w.hashes(0))
        self.words, self.first, self.names, self.back = w, w.first, names, back
        # each distinct word as a mark, its bytes and marks up to a whole filter; a filter begins at every place of it
        length = w.length[which]
        size = np.maximum(length + 2, WIDTH)
        at = np.cumsum(size) - size
        codes = np.full(int(size.sum()), _END, dtype=np.int32)
        codes[at] = _BEGIN
        inner = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        codes[np.repeat(at + 1, length) + inner] = w.buf[np.repeat(w.start[which], length) + inner]
        m = size - WIDTH + 1
        self.char_first = np.cumsum(m) - m
        self.codes, self.char_at = codes, np.repeat(at - self.char_first, m) + np.arange(int(m.sum()))
        n = np.diff(w.first)
        # starts every STRIDE words, the last window ends with the text
        m = np.maximum(-(-(n - WINDOW) // STRIDE), 0) + 1
        self.doc = np.repeat(np.arange(len(n)), m)
        inner = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        start = np.minimum(inner * STRIDE, np.maximum(n - WINDOW, 0)[self.doc])
        self.start, self.window_first = start, np.cumsum(m) - m
        at = start[:, None] + np.arange(WINDOW)
        self.mask = at < n[self.doc][:, None]
        flat = np.minimum(w.first[:-1][self.doc][:, None] + at, max(len(w) - 1, 0))
        self.index = np.where(self.mask, np.append(back, 0)[flat] if len(w) else 0, len(names))  # the last row is no word

    def window_text(self, i: int) -> str:
        """The words of a window, joined by spaces."""
        d = int(self.doc[i])
        lo = int(self.first[d]) + int(self.start[i])
        hi = min(lo + WINDOW, int(self.first[d + 1]))
        return b" ".join(self.words.bytes_of(k) for k in range(lo, hi)).decode()

    def word_rows(self) -> np.ndarray:
        return (self.names % U64(WORD_ROWS)).astype(np.int64)

    def presence(self) -> tuple[np.ndarray, np.ndarray]:
        """(document, distinct word) pairs."""
        pair = np.unique(self.words.doc() * (len(self.names) + 1) + self.back)
        return pair // (len(self.names) + 1), pair % (len(self.names) + 1)


class Model:
    def __init__(self, seed: int = 4):
        rng, h, d = np.random.default_rng(seed), HIDDEN, DIM + FILTERS
        f = lambda *s, k=1.0: (rng.normal(0, 1, s) * k).astype(np.float32)
        self.params = {"word": f(WORD_ROWS, DIM, k=0.05), "cb": f(FILTERS, k=0.0)} | {f"c{j}": f(_SYMBOLS, FILTERS, k=0.2) for j in range(WIDTH)}
        for way in "fb":
            self.params |= {f"x{way}": f(d, 3 * h, k=0.3), f"h{way}": f(h, 3 * h, k=0.3), f"b{way}": f(3 * h, k=0.0)}
        self.params |= {"aw": f(2 * h, h, k=0.3), "ab": f(h, k=0.0), "av": f(h, k=0.3), "ow": f(2 * h, k=0.3), "ob": f(1, k=0.0) - 1}
        self.linear = {"u": f(d, k=0.3), "v": f(1, k=0.0) - 1}
        self.temperature, self.bias, self.ready, self._pairs = 1.0, 0.0, False, None

    def __getstate__(self):
        return self.__dict__ | {"_pairs": None}

    def responses(self, x: Inputs) -> np.ndarray:
        """Of each filter at each place of the distinct words."""
        p = self.params
        return sum(p[f"c{j}"][x.codes[x.char_at + j]] for j in range(WIDTH)) + p["cb"]

    def pairs(self) -> list[np.ndarray]:
        """The filters' tables by two characters: half as many lookups when scoring."""
        if self._pairs is None:
            p = self.params
            self._pairs = [(p[f"c{j}"][:, None, :] + p[f"c{j + 1}"][None, :, :]).reshape(-1, FILTERS) for j in range(0, WIDTH, 2)]
            self._pairs[0] = self._pairs[0] + p["cb"]
        return self._pairs

    def embed(self, x: Inputs) -> np.ndarray:
        """Inputs of the distinct words, and of no word."""
        out = np.zeros((len(x.names) + 1, DIM + FILTERS), dtype=np.float32)
        out[:-1, :DIM] = self.params["word"][x.word_rows()]
        step = 1 << 15  # words
        two = x.codes[:-1] * _SYMBOLS + x.codes[1:] if self.ready and len(x.codes) else None
        for lo in range(0, len(x.names), step):
            hi = min(lo + step, len(x.names))
            a, b = x.char_first[lo], x.char_first[hi] if hi < len(x.names) else len(x.char_at)
            at = x.char_at[a:b]
            if two is None:
                r = sum(self.params[f"c{j}"][x.codes[at + j]] for j in range(WIDTH)) + self.params["cb"]
            else:
                r = np.take(self.pairs()[0], two[at], axis=0)
                for k, t in enumerate(self.pairs()[1:], 1):
                    r += np.take(t, two[at + 2 * k], axis=0)
            out[lo:hi, DIM:] = np.maximum(np.maximum.reduceat(r, x.char_first[lo:hi] - a), 0)
        return out

    def back_inputs(self, x: Inputs, demb: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of word vectors and filters, from those of the inputs."""
        p, g = self.params, {"word": np.zeros_like(self.params["word"]), "cb": np.zeros(FILTERS, np.float32)} | {f"c{j}": np.zeros((_SYMBOLS, FILTERS), np.float32) for j in range(WIDTH)}
        np.add.at(g["word"], x.word_rows(), demb[:, :DIM])
        if len(x.names):
            r = self.responses(x)
            best = np.maximum.reduceat(r, x.char_first)
            owner = np.repeat(np.arange(len(x.names)), np.diff(np.append(x.char_first, len(x.char_at))))
            hit = (r == best[owner]) & (r > 0)
            at, k = np.nonzero(hit)
            _, once = np.unique(owner[at] * FILTERS + k, return_index=True)
            at, k = at[once], k[once]
            d = demb[owner[at], DIM + k]
            for j in range(WIDTH):
                np.add.at(g[f"c{j}"], (x.codes[x.char_at[at] + j], k), d)
            g["cb"] = np.bincount(k, weights=d, minlength=FILTERS).astype(np.float32)
        return g

    def run(self, emb: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: bool = False):
        """Logits of windows; with keep, also what back-propagation needs."""
        n, t, h, p = len(index), WINDOW, HIDDEN, self.params
        states, tape = np.zeros((t, n, 2 * h), np.float32), {}
        whole = bool(mask.all())
        for w, way in enumerate("fb"):
            a = emb @ p[f"x{way}"] + p[f"b{way}"]
            s, u = np.zeros((n, h), np.float32), p[f"h{way}"]
            steps = range(t) if way == "f" else range(t - 1, -1, -1)
            for k in steps:
                x = a[index[:, k]]
                y = s @ u
                rz = sigmoid(x[:, : 2 * h] + y[:, : 2 * h])
                r, z = rz[:, :h], rz[:, h:]
                c = np.tanh(x[:, 2 * h :] + r * y[:, 2 * h :])
                new = c + z * (s - c)
                if not whole:
                    new = np.where(mask[:, k : k + 1], new, s)
                if keep:
                    tape[way, k] = (s, r, z, c, y[:, 2 * h :])
                s = new
                states[k, :, w * h : (w + 1) * h] = s
        e = np.tanh(states @ p["aw"] + p["ab"])
        g = e @ p["av"]
        g = np.where(mask.T, g, -1e9) if not whole else g
        alpha = np.exp(g - g.max(axis=0))
        alpha = alpha * mask.T / np.maximum((alpha * mask.T).sum(axis=0), 1e-9)
        pooled = np.einsum("tn,tnh->nh", alpha, states)
        logit = pooled @ p["ow"] + p["ob"]
        return (logit, (states, tape, e, alpha, pooled)) if keep else logit

    def back(self, x: Inputs, emb, index, mask, y: np.ndarray) -> dict[str, np.ndarray]:
        logit, (states, tape, e, alpha, pooled) = self.run(emb, index, mask, keep=True)
        p, h, n = self.params, HIDDEN, len(index)
        d = ((sigmoid(logit) - y) / n).astype(np.float32)
        g = {"ow": pooled.T @ d, "ob": d.sum(keepdims=True)}
        dp = d[:, None] * p["ow"]
        da = np.einsum("nh,tnh->tn", dp, states)
        dg = alpha * (da - (alpha * da).sum(axis=0))
        g["av"] = np.einsum("tn,tnh->h", dg, e)
        de = dg[:, :, None] * p["av"] * (1 - e**2)
        g["aw"], g["ab"] = np.einsum("tni,tnj->ij", states, de), de.sum(axis=(0, 1))
        ds = alpha[:, :, None] * dp + de @ p["aw"].T
        demb = np.zeros_like(emb)
        for w, way in enumerate("fb"):
            u, xw = p[f"h{way}"], p[f"x{way}"]
            gu, gx, gb = np.zeros_like(u), np.zeros_like(xw), np.zeros(3 * h, np.float32)
            carry = np.zeros((n, h), np.float32)
            for k in range(WINDOW - 1, -1, -1) if way == "f" else range(WINDOW):
                s, r, z, c, yn = tape[way, k]
                dh = carry + ds[k][:, w * h : (w + 1) * h]
                m = mask[:, k : k + 1]
                live = dh * m
                dc = live * (1 - z) * (1 - c**2)
                dz = live * (s - c) * z * (1 - z)
                dr = dc * yn * r * (1 - r)
                pre = np.concatenate((dr, dz, dc), axis=1)
                rec = np.concatenate((dr, dz, dc * r), axis=1)
                gu += s.T @ rec
                xs = emb[index[:, k]]
                gx += xs.T @ pre
                gb += pre.sum(axis=0)
                np.add.at(demb, index[:, k], pre @ xw.T)
                carry = live * z + rec @ u.T + dh * ~m
            g[f"h{way}"], g[f"x{way}"], g[f"b{way}"] = gu, gx, gb
        return g | self.back_inputs(x, demb[:-1])

    def move_words(self, g: np.ndarray, rate: float) -> None:
        """Plain steps: a word moves by how often it is met, so one that few documents have stays near where it was."""
        self.params["word"] -= np.float32(rate) * g

    def train_inputs(self, texts: list[str], y: np.ndarray, epochs: int, rng) -> None:
        """Word vectors and filters, so that the sum over a document's distinct words tells its label."""
        adam = Adam({k: self.params[k] for k in ("cb", *(f"c{j}" for j in range(WIDTH)))} | self.linear, 0.005)
        order = rng.permutation(len(y))
        batches = [(Inputs(column([texts[i] for i in order[lo : lo + 64]])), y[order[lo : lo + 64]]) for lo in range(0, len(order), 64)]
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                x, label = batches[b]
                emb, (doc, word) = self.embed(x)[:-1], x.presence()
                scale = (1 / np.sqrt(np.maximum(np.bincount(doc, minlength=len(label)), 1))).astype(np.float32)
                s = emb @ self.linear["u"]
                z = np.bincount(doc, weights=s[word], minlength=len(label)) * scale + self.linear["v"]
                d = ((sigmoid(z) - label) * scale / len(label)).astype(np.float32)
                ds = np.bincount(word, weights=d[doc], minlength=len(emb)).astype(np.float32)
                g = self.back_inputs(x, ds[:, None] * self.linear["u"])
                self.move_words(g.pop("word"), FIRST_RATE)
                adam.step(g | {"u": emb.T @ ds, "v": np.array([(sigmoid(z) - label).mean()], np.float32)})

    def window_logits(self, x: Inputs, emb: np.ndarray | None = None) -> np.ndarray:
        emb = self.embed(x) if emb is None else emb
        step = 768
        return np.concatenate([self.run(emb, x.index[i : i + step], x.mask[i : i + step]) for i in range(0, len(x.index), step)])

    def doc_logits(self, texts: pa.Array) -> np.ndarray:
        x = Inputs(texts)
        return np.maximum.reduceat(self.window_logits(x), x.window_first)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not self.ready:
            return np.zeros(len(texts))
        return sigmoid(self.doc_logits(texts).astype(np.float64) / self.temperature + self.bias)


def fit_texts(texts: list[str], y: np.ndarray, rounds: int = 3, epochs: int = 3, alone: int = 8) -> Model:
    """alone: epochs in which the inputs are trained by themselves."""
    model = Model()
    y = y.astype(np.int64)
    if not len(y):
        return model
    rng = np.random.default_rng(9)
    order = rng.permutation(len(y))
    aside, use = np.split(order, [len(y) // 5])
    model.train_inputs([texts[i] for i in use], y[use], alone, rng)
    adam = Adam({k: v for k, v in model.params.items() if k != "word"}, 0.01)
    for r in range(rounds):
        chosen: list[str] = []
        labels: list[int] = []
        for own in (use[i : i + 200] for i in range(0, len(use), 200)):
            x = Inputs(column([texts[i] for i in own]))
            emb = model.embed(x)
            rank = (emb @ model.linear["u"])[x.index].max(axis=1) if r == 0 else model.window_logits(x, emb)
            for d, lo in enumerate(x.window_first):
                hi = x.window_first[d + 1] if d + 1 < len(x.window_first) else len(rank)
                best = (lo + np.argsort(-rank[lo:hi], kind="stable")[: 1 if y[own[d]] else 2]).tolist()
                best += [] if y[own[d]] else [int(rng.integers(lo, hi))]
                chosen += [x.window_text(w) for w in best]
                labels += [int(y[own[d]])] * len(best)
        # toxic windows are few: they are met more often, and calibration puts the scale right
        pos, neg = np.flatnonzero(np.array(labels) == 1), np.flatnonzero(np.array(labels) == 0)
        order = rng.permutation(np.concatenate((np.repeat(pos, max(1, min(4, len(neg) // max(1, 2 * len(pos))))), neg)))
        batches = []
        for lo in range(0, len(order), 128):
            i = order[lo : lo + 128]
            batches.append((Inputs(column([chosen[k] for k in i])), np.array(labels)[i]))
        for _ in range(epochs):
            for g in rng.permutation(len(batches)):
                x, label = batches[g]
                g = model.back(x, model.embed(x), x.index, x.mask, label)
                model.move_words(g.pop("word"), RATE)
                adam.step(g)
    model.ready = True
    z = np.concatenate([model.doc_logits(column([texts[i] for i in aside[j : j + 200]])) for j in range(0, len(aside), 200)]) if len(aside) > 20 else None
    if z is not None:
        model.temperature, model.bias = calibrate(z.astype(np.float64), y[aside])
    return model


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_ROWS) -> Model:
    return fit_texts(*sample(docs, labels, label, most))


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns and score."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "_scan", 1 << 20):
                yield [*part.columns[:-1], pa.array(model.scores(part.column("_scan")), pa.float64())]

    return Carried(docs, keep, F.col(text).alias("_scan")).run(run, "score double")
