"""Plain Python versions of what the operators return, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def exact(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    out = []
    for i, t in rows:
        ids = [x for x in by[t or ""] if x is not None]
        keep = max(ids) if ids else None
        out.append((i, keep, len(by[t or ""]), i == keep, sha(t or "")))
    return out


def substrings(rows, size):
    """rows: (doc_id, text)."""
    inf = float("inf")
    toks = [(inf if i is None else i, SPACED.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in toks:
        for k in range(len(w) - size + 1):
            key = tuple(w[k : k + size])
            first[key] = min(first.get(key, inf), i)
    out = []
    for (i, w), (raw, _) in zip(toks, rows):
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone[k : k + size] = [True] * size
        out.append((raw, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def jaccard(rows, n=3, num=90, den=100):
    sets = []
    for _, t in rows:
        w = SPACED.findall(lower(t))
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            where[g].append(i)
    for i, s in enumerate(sets):
        c = Counter(j for g in s for j in where[g] if j < i)
        for j, k in c.items():
            if den * k >= num * (len(s) + len(sets[j]) - k):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(s), low.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def leaks(rows, items, size=13):
    wins = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(lower(t))
        for k in [0] if 0 < len(w) < size else range(len(w) - size + 1):
            wins[tuple(w[k : k + size])].add(str(i))
    sizes = {len(k) for k in wins}
    out = []
    for d, t in rows:
        w = ALNUM.findall(lower(t))
        hit, found = [False] * len(w), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit[k : k + n] = [True] * n
                    found |= wins[x]
        h = sum(hit)
        out.append((d, len(w), h, len(found), sha(",".join(sorted(found))), h > 0 and 20 * h >= len(w)))
    return out


def kneser_ney(train, texts, order):
    """(tokens, known, base, score) of each text."""

    def toks(t):
        return SPACED.findall(lower(t)) + ["</s>"]

    counts = {order: Counter()}
    raw = Counter()
    for t in train:
        w = toks(t)
        raw.update(w)
        p = ["<s>"] * (order - 1) + w
        for k in range(len(w)):
            counts[order][tuple(p[k : k + order])] += 1
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    disc, ctx = {}, {}
    for k in counts:
        n = [0] + [sum(1 for c in counts[k].values() if c == j) for j in (1, 2, 3, 4)]
        if n[1] and n[2] and n[3]:
            y = n[1] / (n[1] + 2 * n[2])
            d = [0, 1 - 2 * y * n[2] / n[1], 2 - 3 * y * n[3] / n[2], 3 - 4 * y * n[4] / n[3]]
            disc[k] = [min(max(v, lo), hi) for v, lo, hi in zip(d, (0, 0.05, 0.1, 0.15), (0, 1, 2, 3))]
        else:
            disc[k] = [0, 0.5, 1.0, 1.5]
        ctx[k] = defaultdict(lambda: [0, 0, 0, 0])
        for g, c in counts[k].items():
            ctx[k][g[:-1]][0] += c
            ctx[k][g[:-1]][min(c, 3)] += 1
    total, vocab = sum(raw.values()), len(raw)

    def prob(g):
        k = len(g)
        if k == 0:
            return 1 / (vocab + 1)
        if g[:-1] not in ctx[k]:
            return prob(g[1:])
        t, *n = ctx[k][g[:-1]]
        c = counts[k].get(g, 0)
        return (max(c - disc[k][min(c, 3)], 0) + sum(a * b for a, b in zip(disc[k][1:], n)) * prob(g[1:])) / t

    out = []
    for t in texts:
        w = toks(t)
        p = ["<s>"] * (order - 1) + w
        out.append((len(w), sum(raw[x] > 0 for x in w), sum(math.log10((raw[x] + 0.1) / (total + 0.1 * (vocab + 1))) for x in w), sum(math.log10(prob(tuple(p[k : k + order]))) for k in range(len(w)))))
    return out


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def lines(rows, most=2, least=24):
    """A line goes if an earlier one of another or the same document is within `most` edits."""
    inf = float("inf")
    firsts = {}
    for i, t in rows:
        for p, x in enumerate((t or "").split("\n")):
            if len(x) >= least:
                at = (inf if i is None else i, p)
                firsts[x] = min(firsts.get(x, at), at)
    low = {}
    keys = sorted(firsts, key=len)
    for x in keys:
        low[x] = firsts[x]
    for n, x in enumerate(keys):
        for y in keys[n + 1 :]:
            if len(y) - len(x) > most:
                break
            if edit_distance(x, y) <= most:
                low[x], low[y] = min(low[x], firsts[y]), min(low[y], firsts[x])
    out = []
    for i, t in rows:
        ls = t.split("\n") if t is not None else []
        keep = [x for p, x in enumerate(ls) if len(x) < least or low[x] >= (inf if i is None else i, p)]
        out.append((i, len(ls), len(ls) - len(keep), sha("\n".join(keep))))
    return out


def all_lines(rows, most=2, least=24):
    """(doc_id, text, n_lines, kept lines): as above, and a shorter line that isn't blank goes if an equal one is earlier."""
    rank = lambda i: float("inf") if i is None else i
    split = [(i, t.split("\n") if t is not None else []) for i, t in rows]
    seen = [(rank(i), p, x) for i, ls in split for p, x in enumerate(ls)]
    same = lambda x, y: len(x) >= least and len(y) >= least and abs(len(x) - len(y)) <= most and edit_distance(x, y) <= most
    low = {x: min((i, p) for i, p, y in seen if x == y or same(x, y)) for x in {x for *_, x in seen} if len(x) >= least or x.strip()}
    return [(i, t, len(ls), [x for p, x in enumerate(ls) if x not in low or low[x] >= (rank(i), p)]) for (i, ls), (_, t) in zip(split, rows)]
