"""Plain versions of the operators, for small tables."""

import hashlib
import math
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: c + 32 for c in range(65, 91)})


def shingles(text, width=5):
    w = WORD.findall((text or "").translate(LOWER))
    if len(w) < width:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1))


def classes(texts, sim=80):
    """The first row of each row's group of linked rows."""
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= sim * len(a | sets[j]):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def kept_bytes(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i:i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(d), sum(gone), spans, bytes(c for c, g in zip(d, gone) if not g)))
    return out


def base_counts(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    in_repeat = {i + k for i in range(len(words) - 2) if windows[tuple(words[i:i + 3])] > 1
                 for k in range(3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        dup += bool(WORD.findall(line)) and line in lines
        lines.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup,
            len(in_repeat))


class KneserNey:
    """Interpolated modified Kneser-Ney over the letters of padded words, from the definitions."""

    def __init__(self, texts, order=5):
        self.order = order
        full = Counter()
        for t in texts:
            for w in WORD.findall((t or "").replace("\0", " ")):
                s = "\x02" * (order - 1) + w + "\x03"
                full.update(s[i:i + order] for i in range(len(s) - order + 1))
        self.n = {order: full}
        for k in range(order - 1, 0, -1):
            up, own = self.n[k + 1], Counter()
            for g, c in up.items():
                own[g[1:]] += c if g[1] == "\x02" else 1
            self.n[k] = Counter({g: c for g, c in own.items() if g != "\x02" * k})
        self.d, self.ctx = {}, {}
        for k, grams in self.n.items():
            t = [0, *(sum(c == i for c in grams.values()) for i in (1, 2, 3, 4))]
            y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.0
            self.d[k] = [0.0] + [min(i - 0.1, max(0.1, i - (i + 1) * y * t[i + 1] / t[i]))
                                 if t[i] else 0.5 for i in (1, 2, 3)]
            ctx = defaultdict(lambda: [0, 0.0, 0])
            for g, c in grams.items():
                e = ctx[g[:-1]]
                e[0], e[1], e[2] = e[0] + c, e[1] + self.d[k][min(c, 3)], e[2] + 1
            self.ctx[k] = ctx

    def p(self, g):
        k = len(g)
        if k == 0:
            e = self.ctx[1][""]
            return 1 / (e[2] + 1)
        if g[:-1] not in self.ctx[k]:
            return self.p(g[1:])
        total, mass, _ = self.ctx[k][g[:-1]]
        c = self.n[k].get(g, 0)
        return (c - self.d[k][min(c, 3)] if c else 0) / total + mass / total * self.p(g[1:])

    def perplexity(self, text):
        logs, n = 0.0, 0
        for w in WORD.findall(text or ""):
            s = "\x02" * (self.order - 1) + w + "\x03"
            for i in range(len(s) - self.order + 1):
                logs += math.log(self.p(s[i:i + self.order]))
                n += 1
        return math.exp(-logs / n) if n else None


def copies(doc_id, text, rate, seed):
    key = f"{seed}|{'' if doc_id is None else doc_id}|{hashlib.md5((text or '').encode()).hexdigest()}"
    u = int(hashlib.md5(key.encode()).hexdigest()[:13], 16) / 2**52
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < rate + 12 * math.sqrt(rate) + 25:
        k += 1
        p *= rate / k
        total += p
    return k + (total <= u)


def rates(sources, alpha=0.5):
    n = Counter(sources)
    want = {s: c**alpha for s, c in n.items()}
    return {s: want[s] / sum(want.values()) * len(sources) / n[s] for s in n}
