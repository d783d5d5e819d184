"""Plain versions of the operators, for small inputs."""

import hashlib
from collections import Counter, defaultdict

import numpy as np


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def words(text):
    return (text or "").encode().split()


def substrings(docs, window):
    """(kept words, removed) of each (id, text): words in windows that occur twice."""
    seen = Counter(tuple(w[i : i + window]) for _, t in docs for w in [words(t)] for i in range(len(w) - window + 1))
    out = []
    for _, t in docs:
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((b" ".join(x for i, x in enumerate(w) if i not in gone), len(gone)))
    return out


def suffixes(docs, size):
    """{id: (kept bytes, removed, spans)}; the first occurrence stays."""
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - size + 1):
            s = b[p : p + size]
            if s in seen:
                gone[p : p + size] = True
            seen.add(s)
        gone[len(b)] = False
        out[i] = (bytes(x for x, g in zip(b, gone, strict=False) if not g), int(gone.sum()), int((np.diff(np.append(False, gone).astype(int)) == 1).sum()))
    return out


def shingles(text, n=5):
    w = [x.lower() for x in words(text)]  # bytes.lower changes A-Z only
    return {tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))} if w else set()


def components(docs, percent=80):
    """{id: (shingles, smallest id of the component)}."""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def measures(text):
    t = text or ""
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {i + d for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for d in range(3)}
    lines = [x for x in t.split("\n") if words(x)]
    return len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")].append(i)
    return {i: (max(v), len(v)) for v in groups.values() for i in v}
