"""Plain definitions of what the operators compute, for comparison on small tables."""

import collections
import hashlib
import re

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, k):
    w = SPACED.findall(low(text))
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def jaccard_groups(docs, k=4, percent=85):
    """{id: (set size, smallest id of the component)} of (id, text) rows with distinct ids."""
    sets = {d: shingles(t, k) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def repeats(docs, window=50):
    first = {}
    for d, t in docs:
        w = SPACED.findall(t or "")
        for i in range(len(w) - window + 1):
            key = tuple(w[i:i + window])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, t in docs:
        w = SPACED.findall(t or "")
        gone = {j for i in range(len(w) - window + 1) if first[tuple(w[i:i + window])] < d for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[d] = len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()
    return out


def leaks(docs, items, size=10):
    owners = collections.defaultdict(set)
    for i, t in items:
        w = ALNUM.findall(low(t))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            owners[tuple(w[k:k + n])].add(str(i))
    out = []
    for d, t in docs:
        w, hit, names = ALNUM.findall(low(t)), set(), set()
        for n in {len(p) for p in owners}:
            for k in range(len(w) - n + 1):
                if found := owners.get(tuple(w[k:k + n])):
                    hit.update(range(k, k + n))
                    names |= found
        names = sorted(names)
        out.append((d, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return out
