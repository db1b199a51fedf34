"""The contracts of the searches, word for word, for small tables."""

import hashlib
import math
import re
from collections import Counter


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def lexical_search(docs, items, k=10):
    term = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    counted = [(d, Counter(re.findall(term, lower(t)))) for d, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_all = sum(c.total() for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = set()
    for item, text in set(items):
        weights = [(t, math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))) for t in re.findall(term, lower(text))]
        scored = []
        for d, c in counted:
            if d is None or not c:
                continue
            m = 25 + 75 * c.total() * n_docs // n_all
            scored.append((-sum(w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t, w in weights), d))
        out |= {(item, i + 1, d, -s) for i, (s, d) in enumerate(sorted(x for x in scored if x[0] < 0)[:k])}
    return out


def centroid_clusters(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()
    start = sorted((r for r in kept if r[0] is not None), key=lambda r: (key(r), r[1])) + sorted((r for r in kept if r[0] is None), key=lambda r: r[1])
    centroids = [v for _, v in start[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centroids)) for _, v in kept]

    for _ in range(rounds):
        found = assign()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    found = assign()
    spent = Counter()
    for d, j in found:
        spent[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, d, spent[j], spent.total(), digest[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def license_scan(text, phrases, notices, allowed):
    """Words, exact places, and per notice the least number of edits of a run of whole words, where it is allowed."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    base = [(label, i) for label, p in phrases for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    close = {}
    for label, notice in notices:
        edits, k = allowed(notice), len(notice.split())
        runs = (" ".join(words[i : i + n]) for i in range(len(words)) for n in range(max(1, k - edits), k + edits + 1) if i + n <= len(words))
        near = [d for r in runs if abs(len(r) - len(notice)) <= edits and (d := edit_distance(r, notice)) <= edits]
        if near:
            close[(label, notice)] = min(near)
    return len(words), sorted(base), close
