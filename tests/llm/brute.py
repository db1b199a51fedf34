"""The contracts of the queries, word for word, for small tables."""

import hashlib
import re

import numpy as np


def suffix_dedup(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, int, str]]:
    first: dict[bytes, int] = {}
    texts = [(d, (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - 50 + 1):
            s = b[i : i + 50]
            first[s] = min(first.get(s, d), d)
    out = {}
    for d, b in texts:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - 50 + 1):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out[d] = (len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def substring_dedup(rows):
    first, texts = {}, []
    for d, t in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        texts.append((d, words))
        for i in range(len(words) - 12):
            key = tuple(words[i : i + 13])
            first[key] = min(first.get(key, d), d)
    out = {}
    for d, words in texts:
        gone = [False] * len(words)
        for i in range(len(words) - 12):
            if first[tuple(words[i : i + 13])] < d:
                gone[i : i + 13] = [True] * 13
        kept = " ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""


def base_secrets(text):
    """Counts per kind and kind:start:end of every base span."""
    text, found = text or "", []
    for m in re.finditer(ASSIGN, text, re.I | re.A):
        if len(m[2]) >= 6 and m[1].isascii():
            found.append((m.start(), 0, m.end()))
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            found.append((m.start(), 1, m.end()))
    for m in re.finditer("[0-9a-f]+", text):
        if len(m[0]) >= 24:
            found.append((m.start(), 2, m.end()))
    names = ("assign", "access", "hex")
    spans = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))
    return *(sum(k == i for _, k, _ in found) for i in range(3)), hashlib.sha256(spans.encode()).hexdigest()


def near_dedup(rows, words=2):
    sets = []
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} - {()}))
    lists = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            lists.setdefault(x, []).append(i)
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, (_, s) in enumerate(sets):
        shared = {}
        for x in s:
            for j in lists[x]:
                if j < i:
                    shared[j] = shared.get(j, 0) + 1
        for j, n in shared.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)], d == least[find(i)]) for i, (d, s) in enumerate(sets)}
