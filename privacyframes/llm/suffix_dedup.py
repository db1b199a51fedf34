"""Exact substring dedup over suffix arrays, sorted deep-shallow: multikey quicksort first, blind tries for long common prefixes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .registry import query, table

LENGTH, GRAM, SHALLOW = 50, 25, 16
#: Suffixes sorted together in one task; a set of segments under one minimizer is never cut.
TOGETHER = 200_000


def _words(text: np.ndarray) -> np.ndarray:
    """At each place, the eight bytes from there as one big-endian number: the characters of the multikey quicksort."""
    out = np.concatenate((text, np.zeros(8, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        out = (out[:-width] << np.uint64(8 * width)) | out[width:]
    return out[: len(text)]


def _split(order: np.ndarray, group: np.ndarray, character: np.ndarray):
    """Sorts each group by a character and splits it where the character changes: all partitions of one depth at once, by a stable sort."""
    at = np.lexsort((character, group))
    order, group, character = order[at], group[at], character[at]
    new = np.append(True, (group[1:] != group[:-1]) | (character[1:] != character[:-1]))
    return order, np.cumsum(new) - 1


def suffix_classes(text: np.ndarray, starts: np.ndarray, depth: int = LENGTH, shallow: int = SHALLOW):
    """The sparse suffix array of ``text`` at ``starts``, in order to ``depth``, and the class of each entry (equal to that depth).

    Shallow: multikey quicksort over characters of eight bytes, one depth after the other, only within groups that are still equal.
    Deep: every group left is ordered by a blind trie. A node stores how far all its suffixes agree (the skip) and branches on the
    character there, and nothing between; all tries of the block grow by one level at a time.
    """
    words = _words(text)
    order, group = starts.astype(np.int64), np.zeros(len(starts), np.int64)
    known = 0
    while known < shallow:
        order, group = _split(order, group, words[np.minimum(order + known, len(text) - 1)])
        known += 8
    lcp = np.full(len(order), known)  # how far the members of an entry's group agree for certain
    alive = np.bincount(group, minlength=len(order))[group] > 1 if len(order) else np.zeros(0, bool)
    while alive.any():
        at = np.flatnonzero(alive)
        g, o, skip = group[at], order[at], lcp[at]
        head = np.append(True, g[1:] != g[:-1])
        node = np.cumsum(head) - 1
        first = np.flatnonzero(head)
        # Skip: the least depth at which a suffix of the node leaves the node's first suffix.
        agree, going = skip.copy(), skip < depth
        lead = o[first][node]
        while going.any():
            i = np.flatnonzero(going)
            a, b = words[o[i] + agree[i]], words[lead[i] + agree[i]]
            same = a == b
            apart = a ^ b
            leading = np.zeros(len(i), np.int64)
            for shift in (32, 16, 8):
                high = (apart >> np.uint64(64 - shift)) == 0
                leading += np.where(high, shift // 8, 0)
                apart = np.where(high, apart << np.uint64(shift), apart)
            agree[i] = np.minimum(agree[i] + np.where(same, 8, leading), depth)
            going[i] = same & (agree[i] < depth)
        skip = np.minimum.reduceat(agree, first)[node]
        # Branch: one child for each character at the skip; at full depth the node is a leaf.
        leaf = skip >= depth
        branch = np.where(leaf, 0, text[np.minimum(o + skip, len(text) - 1)])
        inside = np.lexsort((branch, node))
        order[at] = o[inside]
        child = np.append(True, (node[1:] != node[:-1]) | (np.diff(branch[inside]) != 0))
        number = np.cumsum(child) - 1
        group[at] = len(group) + at[np.flatnonzero(child)][number]  # clear of the other numbers
        lcp[at] = skip[inside] + 1
        alive[at] = ~leaf[inside] & (np.bincount(number)[number] > 1)
        # Group numbers are made to ascend along the array again.
        group = np.cumsum(np.append(True, group[1:] != group[:-1])) - 1 if len(group) else group
    return order, group


def _solve(groups, pieces, documents):
    """Sorts the windows of all segments of a bucket and marks those whose class has a smaller document."""
    block: list[int] = []
    size = 0
    for i, members in enumerate(groups):
        block += members
        size += sum(len(pieces[m]) - LENGTH + 1 for m in members)
        if size >= TOGETHER or i == len(groups) - 1:
            yield from _marks(block, pieces, documents)
            block, size = [], 0


def _marks(block, pieces, documents):
    text = np.frombuffer(b"".join(pieces[m] for m in block), np.uint8)
    lengths = np.array([len(pieces[m]) for m in block])
    counts = lengths - LENGTH + 1
    ends = np.cumsum(counts)
    within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
    starts = np.repeat(np.cumsum(lengths) - lengths, counts) + within
    owner = np.repeat(documents[np.array(block)], counts)
    order, group = suffix_classes(text, starts)
    window = np.searchsorted(starts, order)
    least = np.minimum.reduceat(owner[window], np.flatnonzero(np.append(True, group[1:] != group[:-1])))
    marks = np.zeros(len(starts), bool)
    marks[window] = least[group] < owner[window]
    return zip(block, np.split(marks, ends[:-1]), strict=True)


def _read(column):
    text, ends = windows.joined(column)
    lengths = np.diff(ends, prepend=0)
    return windows.Symbols(np.frombuffer(text, np.uint8), np.repeat(np.arange(len(ends), dtype=np.int32), lengths), ends - lengths, ends, text)


def _cut(body: bytes, begin: np.ndarray, end: np.ndarray):
    """Spans of bytes covered by the windows begin..end-1, and what is left of the text."""
    spans: list[list[int]] = []
    for a, b in zip(begin.tolist(), (end + LENGTH - 1).tolist(), strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], b)
        else:
            spans.append([a, b])
    left, done = [], 0
    for a, b in spans:
        left.append(body[done:a])
        done = b
    left.append(body[done:])
    return len(body), [{"begin": a, "end": b} for a, b in spans], b"".join(left)


def suffix_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", group_bytes: int = 4 << 20) -> DataFrame:
    """Repeated 50-byte strings of every text, kept only in the document with the smallest id.

    Returns one row per row of ``docs``: the id, ``n_bytes``, ``spans`` (removed, maximal, in bytes, end exclusive) and ``kept`` (the
    bytes left). Texts are UTF-8 bytes, null is empty; texts under 50 bytes have no window and stay whole. Rows without an id are
    returned whole and remove nothing; rows with the same id do not remove from each other. Other columns are ignored. An empty table
    gives an empty one. ``group_bytes`` sets how much text a task holds.
    """
    found = windows.find(docs, id_column, text_column, _read, _solve, _cut, "n_bytes long, spans array<struct<begin: long, end: long>>, kept binary", LENGTH, GRAM, group_bytes)
    return found.withColumnRenamed("doc", id_column)


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op1_suffix_dedup")
def op1_suffix_dedup(spark, sf_dir):
    return digest(suffix_dedup(table(spark, sf_dir, "documents")))

