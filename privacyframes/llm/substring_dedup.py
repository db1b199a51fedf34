"""Exact dedup of word windows by relative Lempel-Ziv parsing against the documents with smaller ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import windows
from .registry import query, table

WORDS, GRAM = 13, 6
_ODD = 0xD6E8FEB86659FD93


def word_places(text: np.ndarray, ends: np.ndarray):
    """Start and end of every word: a run of bytes other than blank and 0x09-0x0D, within one row."""
    inside = ~((text == 0x20) | ((text >= 0x09) & (text <= 0x0D)))
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    cut = ends[(ends > 0) & (ends < len(text))]
    begins[cut] |= inside[cut]
    stops[cut - 1] |= inside[cut - 1]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def word_hashes(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    if not len(start):
        return np.zeros(0, np.uint64)
    lengths = stop - start
    power = np.cumprod(np.full(int(lengths.max()), _ODD, np.uint64))
    at = np.repeat(start - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
    value = (text[at].astype(np.uint64) + np.uint64(1)) * power[at - np.repeat(start, lengths)]
    h = np.add.reduceat(value, np.cumsum(lengths) - lengths)
    return h ^ (h >> np.uint64(29))


def _read(column):
    raw, ends = windows.joined(column)
    text = np.frombuffer(raw, np.uint8)
    start, stop = word_places(text, ends)
    row_first, row_end = np.searchsorted(start, np.append(0, ends[:-1])[: len(ends)]), np.searchsorted(start, ends)
    row = np.repeat(np.arange(len(ends), dtype=np.int32), row_end - row_first)
    # Words with one blank between them, so that a segment's bytes tell its words and nothing else.
    lengths = stop - start
    place = np.cumsum(lengths + 1) - lengths - 1
    at = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    plain = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    plain[np.repeat(place, lengths) + at] = text[np.repeat(start, lengths) + at]
    return windows.Symbols(word_hashes(text, start, stop), row, row_first, row_end, plain.tobytes(), place, place + lengths)


class Reference:
    """The segments of smaller documents under one minimizer, each indexed at every window start by its first occurrence."""

    def __init__(self):
        self.segments: list[list[bytes]] = []
        self.at: dict[bytes, tuple[int, int]] = {}

    def factor(self, words: list[bytes], keys: list[bytes], i: int) -> int:
        """Length in words of the factor from place i, 0 where no window of the reference starts so."""
        source = self.at.get(keys[i])
        if source is None:
            return 0
        other, j = self.segments[source[0]], source[1]
        length = WORDS
        while i + length < len(words) and j + length < len(other) and words[i + length] == other[j + length]:
            length += 1
        return length

    def add(self, words: list[bytes], keys: list[bytes]) -> None:
        self.segments.append(words)
        for i, key in enumerate(keys):
            self.at.setdefault(key, (len(self.segments) - 1, i))


def parse(words: list[bytes], keys: list[bytes], reference: Reference) -> np.ndarray:
    """Greedy factors from left to right. A factor covers the windows inside it; the windows over its end are looked up one by one,

    since the reference may hold them elsewhere."""
    marks = np.zeros(len(keys), bool)
    i = 0
    while i < len(keys):
        length = reference.factor(words, keys, i)
        if not length:
            i += 1
            continue
        inside = length - WORDS + 1
        marks[i : i + inside] = True
        border = min(i + length, len(keys))
        for j in range(i + inside, border):
            marks[j] = keys[j] in reference.at
        i = border
    return marks


def _solve(groups, pieces, documents):
    for members in groups:
        reference, waiting, now = Reference(), [], None
        for m in members:
            words = pieces[m].split(b" ")
            keys = [b" ".join(words[i : i + WORDS]) for i in range(len(words) - WORDS + 1)]
            if documents[m] != now:
                # Only documents with smaller ids are a reference: equal ids are added together.
                for w, k in waiting:
                    reference.add(w, k)
                waiting, now = [], documents[m]
            marks = parse(words, keys, reference)
            if not marks.all():
                waiting.append((words, keys))
            yield m, marks


def _cut(body: bytes, begin: np.ndarray, end: np.ndarray):
    words = [w for w in body.translate(_BLANKS).split(b" ") if w]
    gone = np.zeros(len(words) + 1, np.int32)
    np.add.at(gone, begin, 1)
    np.add.at(gone, np.minimum(end + WORDS - 1, len(words)), -1)
    gone = np.cumsum(gone)[: len(words)] > 0
    spans = [{"begin": a, "end": b} for a, b in windows._runs(gone)]
    return len(words), spans, b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g)


_BLANKS = bytes(0x20 if 0x09 <= i <= 0x0D else i for i in range(256))


def substring_dedup(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", group_bytes: int = 4 << 20) -> DataFrame:
    """Repeated runs of 13 words of every text, kept only in the document with the smallest id.

    Returns one row per row of ``docs``: the id, ``n_words``, ``spans`` (removed, maximal, in words, end exclusive) and ``kept`` (the
    words left, joined by one blank, UTF-8 bytes). Words are taken unchanged; null and empty texts have none; texts under 13 words stay
    whole. Rows without an id are returned whole and remove nothing; rows with the same id do not remove from each other. Other columns
    are ignored. An empty table gives an empty one. ``group_bytes`` sets how much text a task holds.
    """
    found = windows.find(docs, id_column, text_column, _read, _solve, _cut, "n_words long, spans array<struct<begin: long, end: long>>, kept binary", WORDS, GRAM, group_bytes)
    return found.withColumnRenamed("doc", id_column)


def digest(found: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op4_substring_dedup")
def op4_substring_dedup(spark, sf_dir):
    return digest(substring_dedup(table(spark, sf_dir, "documents")))
