"""Which windows of W consecutive symbols also start in a document with a smaller id: the exchange behind both exact dedups.

A window is filed under the smallest hash of its K-symbol substrings (its minimizer), so equal windows meet in one bucket, and
neighbouring windows share a minimizer and travel as one segment. Five steps, all keyed by groups of documents or buckets of hashes:

1. each group of documents names its distinct minimizers (8 bytes each), per bucket;
2. a bucket answers which of them occur in two documents or more (one bit each);
3. a group sends the segments under those, each distinct segment once with the smallest document that has it;
4. a bucket makes equal segments one and finds the windows of each that a smaller document has as well - the solver, which is the
   operator's method;
5. the answers return to the group, which marks them in its documents.

A passage that a third of all documents share costs a bucket one entry per group of documents, never one per document. Where its
neighbours differ in every document, segments differ too: a minimizer that very many groups name is heavy, and its windows are filed
one by one under hashes of their own, so that only equal windows meet. Groups and buckets have a set number of bytes, so a task's
memory does not grow with the table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import pack, parts, text_bytes, unpack

_ODD = 0x9E3779B97F4A7C15
#: Groups that name a minimizer before its segments are cut into single windows, each filed under a hash of its own.
HEAVY = 1024
#: Windows looked at together, and windows of one segment at most (a periodic text repeats its minimizer without end).
SLICE, LONGEST = 1 << 19, 64


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k symbols, put together from runs of 1, 2, 4, ... symbols."""
    power, width, block, done, length = _ODD, 1, symbols.astype(np.uint64) + np.uint64(1), None, 0
    n = len(symbols) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    while True:
        if k & width:
            # What is done so far stands before this block.
            done = block if done is None else done[: len(symbols) - length - width + 1] * np.uint64(power) + block[length : len(symbols) - width + 1]
            length += width
        if width * 2 > k:
            break
        block = block[:-width] * np.uint64(power) + block[width:]
        power = power * power % (1 << 64)
        width *= 2
    h = done[:n]
    h = h ^ (h >> np.uint64(31))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


def mixed(h: np.ndarray) -> np.ndarray:
    """Minima crowd near zero; mixed once more (a bijection) they fill the range of hashes evenly, and so the buckets cut from it."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    n, width, low = len(h) - w + 1, 1, h
    while width * 2 <= w:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    return np.minimum(low[:n], low[w - width : w - width + n])


class Symbols:
    """A group's symbols: ``value`` (numbers to hash), ``row`` of each, ``row_first`` and ``row_end`` per row, and where each lies in ``text``."""

    def __init__(self, value, row, row_first, row_end, text, start=None, stop=None):
        self.value, self.row, self.row_first, self.row_end = value, row, row_first, row_end
        self.text, self.start, self.stop = text, start, stop

    def piece(self, first: int, last: int) -> bytes:
        """Text from one symbol up to and with another. Without places, symbols are the bytes themselves."""
        return self.text[first : last + 1] if self.start is None else self.text[self.start[first] : self.stop[last]]


def joined(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """All bytes of a binary column, one after the other, and the end of each row."""
    values = [x.as_py() for x in column]
    return b"".join(values), np.cumsum([len(x) for x in values], dtype=np.int64)


def segments(held: Symbols, window: int, k: int):
    """Runs of neighbouring windows with one minimizer: first window, number of windows, minimizer (48 bits). No window crosses a row."""
    out = []
    for low in range(0, len(held.value) - window + 1, SLICE):
        part = held.value[low : low + SLICE + window - 1]
        least = sliding_min(gram_hashes(part, k), window - k + 1)
        at = np.arange(low, low + len(least))
        at = at[at + window <= held.row_end[held.row[low : low + len(least)]]]
        if not len(at):
            continue
        value = mixed(least[at - low]) >> np.uint64(16)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) != 1) | (value[1:] != value[:-1])
        first = np.flatnonzero(new)
        offset = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
        first = np.flatnonzero(new | (offset % LONGEST == 0))
        out.append((at[first], np.diff(np.append(first, len(at))), value[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _columns(values: np.ndarray) -> np.ndarray:
    """Differences of sorted numbers, byte by byte: the high bytes are zeros and pack well."""
    return np.diff(values, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.copy()


def _values(columns: np.ndarray) -> np.ndarray:
    return np.cumsum(columns.T.copy().view(np.uint64).ravel(), dtype=np.uint64)


def find(
    docs: DataFrame,
    id_column: str,
    text_column: str,
    read: Callable[[pa.ChunkedArray], Symbols],
    solve: Callable,
    finish: Callable[[bytes, np.ndarray, np.ndarray], tuple],
    result: str,
    window: int,
    k: int,
    group_bytes: int,
) -> DataFrame:
    """One row per document: the id (``doc``) and what ``finish(text, begin, end)`` makes of its text and its covered runs of windows.

    ``solve(groups, pieces, documents)`` gets lists of segment numbers filed under one minimizer each, ascending by document, and
    yields (segment number, marks of the windows that a smaller document has). ``result`` names finish's columns as DDL. Rows without
    an id cover nothing and are not covered; rows with the same id do not cover each other.
    """
    n = parts(text_bytes(docs, text_column), group_bytes)
    body = F.coalesce(F.col(text_column).cast("binary"), F.lit(b""))
    base = docs.select(F.col(id_column).cast("long").alias("doc"), body.alias("body"))
    key = F.xxhash64("doc", "body")
    base = base.select("doc", "body", key.alias("row_key"), F.pmod(key, F.lit(n)).cast("int").alias("part"))

    def found(table: pa.Table):
        table = table.filter(pc.is_valid(table["doc"]))
        held = read(table["body"])
        rank = np.unique(table["row_key"].to_numpy(), return_inverse=True)[1].astype(np.int32)
        return table["doc"].to_numpy(), rank, held, *segments(held, window, k)

    def by_bucket(values):
        """Sorted minimizers, cut at the bounds of the buckets (equal ranges of hashes)."""
        if not len(values):
            return []
        bucket = (values >> np.uint64(16)) * np.uint64(n) >> np.uint64(32)
        cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        return [(int(bucket[a]), a, b) for a, b in zip(cut, np.append(cut[1:], len(values)), strict=True)]

    def name(key, table):
        ids, _, held, first, _, value = found(table)
        values, where = np.unique(value, return_inverse=True)
        owner = ids[held.row[first]]
        low, high = np.full(len(values), np.iinfo(np.int64).max), np.full(len(values), np.iinfo(np.int64).min)
        np.minimum.at(low, where, owner)
        np.maximum.at(high, where, owner)
        rows = [(b, key[0].as_py(), pack((_columns(values[i:j]), np.packbits(low[i:j] < high[i:j])))) for b, i, j in by_bucket(values)]
        return _table(rows, ("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()))

    def answer(key, table):
        values, several = [], []
        for x in table["blob"].to_pylist():
            columns, bits = unpack(x)
            values.append(_values(columns))
            several.append(np.unpackbits(bits, count=columns.shape[1]).astype(bool))
        ends = np.cumsum([len(x) for x in values])
        _, where, times = np.unique(np.concatenate(values), return_inverse=True, return_counts=True)
        # Named by two groups, or by one for two documents. Too many are harmless: the solver compares texts.
        mixed = times > 1
        mixed[where[np.concatenate(several)]] = True
        heavy = times > HEAVY
        parts_of = zip(table["part"].to_pylist(), np.split(mixed[where], ends[:-1]), np.split(heavy[where], ends[:-1]), strict=True)
        rows = [(p, key[0].as_py(), pack((np.packbits(bits), np.packbits(many)))) for p, bits, many in parts_of if bits.any()]
        return _table(rows, ("part", pa.int32()), ("bucket", pa.int32()), ("blob", pa.binary()))

    def send(key, table, answers):
        ids, rank, held, first, count, value = found(table)
        values, where = np.unique(value, return_inverse=True)
        shared, heavy = np.zeros(len(values), bool), np.zeros(len(values), bool)
        said = dict(zip(answers["bucket"].to_pylist(), answers["blob"].to_pylist(), strict=True))
        for b, i, j in by_bucket(values):
            if b in said:
                bits, many = unpack(said[b])
                shared[i:j], heavy[i:j] = np.unpackbits(bits, count=j - i), np.unpackbits(many, count=j - i)
        first, count, value, many = (x[shared[where]] for x in (first, count, value, heavy[where]))
        if many.any():
            alone = np.concatenate([np.arange(f, f + c) for f, c in zip(first[many].tolist(), count[many].tolist(), strict=True)])
            own = [int.from_bytes(hashlib.blake2b(held.piece(f, f + window - 1), digest_size=6).digest()) for f in alone.tolist()]
            first, count = np.concatenate((first[~many], alone)), np.concatenate((count[~many], np.ones(len(alone), np.int64)))
            value = np.concatenate((value[~many], np.array(own, np.uint64)))
        order = np.argsort(value, kind="stable")
        first, count, value = first[order], count[order], value[order]
        rows = []
        for b, i, j in by_bucket(value):
            mine = slice(i, j)
            seen: dict[bytes, int] = {}
            least, under, place = [], [], []
            row = held.row[first[mine]]
            owner = ids[row]
            for f, c, d, v in zip(first[mine].tolist(), count[mine].tolist(), owner.tolist(), value[mine].tolist(), strict=True):
                s = seen.setdefault(held.piece(f, f + c + window - 2), len(seen))
                if s == len(least):
                    least.append(d)
                    under.append(v)
                elif d < least[s]:
                    least[s] = d
                place.append(s)
            least, place = np.array(least), np.array(place, np.int32)
            start = (first[mine] - held.row_first[row]).astype(np.int32)
            rows.append((b, key[0].as_py(), pack((list(seen), least, np.array(under, np.uint64), place, rank[row], start, count[mine].astype(np.int16), owner > least[place]))))
        return _table(rows, ("bucket", pa.int32()), ("part", pa.int32()), ("blob", pa.binary()))

    def settle(key, table):
        whole = [unpack(x) for x in table["blob"].to_pylist()]
        # A segment that many groups hold is settled once, for the smallest document of all; in the others it is covered whole.
        number: dict[tuple[int, bytes], int] = {}
        pieces, under, alike = [], [], []
        for x in whole:
            mine = []
            for piece, v in zip(x[0], x[2].tolist(), strict=True):
                at = number.setdefault((v, piece), len(pieces))
                if at == len(pieces):
                    pieces.append(piece)
                    under.append(v)
                mine.append(at)
            alike.append(np.array(mine, np.int64))
        number.clear()
        least, under = np.full(len(pieces), np.iinfo(np.int64).max), np.array(under, np.uint64)
        for x, mine in zip(whole, alike, strict=True):
            np.minimum.at(least, mine, x[1])
        order = np.lexsort((least, under))
        covered: list[np.ndarray] = [None] * len(pieces)
        cut = np.flatnonzero(np.append(True, under[order][1:] != under[order][:-1]))
        groups = [order[a:b].tolist() for a, b in zip(cut, np.append(cut[1:], len(order)), strict=True)]
        for at, marks in solve(groups, pieces, least):
            covered[at] = marks
        rows = []
        for p, x, mine in zip(table["part"].to_pylist(), whole, alike, strict=True):
            keys, begin, end = [], [], []
            elsewhere = x[1] > least[mine]
            for s, row, start, count, later in zip(*(y.tolist() for y in x[3:]), strict=True):
                spans = ((0, count),) if later or elsewhere[s] else _runs(covered[mine[s]])
                for a, b in spans:
                    keys.append(row)
                    begin.append(start + a)
                    end.append(start + b)
            if keys:
                rows.append((p, pack((np.array(keys, np.int32), np.array(begin, np.int32), np.array(end, np.int32)))))
        return _table(rows, ("part", pa.int32()), ("blob", pa.binary()))

    fields = [("doc", pa.int64()), *_arrow_fields(result)]

    def close(key, table, spans):
        whole = [unpack(x) for x in spans["blob"].to_pylist()]
        marks: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        if whole:
            keys, begin, end = (np.concatenate([x[i] for x in whole]) for i in range(3))
            order = np.lexsort((begin, keys))
            keys, begin, end = keys[order], begin[order], end[order]
            cut = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            marks = {int(keys[a]): (begin[a:b], end[a:b]) for a, b in zip(cut, np.append(cut[1:], len(keys)), strict=True)}
        rows, none = [], (np.zeros(0, np.int32),) * 2
        # The same numbers as in found(): ranks among the keys of rows that have an id.
        keys = table["row_key"].to_numpy()
        known = np.unique(keys[table["doc"].is_valid().to_numpy(zero_copy_only=False)])
        for doc, rank, body in zip(table["doc"].to_pylist(), np.searchsorted(known, keys).tolist(), table["body"], strict=True):
            rows.append((doc, *finish(body.as_py(), *(marks.get(rank, none) if doc is not None else none))))
        return _table(rows, *fields)

    grouped = base.groupBy("part")
    named = grouped.applyInArrow(name, "bucket int, part int, blob binary")
    answered = named.groupBy("bucket").applyInArrow(answer, "part int, bucket int, blob binary")
    sent = grouped.cogroup(answered.groupBy("part")).applyInArrow(send, "bucket int, part int, blob binary")
    settled = sent.groupBy("bucket").applyInArrow(settle, "part int, blob binary")
    return grouped.cogroup(settled.groupBy("part")).applyInArrow(close, f"doc long, {result}")


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], marks.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def _arrow_fields(ddl: str):
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import StructType

    return [(f.name, to_arrow_type(f.dataType)) for f in StructType.fromDDL(ddl)]


def _table(rows, *fields) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.table({name: pa.array(list(x), kind) for (name, kind), x in zip(fields, columns, strict=True)})
