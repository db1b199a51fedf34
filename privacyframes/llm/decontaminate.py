"""Benchmark decontamination: q-gram lemma filtering in overlapping diagonal bands, verified by banded alignment."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import parts, text_bytes
from .registry import query, table
from .sampling import slices

#: Characters of a q-gram; characters of a passage looked for; its share of edits; bytes of benchmark text in one index.
Q, PASSAGE, EDITS, INDEX_BYTES = 12, 100, 0.05, 16 << 20
#: Passages aligned together; shared q-grams looked at together, and by how much the stretches of a text cut for that overlap.
ALIGNED, SHARED, OVERLAP = 1 << 10, 1 << 20, 2 * PASSAGE
_ODD = 0x9E3779B97F4A7C15
#: Its powers for blocks of 1, 2 and 4 characters.
_POWERS = [np.uint64(pow(_ODD, n, 1 << 64)) for n in (1, 2, 4)]


def fold(text: str) -> str:
    """Lower case, one character for each: U+0130 alone has a longer lower form and is folded to its first letter."""
    return text.replace("\u0130", "i").lower()


def plain(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Characters compared - lower case, each run of white space as one blank - and the place of each in the text."""
    code = np.frombuffer(fold(text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0)
    code = np.where(blank, np.uint32(32), code)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    place = np.flatnonzero(keep)
    return code[place], place


def gram_keys(code: np.ndarray) -> np.ndarray:
    n = len(code) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    one = code.astype(np.uint64)
    two = one[:-1] * _POWERS[0] + one[1:]
    four = two[:-2] * _POWERS[1] + two[2:]
    eight = four[:-4] * _POWERS[2] + four[4:]
    h = eight[:n] * _POWERS[2] + four[8 : 8 + n]
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


class Windows(NamedTuple):
    """Passages of one item in one band: the item's number, their starts in it, and the fewest edits their q-grams leave possible."""

    item: int
    starts: np.ndarray
    fewest: int


class Passages:
    """q-grams of all items. Every ``PASSAGE`` characters of an item are a passage, whatever their start; a shorter item is one passage.

    An item of under two q-grams, none of which need survive an edit, is looked up as it is, between characters that are no letters or digits.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        self.item, self.text, keys, owner, at = [], [], [], [], []
        self.short: dict[str, list[int]] = {}
        for item, text in items:
            code, _ = plain(text)
            if len(code) < 2 * Q:
                whole = code.tobytes().decode("utf-32-le", "surrogatepass").strip()
                if any(c.isalnum() for c in whole):
                    self.short.setdefault(whole, []).append(item)
                continue
            k = gram_keys(code)
            keys.append(k)
            owner.append(np.full(len(k), len(self.item)))
            at.append(np.arange(len(k)))
            self.item.append(item)
            self.text.append(code)
        #: Characters of a passage of each item.
        self.length = np.minimum(np.array([len(t) for t in self.text], np.int64), PASSAGE)
        self.budget = (self.length * EDITS).astype(np.int64)
        #: q-gram lemma: k edits destroy at most k * q of the n - q + 1 grams.
        self.least = self.length - Q + 1 - Q * self.budget
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owner, at = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (owner, at))
        order = np.argsort(keys, kind="stable")
        self.keys, self.first, self.count = np.unique(keys[order], return_index=True, return_counts=True)
        self.owner, self.at = owner[order], at[order]
        self.flags = np.zeros(1 << 22, bool)
        self.flags[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        if self.short:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for whole in self.short:
                self.automaton.add_word(whole, whole)
            self.automaton.make_automaton()

    def exact(self, code: np.ndarray):
        """First place of every short item that stands in the text: (item, begin, end)."""
        if not self.short or not len(code):
            return []
        text, found = code.tobytes().decode("utf-32-le", "surrogatepass"), {}
        inside = lambda i: 0 <= i < len(text) and text[i].isalnum()
        for last, whole in self.automaton.iter(text):
            begin = last + 1 - len(whole)
            if whole not in found and not (inside(begin - 1) and whole[0].isalnum()) and not (inside(last + 1) and whole[-1].isalnum()):
                found[whole] = begin
        return [(item, begin, begin + len(whole)) for whole, begin in found.items() for item in self.short[whole]]

    def shared(self, code: np.ndarray):
        """Places of q-grams that items have, and the numbers of those q-grams."""
        keys = gram_keys(code)
        place = np.flatnonzero(self.flags[(keys >> np.uint64(42)).astype(np.int64)]) if len(self.keys) else np.zeros(0, np.int64)
        slot = np.minimum(np.searchsorted(self.keys, keys[place]), len(self.keys) - 1)
        good = self.keys[slot] == keys[place] if len(place) else np.zeros(0, bool)
        return place[good], slot[good]

    def stretches(self, code: np.ndarray):
        """Stretches of a text, its shared q-grams there and the numbers of those. They overlap by more than a match can be long.

        A repetitive text shares a q-gram with many places of a repetitive item: stretches are cut so that what they share is bounded.
        """
        place, slot = self.shared(code)
        if not len(place):
            return
        total = np.append(0, np.cumsum(self.count[slot]))
        first = 0
        while True:
            last = max(int(np.searchsorted(total, total[first] + SHARED, "right")) - 1, int(np.searchsorted(place, place[first] + 4 * OVERLAP)))
            last = min(last, len(place))
            yield place[first:last], slot[first:last]
            if last == len(place):
                return
            first = int(np.searchsorted(place, place[last] - OVERLAP))

    def regions(self, place: np.ndarray, slot: np.ndarray, settled: np.ndarray):
        """(passages, first diagonal) of every band in which passages of an item share enough q-grams, those with the fewest edits first.

        Items in ``settled`` are passed over.

        k edits move a match over k + 1 neighbouring diagonals at most, so all its grams lie in one of the bands of 2k + 2 diagonals that
        start every k + 1 and overlap by half. A gram of the item counts once in a band.
        """
        n = self.count[slot]
        posting = np.repeat(self.first[slot] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, item, at = np.repeat(place, n), self.owner[posting], self.at[posting]
        if settled.any():
            open_items = ~settled[item]
            place, item, at = place[open_items], item[open_items], at[open_items]
        if not len(place):
            return []
        band = np.floor_divide(place - at, self.budget[item] + 1)
        order = np.lexsort((at, band, item))
        item, band, at = item[order], band[order], at[order]
        new = np.append(True, (item[1:] != item[:-1]) | (band[1:] != band[:-1]))
        distinct = new | np.append(True, at[1:] != at[:-1])
        item, band, at = item[distinct], band[distinct], at[distinct]
        begin = np.flatnonzero(new[distinct])
        item, band, end = item[begin], band[begin], np.append(begin[1:], len(at))
        # A band is the union of two neighbouring half bands.
        joined = np.append((item[1:] == item[:-1]) & (band[1:] == band[:-1] + 1), False)
        end = np.where(joined, np.append(end[1:], 0), end)
        found = []
        for x in np.flatnonzero(end - begin >= self.least[item]).tolist():
            i = int(item[x])
            grams, k = int(self.length[i]) - Q + 1, int(self.budget[i])
            held = at[begin[x] : end[x]]
            low = max(int(held.min()) - grams + 1, 0)
            high = min(int(held.max()), len(self.text[i]) - int(self.length[i]))
            holds = np.zeros(high - low + grams + 1, np.int64)
            holds[held[held < high + grams] - low + 1] = 1
            total = np.cumsum(holds)
            fewest = -(-(grams - (total[grams:] - total[:-grams])) // Q)
            for edits in range(k + 1):
                starts = np.flatnonzero(fewest == edits) + low
                if len(starts):
                    found.append((Windows(i, starts, edits), int(band[x]) * (k + 1)))
        return sorted(found, key=lambda r: (r[0].fewest, r[1], r[0].item))

    def align(self, code: np.ndarray, windows: Windows, diagonal: int):
        """Fewest edits of any of the passages against any stretch of text in the band, and that stretch; None beyond the budget.

        The band holds the diagonals of two half bands and k more on both sides; a passage is read whole, its start and end in the text are free.
        """
        parts = (windows.starts[i : i + ALIGNED] for i in range(0, len(windows.starts), ALIGNED))
        return min((x for p in parts if (x := self._align(code, windows.item, p, diagonal))), default=None)

    def _align(self, code: np.ndarray, item: int, starts: np.ndarray, diagonal: int):
        k, n, want = int(self.budget[item]), int(self.length[item]), self.text[item]
        width = 4 * k + 4
        first = int(starts[0])
        low = diagonal - k - 1 + first
        padded = np.full(int(starts[-1]) - first + n + width, np.uint32(0xFFFFFFFF))
        begin, end = max(low, 0), min(low + len(padded), len(code))
        if begin >= end:
            return None
        padded[begin - low : end - low] = code[begin:end]
        # cost[j, s]: edits of the first i characters of passage s ending on diagonal j of the band, and below them the start in ``padded``.
        one = np.int64(1 << 32)
        step = np.arange(width)[:, None]
        ends = step + (starts - first)
        cost, step = ends.astype(np.int64), step * one
        for i in range(n):
            new = cost + (padded[ends + i] != want[starts + i]) * one
            # A character of the passage that the text lacks.
            new[:-1] = np.minimum(new[:-1], cost[1:] + one)
            # Characters of the text that the passage lacks: cheapest way from any earlier diagonal.
            cost = np.minimum.accumulate(new - step, axis=0) + step
        j, s = np.unravel_index(int(cost.argmin()), cost.shape)
        edits, start = divmod(int(cost[j, s]), int(one))
        if edits > k:
            return None
        return edits, max(low + start, 0), min(low + int(ends[j, s]) + n, len(code))


def _scan(passages: Passages, text: str | None):
    """Best match of each item: (item, edits, start, end) with places in the whole text, end exclusive."""
    code, place = plain(text)
    best: dict[int, tuple] = {}
    # An item found without an edit is settled: what comes later in the text is no better.
    settled = np.zeros(len(passages.item), bool)
    for at, slot in passages.stretches(code):
        for windows, diagonal in passages.regions(at, slot, settled):
            item = passages.item[windows.item]
            if best.get(item, (1 << 30,))[0] <= windows.fewest:
                continue
            found = passages.align(code, windows, diagonal)
            if found and found[2] > found[1]:
                edits, begin, end = found
                best[item] = min(best.get(item, (1 << 30,)), (edits, int(place[begin]), int(place[end - 1]) + 1))
                settled[windows.item] |= edits == 0
    for item, begin, end in passages.exact(code):
        best[item] = min(best.get(item, (1 << 30,)), (0, int(place[begin]), int(place[end - 1]) + 1))
    return [(item, *x) for item, x in sorted(best.items())]


MATCHES = "array<struct<item_id: long, edits: int, start: int, end: int>>"


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", index_bytes: int = INDEX_BYTES) -> DataFrame:
    """``docs`` with ``leaks``: for every benchmark item with a passage in the text its best match (item, edits, start, end in code points).

    A passage is any 100 characters of an item (a shorter item whole), found with up to 5 edits in 100 after folding case and white space;
    an item of under 24 characters is found unchanged, not within a longer word, and one without a letter or digit not at all. Each text is read whole, in one narrow stage. Null, empty and short texts have no leaks; null items are ignored,
    repeated ones reported once per id. All rows and columns come back (a column named ``leaks`` is replaced).

    The index goes to every task and is therefore checked: beyond ``index_bytes`` of benchmark text the items are dealt into that many
    smaller indexes, each scanned in a pass of its own, and the matches are put together; nothing is left out.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_column).cast("long").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    passes = parts(text_bytes(items, "text"), index_bytes, least=1)
    out = docs.withColumn("leaks", F.expr(f"cast(array() as {MATCHES})"))
    names, schema = out.columns, out.schema
    at = names.index("leaks")
    text_at = names.index(text_column)
    for p in range(passes):
        mine = items.filter(F.pmod(F.xxhash64("item"), F.lit(passes)) == p)
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine.collect()])
        out = out.mapInArrow(_pass(shared, names, at, text_at), schema)
    return out


def _pass(shared, names, at, text_at):
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("edits", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def scan(batches):
        passages = Passages(shared.value)
        for batch in batches:
            texts = batch.column(text_at).to_pylist()
            leaks = batch.column(at).to_pylist()
            for a, b in slices(texts):
                found = _scan_many(passages, texts[a:b])
                for i, x in found.items():
                    leaks[a + i] = leaks[a + i] + [{"item_id": m[0], "edits": m[1], "start": m[2], "end": m[3]} for m in x]
            columns = list(batch.columns)
            columns[at] = pa.array(leaks, kind)
            yield pa.RecordBatch.from_arrays(columns, names)

    return scan


def _scan_many(passages: Passages, texts):
    """Matches per text. Texts are hashed together; only those that share a q-gram are looked at on their own."""
    rows = [fold(t or "") for t in texts]
    code = np.frombuffer("\n".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in rows])
    blank = (code == 32) | ((code >= 9) & (code <= 13)) | (code == 0xA0)
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    place = np.flatnonzero(keep)
    hit = passages.shared(np.where(blank, np.uint32(32), code)[place])[0]
    some = range(len(texts)) if passages.short else np.unique(np.searchsorted(ends, place[hit], side="right")).tolist()
    return {i: x for i in some if (x := _scan(passages, texts[i]))}


@query("op7_decontaminate")
def op7_decontaminate(spark, sf_dir):
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("contaminated"), F.size("leaks").alias("n_items"), F.transform("leaks", lambda m: m["item_id"]).alias("item_ids"), "leaks")
