"""License scans: short notices found with a few edits, located by exact seeds and verified by the regex library's bounded-error matching."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .registry import query, table

#: The exact phrases, and the notices that are searched with edits.
PHRASES = (
    ("mit", "mit license"),
    ("apache", "apache license"),
    ("gpl", "general public license"),
)
NOTICES = PHRASES + (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("apache", "licensed under the apache license version 2 0"),
    ("gpl", "this program is free software you can redistribute it and or modify it"),
    ("lgpl", "gnu lesser general public license"),
    ("agpl", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "bsd 2 clause license"),
    ("bsd", "bsd 3 clause license"),
    ("mpl", "mozilla public license"),
    ("epl", "eclipse public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose"),
    ("boost", "boost software license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc", "licensed under cc by"),
    ("cc", "creative commons attribution"),
    ("proprietary", "all rights reserved"),
)
#: One edit in so many characters of a notice is allowed, one at least and ``EDITS`` at most.
CHARACTERS, EDITS = 12, 4
#: Windows of text whose verdict a task remembers: a repeated text is verified once. The results do not depend on it.
REMEMBERED = 4096

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def allowed(notice: str) -> int:
    return max(1, min(EDITS, len(notice) // CHARACTERS))


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into one piece more than edits are allowed, with the pieces' places: some piece stands unchanged in every match."""
    cut = [len(notice) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cut, cut[1:], strict=False)]


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, only A-Z in lower case: digits, a-z and what is not ASCII."""
    return _WORD.findall((text or "").encode().lower())


class Scanner:
    """Exact phrases and fuzzy notices in words joined by one space."""

    def __init__(self, notices=NOTICES, phrases=PHRASES):
        import ahocorasick
        import regex

        self.notices, self.phrases = notices, phrases
        self.exact = [re.compile(rf"(?<![^ ])(?={re.escape(p)}(?![^ ]))") for _, p in phrases]
        self.edits = [allowed(n) for _, n in notices]
        self.fuzzy = [regex.compile(rf"(?b)(?:{regex.escape(n, special_only=True)}){{e<={e}}}(?![^ ])") for (_, n), e in zip(notices, self.edits, strict=True)]
        self.automaton = ahocorasick.Automaton()
        for i, ((_, n), e) in enumerate(zip(notices, self.edits, strict=True)):
            for place, piece in seeds(n, e):
                self.automaton.add_word(piece, (*self.automaton.get(piece, ()), (i, place, len(piece))))
        self.automaton.make_automaton()
        self.verify = lru_cache(REMEMBERED)(self._verify)

    def base(self, joined: str) -> list[tuple[str, int]]:
        """Label and place of every phrase that stands exactly."""
        return [(label, m.start()) for (label, p), exact in zip(self.phrases, self.exact, strict=True) if p in joined for m in exact.finditer(joined)]

    def _verify(self, notice: int, window: str) -> tuple[int, int, int] | None:
        """The closest match of whole words. It is tried at every word that can be its first: a search would not insert before it."""
        last = len(window) - len(self.notices[notice][1]) + self.edits[notice]
        first = [0, *(i + 1 for i, c in enumerate(window[:last]) if c == " ")]
        found = [(sum(m.fuzzy_counts), *m.span()) for i in first if (m := self.fuzzy[notice].match(window, i))]
        edits, a, b = min(found, default=(0, 0, 0))
        return (a, b, edits) if found else None

    def windows(self, joined: str):
        """Where matches can lie, as (notice, begin, end): around every seed, cut to whole words, each once."""
        seen: dict[int, set[tuple[int, int]]] = {}
        for last, ends in self.automaton.iter(joined):
            for notice, place, length in ends:
                edits, size = self.edits[notice], len(self.notices[notice][1])
                begin = last + 1 - length - place
                a, b = max(0, begin - edits), min(len(joined), begin + size + edits)
                if a and joined[a - 1] != " ":
                    a = joined.find(" ", a, b) + 1 or b
                if b < len(joined) and joined[b] != " ":
                    b = joined.rfind(" ", a, b)
                if b - a >= size - edits and (a, b) not in seen.setdefault(notice, set()):
                    seen[notice].add((a, b))
                    yield notice, a, b

    def matches(self, joined: str) -> list[tuple[int, int, int, int]]:
        """Matches of every notice as (begin, end, notice, edits); of matches of one notice that overlap, the closest, then the first stays."""
        found: dict[int, set[tuple[int, int, int]]] = {}
        for notice, a, b in self.windows(joined):
            if m := self.verify(notice, joined[a:b]):
                found.setdefault(notice, set()).add((m[2], a + m[0], a + m[1]))
        out = []
        for notice, spans in found.items():
            # Whole matches are shorter than two windows, so only neighbours by place can overlap.
            taken: dict[int, list[tuple[int, int]]] = {}
            wide = len(self.notices[notice][1]) + EDITS
            for edits, a, b in sorted(spans):
                near = [s for cell in range(a // wide - 1, b // wide + 1) for s in taken.get(cell, ())]
                if all(b <= x or y <= a for x, y in near):
                    taken.setdefault(a // wide, []).append((a, b))
                    out.append((a, b, notice, edits))
        return sorted(out)

    def scan(self, text: str | None):
        """Number of words, exact places (label, word) and matches (label, notice, first word, words, edits), all in the order of the text."""
        words = words_of(text)
        joined = b" ".join(words).decode()
        base, found = self.base(joined), self.matches(joined)
        if not base and not found:
            return len(words), [], []
        blank = np.flatnonzero(np.frombuffer(joined.encode("utf-32-le"), np.uint32) == 0x20)
        number = lambda places: np.searchsorted(blank, np.array(places, np.int64)).tolist()
        exact = sorted(zip(number([p for _, p in base]), (label for label, _ in base), strict=True))
        first, last = number([a for a, *_ in found]), number([b - 1 for _, b, *_ in found])
        close = [(self.notices[i][0], self.notices[i][1], a, b - a + 1, e) for a, b, (_, _, i, e) in zip(first, last, found, strict=True)]
        return len(words), [(label, w) for w, label in exact], close


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", notices=NOTICES, phrases=PHRASES) -> DataFrame:
    """License phrases and notices of every whole text: the id, ``n_words``, ``base`` and ``notices``.

    Words are runs of digits, letters a-z and characters that are not ASCII, only A-Z lower-cased, numbered from 0. ``base`` holds (label,
    first_word) of every place where a phrase's words stand consecutively; ``notices`` (label, notice, first_word, n_words, edits) of every
    run of whole words that differs from a notice, words joined by one space, in at most one edit (insertion, deletion, substitution of
    a character) for every 12 of its characters, one at least and four at most.

    A notice is cut into one piece more than edits are allowed, so every match holds a piece unchanged; an Aho-Corasick automaton finds the
    pieces of all notices in one walk, and only the windows around them are verified. Null texts and texts without words
    have no words and no hits. Every row gives one row, in any order, also rows without an id or with the same one; extra columns are
    ignored; an empty table gives no rows. The work is one narrow pass, linear in the text but for the verified windows.
    """

    def run(batches):
        scanner = Scanner(notices, phrases)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                found = [scanner.scan(t) for t in part["text"].to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part["id"],
                        pa.array([n for n, _, _ in found], pa.int64()),
                        pa.array([[{"label": x, "first_word": w} for x, w in base] for _, base, _ in found], kinds[0]),
                        pa.array([[dict(zip(names, x, strict=True)) for x in close] for _, _, close in found], kinds[1]),
                    ],
                    [id_column, "n_words", "base", "notices"],
                )

    names = ("label", "notice", "first_word", "n_words", "edits")
    kinds = (
        pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64())])),
        pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("edits", pa.int32())])),
    )
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run,
        f"`{id_column}` {kind}, n_words long, base array<struct<label: string, first_word: bigint>>, notices array<struct<label: string, notice: string, first_word: bigint, n_words: bigint, edits: int>>",
    )


def digest(found: DataFrame) -> DataFrame:
    """Counts, places and labels of each row; ``score`` is 1 for an exact phrase, else 1 - edits / characters of the closest notice, else 0."""
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    close = F.transform("notices", lambda x: 1.0 - x["edits"] / F.length(x["notice"]))
    return found.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("base.first_word").alias("first_word"),
        F.array_max("base.first_word").alias("last_word"),
        joined(F.col("base.label")).alias("base_labels"),
        joined(F.concat("base.label", "notices.label")).alias("labels"),
        F.when(F.size("base") > 0, 1.0).otherwise(F.coalesce(F.array_max(close), F.lit(0.0))).alias("score"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


CHECK = f"""
with w as materialized (select row_number() over () as row, doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
 '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x != '') as words from documents),
j as materialized (select *, array_to_string(words, ' ') as joined from w),
phrase(label, phrase) as (values {", ".join(f"({_quoted(a)}, {_quoted(b)})" for a, b in PHRASES)}),
base as (select row, label, i from (select row, words, label, string_split(phrase, ' ') as p, unnest(range(len(words))) as i from j, phrase where contains(joined, phrase))
 where words[i + 1:i + len(p)] = p),
notice(label, notice, edits, piece) as (values {", ".join(f"({_quoted(a)}, {_quoted(n)}, {allowed(n)}, {_quoted(p)})" for a, n in NOTICES for _, p in seeds(n, allowed(n)))}),
asked as (select distinct row, label, notice, edits from j, notice where contains(joined, piece)),
runs as (select row, label, notice, edits, words, unnest(range(len(words))) as i from asked join j using (row)),
sized as (select *, len(string_split(notice, ' ')) as k from runs),
tried as (select row, label, notice, edits, array_to_string(words[i + 1:i + n], ' ') as x
 from (select *, unnest(range(greatest(1, k - edits), k + edits + 1)) as n from sized) where i + n <= len(words)),
near as (select row, label, min(levenshtein(x, notice) / len(notice)) as apart from tried where len(x) between len(notice) - edits and len(notice) + edits and levenshtein(x, notice) <= edits group by all),
close as (select row, list(distinct label) as labels, max(1.0 - apart) as score from near group by row),
exact as (select row, count(*) as n, min(i) as low, max(i) as high, list(distinct label) as labels from base group by row)
select doc_id, cast(len(words) as bigint) as n_words, coalesce(e.n, 0) as n_base, e.low as first_word, e.high as last_word,
 coalesce(array_to_string(list_sort(e.labels), ','), '') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(coalesce(e.labels, []), coalesce(c.labels, [])))), ',') as labels,
 case when e.n > 0 then 1.0 else coalesce(c.score, 0.0) end as score
from j left join exact e using (row) left join close c using (row)"""


@query("op13_license_scan", CHECK)
def op13_license_scan(spark, sf_dir):
    return digest(license_scan(table(spark, sf_dir, "documents")))
