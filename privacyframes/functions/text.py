"""Blocked scans over arrays and Unicode-aware text rules, all of them built-in Spark expressions."""

from __future__ import annotations

import functools
import sys
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .sqltext import X, fn, let, struct, when

WORD = r"\p{L}\p{N}_"
# The extra digit is in \p{N} already; a literal above U+FFFF makes Java step back by whole code points.
WORD_BEHIND = WORD + "\U0001d7d7"
SPACE = r"\p{IsWhite_Space}\x1c-\x1f"
# Spark copies a fold's state at every step, so scans carry plain numbers only and work in short blocks.
SCAN_BLOCK = 256


def scan(items: X, start: dict, step, finish) -> X:
    """Left fold whose state holds a growing array ``out``; ``start`` gives the first state, field by field.

    The fold runs block by block: inner blocks begin with an empty ``out`` and are appended once, so a
    document with hundreds of thousands of hits does not copy its whole output for every hit.
    """
    carried = [k for k in start if k != "out"]

    def outer(state: X, block: X) -> X:
        first = struct(**{k: state[k] for k in carried}, out=start["out"])
        return fn.aggregate(
            block, first, step, lambda s: struct(**{k: s[k] for k in carried}, out=fn.concat(state.out, s.out))
        )

    def blocks(it: X) -> X:
        n = fn.ceil(fn.size(it) / SCAN_BLOCK).cast("int")
        many = fn.transform(fn.sequence(0, n - 1), lambda b: fn.slice(it, b * SCAN_BLOCK + 1, SCAN_BLOCK))
        return when(fn.size(it) <= SCAN_BLOCK, fn.array(it)).otherwise(many)

    return let(items, lambda it: fn.aggregate(blocks(it), struct(**start), outer, finish))


def running(items: X, combine) -> X:
    """Running value over an array of numbers: ``combine(value so far, item)``, starting from 0."""

    def step(s: X, x: X) -> X:
        v = combine(s.v, x)
        return struct(v=v, out=fn.concat(s.out, fn.array(v)))

    return scan(items, {"v": X("0L"), "out": X("cast(array() as array<bigint>)")}, step, lambda s: s.out)


@functools.cache
def _digit_values() -> tuple[str, str]:
    """All characters Python counts as digits, and their ASCII values (a Unicode rule, not a table)."""
    chars = [c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isdigit()]
    return "".join(chars), "".join(str(unicodedata.digit(c)) for c in chars)


@functools.cache
def _digit_class() -> str:
    """Regex class of the same characters: decimal digits, plus ranges of the other digit signs."""
    points = sorted(ord(c) for c in _digit_values()[0] if unicodedata.category(c) != "Nd")
    ranges: list[list[int]] = []
    for p in points:
        if ranges and p == ranges[-1][1] + 1:
            ranges[-1][1] = p
        else:
            ranges.append([p, p])
    return r"[\p{Nd}" + "".join(chr(a) + ("-" + chr(b) if b > a else "") for a, b in ranges) + "]"


def is_ascii(v: X) -> X:
    return fn.octet_length(v) == fn.length(v)


def strip(v: X) -> X:
    """Trim every Unicode whitespace character on both sides."""
    return fn.regexp_replace(v, (rf"^[{SPACE}]+|[{SPACE}]+$"), (""))


def words(v: X) -> X:
    """Whitespace-separated words of a stripped string."""
    return fn.filter(fn.split(v, rf"[{SPACE}]+"), lambda w: fn.length(w) > 0)


def ascii_digits(v: X) -> X:
    """Digits of any script, written as 0-9; everything else dropped. Plain ASCII takes the short way."""
    kept = fn.regexp_replace(v, f"[^{_digit_class()[1:]}", "")
    return when(is_ascii(v), fn.regexp_replace(v, "[^0-9]", "")).otherwise(fn.translate(kept, *_digit_values()))


def decimal_digits(v: X) -> X:
    """Decimal digits kept as written (what dropping ``\\D`` leaves)."""
    return fn.regexp_replace(v, r"[^\p{Nd}]", "")


def is_digits(v: X) -> X:
    return when(is_ascii(v), v.rlike("^[0-9]+$")).otherwise(v.rlike(f"^{_digit_class()}+$"))


def has_digit(v: X) -> X:
    return when(is_ascii(v), v.rlike("[0-9]")).otherwise(v.rlike(_digit_class()))


def compact_upper(v: X) -> X:
    """ASCII letters and digits only, upper-cased."""
    return fn.upper(fn.regexp_replace(v, ("[^A-Za-z0-9]"), ("")))


def head(v: X, n: int) -> X:
    return fn.substring(v, 1, n)


def tail(v: X, n: int) -> X:
    """Last ``n`` characters, or the whole value when shorter."""
    return fn.right(v, (n))


def stars(n: X) -> X:
    return fn.repeat(("*"), fn.greatest(n.cast("int"), (0)))


def utf8_text(content: Column) -> Column:
    """Binary content as text with undecodable bytes dropped.

    Valid content (nearly all of it) is only checked and cast; a byte order mark is kept. Otherwise real replacement characters are
    put aside before the bad bytes become such characters and go.
    """
    plain = content.cast("string")
    aside = F.replace(F.replace(plain, F.lit("\ufdd0"), F.lit("\ufdd0\ufdd1")), F.lit("\ufffd"), F.lit("\ufdd0\ufdd2"))
    clean = F.replace(F.make_valid_utf8(aside), F.lit("\ufffd"), F.lit(""))
    back = F.replace(F.replace(clean, F.lit("\ufdd0\ufdd2"), F.lit("\ufffd")), F.lit("\ufdd0\ufdd1"), F.lit("\ufdd0"))
    return F.when(F.is_valid_utf8(plain), plain).otherwise(back)
