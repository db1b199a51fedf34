"""Recogniser definitions and their translation to JVM regular expressions."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import Column

from . import fixed
from .sqltext import X, fn, lit
from .text import SPACE, WORD, WORD_BEHIND

_BOUNDARY = rf"(?:(?<=[{WORD_BEHIND}])(?![{WORD}])|(?<![{WORD_BEHIND}])(?=[{WORD}]))"


def jvm_pattern(
    pattern: str, ignore_case: bool = False, starts_in_word: bool = False, ends_in_word: bool = False
) -> str:
    """Rewrite a Unicode ``re`` pattern for ``java.util.regex``.

    Word, digit and space classes are spelled out so that results do not depend on JVM defaults. A word
    boundary next to something that can only be a word character needs one look-around instead of two;
    the two flags say so for the first and the last ``\\b``.
    """
    body, prefix, suffix = pattern, "", ""
    if starts_in_word and body.startswith(r"\b"):
        body, prefix = body[2:], rf"(?<![{WORD_BEHIND}])"
    if ends_in_word and body.endswith(r"\b"):
        body, suffix = body[:-2], rf"(?![{WORD}])"
    body = body.replace(r"\b", _BOUNDARY).replace(r"\d", r"\p{Nd}").replace(r"\s", f"[{SPACE}]")
    return ("(?iu)" if ignore_case else "") + prefix + body + suffix


@dataclasses.dataclass(frozen=True)
class Probe:
    """Cheap facts about one text, computed once and shared by all recognisers."""

    text: X
    digits: X  # the text with every run of non-digits replaced by one space
    folded: X  # lower-cased text
    indic: X  # has a Devanagari or Gujarati character


@dataclasses.dataclass(frozen=True)
class Recognizer:
    """One pattern.

    ``guard`` maps a :class:`Probe` to a boolean that is true whenever the pattern could match; it only
    saves work. ``validator`` replaces the built-in rule of the entity and sees the stripped value.
    """

    name: str
    entity: str
    pattern: str
    ignore_case: bool = False
    score: float = fixed.PATTERN_SCORE
    source: str = "regex"
    validator: Callable[[X], X] | None = None
    guard: Callable[[Probe], X] | None = None
    starts_in_word: bool = False
    ends_in_word: bool = False
    skip: str | None = None
    tight: str | None = None

    @property
    def jvm(self) -> str:
        return jvm_pattern(self.pattern, self.ignore_case, self.starts_in_word, self.ends_in_word)

    @property
    def scan(self) -> str:
        """The pattern as group 1, or else what ``skip`` takes: text in which no match can start once one start has failed.

        Without it, every start in a long run is tried up to the end of the run, which is quadratic. ``tight`` is the same pattern
        without steps back that can't help.
        """
        if self.skip is None:
            return self.jvm
        match = jvm_pattern(self.tight or self.pattern, False, self.starts_in_word, self.ends_in_word)
        return ("(?iu)" if self.ignore_case else "") + f"({match})|{jvm_pattern(self.skip, False, self.starts_in_word)}"


#: What a function recogniser returns for a text. A null entity or score stands for the recogniser's own.
FUNCTION_HITS = "array<struct<start:int,end:int,entity_type:string,score:double>>"


@dataclasses.dataclass(frozen=True)
class FunctionRecognizer:
    """Any function from a text column to a column of hits (``FUNCTION_HITS``): built-in functions, or a ``pandas_udf``.

    It stands among the patterns in the order they are given: of equal hits the earlier recogniser's is kept. Values are cut from the text;
    hits out of it, or without a value, are dropped, and ``checked`` ones must pass the rule of their entity.
    """

    name: str
    entity: str
    find: Callable[[Column], Column]
    score: float = fixed.PATTERN_SCORE
    source: str = "custom"
    checked: bool = True


def _has(*needles: str) -> Callable[[Probe], X]:
    def guard(p: Probe) -> X:
        tests = [fn.contains(p.folded, lit(n)) for n in needles]
        out = tests[0]
        for t in tests[1:]:
            out = out | t
        return out

    return guard


def _digits(shape: str) -> Callable[[Probe], X]:
    return lambda p: p.digits.rlike(shape)


def _both(*guards) -> Callable[[Probe], X]:
    def guard(p: Probe) -> X:
        out = guards[0](p)
        for g in guards[1:]:
            out = out & g(p)
        return out

    return guard


def _indic(p: Probe) -> X:
    return p.indic


_MONTHS = _has("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")

# Necessary conditions. In ``digits`` each separator run is one blank, so one blank stands for any separator.
_GUARDS = {
    "EMAIL_ADDRESS": _has("@"),
    "PHONE_NUMBER": _digits(r"[6-9]\p{Nd}{9}"),
    "IP_ADDRESS": _digits(r"\p{Nd} \p{Nd}{1,3} \p{Nd}{1,3} \p{Nd}"),
    "IN_PAN": _digits("[0-9]{4}"),
    "IN_AADHAAR": _digits("[0-9]{4} ?[0-9]{4} ?[0-9]{4}"),
    "IN_VID": _both(_digits("[0-9]{4} ?[0-9]{4} ?[0-9]{4} ?[0-9]{4}"), _has("vid")),
    "DATE_OF_BIRTH": _digits("[0-3][0-9] [01][0-9] [12][0-9]{3}"),
    "DATE_OF_BIRTH_TEXT": _both(_digits("[1-9] [12][0-9]{3}|[123]0 [12][0-9]{3}"), _MONTHS),
    "IN_ADDRESS": _both(_digits(r"\p{Nd}"), _has("road", "rd", "st", "lane", "ln", "ave", "nagar", "colony", "sector", "block")),
    "IN_ADDRESS_INDIC": _indic,
    "IN_ADDRESS_LABELLED": _has("address"),
    "PIN_CODE": _digits("[0-9]{6}"),
    "UPI_ID": _has("@"),
    "CREDIT_CARD": _digits(r"(?:\p{Nd} ?){13}"),
    "PASSPORT_NUMBER": _digits("[1-9][0-9]{6}"),
    "BANK_ACCOUNT": _digits("[0-9]{11}"),
    "IFSC_CODE": _digits("0"),
    "DEVICE_ID": _has("android-", "ios-"),
    "FINGERPRINT_TEMPLATE": _has("fp_hash_"),
    "FACE_TEMPLATE": _has("face_tmp_"),
    "BANK_NAME": _has("bank"),
    "PHONE_NUMBER_LABEL_HI_GU": _both(_indic, _digits(r"[6-9]\p{Nd}{9}")),
    "IN_AADHAAR_LABEL_HI_GU": _both(_indic, _digits(r"\p{Nd}{4} ?\p{Nd}{4} ?\p{Nd}{4}")),
    "IN_PAN_LABEL_HI_GU": _both(_digits("[0-9]{4}"), lambda p: p.indic | fn.contains(p.folded, lit("pan"))),
    "DATE_OF_BIRTH_LABEL_HI_GU": _both(_indic, _digits(r"\p{Nd}{1,2} \p{Nd}{1,2} \p{Nd}{4}")),
    "IN_ADDRESS_LABEL_HI_GU": _indic,
    "IN_ADDRESS_PIN_LABEL": _both(_digits(r"\p{Nd}{6}"), lambda p: p.indic | fn.contains(p.folded, lit("pin"))),
}

# Runs that are passed over as a whole when a match can't start in them. Of a number line everything goes but digits at its end:
# a start there may reach over a line break.
_SKIPS = {
    "EMAIL_ADDRESS": r"\b[A-Za-z0-9._%+-]{64,}+",
    "UPI_ID": r"\b[a-zA-Z0-9._-]{64,}+",
    "IN_ADDRESS": r"\b\d{1,4}+\s++[A-Za-z ,.-]*+(?:[0-9]++(?: *+[A-Za-z,.-][A-Za-z ,.-]*+| ++(?=[0-9])))*+",
}

# Of an address's number and the blanks after it nothing is given back: a blank can't be the first letter of what follows.
_TIGHT = {label: (r"\b\d{1,4}\s+", r"\b\d{1,4}+\s++") for label in ("IN_ADDRESS",)}


def _tight(label: str, pattern: str) -> str | None:
    loose, tight = _TIGHT.get(label, ("", ""))
    return tight + pattern.removeprefix(loose) if loose and pattern.startswith(loose) else None


# Patterns whose first match character may not be a word character, and the same for the last one.
_OPEN_START = {"EMAIL_ADDRESS", "PHONE_NUMBER", "DATE_OF_BIRTH", "DATE_OF_BIRTH_TEXT", "IN_ADDRESS_INDIC", "UPI_ID"}
_OPEN_END = {"CREDIT_CARD", "IN_ADDRESS_INDIC"}

DEFAULT: tuple[Recognizer, ...] = tuple(
    Recognizer(
        name=label,
        entity=fixed.LABEL_ENTITY.get(label, label),
        pattern=pattern,
        ignore_case=ignore_case,
        guard=_GUARDS.get(label),
        starts_in_word=label not in _OPEN_START,
        ends_in_word=label not in _OPEN_END,
        skip=_SKIPS.get(label),
        tight=_tight(label, pattern),
    )
    for label, pattern, ignore_case in fixed.PATTERNS
)

# Scored twins: only those at or above the external threshold can ever produce a finding.
SCORED: tuple[Recognizer, ...] = tuple(
    Recognizer(f"SCORED_{label}", label, pattern, ignore_case, score, "presidio", guard=_digits(r"\p{Nd}"))
    for label, pattern, ignore_case, score in fixed.SCORED_PATTERNS
    if score >= fixed.EXTERNAL_MIN_SCORE
)


def named(*names: str) -> tuple[Recognizer, ...]:
    """Built-in recognisers by name, in evaluation order."""
    unknown = set(names) - {r.name for r in DEFAULT}
    if unknown:
        raise ValueError(f"unknown recognizers: {sorted(unknown)}")
    return tuple(r for r in DEFAULT if r.name in names)
