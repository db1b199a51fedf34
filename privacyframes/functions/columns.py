"""Column forms of the validation rules, for use outside detection."""

from __future__ import annotations

from pyspark.sql import Column

from . import validate
from .detect import _col
from .sqltext import bind
from .text import ascii_digits


def accepted(entity, value, strict_aadhaar: bool = False) -> Column:
    """Would this value count as a finding of this entity?"""
    return bind(
        lambda r: validate.valid_finding(r.entity, r.value, strict_aadhaar), entity=_col(entity), value=_col(value)
    )


def luhn_check(value) -> Column:
    return bind(lambda r: validate.luhn_ok(r.v), v=_col(value))


def verhoeff_check(digits) -> Column:
    return bind(lambda r: validate.verhoeff_ok(r.v), v=_col(digits))


def normalized_digits(value) -> Column:
    """Digits of any script as 0-9, everything else dropped."""
    return bind(lambda r: ascii_digits(r.v), v=_col(value))
