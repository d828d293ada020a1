"""Masking and detecting natural-person ids in text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_DOTTED = "(?<![0-9])([0-9]{3})\\.([0-9]{3})\\.([0-9]{3})-([0-9]{2})(?![0-9])"
_BARE = "(?<![0-9])([0-9]{3})([0-9]{3})([0-9]{3})([0-9]{2})(?![0-9])"
_MASK = "***.$2.$3-**"
_ANY_DOTTED = "[0-9]{3}\\.[0-9]{3}\\.[0-9]{3}-[0-9]{2}"


def mask_person(c: Column) -> Column:
    """Replace 11-digit person ids, bare or dotted, keeping digits 4 to 9."""
    return F.regexp_replace(F.regexp_replace(c, _DOTTED, _MASK), _BARE, _MASK)


def is_masked(c: Column) -> Column:
    return c.startswith("***") & F.contains(c, F.lit("-"))


def count_digits(c: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", ""))


def is_company(c: Column) -> Column:
    return count_digits(c) == 14


def is_person(c: Column) -> Column:
    return count_digits(c) == 11


def _check_digit(c: Column, length: int) -> Column:
    total = sum(
        (F.substring(c, i + 1, 1).try_cast("int") * F.lit(length + 1 - i) for i in range(length)),
        F.lit(0),
    )
    rest = total % 11
    return F.when(rest < 2, F.lit(0)).otherwise(11 - rest)


def has_raw_person(c: Column) -> Column:
    """A dotted id anywhere, or exactly 11 digits with valid check digits."""
    eleven = c.rlike("^[0-9]{11}$")
    varied = F.replace(c, F.substring(c, 1, 1), F.lit("")) != ""
    valid = (F.substring(c, 10, 1).try_cast("int") == _check_digit(c, 9)) & (
        F.substring(c, 11, 1).try_cast("int") == _check_digit(c, 10)
    )
    return c.rlike(_ANY_DOTTED) | F.coalesce(eleven & varied & valid, F.lit(False))
