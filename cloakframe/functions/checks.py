"""Check-digit tests used to confirm a shape match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let


def digits_only(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _digit(digits: Column, position: int) -> Column:
    return F.substring(digits, position, 1).cast("int")


def _weighted(digits: Column, weights: list[int]) -> Column:
    total = F.lit(0)
    for position, weight in enumerate(weights, start=1):
        total = total + _digit(digits, position) * F.lit(weight)
    return total


def luhn(text: Column) -> Column:
    return F.call_function("luhn_check", digits_only(text))


def mod97(text: Column) -> Column:
    """International bank account check: letters count 10..35, remainder 1."""
    plain = F.upper(F.regexp_replace(text, "[^A-Za-z0-9]", ""))
    moved = let(plain, lambda p: F.concat(F.substring(p, F.lit(5), F.length(p)), F.substring(p, 1, 4)))

    def step(acc: Column, char: Column) -> Column:
        code = F.ascii(char)
        value = F.when(code >= 65, code - 55).otherwise(code - 48)
        shift = F.when(code >= 65, F.lit(100)).otherwise(F.lit(10))
        return (acc * shift + value) % F.lit(97)

    chars = F.filter(F.split(moved, ""), lambda c: c != F.lit(""))
    return F.aggregate(chars, F.lit(0), step) == F.lit(1)


def mod11(text: Column) -> Column:
    """Ten-digit health number: weights 10..2, check digit 11 minus remainder."""

    def test(digits: Column) -> Column:
        check = (F.lit(11) - _weighted(digits, [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 11
        return (F.length(digits) == 10) & (check == _digit(digits, 10))

    return let(digits_only(text), test)


def dea(text: Column) -> Column:
    """Prescriber number: (d1+d3+d5) + 2(d2+d4+d6) ends in d7."""
    return let(digits_only(text), lambda d: _weighted(d, [1, 2, 1, 2, 1, 2]) % 10 == _digit(d, 7))


CHECKS = {"luhn": luhn, "mod97": mod97, "mod11": mod11, "dea": dea}


# --- the same tests of one value ---------------------------------------------------------------------------------


def _digits(text: str) -> list[int]:
    return [int(c) for c in re.sub("[^0-9]", "", text)]


def _sum(digits: list[int], weights: list[int]) -> int:
    return sum(d * w for d, w in zip(digits, weights))


def _luhn(text: str) -> bool:
    digits = _digits(text)[::-1]
    return bool(digits) and (sum(digits[::2]) + sum(2 * d - 9 * (d > 4) for d in digits[1::2])) % 10 == 0


def _mod97(text: str) -> bool:
    plain, left = re.sub("[^A-Za-z0-9]", "", text).upper(), 0
    for c in plain[4:] + plain[:4]:
        left = (left * (100 if c >= "A" else 10) + int(c, 36)) % 97
    return left == 1


def _mod11(text: str) -> bool:
    digits = _digits(text)
    return len(digits) == 10 and (11 - _sum(digits, [10, 9, 8, 7, 6, 5, 4, 3, 2]) % 11) % 11 == digits[9]


def _dea(text: str) -> bool:
    digits = _digits(text)
    return len(digits) > 6 and _sum(digits, [1, 2, 1, 2, 1, 2]) % 10 == digits[6]


VALUE_CHECKS = {"luhn": _luhn, "mod97": _mod97, "mod11": _mod11, "dea": _dea}
