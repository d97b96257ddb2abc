"""Repeatable pseudo-random choices from hashes, and text templates."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_number(*parts) -> Column:
    """A whole number below 2^28 from the parts; the same in any engine with MD5."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws("|", *[c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("int")


def pick_index(n, *parts) -> Column:
    size = n if isinstance(n, Column) else F.lit(n)
    return F.when(size > 0, hash_number(*parts) % size).cast("int")


def fill(template: str, values: dict[str, Column]) -> Column:
    """A template's text with its ``{name}`` parts replaced by columns."""
    pieces = [p for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(
        *[values[p[1:-1]] if re.fullmatch(r"\{\w+\}", p) else F.lit(p) for p in pieces]
    )


def choose_filled(templates: tuple[str, ...], index: Column, values: dict[str, Column]) -> Column:
    """The ``index``-th template, filled; only the chosen branch is evaluated."""
    out = None
    for i, template in enumerate(templates):
        value = fill(template, values)
        out = F.when(index == i, value) if out is None else out.when(index == i, value)
    return out
