"""Text helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from feedlake import constants as C


def trim_space(col: Column) -> Column:
    """Strip Unicode white space from both ends (plain ``trim`` strips U+0020 only)."""
    return F.trim(col, F.lit(C.WHITE_SPACE))


def is_blank(col: Column) -> Column:
    return trim_space(col) == ""


def contains_any(col: Column, words) -> Column:
    """True when ``col`` holds one of the literal ``words``."""
    hit = F.lit(False)
    for word in words:
        hit = hit | col.contains(word)
    return hit


def ends_with_any(col: Column, endings) -> Column:
    hit = F.lit(False)
    for ending in endings:
        hit = hit | col.endswith(ending)
    return hit
