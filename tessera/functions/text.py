"""Text expressions shared by operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Python's white space as a Java character class.
WHITE = r"\s\x1c-\x1f\x{85}\p{Z}"


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def not_blank(c: Column | str) -> Column:
    """True where the text holds a character other than white space; false for null."""
    return F.coalesce(as_column(c).rlike(f"[^{WHITE}]"), F.lit(False))


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(as_column(c), f"^[{WHITE}]+|[{WHITE}]+$", "")


def last_segment(c: Column | str, sign: str = "/") -> Column:
    """What follows the last such sign; the whole text where there is none."""
    return F.substring_index(as_column(c), sign, -1)
