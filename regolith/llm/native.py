"""Column expressions shared by the operators that stay in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The six white-space characters between words, and the class of their runs.
SPACE = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE))


def words(text: Column) -> Column:
    """Words of a text; null and blank texts have none."""
    t = stripped(F.coalesce(text, F.lit("")))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, SPACE_RUN))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def without(text: Column, chars: str) -> Column:
    """The text without some characters: byte-wise replaces, much cheaper than ``translate``."""
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def count_of(text: Column, chars: str) -> Column:
    """How many characters of a text are in ``chars``."""
    return F.length(text) - F.length(without(text, chars))


def window_hashes(array: str, k: int) -> Column:
    """Hash of each run of ``k`` elements of an array column; empty if it is shorter."""
    hashed = F.transform(
        F.sequence(F.lit(0), F.size(array) - k),
        lambda i: F.xxhash64(*[F.get(F.col(array), i + j) for j in range(k)]),
    )
    return F.when(F.size(array) >= k, hashed).otherwise(F.array().cast("array<bigint>"))
