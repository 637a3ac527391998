"""Column expressions: keys, text predicates, keyword scoring, dates, ordinals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Rules = Sequence[tuple[str, Sequence[str]]]


def norm_key(c: Column | str) -> Column:
    """Lower-case stripped key; blank and ``unknown`` are null."""
    k = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(~k.isin("", "unknown"), k)


def blank_to_null(c: str) -> Column:
    return F.nullif(F.col(c), F.lit(""))


def short_hash(*parts: Column, bits: int = 256, length: int = 16, sep: str = "::") -> Column:
    """Prefix of the hex digest of parts joined by ``sep``: sha-256, or md5 for ``bits=128``."""
    joined = F.concat_ws(sep, *parts)
    return F.substring(F.md5(joined) if bits == 128 else F.sha2(joined, bits), 1, length)


def any_of(text: Column, phrases: Sequence[str]) -> Column:
    """Whether a lower-case text contains any phrase."""
    out = F.lit(False)
    for p in phrases:
        out = out | text.contains(p)
    return out


def first_match(text: Column, rules: Rules, default: str | None) -> Column:
    """Label of the first rule with a phrase in the lower-case text."""
    out = F
    for label, phrases in rules:
        out = out.when(any_of(text, phrases), F.lit(label))
    return out.otherwise(F.lit(default))


def parse_date(text: str | Column, month_first: bool = False) -> Column:
    """Date from the notices' formats: ISO first, then compact, month names, slashes by preference."""
    t = F.substring(F.trim(F.col(text) if isinstance(text, str) else text), 1, 30)
    slashes = ["MM/dd/yyyy", "dd/MM/yyyy"] if month_first else ["dd/MM/yyyy", "MM/dd/yyyy"]
    shapes = [
        (r"^\d{4}-\d{2}-\d{2}([T ].*)?$", None),
        (r"^\d{8}$", "yyyyMMdd"),
        (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
        (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
        (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
        (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
        *[(r"^\d{1,2}/\d{1,2}/\d{4}$", s.replace("dd", "d").replace("MM", "M")) for s in slashes],
        (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    ]
    tries = [F.when(t.rlike(p), F.to_date(F.try_to_timestamp(F.substring(t, 1, 10) if f is None else t, F.lit(f or "yyyy-MM-dd")))) for p, f in shapes]
    return F.coalesce(*tries)


def rank_of(c: Column, order: Sequence[str], default: int, start: int = 0) -> Column:
    """Position of a value in ``order``."""
    out = F
    for i, v in enumerate(order):
        out = out.when(c == v, F.lit(start + i))
    return out.otherwise(F.lit(default))


def mdy_sort_key(date: Column) -> Column:
    """Date as yyyymmdd number, 0 if missing."""
    return F.coalesce(F.date_format(date, "yyyyMMdd").cast("int"), F.lit(0))


def first_filled(*columns: str) -> Column:
    """The first column that is neither null nor empty, else an empty string."""
    return F.coalesce(*map(blank_to_null, columns), F.lit(""))


def joined_filled(*columns: str) -> Column:
    return F.concat_ws(" ", *map(blank_to_null, columns))


def icase(pattern: str) -> str:
    return f"(?is){pattern}" if not pattern.startswith("(?") else pattern
