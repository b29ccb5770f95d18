"""Column expressions on texts that several operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
_SPACE_CHARS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(_SPACE_CHARS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(
        F.array().cast("array<string>"))


def head(items: Column, drop: int) -> Column:
    """``items`` without its last ``drop`` elements."""
    return F.slice(items, F.lit(1), F.greatest(F.size(items) - drop, F.lit(0)))


def tail(items: Column, drop: int) -> Column:
    """``items`` without its first ``drop`` elements."""
    return F.slice(items, F.lit(drop + 1), F.greatest(F.size(items) - drop, F.lit(0)))


def chars_in(text: Column, char_class: str) -> Column:
    """Number of code points of ``text`` in the regular-expression class ``[char_class]``."""
    return F.length(F.regexp_replace(text, f"[^{char_class}]+", "")).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
