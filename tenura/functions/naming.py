"""Readable names for model features."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tenura import fixed_values as fv


def _remove(text: Column, part: str) -> Column:
    return F.replace(text, F.lit(part), F.lit(""))


def _spaced(text: Column) -> Column:
    return F.translate(text, "_", " ")


def title_case(text: Column) -> Column:
    """Upper case for every letter that does not follow a letter, lower case for the others."""
    chars = F.split(text, "")

    def cased(c: Column, i: Column) -> Column:
        after_letter = F.coalesce(F.get(chars, i - 1).rlike(r"\p{L}"), F.lit(False))
        return F.when(after_letter, F.lower(c)).otherwise(F.upper(c))

    return F.array_join(F.transform(chars, cased), "")


def raw_name(feature: Column) -> Column:
    return _remove(_remove(feature, "num__"), "cat__")


def display_name(feature: Column) -> Column:
    raw = raw_name(feature)
    name = F
    for key, (text, _) in fv.FEATURE_NAMES.items():
        name = name.when(raw == key, text)
    for prefix, (title, _) in fv.FEATURE_PREFIXES.items():
        shown = F.concat(F.lit(f"{title}: "), _spaced(_remove(raw, prefix)))
        name = name.when(raw.startswith(prefix), shown)
    return name.otherwise(title_case(_spaced(raw)))


def interpretation(feature: Column) -> Column:
    raw = raw_name(feature)
    text = F
    for key, (_, meaning) in fv.FEATURE_NAMES.items():
        text = text.when(raw == key, meaning)
    for prefix, (_, meaning) in fv.FEATURE_PREFIXES.items():
        text = text.when(raw.startswith(prefix), meaning)
    return text.otherwise(fv.FEATURE_FALLBACK)
