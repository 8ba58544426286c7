"""Recodes and flags."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyframe.functions.dates import col


def two_way(value: Column | str, match: str, label: str, other: str) -> Column:
    """`label` where the value matches, `other` for everything else, null too."""
    return F.when(col(value) == match, F.lit(label)).otherwise(F.lit(other))


def two_way_by_source(
    value: Column | str, source: Column | str, rules: Mapping[str, tuple[str, str, str]]
) -> Column:
    """Two-way recode whose rule (match, label, other) depends on the source.

    A row from a source without a rule keeps its value.
    """
    result = col(value)
    for name, (match, label, other) in rules.items():
        result = F.when(col(source) == name, two_way(value, match, label, other)).otherwise(result)
    return result


def override(value: Column | str, when: Column, replacement) -> Column:
    return F.when(when, F.lit(replacement)).otherwise(col(value))


def flag(value: Column | str, mark: str = "X") -> Column:
    """True for the mark, false for anything else, null too."""
    return F.coalesce(col(value) == mark, F.lit(False))


def decode(value: Column | str, names: Mapping[int, str], other: str) -> Column:
    result = F.lit(other)
    for code, name in reversed(list(names.items())):
        result = F.when(col(value) == code, F.lit(name)).otherwise(result)
    return result


def starts_with(value: Column | str, prefix: str) -> Column:
    """Case-sensitive prefix test; null does not start with anything."""
    return F.coalesce(col(value).startswith(prefix), F.lit(False))
