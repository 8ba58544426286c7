"""Toxicity: a factorisation machine over hashed terms and their pairs.

The pairwise part learns what two terms say together, such as an insult next to
the mention of a group, beyond the sum of their weights. Terms are the words of
a text in lower case and their first letters, by presence; see ``factorisation`` for nulls, empty texts
and samples.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import factorisation

THRESHOLD = 0.5
#: Bytes of a beginning, so that the forms of a word have a term in common.
STEM = 5

#: Letters and bytes over 0x7F stay, A-Z become a-z, all else parts words.
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


def describe(text: bytes) -> tuple[list[float], set[bytes]]:
    """No dense values; the distinct words and the beginnings of the longer ones."""
    words = set(text.translate(_WORDS).split())
    return [], words | {b"^" + w[:STEM] for w in words if len(w) > STEM}


def rate(
    docs: DataFrame,
    labels: DataFrame,
    usable: Callable[[Column], Column],
    keep: Iterable[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: ``row`` (the kept columns), ``score`` (1: toxic), ``predicted`` (1 from the threshold on)."""
    machine = factorisation.fit(docs, labels, "toxic", usable, describe)
    out = factorisation.scored(docs, machine, describe, keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
