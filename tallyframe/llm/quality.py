"""Quality classifier: a factorisation machine over words, structure and length.

Inputs are the hashed words and word shapes of a text, statistics of its
structure, and its length. The share of label 1 is a probability; see
``factorisation`` for nulls, empty texts and samples.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import factorisation

THRESHOLD = 0.7

_DROP_LETTERS = bytes(c for c in range(256) if c >= 0x80 or chr(c).isalnum() and c < 0x80)


def describe(text: bytes) -> tuple[list[float], set[bytes]]:
    """Statistics of the structure, and the words with their signs."""
    n = max(len(text), 1)
    words = text.split()
    count = max(len(words), 1)
    distinct = set(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    line_count = max(len(lines), 1)
    signs = text.translate(None, _DROP_LETTERS)
    blank = sum(signs.count(c) for c in (b" ", b"\n", b"\t", b"\r"))
    upper = n - len(text.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")) if text else 0
    digits = n - len(text.translate(None, b"0123456789")) if text else 0
    dense = [
        math.log1p(len(text)),
        len(text) / count if text else 0.0,
        len(distinct) / count,
        len(set(lines)) / line_count,
        math.log1p(len(text) / line_count),
        (len(signs) - blank) / n,
        upper / n,
        digits / n,
        max(Counter(words).values(), default=0) / count,
        text.count(b"|") / count,
        text.count(b"!") / count,
    ]
    shapes = {b"#" + w[:12] for w in {w.translate(None, _DROP_LETTERS) for w in distinct}}
    return dense, set(text.lower().split()) | shapes


def rate(
    docs: DataFrame,
    labels: DataFrame,
    usable: Callable[[Column], Column],
    keep: Iterable[str] | None = None,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Per row: ``row`` (the kept columns), ``score`` (1: good), ``predicted`` (1 from the threshold on)."""
    machine = factorisation.fit(docs, labels, "quality", usable, describe)
    out = factorisation.scored(docs, machine, describe, keep)
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
