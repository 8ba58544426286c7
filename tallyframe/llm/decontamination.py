"""Benchmark decontamination with a generalised suffix automaton over words.

The normalised benchmark items of one block form one automaton. The words of a
document stream through it; at each word the automaton knows the longest suffix
of the document so far that occurs in some item. Where that length reaches the
window, the window's words are hit.

Benchmark items come in blocks of at most ``BLOCK_WORDS`` words, so that the
automaton, which is broadcast, has a proven size; each further block is one more
pass over the rows, without a shuffle.

Null, empty and word-less texts have no words and are clean. A benchmark row
without words or without an id takes no part. Repeated items count once, by id.
Every row is judged by itself, so repeated rows get equal results, and an empty
table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import ROW, annotated, field, utf8

WINDOW = 13
COVERAGE_PERCENT = 5
BLOCK_WORDS = 200_000

FOUND = (
    field("n_words", "long"),
    field("spans", T.StructType([field("first", "int"), field("end", "int")]), many=True),
    field("items", "string", many=True),
)

#: Separators become blanks, A-Z become a-z, all else stays; bytes over 0x7F belong to words.
NORMAL = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(NORMAL).split()


class SuffixAutomaton:
    """All substrings of the added items, with the items that hold each window."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.items: list[tuple[str, list[int]]] = []

    def add(self, item_id: str, words: list[bytes]) -> None:
        ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
        self.items.append((item_id, ids))
        last = 0
        for word in ids:
            last = self._extended(last, word)

    def _state(self, transitions: dict[int, int], length: int) -> int:
        self.next.append(transitions)
        self.link.append(0)
        self.length.append(length)
        return len(self.next) - 1

    def _extended(self, last: int, word: int) -> int:
        if word in self.next[last]:
            old = self.next[last][word]
            return old if self.length[old] == self.length[last] + 1 else self._split(last, word, old)
        new = self._state({}, self.length[last] + 1)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            old = self.next[at][word]
            self.link[new] = old if self.length[old] == self.length[at] + 1 else self._split(at, word, old)
        return new

    def _split(self, at: int, word: int, old: int) -> int:
        """A copy of ``old`` that holds only its strings of ``length[at] + 1`` words or fewer."""
        copy = self._state(dict(self.next[old]), self.length[at] + 1)
        self.link[copy] = self.link[old]
        self.link[old] = copy
        while at >= 0 and self.next[at].get(word) == old:
            self.next[at][word] = copy
            at = self.link[at]
        return copy

    def close(self) -> SuffixAutomaton:
        """Fixes windows: by state, the ancestor that stands for the last ``window`` words, and its items."""
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.at_window = [0] * len(order)
        for state in order:
            if self.length[state] >= self.window:
                parent = self.link[state]
                self.at_window[state] = state if self.length[parent] < self.window else self.at_window[parent]
        self.held_by: dict[int, set[str]] = {}
        self.whole: dict[int, set[str]] = {}
        pairs = set()
        for item_id, ids in self.items:
            state = 0
            for i, word in enumerate(ids):
                state = self.next[state][word]
                if i + 1 >= self.window:
                    self.held_by.setdefault(self.at_window[state], set()).add(item_id)
                if i:
                    pairs.add(ids[i - 1] * len(self.vocabulary) + word)
            if len(ids) < self.window:
                self.whole.setdefault(state, set()).add(item_id)
        # the nearest suffix, itself included, that is a whole short item
        self.short = [-1] * len(order)
        for state in order[1:]:
            self.short[state] = state if state in self.whole else self.short[self.link[state]]
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min([self.window, *(len(ids) for _, ids in self.items)])
        return self

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(first word, end, items) of each window of the text that occurs in an item."""
        n = len(words)
        if not n or not self.items:
            return
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, n)
        for start, stop in self._segments(ids):
            state = length = 0
            for i in range(start, stop):
                word = int(ids[i])
                while state and word not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if word in self.next[state]:
                    state = self.next[state][word]
                    length += 1
                if length >= self.window:
                    yield i + 1 - self.window, i + 1, self.held_by[self.at_window[state]]
                shorter = self.short[state]
                while shorter > 0:
                    if self.length[shorter] <= length:
                        yield i + 1 - self.length[shorter], i + 1, self.whole[shorter]
                    shorter = self.short[self.link[shorter]]

    def _segments(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Runs whose neighbouring words are neighbours in some item too; no match leaves one."""
        known = ids >= 0
        joined = known[1:] & known[:-1]
        where = np.flatnonzero(joined)
        if len(where) and len(self.pairs):
            codes = ids[where] * len(self.vocabulary) + ids[where + 1]
            found = self.pairs[np.minimum(np.searchsorted(self.pairs, codes), len(self.pairs) - 1)]
            joined[where[found != codes]] = False
        elif len(where):
            joined[where] = False
        first = known.copy()
        first[1:] &= ~joined
        starts = np.flatnonzero(first)
        last = known.copy()
        last[:-1] &= ~joined
        stops = np.flatnonzero(last) + 1
        long = stops - starts >= self.least
        yield from zip(starts[long].tolist(), stops[long].tolist())


def automata(benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> Iterator[SuffixAutomaton]:
    """One automaton per block of items; the items stream through, a block at a time."""
    block, size = SuffixAutomaton(window), 0
    picked = benchmark.select(F.col("item_id").cast("string").alias("i"), F.col("text").alias("t"))
    for item_id, text in picked.where("i is not null and t is not null").toLocalIterator():
        words = words_of(text.encode())
        if not words:
            continue
        if size and size + len(words) > block_words:
            yield block.close()
            block, size = SuffixAutomaton(window), 0
        block.add(item_id, words)
        size += len(words)
    yield block.close()


def _merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the given runs of words."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(NORMAL))]
    kept, at = [], 0
    for first, end in spans:
        kept.append(text[at : places[first][0]])
        at = places[end - 1][1]
    return b"".join([*kept, text[at:]]).decode()


def _matched(frame: DataFrame, keep: list[str], automaton: SuffixAutomaton) -> DataFrame:
    """One pass with one block; adds to what earlier blocks have found."""
    shipped = frame.sparkSession.sparkContext.broadcast(automaton)

    def step(parts):
        block = shipped.value
        for texts, spans_before, items_before in parts:
            counts, spans, items = [], [], []
            for text, old, named in zip(utf8(texts), spans_before.to_pylist(), items_before.to_pylist()):
                words = words_of(text)
                found, named = {(x["first"], x["end"]) for x in old or ()}, set(named or ())
                for first, end, ids in block.matches(words):
                    found.add((first, end))
                    named |= ids
                counts.append(len(words))
                spans.append([{"first": a, "end": b} for a, b in _merged(found)])
                items.append(sorted(named))
            yield counts, spans, items

    made = annotated(frame, ["text", "spans", "items"], step, FOUND, keep)
    return made.select(f"{ROW}.*", *[f.name for f in FOUND])


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: Iterable[str] | None = None,
    window: int = WINDOW,
    coverage_percent: int = COVERAGE_PERCENT,
    block_words: int = BLOCK_WORDS,
    cut: bool = False,
) -> DataFrame:
    """Per row: ``row`` (the kept columns), n_words, spans, items, n_hit, contaminated.

    ``spans`` are runs of hit words (first, end), ``items`` the sorted ids of the
    items with an occurring window. A document is contaminated if at least
    ``coverage_percent`` of its words are hit, and one is. With ``cut``,
    ``clean_text`` is the text, without the hit runs if it is contaminated.
    """
    frame = docs.select(
        F.struct(*[docs[n] for n in (docs.columns if keep is None else keep)]).alias(ROW),
        docs["text"].alias("text"),
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in FOUND[1:]],
    )
    blocks = automata(benchmark, window, block_words)
    block = next(blocks)
    while block is not None:
        following = next(blocks, None)
        frame = _matched(frame, [ROW, "text"] if cut or following else [ROW], block)
        block = following
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    frame = frame.withColumn("n_hit", n_hit).withColumn(
        "contaminated",
        (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * coverage_percent),
    )
    return _cleaned(frame) if cut else frame


def _cleaned(frame: DataFrame) -> DataFrame:
    def step(parts):
        for texts, spans, flags in parts:
            yield ([
                _cut(t, [(x["first"], x["end"]) for x in s]) if f else (None if t is None else t.decode())
                for t, s, f in zip(utf8(texts), spans.to_pylist(), flags.to_pylist())
            ],)

    keep = [c for c in frame.columns if c != "text"]
    out = annotated(frame, ["text", "spans", "contaminated"], step, [field("clean_text", "string")], keep)
    return out.select(f"{ROW}.*", "clean_text")
