"""Token counts by byte-pair merging with a heap and a linked list.

Each stretch of text starts as a linked list of characters. A heap holds the
adjacent pairs that the vocabulary knows; the pair of the lowest rank is popped
and merged, and its new neighbours are pushed, until no pair is left. The count
is the number of initial symbols less the merges; no identifiers are made. A
character that the vocabulary lacks counts as its UTF-8 bytes.

A merge never joins two characters that stand side by side in no piece. The text
is split at such places first, exactly, and the counts of stretches are
remembered in a table of bounded size.

Null and empty texts have 0 tokens. Rows are counted one by one, so repeated
rows get equal counts and an empty table gives an empty one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.shared import annotated, field, utf8, worker_cache

LIMIT = 4096
#: Stretches remembered by one Python worker.
REMEMBERED = 500_000
#: Longer stretches are counted anew each time, so that the table's bytes are bounded too.
LONGEST_REMEMBERED = 64
SPACE = "▁"
#: Bits of a symbol or of a place in a stretch; symbols outside the vocabulary join with nothing.
WIDTH = 32
MASK = (1 << WIDTH) - 1
UNKNOWN, GONE = MASK - 1, MASK


def _stretch_pattern(pieces: Iterable[str]) -> str:
    """Splits a text where no piece can span: before a space mark, and between letters and signs."""
    beside = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}
    if any(pair[1] == SPACE != pair[0] for pair in beside):
        return "(?s:.+)"
    signs = {c for pair in beside for c in pair if not c.isalpha() and c != SPACE} | {"\n"}
    if any(a != SPACE and (a in signs) != (b in signs) for a, b in beside):
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    some = re.escape("".join(sorted(signs)))
    return f"{SPACE}*[{some}]+|{SPACE}*[^{SPACE}{some}]+|{SPACE}+"


class MergeCounter:
    """Counts the tokens of whole texts for a sentencepiece BPE model file."""

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        score = {
            model.id_to_piece(i): model.get_score(i)
            for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        }
        symbols = list(dict.fromkeys([*score, *(c for piece in score for c in piece)]))
        self.symbol = {s: i for i, s in enumerate(symbols)}
        # a character outside the vocabulary is as many tokens as it has bytes
        self.lacking = {i: len(s.encode()) - 1 for i, s in enumerate(symbols) if s not in score}
        rank = {x: r for r, x in enumerate(sorted(set(score.values()), reverse=True))}
        #: (left << WIDTH | right) to (rank << WIDTH | piece)
        self.joins = {
            self.symbol[piece[:i]] << WIDTH | self.symbol[piece[i:]]: rank[x] << WIDTH | self.symbol[piece]
            for piece, x in score.items()
            for i in range(1, len(piece))
            if piece[:i] in self.symbol and piece[i:] in self.symbol
        }
        self.stretches = re.compile(_stretch_pattern(score)).findall

    def count(self, text: str, seen: dict[str, int]) -> int:
        if not text:
            return 0
        total = 0
        for stretch in self.stretches(self.model.normalize(text)):
            n = seen.get(stretch)
            if n is None:
                n = self.merged(stretch)
                if len(stretch) <= LONGEST_REMEMBERED:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[stretch] = n
            total += n
        return total

    def merged(self, part: str) -> int:
        """Initial symbols less merges, with the bytes of unknown characters that stay alone."""
        size = len(part)
        if size == 1:
            return 1 if part in self.symbol and self.symbol[part] not in self.lacking else len(part.encode())
        joins, symbol = self.joins, self.symbol
        symbols = [symbol.get(c, UNKNOWN) for c in part]
        # an entry of the heap: rank << WIDTH | place of the left symbol
        heap = []
        left = symbols[0]
        for i in range(1, size):
            right = symbols[i]
            joined = joins.get(left << WIDTH | right)
            if joined is not None:
                heap.append(joined >> WIDTH << WIDTH | i - 1)
            left = right
        heapify(heap)
        symbols.append(UNKNOWN)  # behind the last
        after = list(range(1, size + 2))
        before = list(range(-1, size))
        merges = 0
        while heap:
            entry = heappop(heap)
            i = entry & MASK
            j = after[i]
            joined = joins.get(symbols[i] << WIDTH | symbols[j])
            if joined is None or joined >> WIDTH != entry >> WIDTH:
                continue  # one of the two was merged meanwhile
            merges += 1
            piece = symbols[i] = joined & MASK
            symbols[j] = GONE
            k = after[i] = after[j]
            before[k] = i
            joined = joins.get(piece << WIDTH | symbols[k])
            if joined is not None:
                heappush(heap, joined >> WIDTH << WIDTH | i)
            h = before[i]
            if h >= 0:
                joined = joins.get(symbols[h] << WIDTH | piece)
                if joined is not None:
                    heappush(heap, joined >> WIDTH << WIDTH | h)
        symbols.pop()
        extra = 0
        if UNKNOWN in symbols:
            extra = sum(len(c.encode()) - 1 for c, s in zip(part, symbols) if s == UNKNOWN)
        if self.lacking:
            extra += sum(self.lacking.get(s, 0) for s in symbols)
        return size - merges + extra


def count_tokens(
    docs: DataFrame, model_path: str, keep: Iterable[str] | None = None, limit: int = LIMIT
) -> DataFrame:
    """Per row: ``row`` (the kept columns), n_bytes, n_tokens and over_limit."""

    def step(parts):
        cached = worker_cache("token counts")
        if model_path not in cached:
            cached[model_path] = MergeCounter(model_path), {}
        counter, seen = cached[model_path]
        for (texts,) in parts:
            rows = [t or b"" for t in utf8(texts)]
            counts = {t: counter.count(t.decode(), seen) for t in set(rows)}
            yield [len(t) for t in rows], [counts[t] for t in rows]

    out = annotated(docs, ["text"], step, [field("n_bytes", "long"), field("n_tokens", "long")], keep)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
