"""Pattern packing of documents by non-negative least squares.

Documents of more than ``capacity`` tokens are cut into pieces of that length; the
first piece holds what is over. Whole pieces fill sequences alone, all other pieces
are packed uncut:

1. Tasks tokenise whole texts and number their pieces within each length. The table
   of pieces is stored; one aggregate gives the histogram, at most ``capacity`` numbers.
2. All patterns of up to three lengths that fill a sequence exactly are listed, and
   non-negative least squares fit how often each is used, so that the uses add up to
   the histogram (short pieces weigh less, as they fit nearly anywhere).
3. The counts are rounded down and used, largest first, as long as pieces last. The
   rest, which no pattern took, is packed best fit, longest first, over counts of equal sequences.
4. A piece's number within its length tells its pattern, sequence and place there.

Steps 2 and 3 see the histogram alone, so their work is bounded by the capacity, not
by the documents, and no task ever holds a group of documents.

A null or empty text is one end token. Rows are packed one by one: repeated rows, also
without an id, are packed as often as they occur, and equal lengths are dealt in the
order of the input's tasks. An empty table gives no pieces; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import byte_letters, field, slices, stored, worker_cache

CAPACITY = 1024
END = 2
#: Steps of the fit; it ends earlier where a step changes less than TOLERANCE of the pieces.
STEPS, TOLERANCE = 1_000, 1e-5
# The pre-tokens of byte-level vocabularies but for runs of white space, and
# the white space of that pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
BLANKS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

PIECE = T.StructType([
    field("doc_id", "long"),
    field("piece", "int"),
    field("start", "long"),
    field("length", "long"),
    field("ids_crc32", "long"),
    field("sequence_id", "long"),
    field("offset", "long"),
    field("ids", "binary"),
])

TOKENS = T.StructType([
    field("task", "long"),
    field("doc_id", "long"),
    field("doc_tokens", "long"),
    field("rest", "int"),
    field("nth", "long"),
    field("full_before", "long"),
    field("crcs", "long", many=True),
    field("ids", "binary"),
])


def ranks_of(path: str) -> dict[bytes, int] | None:
    """Pieces of a byte-level vocabulary by rank; None where its identifiers do not follow the merges."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
        return None
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
        return None
    letters, special = byte_letters(), {t["content"] for t in spec["added_tokens"]}
    pieces = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(c not in letters for t in pieces for c in t):
        return None
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    ids = [pieces.get(t) for t in merged]
    if None in ids or ids != sorted(ids) or len(pieces) - len(set(ids)) != 256 or min(ids, default=256) < 256:
        return None
    return {bytes(letters[c] for c in t): i for t, i in pieces.items()}


class ByteEncoder:
    """Identifiers of whole texts, as little-endian 32-bit numbers.

    The pattern of these vocabularies looks ahead to leave the last of several white
    spaces to the word after it. Texts are cut there first, so that the plain pattern,
    which needs half the time, gives the same pre-tokens. Texts that hold a special
    token, and other vocabularies, go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.run = re.compile(f"[{BLANKS}]{{2}}").search
        self.cut = re.compile(f"(?<=[{BLANKS}])(?=[{BLANKS}][^{BLANKS}])").split
        ranks = ranks_of(path)
        self.own = None
        if ranks:
            import tiktoken

            self.own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.own is None or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self.run(text):
            return b"".join([self._ids(part) for part in self.cut(text)])
        return self._ids(text)

    def _ids(self, text: str) -> bytes:
        return self.own.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def tokenised(docs: DataFrame, path: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """Per row: its length, what is over whole pieces, its number in the task, and the checksums of its pieces."""
    tail = np.array([end], "<u4").tobytes()
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = worker_cache("pattern packing")
        if path not in cached:
            cached[path] = ByteEncoder(path)
        encode = cached[path].encode
        task, full = TaskContext.get().partitionId(), 0
        met = np.zeros(capacity, np.int64)
        for batch in batches:
            for some in slices(batch, lambda b: [b.column(1)]):
                rows = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = encode(text.as_py() or "") + tail
                    size = len(ids) // 4
                    rest = size % capacity
                    cuts = [0] * (rest > 0) + list(range(rest, size, capacity))
                    crcs = [zlib.crc32(memoryview(ids)[4 * a : 4 * b]) for a, b in zip(cuts, [*cuts[1:], size])]
                    rows.append((task, doc_id, size, rest, int(met[rest]), full, crcs, ids if with_ids else None))
                    met[rest] += 1
                    full += size // capacity
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=TOKENS.names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, TOKENS)


def filling_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """All patterns of one to three of the lengths that fill a sequence, as rows padded with 0."""
    there = np.zeros(capacity + 1, bool)
    there[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if there[capacity] else []
    for a in lengths.tolist():
        b = lengths[lengths <= a]
        c = capacity - a - b
        ok = (c >= 0) & (c <= b) & there[np.clip(c, 0, capacity)] | (c == 0)
        found.append(np.stack([np.full(ok.sum(), a), b[ok], c[ok]], axis=1))
    return np.concatenate(found) if found else np.zeros((0, 3), np.int64)


def fitted(patterns: np.ndarray, counts: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """How often to use each pattern: accelerated projected gradient on the weighted squares, never below 0.

    ``counts[n]`` pieces have the length n; ``counts[0]`` is not looked at. The residual
    of a length weighs as its tokens do.
    """
    weight = np.arange(len(counts)) / (len(counts) - 1)
    uses = lambda x: np.bincount(patterns.ravel(), np.repeat(x, 3), len(counts))
    slope = lambda r: (weight * r)[patterns].sum(axis=1)
    # the largest curvature, by the power method
    probe = np.ones(len(patterns))
    for _ in range(20):
        probe = slope(uses(probe / np.linalg.norm(probe)))
    rate = 1 / (1.05 * np.linalg.norm(probe))
    x = ahead = np.zeros(len(patterns))
    speed = 1.0
    for _ in range(steps):
        after = np.maximum(ahead - rate * slope(uses(ahead) - counts), 0)
        faster = (1 + np.sqrt(1 + 4 * speed * speed)) / 2
        moved = after - x
        if (ahead - after) @ moved > 0:  # the momentum leads uphill: start anew
            faster = 1.0
        ahead = after + (speed - 1) / faster * moved
        x, speed = after, faster
        if np.abs(moved).sum() < TOLERANCE * max(1.0, x.sum()):
            break
    return x


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, pieces of it)]): longest first into the least room, equal sequences together."""
    by_room: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    rooms = np.zeros(capacity + 1, bool)

    def put(room: int, number: int, held: list[tuple[int, int]]) -> None:
        by_room.setdefault(room, []).append((number, held))
        rooms[room] = True

    for length in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[length])
        while left:
            at = int(rooms[length:].argmax()) + length
            if rooms[at]:
                number, held = by_room[at].pop()
                rooms[at] = bool(by_room[at])
            else:
                at, held = capacity, []
                number = -(-left // (capacity // length))
            each = at // length
            whole = min(number, left // each)
            over = left - whole * each if whole < number else 0
            if whole:
                put(at - each * length, whole, [*held, (length, each)])
            if over:
                put(at - over * length, 1, [*held, (length, over)])
            if held and number > whole + (over > 0):
                put(at, number - whole - (over > 0), held)
            left -= whole * each + over
    return [entry for some in by_room.values() for entry in some]


def planned(counts: np.ndarray, capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, pieces of it)]) for the histogram; every piece is in exactly one."""
    left = counts.astype(np.int64).copy()
    made: list[tuple[int, list[tuple[int, int]]]] = []
    patterns = filling_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        uses = fitted(patterns, left.astype(float))
        for i in np.flatnonzero(uses >= 1)[np.argsort(-uses[uses >= 1], kind="stable")].tolist():
            held = Counter(n for n in patterns[i].tolist() if n)
            times = min(int(uses[i]), *[int(left[n]) // k for n, k in held.items()])
            if times > 0:
                made.append((times, list(held.items())))
                for n, k in held.items():
                    left[n] -= times * k
    return made + best_fit(left, capacity)


def slots_of(plan: list[tuple[int, list[tuple[int, int]]]], capacity: int) -> np.ndarray:
    """Rows (length, first, sequence, offset, each) by length and first: where the pieces of a length go, by number."""
    met = np.zeros(capacity + 1, np.int64)
    rows, sequence = [], 0
    for number, held in plan:
        offset = 0
        for length, each in held:
            rows.append((length, int(met[length]), sequence, offset, each))
            met[length] += number * each
            offset += length * each
        sequence += number
    slots = np.array(rows, np.int64).reshape(-1, 5)
    return slots[np.lexsort((slots[:, 1], slots[:, 0]))]


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end: int = END,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece; ``ids`` holds its identifiers, 32 bits each, or null without ``with_ids``.

    Packed sequences are numbered from 0; those of one whole piece have numbers below 0.
    """
    if capacity > 1 << 14:
        raise ValueError("patterns are listed for capacities of at most 16384 tokens")
    pieces = stored(tokenised(docs, tokenizer_path, capacity, end, with_ids))
    counts = pieces.where("rest > 0").groupBy("rest", "task").agg(F.count("*").alias("number"))
    histogram = np.zeros(capacity + 1, np.int64)
    for row in counts.groupBy("rest").agg(F.sum("number").alias("number")).collect():  # at most one row per length
        histogram[row["rest"]] = row["number"]
    slots = slots_of(planned(histogram, capacity), capacity)
    before = Window.partitionBy("rest").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("rest", "task", F.coalesce(F.sum("number").over(before), F.lit(0)).alias("shift"))
    numbered = pieces.join(shifts, ["rest", "task"], "left")
    columns = ["doc_id", "doc_tokens", "rest", (F.col("nth") + F.col("shift")).alias("nth"), "task", "full_before", "crcs", "ids"]
    kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.binary()]
    names = PIECE.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [slots[slots[:, 0] == n] for n in range(capacity)]
        for batch in batches:
            rows = []
            for doc_id, size, rest, nth, task, full, crcs, ids in zip(*[c.to_pylist() for c in batch.columns]):
                start = 0
                for piece, crc in enumerate(crcs):
                    if start == 0 and rest:
                        mine = firsts[rest]
                        _, first, sequence, offset, each = mine[np.searchsorted(mine[:, 1], nth, "right") - 1].tolist()
                        turn, place = divmod(nth - first, each)
                        length, sequence, offset = rest, sequence + turn, offset + place * rest
                    else:
                        length, sequence, offset = capacity, -((task << 36) + full) - 1, 0
                        full += 1
                    cut = ids[4 * start : 4 * (start + length)] if ids is not None else None
                    rows.append((doc_id, piece, start, length, crc, sequence, offset, cut))
                    start += length
            made = list(zip(*rows)) or [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=names)

    return numbered.select(*columns).mapInArrow(run, PIECE)
