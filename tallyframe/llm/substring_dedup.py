"""Exact removal of repeated strings by prefix-free parsing, distributed.

Every ``LENGTH``-byte string of a text owns a trigger: the ``GRAM``-byte string in it
whose rolling hash is smallest (the first of equals). Triggers depend on content
alone, so equal strings have equal triggers. Neighbouring strings with one trigger
form a phrase; the phrases of a text, in order, are its parse, and the distinct
phrases are the dictionary. A string lies in exactly one phrase of its parse, so
the dictionary's suffixes, ordered to a depth of ``LENGTH`` bytes, group all equal
strings of the corpus, and each phrase's smallest document id, from the parse, gives
each group its owner: the smallest document in which the string starts. Where the
owner is smaller than the document, the string's bytes are removed.

The work runs in blocks of documents of about ``BLOCK_BYTES`` by a hash of id and
text, and in buckets of triggers by their hash:

1. blocks send the triggers that they hold, each once;
2. buckets answer with those that occur in two documents or more;
3. blocks send the distinct phrases of these, with the smallest id;
4. buckets order the suffixes and answer with the owners of each phrase's strings;
5. blocks mark the covered bytes.

Whatever the number of copies, a block sends a trigger or a phrase once, so no
bucket grows with a group. The order in a bucket is by trigger and 64-bit hash of the
first ``LENGTH`` bytes rather than alphabetical: only equality counts to that depth.

Texts are judged as UTF-8 bytes on the input. Null and empty texts are empty.
A null id counts as larger than all ids; rows with equal ids (or both without one)
never remove each other's bytes. Texts may be of any length: they are cut into
overlapping pieces of ``PIECE_BYTES``. Extra columns are ignored; an empty table gives an
empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import field, utf8

LENGTH = 50
GRAM = 25
BLOCK_BYTES = 8 << 20
PIECE_BYTES = 2 << 20
LAST = np.iinfo(np.int64).max

U = np.uint64
BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


BYTE_CODES = _mixed(np.arange(1, 257, dtype=np.uint64))


def rolling(data: np.ndarray, size: int) -> np.ndarray:
    """The polynomial hash of the ``size`` bytes from each place on, by doubling."""
    count = len(data) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    power, width, done, out = BYTE_CODES[data], 1, 0, None
    while True:
        if size & width:
            # low bits first: the part of ``width`` bytes stands behind what is there
            part = power[done : done + count]
            out = part.copy() if out is None else out * U(pow(BASE, width, 2**64)) + part
            done += width
        if 2 * width > size:
            return out
        power = power[:-width] * U(pow(BASE, width, 2**64)) + power[width:]
        width *= 2


def packed(numbers: np.ndarray, ordered: bool = False) -> bytes:
    """Numbers as compressed planes of bytes, ordered ones as differences."""
    if ordered:
        numbers = np.diff(numbers, prepend=numbers.dtype.type(0))
    planes = numbers.view(np.uint8).reshape(len(numbers), -1).T
    raw = np.ascontiguousarray(planes).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(data: bytes, kind: type, ordered: bool = False) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    raw = pa.decompress(data[8:], size, codec="zstd", asbytes=True) if size else b""
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(raw, np.uint8).reshape(width, -1)
    numbers = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return np.cumsum(numbers, dtype=kind) if ordered else numbers


@dataclass
class Phrases:
    """The parse of a piece: per phrase its trigger, first and last string, and its place."""

    trigger: np.ndarray
    first: np.ndarray
    last: np.ndarray
    head: np.ndarray
    tail: np.ndarray


def parsed(data: np.ndarray, with_hashes: bool) -> Phrases | None:
    """Places are counted from the start of the piece; head and tail are hashes of the first and last string."""
    count = len(data) - LENGTH + 1
    if count <= 0:
        return None
    grams = rolling(data, GRAM)
    order = (_mixed(grams) & ~U(0xFFFFFFFF)) | np.arange(len(grams), dtype=np.uint64)
    width, least = 1, order
    reach = LENGTH - GRAM + 1
    while 2 * width <= reach:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if reach > width:
        least = np.minimum(least[: len(least) - (reach - width)], least[reach - width :])
    at = (least & U(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [count]]) - 1
    strings = rolling(data, LENGTH) if with_hashes else np.zeros(count, np.uint64)
    return Phrases(_mixed(grams[at[first]] * U(3) + U(1)), first, last, strings[first], strings[last])


class Block:
    """The texts of a block, their ids, and the parse of all pieces."""

    def __init__(self, table: pa.Table, with_hashes: bool):
        self.ids = np.array([LAST if i is None else i for i in table.column("doc_id").to_pylist()], np.int64)
        texts = [t or b"" for chunk in table.column("text").chunks for t in utf8(chunk)]
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)]).astype(np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        made, rows = [], []
        for row, start, end in self._pieces():
            phrases = parsed(self.data[start:end], with_hashes)
            if phrases is not None:
                phrases.first += start
                phrases.last += start
                made.append(phrases)
                rows.append(np.full(len(phrases.first), row, np.int64))
        join = lambda name, kind: (
            np.concatenate([getattr(p, name) for p in made]) if made else np.zeros(0, kind)
        )
        self.trigger, self.head, self.tail = (join(n, np.uint64) for n in ("trigger", "head", "tail"))
        self.first, self.last = join("first", np.int64), join("last", np.int64)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.owner = self.ids[self.row]

    def _pieces(self) -> Iterator[tuple[int, int, int]]:
        for row, (start, size) in enumerate(zip(self.starts.tolist(), self.sizes.tolist())):
            for at in range(0, max(size - LENGTH + 1, 0), PIECE_BYTES):
                yield row, start + at, start + min(size, at + PIECE_BYTES + LENGTH - 1)

    def triggers(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct triggers in order, and whether two documents of the block hold them."""
        order = np.argsort(self.trigger, kind="stable")
        trigger, owner = self.trigger[order], self.owner[order]
        start = np.flatnonzero(_changes(trigger))
        if not len(start):
            return trigger, np.zeros(0, bool)
        return trigger[start], np.minimum.reduceat(owner, start) != np.maximum.reduceat(owner, start)

    def dictionary(self, shared: np.ndarray) -> None:
        """Numbers the distinct phrases whose trigger is shared, by trigger."""
        held = shared[np.minimum(np.searchsorted(shared, self.trigger), len(shared) - 1)] == self.trigger if len(shared) else np.zeros(len(self.trigger), bool)
        keep = np.flatnonzero(held)
        length = (self.last - self.first)[keep]
        order = keep[np.lexsort((length, self.tail[keep], self.head[keep], self.trigger[keep]))]
        self.order = order
        new = _changes(self.trigger[order], self.head[order], self.tail[order], (self.last - self.first)[order])
        self.number = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        self.phrase = order[start]
        owner = self.owner[order]
        self.least = np.minimum.reduceat(owner, start) if len(start) else np.zeros(0, np.int64)
        self.several = (np.maximum.reduceat(owner, start) != self.least) if len(start) else np.zeros(0, bool)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row of sorted columns differs from the row before; the first does."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for column in columns:
        out[1:] |= column[1:] != column[:-1]
    return out


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[i], starts[i] + 1, ... counts[i] of them, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)


def _binary_rows(rows: list[tuple], schema: T.StructType) -> pa.Table:
    columns = list(zip(*rows)) or [[] for _ in schema]
    kinds = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.binary() for f in schema]
    return pa.table([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=schema.names)


def _schema(*names: str) -> T.StructType:
    return T.StructType([field(n, "long" if n in ("bucket", "block", "start") else "binary") for n in names])


HELD = _schema("bucket", "block", "triggers", "several")
SHARED = _schema("block", "triggers")
SENT = _schema("bucket", "block", "start", "triggers", "counts", "least", "several", "bytes")
OWNED = _schema("block", "numbers", "from", "to", "owners")


def removed(docs: DataFrame, block_bytes: int = BLOCK_BYTES, with_text: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end) and the kept bytes.

    ``kept`` is null without ``with_text``.
    """
    total = docs.agg(F.sum(F.octet_length(docs["text"]))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    # steps have no annotations: Spark would read the kind of function from them
    def hold(key, table):
        block = Block(table, with_hashes=False)
        trigger, several = block.triggers()
        rows = []
        for bucket, part in _by_bucket(trigger, blocks):
            rows.append((bucket, key[0].as_py(), packed(trigger[part], ordered=True), np.packbits(several[part]).tobytes()))
        return _binary_rows(rows, HELD)

    def share(key, table):
        parts = [unpacked(x, np.uint64, ordered=True) for x in table.column("triggers").to_pylist()]
        several = [np.unpackbits(np.frombuffer(x, np.uint8))[: len(p)].astype(bool) for x, p in zip(table.column("several").to_pylist(), parts)]
        trigger = np.sort(np.concatenate(parts))
        twice = trigger[1:][trigger[1:] == trigger[:-1]]
        shared = np.unique(np.concatenate([twice, *[p[s] for p, s in zip(parts, several)]]))
        rows = []
        for block, part in zip(table.column("block").to_pylist(), parts):
            part = np.intersect1d(part, shared, assume_unique=True)
            if len(part):
                rows.append((block, packed(part, ordered=True)))
        return _binary_rows(rows, SHARED)

    def send(key, table, answers):
        if not table.num_rows or not answers.num_rows:
            return _binary_rows([], SENT)
        block = _with_dictionary(table, answers)
        phrase = block.phrase
        counts = block.last[phrase] - block.first[phrase]
        rows = []
        for bucket, part in _by_bucket(block.trigger[phrase], blocks):
            some = phrase[part]
            data = block.data[_ranges(block.first[some], counts[part] + LENGTH)]
            rows.append((
                bucket, key[0].as_py(), int(part[0]), packed(block.trigger[some], ordered=True),
                packed(counts[part].astype(np.uint8)), packed(block.least[part]),
                np.packbits(block.several[part]).tobytes(),
                len(data).to_bytes(8, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True),
            ))
        return _binary_rows(rows, SENT)

    def own(key, table):
        return _binary_rows(list(_owners(table)), OWNED)

    def mark(key, table, answers):
        return _marked(table, answers, with_text)

    by_block = texts.groupBy("block")
    held = by_block.applyInArrow(hold, HELD)
    shared = held.groupBy("bucket").applyInArrow(share, SHARED)
    sent = by_block.cogroup(shared.groupBy("block")).applyInArrow(send, SENT)
    # a block's later steps need what buckets said of its triggers too, to number its phrases alike
    owned = sent.groupBy("bucket").applyInArrow(own, OWNED)
    answers = owned.select("block", *OWNED.names[1:], F.lit(None).cast("binary").alias("triggers")).union(
        shared.select("block", *[F.lit(None).cast("binary").alias(n) for n in OWNED.names[1:]], "triggers")
    )
    return by_block.cogroup(answers.groupBy("block")).applyInArrow(mark, RESULT)


RESULT = T.StructType([
    field("doc_id", "long"),
    field("n_bytes", "long"),
    field("n_removed", "long"),
    field("n_spans", "long"),
    field("kept_sha256", "string"),
    field("spans", T.StructType([field("start", "long"), field("end", "long")]), many=True),
    field("kept", "binary"),
])


def _by_bucket(trigger: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of each bucket's triggers; ranges of ordered triggers, so places are in order."""
    bucket = ((trigger >> U(32)) * U(buckets)) >> U(32)
    start = np.flatnonzero(_changes(bucket))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(trigger)]):
        yield int(bucket[a]), np.arange(a, b)


def _with_dictionary(table: pa.Table, answers: pa.Table) -> Block:
    block = Block(table, with_hashes=True)
    parts = [unpacked(x, np.uint64, ordered=True) for x in answers.column("triggers").to_pylist() if x is not None]
    block.dictionary(np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64))
    return block


def _owners(table: pa.Table) -> Iterator[tuple]:
    """Orders the suffixes of a bucket's phrases; per block, the strings that a smaller or another document owns."""
    columns = {n: table.column(n).to_pylist() for n in table.column_names}
    trigger = [unpacked(x, np.uint64, ordered=True) for x in columns["triggers"]]
    sizes = [len(t) for t in trigger]
    counts = np.concatenate([unpacked(x, np.uint8) for x in columns["counts"]]).astype(np.int64) + 1
    least = np.concatenate([unpacked(x, np.int64) for x in columns["least"]])
    several = np.concatenate([
        np.unpackbits(np.frombuffer(x, np.uint8))[:n].astype(bool) for x, n in zip(columns["several"], sizes)
    ])
    data = np.frombuffer(
        b"".join(
            pa.decompress(x[8:], int.from_bytes(x[:8], "little"), codec="zstd", asbytes=True) for x in columns["bytes"]
        ),
        np.uint8,
    )
    lengths = counts + LENGTH - 1
    begins = np.cumsum(lengths) - lengths
    strings = _strings(data, begins, counts)
    of = np.repeat(np.arange(len(counts)), counts)
    key = np.concatenate(trigger)[of]
    order = np.lexsort((strings, key))
    start = np.flatnonzero(_changes(key[order], strings[order]))
    smallest = np.minimum.reduceat(least[of][order], start)
    owner = np.empty(len(of), np.int64)
    owner[order] = np.repeat(smallest, np.diff(np.append(start, len(of))))
    told = (owner < least[of]) | several[of]
    # neighbouring strings of a phrase with one owner are told together
    place = np.flatnonzero(told)
    new = _changes(of[place], owner[place])
    new[1:] |= place[1:] != place[:-1] + 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(place)) - 1
    offset = np.cumsum(counts) - counts
    phrase, first, last = of[place[begin]], place[begin], place[end]
    limits = np.concatenate([[0], np.cumsum(sizes)])
    edges = np.searchsorted(phrase, limits)
    for i, block in enumerate(columns["block"]):
        some = slice(edges[i], edges[i + 1])
        if edges[i] < edges[i + 1]:
            yield (
                block,
                packed(phrase[some] - limits[i] + columns["start"][i], ordered=True),
                packed((first - offset[phrase])[some].astype(np.uint8)),
                packed((last - offset[phrase])[some].astype(np.uint8)),
                packed(owner[first[some]]),
            )


def _strings(data: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Hashes of all strings of the phrases, some megabytes at a time."""
    out, at = [], 0
    lengths = counts + LENGTH - 1
    while at < len(counts):
        to = max(at + 1, int(np.searchsorted(begins, begins[at] + PIECE_BYTES)))
        some = data[begins[at] : begins[to - 1] + lengths[to - 1]]
        out.append(rolling(some, LENGTH)[_ranges(begins[at:to] - begins[at], counts[at:to])])
        at = to
    return np.concatenate(out)


def _marked(table: pa.Table, answers: pa.Table, with_text: bool) -> pa.Table:
    told = [i for i, x in enumerate(answers.column("numbers").to_pylist()) if x is not None] if answers.num_rows else []
    if told:
        block = _with_dictionary(table, answers)
        covered = _covered(block, answers.take(told))
    else:
        block = Block(table.slice(0, 0), False)
        texts = [t or b"" for chunk in table.column("text").chunks for t in utf8(chunk)]
        block.data = np.frombuffer(b"".join(texts), np.uint8)
        block.sizes = np.array([len(t) for t in texts], np.int64)
        block.starts = np.concatenate([[0], np.cumsum(block.sizes)]).astype(np.int64)
        covered = np.zeros(len(block.data), bool)
    rows = []
    for start, size in zip(block.starts.tolist(), block.sizes.tolist()):
        mine = covered[start : start + size]
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mine.view(np.int8), [0]]))).tolist()
        kept = block.data[start : start + size][~mine].tobytes()
        rows.append((
            size, int(mine.sum()), len(edges) // 2, hashlib.sha256(kept).hexdigest(),
            [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2])], kept if with_text else None,
        ))
    columns = list(zip(*rows)) or [[] for _ in RESULT.names[1:]]
    pairs = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pairs, pa.binary()]
    made = [pa.array(list(c), k) for c, k in zip(columns, kinds)]
    return pa.table([table.column("doc_id").combine_chunks(), *made], names=RESULT.names)


def _covered(block: Block, answers: pa.Table) -> np.ndarray:
    """The bytes under strings whose owner is smaller than the document."""
    column = lambda name, kind, ordered=False: np.concatenate(
        [unpacked(x, kind, ordered) for x in answers.column(name).to_pylist()]
    )
    number = np.concatenate([unpacked(x, np.int64, True) for x in answers.column("numbers").to_pylist()])
    low, high, owner = column("from", np.uint8), column("to", np.uint8), column("owners", np.int64)
    order = np.argsort(number, kind="stable")
    number, low, high, owner = number[order], low[order].astype(np.int64), high[order].astype(np.int64), owner[order]
    # every occurrence of a phrase with every answer on it; a phrase has at most LENGTH - GRAM + 1
    a, b = np.searchsorted(number, block.number, "left"), np.searchsorted(number, block.number, "right")
    where = np.repeat(block.order, b - a)
    answer = _ranges(a, b - a)
    later = owner[answer] < block.owner[where]
    where, answer = where[later], answer[later]
    depth = np.zeros(len(block.data) + 1, np.int64)
    np.add.at(depth, block.first[where] + low[answer], 1)
    np.add.at(depth, block.first[where] + high[answer] + LENGTH, -1)
    return np.cumsum(depth[:-1]) > 0
