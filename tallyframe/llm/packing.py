"""Cost-balanced packing of documents into sequences of bounded length.

A document of n tokens costs ``LINEAR * n + QUADRATIC * n * n``, since attention
grows with the square of its length. Whole capacities are cut off a long
document and fill sequences alone. The rests are taken longest first; each goes
to the sequence of the lowest cost that has room for it, and one that fits
nowhere is cut over the roomiest sequences. As many sequences are opened as the
tokens need, so less than one capacity is left empty in a group.

Tokens are computed once, where the text lies, and only the rests are shuffled.
Groups hold about ``GROUP_BYTES`` of text by a hash over id, tokens and the row's place in
its task, so their number follows the input and their size does not, also where rows repeat.

A null or empty text is one end token. Rows are packed one by one: repeated rows
are packed as often as they occur, ties go by id (null last) and checksum, and
an empty table gives no pieces.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import byte_letters, field, slices, worker_cache

CAPACITY = 4096
END = 2
LINEAR = 1.0
#: Of the linear cost at a full sequence: attention as dear as the rest of a layer at 4096 tokens.
QUADRATIC = 1.0 / CAPACITY
GROUP_BYTES = 16 << 20
#: Odd words whose identifiers one Python worker remembers.
REMEMBERED = 100_000
LONGEST_REMEMBERED = 48

# How the tokenizer that the fast way knows cuts texts, its letters among those
# up to U+00FF, and the pre-tokens of such texts.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SIMPLE = "[\t-\r -~À-ÖØ-öø-ÿ]*"
SIMPLE_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+"
END_MARK = "\0"

PIECE = T.StructType([
    field("doc_id", "long"),
    field("start", "long"),
    field("length", "long"),
    field("ids_crc32", "long"),
    field("doc_tokens", "long"),
    field("sequence_id", "long"),
    field("offset", "long"),
    field("ids", "binary"),
])


def marked_ranks(path: str) -> tuple[dict[bytes, int], np.ndarray] | None:
    """Pieces by rank, a word's end written as a zero byte, and the identifier of each rank.

    The end is merged into a word's last byte before anything else, as the vocabulary
    has it there from the start. None for tokenizers that cut texts in other ways.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    model, pre = spec["model"], spec["pre_tokenizer"] or {}
    steps = pre.get("pretokenizers", [])
    split = {"type": "Split", "pattern": {"Regex": PRE_TOKENS}, "behavior": "Removed", "invert": True}
    known = spec["normalizer"] == NORMALIZER and len(steps) == 2 and steps[0] == split and steps[1]["type"] == "ByteLevel"
    known = known and not steps[1]["add_prefix_space"] and not steps[1]["use_regex"] and model["type"] == "BPE"
    if not known or model["end_of_word_suffix"] != "</w>" or any(model.get(k) for k in ("dropout", "ignore_merges", "continuing_subword_prefix")):
        return None
    letters, vocabulary = byte_letters(), model["vocab"]

    def raw(piece: str) -> bytes:
        body = piece.removesuffix("</w>")
        return bytes(letters[c] for c in body) + END_MARK.encode() * (body != piece)

    singles = [c for c, b in letters.items() if b]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    pieces = [(raw(c), c) for c in singles] + [(END_MARK.encode(), None)] + [(raw(c + "</w>"), c + "</w>") for c in singles]
    pieces += [(raw(m), m) for m in merged]
    ranks = {bytes_: rank for rank, (bytes_, _) in enumerate(pieces)}
    if len(ranks) < len(pieces):
        return None
    return ranks, np.array([0 if piece is None else vocabulary[piece] for _, piece in pieces], "<u2")


class WordEncoder:
    """Identifiers of whole texts, as little-endian 16-bit numbers.

    Texts of ASCII and the letters up to U+00FF are cut into pre-tokens, each gets a mark
    at its end, and all are merged at once. White space always ends a word of this
    tokenizer, so in other texts only the words with other characters, and those that may
    hold a special token, go to the library.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("identifiers need more than 16 bits")
        self.simple, self.pre_tokens = re.compile(SIMPLE).fullmatch, re.compile(SIMPLE_PRE_TOKENS).findall
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.seen: dict[str, bytes] = {}
        self.own = None
        known = marked_ranks(path)
        if known and not any(" " in s for s in self.special):
            import tiktoken

            ranks, self.ids = known
            pattern = f"[^{END_MARK}]+{END_MARK}"
            self.own = tiktoken.Encoding("marked", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.own is None:
            return self._by_library([text])[0]
        special = any(s in text for s in self.special)
        if not special and self.simple(text):
            return self._marked(text)
        out, plain = [], []
        words = text.split(" ")
        odd = [not self.simple(w) or special and any(s in w for s in self.special) for w in words]
        self._learn({w for w, o in zip(words, odd) if o}.difference(self.seen))
        for word, o in zip(words, odd):
            if not o:
                plain.append(word)
                continue
            out += [self._marked(" ".join(plain)), self.seen[word] if word in self.seen else self._by_library([word])[0]]
            plain.clear()
        return b"".join([*out, self._marked(" ".join(plain))])

    def _marked(self, text: str) -> bytes:
        found = self.pre_tokens(text.lower())
        if not found:
            return b""
        found.append("")
        return self.ids[self.own.encode_to_numpy(END_MARK.join(found), disallowed_special=())].tobytes()

    def _learn(self, words: set[str]) -> None:
        if len(self.seen) + len(words) > REMEMBERED:
            self.seen.clear()
        short = [w for w in words if len(w) <= LONGEST_REMEMBERED]
        self.seen.update(zip(short, self._by_library(short)))

    def _by_library(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch(texts, add_special_tokens=False) if texts else []
        return [np.array(x.ids, "<u2").tobytes() for x in made]


def crc_of(ids: bytes) -> int:
    """crc32 over the identifiers as little-endian 32-bit numbers."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


TOKENS = T.StructType([
    field("nth", "long"),
    field("doc_id", "long"),
    field("doc_tokens", "long"),
    field("full_crcs", "long", many=True),
    field("full_ids", "binary"),
    field("rest", "binary"),
    field("rest_crc", "long"),
])


def tokenised(docs: DataFrame, path: str, capacity: int, end: int, with_ids: bool) -> DataFrame:
    """Per row: its length, the checksums of its full pieces, and the tokens of the rest."""
    tail = np.array([end], "<u2").tobytes()

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]

    def run(batches):
        cached = worker_cache("packing")
        if path not in cached:
            cached[path] = WordEncoder(path)
        encode, nth = cached[path].encode, 0
        for batch in batches:
            for some in slices(batch, lambda b: [b.column(1)]):
                rows = []
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = encode(text.as_py() or "") + tail
                    size = len(ids) // 2
                    cut = size // capacity * capacity * 2
                    full = [crc_of(ids[at : at + 2 * capacity]) for at in range(0, cut, 2 * capacity)]
                    rest = ids[cut:]
                    rows.append((nth, doc_id, size, full, ids[:cut] if with_ids else None, rest, crc_of(rest)))
                    nth += 1
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=TOKENS.names)

    return docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")).mapInArrow(run, TOKENS)


def placed(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(document, start in it, length, sequence, offset) for lengths in descending order."""
    count = -(-int(lengths.sum()) // capacity)
    room = np.full(count, capacity, np.int64)
    cost = np.zeros(count)
    for i, length in enumerate(lengths.tolist()):
        start = 0
        while start < length:
            left = length - start
            fits = room >= left
            if fits.any():
                to, size = int(np.where(fits, cost, np.inf).argmin()), left
            else:
                to = int(room.argmax())
                size = int(room[to])
            yield i, start, size, to, int(capacity - room[to])
            room[to] -= size
            cost[to] += linear * size + quadratic * size * size
            start += size


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = CAPACITY,
    end: int = END,
    linear: float = LINEAR,
    quadratic: float = QUADRATIC,
    group_bytes: int = GROUP_BYTES,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece; ``ids`` holds its identifiers, 16 bits each, or null without ``with_ids``."""
    total = docs.agg(F.sum(F.coalesce(F.octet_length(docs["text"]), F.lit(0)) + 8)).first()[0] or 0
    groups = max(1, -(-total // group_bytes))
    grouped = tokenised(docs, tokenizer_path, capacity, end, with_ids).withColumn(
        "pack", F.pmod(F.xxhash64("doc_id", "rest_crc", "doc_tokens", "nth"), F.lit(groups))
    )

    def pack_group(key, rows: pd.DataFrame) -> pd.DataFrame:
        size = rows["rest"].str.len() // 2
        order = np.lexsort((rows["rest_crc"], rows["doc_id"].fillna(np.inf), -size))
        rows, sizes = rows.iloc[order], size.to_numpy()[order].astype(np.int64)
        doc_ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        tokens, rests = rows["doc_tokens"].tolist(), rows["rest"].tolist()
        base = int(key[0]) << 32
        out = []
        for i, start, length, to, offset in placed(sizes, capacity, linear, quadratic):
            ids = rests[i][2 * start : 2 * (start + length)]
            out.append((doc_ids[i], tokens[i] - int(sizes[i]) + start, length, crc_of(ids), tokens[i], base + to, offset,
                        ids if with_ids else None))
        free = base - (-int(sizes.sum()) // capacity)
        for i, (crcs, full) in enumerate(zip(rows["full_crcs"], rows["full_ids"])):
            for k, crc in enumerate(crcs):
                ids = full[2 * capacity * k : 2 * capacity * (k + 1)] if with_ids else None
                out.append((doc_ids[i], capacity * k, capacity, int(crc), tokens[i], free, 0, ids))
                free += 1
        frame = pd.DataFrame(out, columns=PIECE.names)
        return frame.astype({"doc_id": "Int64"})

    return grouped.groupBy("pack").applyInPandas(pack_group, PIECE)
