"""Tokens of the packing operator, and groups of repeated rows."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tallyframe.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_tokens_are_those_of_the_library():
    library, encoder = Tokenizer.from_file(PATH), packing.WordEncoder(PATH)
    assert encoder.own is not None and packing.marked_ranks(public_tokenizers.path("byte_bpe_50k.json")) is None
    rng = random.Random(5)
    parts = [*"ab 1 \n\t\r\x0b\x1c\x1f\x85\xa0　 ​.,'!éÉß×÷µªĳİσΣς日本ñ𝔸́ﬁ\x00_", "'s", "'LL", " ", "<|endoftext|>", "<|", " the", "Qu", "</w>"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(3_000)]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} X{chr(c)}y !{chr(c)}?" for c in range(0x3100)]
    texts += ["ab" * 40_000, " " * 50_000, "日本" * 20_000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == want.ids, repr(text[:50])


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = np.frombuffer(packing.WordEncoder(path).encode("Hello  World"), "<u2").tolist()
    assert ids == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


def test_equal_rows_are_dealt_over_groups(spark):
    """Rows without an id and with the same text, or none, do not meet in one group."""
    frame = spark.createDataFrame([(None, "same words")] * 2_000 + [(None, None)] * 2_000, "doc_id long, text string")
    out = packing.pack(frame, PATH, capacity=64, group_bytes=2_000)
    rows = out.collect()
    assert len({r.sequence_id >> 32 for r in rows}) > 5
    assert sum(r.length for r in rows) == 2_000 * 3 + 2_000
