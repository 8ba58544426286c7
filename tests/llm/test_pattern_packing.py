"""Pattern packing against the library's tokens and plain packing."""

from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyframe.llm import pattern_packing as pp

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_tokens_are_those_of_the_library(library):
    encoder = pp.ByteEncoder(PATH)
    assert encoder.own is not None
    rng = random.Random(5)
    parts = [*"ab 1 \n\t\r\x0b\x1c\x1f\x85\xa0　 ​.,'!é日本ñ𝔸́", "'s", "'ll", " ", "  ", "<|endoftext|>", " the", "x" * 40]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 16))) for _ in range(5_000)]
    odd = [c for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    texts += [f"a{chr(c)}b 1{chr(c)}2 {chr(c)}{chr(c)} x{chr(c)}{chr(c)}{chr(c)}y !{chr(c)}?" for c in odd]
    texts += [" " * 70_000 + "x", "ab" * 60_000, "\n" * 50_000]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want.ids, repr(text[:50])


def test_other_vocabularies_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert pp.ranks_of(path) is None
    ids = np.frombuffer(pp.ByteEncoder(path).encode("Hello  World"), "<u4").tolist()
    assert ids == Tokenizer.from_file(path).encode("Hello  World", add_special_tokens=False).ids


def _held(plan, capacity):
    counts = np.zeros(capacity + 1, np.int64)
    for number, held in plan:
        assert number > 0 and 0 < sum(n * k for n, k in held) <= capacity
        for n, k in held:
            counts[n] += number * k
    return counts


@pytest.mark.parametrize("capacity", [8, 60, 256])
def test_plans_hold_every_piece(capacity):
    rng = np.random.default_rng(capacity)
    for _ in range(20):
        counts = rng.integers(0, rng.integers(1, 2_000), capacity + 1) * (rng.random(capacity + 1) < rng.random())
        counts[0] = counts[capacity] = 0
        plan = pp.planned(counts, capacity)
        assert (_held(plan, capacity) == counts).all()
        need = -(-int((counts * np.arange(capacity + 1)).sum()) // capacity)
        alone = max(need, int(counts[capacity // 2 + 1 :].sum()))
        assert alone <= sum(n for n, _ in plan) <= max(alone * 1.25 + 3, 1)


def test_fit_reaches_an_exact_histogram():
    """Where patterns make up the histogram, the fit finds uses that do so too."""
    rng = np.random.default_rng(1)
    patterns = pp.filling_patterns(np.arange(1, 100), 100)
    assert (patterns.sum(axis=1) == 100).all() and len(np.unique(patterns, axis=0)) == len(patterns)
    assert len(patterns) == sum(a + b + c == 100 for a in range(1, 100) for b in range(a + 1) for c in range(b + 1) if b or c)
    true = rng.integers(0, 1_000, len(patterns)) * (rng.random(len(patterns)) < 0.1)
    counts = np.bincount(patterns.ravel(), np.repeat(true, 3), 101)
    uses = pp.fitted(patterns, counts, 4_000)
    assert (uses >= 0).all()
    off = np.abs(np.bincount(patterns.ravel(), np.repeat(uses, 3), 101) - counts)[1:]
    assert (off * np.arange(1, 101)).sum() < 0.01 * (counts[1:] * np.arange(1, 101)).sum()
    counts[0] = 0
    made = sum(n for n, _ in pp.planned(counts.astype(np.int64), 100))
    assert made <= 1.002 * true.sum() + 2


def test_best_fit_equals_one_by_one():
    rng = np.random.default_rng(2)
    for _ in range(50):
        counts = np.concatenate([[0], rng.integers(0, 6, 30)])
        plan = pp.best_fit(counts.copy(), 30)
        assert (_held(plan, 30) == counts).all()
        rooms = []
        for n in range(30, 0, -1):
            for _ in range(counts[n]):
                fits = [r for r in rooms if r >= n]
                room = min(fits) if fits else 30
                if fits:
                    rooms.remove(room)
                rooms.append(room - n)
        assert sum(n for n, _ in plan) == len(rooms)


def checked(out, docs, library, capacity):
    """Sequences are gapless, and pieces hold the tokens of their documents; returns the sequence lengths."""
    rows = out.collect()
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    want, got = [], []
    for doc_id, text in docs:
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        rest = len(ids) % capacity
        cuts = [0] * (rest > 0) + list(range(rest, len(ids), capacity)) + [len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            raw = np.array(ids[a:b], "<u4").tobytes()
            want.append((doc_id, piece, a, b - a, zlib.crc32(raw)))
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    return [sum(n for _, n in held) for held in places.values()]


def test_pack(spark, library):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(["a", "tree", "xyzzy", "\n", "über"], k=rng.randint(0, 300)))) for i in range(300)]
    docs += [(None, None)] * 40 + [(None, "same text")] * 40 + [(7, "same text")] * 500 + [(8, ""), (1_009, "word " * 9_000)]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, sequence_id int").repartition(7)
    sizes = checked(pp.pack(frame, PATH, capacity=128), docs, library, 128)
    assert len(sizes) <= 1.01 * sum(sizes) / 128 + 2
    with_ids = pp.pack(frame, PATH, capacity=128).where("doc_id = 1009").orderBy("piece").collect()
    ids = b"".join(bytes(r.ids) for r in with_ids)
    assert np.frombuffer(ids, "<u4").tolist() == library.encode("word " * 9_000, add_special_tokens=False).ids + [2]
    assert pp.pack(frame.where("false"), PATH).count() == 0
    assert {r.length for r in pp.pack(frame.where("text is null"), PATH).collect()} == {1}


def test_query_on_whole_documents(spark, library):
    from tallyframe.llm import queries

    folder = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    out = queries.op13_pattern_packing(spark, folder)
    sizes = checked(out, docs, library, 1024)
    assert len(sizes) <= sum(sizes) / 1024 * 1.02 + 2
    assert out.where(F.col("length") > 1024).count() == 0
