"""MinHash near-duplicates with a multi-index Hamming join over b-bit signatures.

A document's set holds its distinct five-word shingles. Its signature has
``SYMBOLS`` minimum hashes of ``BITS`` bits each. Two signatures that differ in
at most ``DISTANCE`` symbols differ, by the pigeonhole principle, in at most
``DISTANCE // CHUNKS`` symbols of one of the ``CHUNKS`` chunks. Every way to leave
that many symbols out of a chunk gives a key, so all pairs under the distance
share a key. At a similarity of 0.85 a pair exceeds the distance with a
probability below 1e-4, and far less above it.

Documents with equal sets are one class from the start. In the first round each
class of a key meets one representative of the key, and links are confirmed on
the full sets; so a group of copies costs as many pairs as it has members. In the
second round the classes of a key that are not in their representative's
component meet those outside their own component with which they have one of the
rarest shingles in common, as every linked pair does; signatures and full sets
decide again. A pair that is left out lies inside one component or cannot be
linked, so components are whole.

Null, empty and word-less texts have an empty set and link with nothing; texts of
fewer words than a shingle are one shingle. Rows without an id link with nothing.
Rows with the same id count as one document when links are followed; each of them
is returned with its own set size. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.components import components
from tallyframe.llm.shared import annotated, field, stored, utf8

SHINGLE = 5
SIMILARITY_PERCENT = 85
SYMBOLS, BITS, CHUNKS, DISTANCE = 24, 16, 4, 11
SEED = 20_011
#: Ids up to this number (8 bytes each) are broadcast, more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Words whose hashes a task remembers.
REMEMBERED = 500_000

LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Shingles:
    """64-bit hashes of the distinct shingles of texts."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.factors = _odd(size, SEED)
        self.seen: dict[bytes, int] = {}

    def of(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(words) < self.size:
            return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), SEED)], np.uint64)
        seen = self.seen
        if len(seen) > REMEMBERED:
            seen.clear()
        for word in set(words).difference(seen):
            seen[word] = xxhash.xxh3_64_intdigest(word)
        hashes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        count = len(words) - self.size + 1
        total = np.zeros(count, np.uint64)
        for i, factor in enumerate(self.factors):
            total += _mixed(hashes[i : i + count]) * factor
        return np.unique(_mixed(total))


def signature(hashes: np.ndarray) -> np.ndarray:
    """The low bits of the minima under ``SYMBOLS`` hash functions."""
    out = np.zeros(SYMBOLS, np.uint64)
    for i, factor in enumerate(_odd(SYMBOLS, SEED + 1)):
        out[i] = (hashes * factor).min()
    return (_mixed(out) & np.uint64((1 << BITS) - 1)).astype(np.int32)


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, print, symbols); print, a hash of the set, and symbols are null for empty sets."""

    def step(parts):
        shingles = Shingles()
        for (texts,) in parts:
            sets = [shingles.of(t) for t in utf8(texts)]
            prints = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            symbols = [signature(s).tolist() if len(s) else None for s in sets]
            yield [len(s) for s in sets], prints, symbols

    fields = [field("n_shingles", "long"), field("print", "binary"), field("symbols", "int", many=True)]
    return annotated(docs, ["text"], step, fields, ["doc_id"]).select("row.doc_id", *[f.name for f in fields])


def keys_of(classes: DataFrame) -> DataFrame:
    """(key, node): every chunk with every choice of allowed errors left out."""
    width, errors = SYMBOLS // CHUNKS, DISTANCE // CHUNKS
    choices = [list(c) for c in combinations(range(width), width - errors)]
    picks = np.array([[chunk * width + i for i in c] for chunk in range(CHUNKS) for c in choices])
    factors = _odd(len(picks) * picks.shape[1], SEED + 2).reshape(picks.shape)
    salt = _odd(len(picks), SEED + 3)
    schema = T.StructType([field("key", "long"), field("node", "long")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                some = batch.slice(at, 2_000)
                symbols = some.column(1).flatten().to_numpy().reshape(some.num_rows, SYMBOLS).astype(np.uint64)
                keys = np.zeros((some.num_rows, len(picks)), np.uint64)
                for i in range(picks.shape[1]):
                    keys += _mixed(symbols[:, picks[:, i]] + np.uint64(1)) * factors[:, i]
                keys = _mixed(keys + salt).view(np.int64).ravel()
                nodes = np.repeat(some.column(0).to_numpy(), len(picks))
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(nodes)], names=schema.names)

    return classes.select("node", "symbols").mapInArrow(run, schema)


def _with_sets(docs: DataFrame, nodes: DataFrame, count: int) -> DataFrame:
    """(node, hashes): the full sets of the documents that occur in a pair."""
    few = count <= BROADCAST_IDS
    wanted = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text")).join(
        F.broadcast(nodes) if few else nodes, F.col("doc_id") == F.col("node"), "left_semi"
    )

    def step(parts):
        shingles = Shingles()
        for (texts,) in parts:
            yield ([shingles.of(t).view(np.int64) for t in utf8(texts)],)

    out = annotated(wanted, ["text"], step, [field("hashes", "long", many=True)], ["doc_id"])
    return out.select(F.col("row.doc_id").alias("node"), "hashes")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity_percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("hashes").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("hashes").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a")
    shared, size_a, size_b = F.size(F.array_intersect("set_a", "set_b")), F.size("set_a"), F.size("set_b")
    close = shared * 100 >= (size_a + size_b - shared) * similarity_percent
    return both.where(_sizes_allow(size_a, size_b, similarity_percent) & close).select("a", "b").distinct()


def _sizes_allow(one: Column, other: Column, similarity_percent: int) -> Column:
    return F.least(one, other) * 100 >= F.greatest(one, other) * similarity_percent


def _under_distance(pairs: DataFrame, classes: DataFrame, similarity_percent: int) -> DataFrame:
    """Pairs (a, b), once each, with set sizes that allow a link and signatures under the distance."""
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    a = classes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("symbols").alias("s_a"))
    b = classes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("symbols").alias("s_b"))
    differ = F.aggregate(
        F.zip_with("s_a", "s_b", lambda x, y: (x != y).cast("int")), F.lit(0), lambda n, x: n + x
    )
    both = pairs.join(a, "a").join(b, "b")
    return both.where(_sizes_allow(F.col("n_a"), F.col("n_b"), similarity_percent) & (differ <= DISTANCE)).select("a", "b").distinct()


def _same_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): classes that hold rows of one id; usually none."""
    ids = rows.where("doc_id is not null").join(classes.select("print", "node"), "print").select("doc_id", "node")
    ends = ids.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("last"))
    return ids.join(ends.where("a <> last"), "doc_id").select("a", F.col("node").alias("b")).distinct()


def linked(
    docs: DataFrame, classes: DataFrame, same: DataFrame, similarity_percent: int = SIMILARITY_PERCENT
) -> DataFrame:
    """(node, component) of the classes that are linked with another one, or the ``same`` document (a, b)."""
    keys = stored(keys_of(classes))
    firsts = keys.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
    shared = stored(keys.join(firsts.where("first <> last").select("key", "first"), "key"))
    starry = shared.where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    pairs = stored(_under_distance(starry, classes, similarity_percent))
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    sets = stored(_with_sets(docs, nodes, 2 * pairs.count()))
    found = stored(_confirmed(pairs, sets, similarity_percent).union(same))
    label = components(found)
    crossing = stored(_crossing(shared, label))
    nodes = crossing.select("node").distinct()
    sets = stored(_with_sets(docs, nodes, nodes.count()))
    more = _second_round(crossing, _rarest(sets, similarity_percent), similarity_percent)
    again = stored(_under_distance(more, classes, similarity_percent).join(pairs, ["a", "b"], "left_anti"))
    return components(found.union(_confirmed(again, sets, similarity_percent)))


def _crossing(shared: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, own, outside): the keys whose classes are in two components or more.

    ``own`` is the component of the node, ``outside`` tells that it is not the representative's.
    """
    named = label.select("node", "component")
    own = shared.join(named, "node", "left").select(
        "key", "node", "first", F.coalesce("component", "node").alias("own")
    )
    heads = named.select(F.col("node").alias("first"), F.col("component").alias("head"))
    own = own.join(heads, "first", "left").withColumn("outside", F.col("own") != F.coalesce("head", "first"))
    own = stored(own.select("key", "node", "own", "outside"))
    return own.join(own.where("outside").select("key").distinct(), "key", "left_semi")


def _rarest(sets: DataFrame, similarity_percent: int) -> DataFrame:
    """(hash, node, place, n): of each set, the rarest shingles that one linked set at least must have too.

    Shingles are ordered by the number of sets that have them, then by hash; ``place`` counts from 0.
    """
    each = sets.select("node", F.explode("hashes").alias("hash"))
    counts = each.groupBy("hash").agg(F.count("*").alias("held"))
    ordered = each.join(counts, "hash").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("held", "hash"))).alias("all"))
    n = F.size("all")
    first = F.slice("all", F.lit(1), n - F.ceil(n * similarity_percent / 100).cast("int") + 1)
    placed = ordered.select("node", n.alias("n"), F.posexplode(first).alias("place", "x"))
    return placed.select(F.col("x.hash").alias("hash"), "node", "place", "n")


def _second_round(crossing: DataFrame, rarest: DataFrame, similarity_percent: int) -> DataFrame:
    """Pairs across components that can be linked, of classes outside a representative's with all others.

    A linked pair shares so many shingles that one of them is among the rarest of both. Copies with edits of
    their own have rare shingles that nobody shares, so those that stand alone make few pairs.
    """
    nodes = crossing.groupBy("node").agg(F.first("own").alias("own"), F.bool_or("outside").alias("open"))
    every = rarest.join(nodes, "node")
    side = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("place", "n", "own", "open")]
    a = every.where("open").select("hash", F.col("node").alias("a"), *side("a"))
    b = every.select("hash", F.col("node").alias("b"), *side("b"))
    both = F.col("n_a") + F.col("n_b")
    shared = F.ceil(both * similarity_percent / (100 + similarity_percent))
    near = (F.col("place_a") <= F.col("n_a") - shared) & (F.col("place_b") <= F.col("n_b") - shared)
    # two open ones meet once
    meet = (F.col("own_a") != F.col("own_b")) & (~F.col("open_b") | (F.col("a") < F.col("b")))
    fit = _sizes_allow(F.col("n_a"), F.col("n_b"), similarity_percent)
    return a.join(b, "hash").where(meet & fit & near).select("a", "b")


def near_duplicates(docs: DataFrame, similarity_percent: int = SIMILARITY_PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id and kept (it is the smallest id of its component)."""
    docs = docs.select("doc_id", "text")
    rows = stored(signed(docs))
    classes = (
        rows.where("doc_id is not null and print is not null")
        .groupBy("print")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("symbols").alias("symbols"))
    )
    classes = stored(classes)
    label = linked(docs, classes, _same_id(rows, classes), similarity_percent)
    named = classes.select("print", "node").join(label, "node", "left")
    named = named.select("print", F.coalesce("component", "node").alias("component"))
    out = rows.join(named, "print", "left").withColumn(
        "component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    )
    return out.select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept")
    )
