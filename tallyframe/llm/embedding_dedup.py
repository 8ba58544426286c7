"""Embedding near-duplicates by lattice hashing with E8 cells.

Each of ``TABLES`` tables projects a unit vector at random to ``BLOCKS`` times
eight dimensions, scales it and decodes each block to the nearest point of the
E8 lattice; the points together are the vector's cell. A vector is filed in its
own cell and looks into that one and, per block, into the ``PROBES`` neighbouring
cells nearest to it (of the 240 around a lattice point). Vectors that meet in a
cell are compared by cosine in double precision, so no false link is made.

With these numbers a pair at cosine 0.90, 0.95, 0.98 is found with a probability
of about 0.95, 0.999 and 1, and two unrelated vectors of 64 dimensions meet with
about 0.001. For far larger tables, raise ``blocks`` (each makes chance meetings
rarer by two to three orders) and ``tables`` with it.

Equal vectors are one class from the start and count as many links as they have
members. Vectors that are null, zero, or hold null or non-finite components link
with nothing, nor do rows without an id; vectors of different dimensions never
meet. Rows with the same id count as one vector when links are followed. Extra
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.components import components
from tallyframe.llm.shared import field, stored

COSINE = 0.9
TABLES, BLOCKS, PROBES = 10, 2, 8
SCALE = 1.6
SEED = 8_008


def minimal_vectors() -> np.ndarray:
    """The 240 lattice points around the origin."""
    found = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            found.append(v)
    found += [np.array(s) for s in product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(found)


def _nearest_even(y: np.ndarray) -> np.ndarray:
    """The nearest integer points with an even sum."""
    point = np.rint(y)
    off = y - point
    rows = np.flatnonzero(point.sum(axis=1).astype(np.int64) & 1)
    worst = np.abs(off[rows]).argmax(axis=1)
    point[rows, worst] += np.where(off[rows, worst] >= 0, 1.0, -1.0)
    return point


def nearest_points(y: np.ndarray) -> np.ndarray:
    """E8 is the integer points with an even sum, and those shifted by one half."""
    whole, half = _nearest_even(y), _nearest_even(y - 0.5) + 0.5
    nearer = ((y - whole) ** 2).sum(axis=1) <= ((y - half) ** 2).sum(axis=1)
    return np.where(nearer[:, None], whole, half)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Lattice:
    """Cells of all tables for vectors of one dimension."""

    def __init__(self, dimension: int, tables: int, blocks: int, probes: int, scale: float):
        rng = np.random.default_rng([SEED, dimension])
        self.tables, self.blocks, self.probes = tables, blocks, probes
        self.project = rng.normal(size=(tables, blocks, dimension, 8)) / scale
        self.factors = rng.integers(-(2**62), 2**62, (tables, blocks, 8))
        self.salts = rng.integers(0, 2**63, tables, dtype=np.uint64) + np.uint64(dimension)
        self.around = minimal_vectors()

    def cells(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of the own cells (rows, tables) and of the probed ones (rows, tables * blocks * probes)."""
        own, probed = [], []
        with np.errstate(over="ignore"):
            for t in range(self.tables):
                codes, steps = [], []
                for b in range(self.blocks):
                    y = x @ self.project[t, b]
                    point = nearest_points(y)
                    # lattice points are whole in halves; the code of a neighbour is a sum
                    codes.append((np.rint(2 * point).astype(np.int64) * self.factors[t, b]).sum(axis=1))
                    turn = (np.rint(2 * self.around).astype(np.int64) * self.factors[t, b]).sum(axis=1)
                    near = np.argpartition(-((y - point) @ self.around.T), self.probes, axis=1)[:, : self.probes]
                    steps.append(turn[near])
                code = sum(codes)
                own.append(_mixed(code.view(np.uint64) + self.salts[t]))
                for step in steps:
                    probed.append(_mixed((code[:, None] + step).view(np.uint64) + self.salts[t]))
        return np.stack(own, axis=1), np.concatenate(probed, axis=1)


def cells_of(classes: DataFrame, tables: int, blocks: int, probes: int, scale: float) -> DataFrame:
    """(key, node, own): the cells that a vector is filed in (own) and looks into."""
    schema = T.StructType([field("key", "long"), field("node", "long"), field("own", "boolean")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                some = batch.slice(at, 1_000)
                nodes, sizes = some.column(0).to_numpy(), some.column(1).value_lengths().to_numpy()
                flat = some.column(1).flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(sizes)])
                for size in np.unique(sizes).tolist():
                    if size not in made:
                        made[size] = Lattice(size, tables, blocks, probes, scale)
                    rows = np.flatnonzero(sizes == size)
                    x = flat[starts[rows][:, None] + np.arange(size)]
                    own, probed = made[size].cells(x)
                    for keys, mine in ((own, True), (probed, False)):
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys.view(np.int64).ravel()),
                                pa.array(np.repeat(nodes[rows], keys.shape[1])),
                                pa.array(np.full(keys.size, mine)),
                            ],
                            names=schema.names,
                        )

    return classes.select("node", "unit").mapInArrow(run, schema)


def _dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)


def classes_of(vectors: DataFrame) -> DataFrame:
    """(vector, node, members, unit): distinct usable vectors in double precision."""
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), _doubles(vectors).alias("vector"))
    usable = (
        F.col("vec_id").isNotNull()
        & F.col("vector").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    )
    grouped = rows.where(usable).groupBy("vector").agg(F.min("vec_id").alias("node"), F.count("*").alias("members"))
    # scaled by the largest component first, so that squares neither overflow nor vanish
    largest = F.array_max(F.transform("vector", F.abs))
    grouped = grouped.withColumn("unit", F.transform("vector", lambda x: x / largest))
    length = F.sqrt(_dot("unit", "unit"))
    return grouped.withColumn("length", length).withColumn("unit", F.transform("unit", lambda x: x / F.col("length"))).drop("length")


def _doubles(vectors: DataFrame) -> Column:
    """Zeros of either sign are equal."""
    return F.transform(vectors["embedding"].cast("array<double>"), lambda x: x + F.lit(0.0))


def links_of(classes: DataFrame, cosine: float, tables: int, blocks: int, probes: int, scale: float) -> DataFrame:
    """(a, b), a < b: classes that met in a cell and are close enough."""
    cells = stored(cells_of(classes, tables, blocks, probes, scale))
    looking = cells.select("key", F.col("node").alias("x"), F.col("own").alias("home"))
    filed = cells.where("own").select("key", F.col("node").alias("y"))
    met = looking.join(filed, "key").where("x <> y and (not home or x < y)")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    a = classes.select(F.col("node").alias("a"), F.col("unit").alias("unit_a"))
    b = classes.select(F.col("node").alias("b"), F.col("unit").alias("unit_b"))
    close = (F.size("unit_a") == F.size("unit_b")) & (_dot("unit_a", "unit_b") >= cosine)
    return pairs.join(a, "a").join(b, "b").where(close).select("a", "b").distinct()


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    tables: int = TABLES,
    blocks: int = BLOCKS,
    probes: int = PROBES,
    scale: float = SCALE,
) -> DataFrame:
    """Per row: vec_id, n_links, component_id and kept (it is the smallest id of its component)."""
    classes = stored(classes_of(vectors))
    links = stored(links_of(classes, cosine, tables, blocks, probes, scale))
    members = classes.select(F.col("node").alias("b"), "members")
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(members, "b").groupBy(F.col("a").alias("node")).agg(F.sum("members").alias("others"))
    named = classes.join(linked, "node", "left").join(components(links), "node", "left")
    named = named.select(
        F.col("vector").alias("own_vector"),
        (F.col("members") - 1 + F.coalesce("others", F.lit(0))).alias("links"),
        F.coalesce("component", "node").alias("component"),
    )
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), _doubles(vectors).alias("vector"))
    # rows that link with nothing need no partner
    out = rows.join(named, (F.col("vector") == F.col("own_vector")) & F.col("vec_id").isNotNull(), "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
                     F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
