"""Hard-negative mining by exact search in a multiway hyperplane tree.

Vectors are scaled to integers and compared by their inner product. The tree follows the
geometric near-neighbour access tree: a node has up to ``FANOUT`` split points, chosen far
apart, and a vector goes to the nearest one. Every split point keeps the least and the
largest distance to the vectors of every sibling's subtree, and every subtree the range of
its vectors' lengths, taken over all rows. Only the split points come from a sample, of at
most ``SAMPLE_ROWS`` rows and ``SAMPLE_BYTES``, by a hash of the vector.

A window of scores is an annulus of distances around the anchor, as
``distance^2 = |q|^2 + |x|^2 - 2 score``. A subtree is left out where, by one of the split
points, no vector of it can lie within the annulus. All others are searched to their
leaves, vector by vector, so results are exact: the sample changes the work only.

Each anchor first looks into its own leaf; what it finds narrows the window for the rest of
the tree. Leaves are dealt in blocks of about ``BLOCK_ROWS`` vectors, and the anchors of a
block in parts, which pass by as a stream, so that a leaf of very many vectors or anchors
is many small units of work.

Rows of one label with equal vectors are one entry with its smallest ids, as many as a
search can return. Of rows that share a vec_id, the one of the smallest (label, vector)
counts. Rows with a null id, label, vector or component, or with a component that is not
finite or reaches 2^31 when scaled, take no part. Vectors of different dimensions never
meet. Ties go to the smaller vec_id. An empty table gives an empty one; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field as member

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import field, stored

SCALE = 256
FANOUT = 12
#: Vectors of a leaf that the fit aims at, vectors of a block, and anchors of a part.
LEAF_ROWS, BLOCK_ROWS, PART_ROWS = 2_048, 4_096, 65_536
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 32 << 20
SEED = 11
#: Scores without a bound.
LOWEST, HIGHEST = -(1 << 63) + 1, (1 << 63) - 1
#: Anchors compared with a block at a time.
AT_ONCE = 256

SLOTS = T.ArrayType(T.StructType([field("slot", "long"), field("low", "long"), field("high", "long")]))


@dataclass
class Node:
    """Split points and, per point, what lies there: another node, or ~leaf."""

    points: np.ndarray
    children: list[int]
    #: near[i, j], far[i, j]: distances from point i to the vectors of subtree j.
    near: np.ndarray = member(default=None)
    far: np.ndarray = member(default=None)
    #: Squared lengths of the vectors of each subtree; an empty one has shortest > longest.
    shortest: np.ndarray = member(default=None)
    longest: np.ndarray = member(default=None)


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(axis=1)[:, None] + (points * points).sum(axis=1) - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0))


class Tree:
    """The nodes of all dimensions; a dimension that the sample lacks is one leaf of its own."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.roots: dict[int, int] = {}
        self.leaves = 0

    def fit(self, sample: list[np.ndarray], rows: float) -> None:
        """Splits the sample until a leaf stands for about LEAF_ROWS of all rows."""
        rng = np.random.default_rng(SEED)
        each = rows / max(1, len(sample))
        by_size: dict[int, list[np.ndarray]] = {}
        for v in sample:
            by_size.setdefault(len(v), []).append(v)
        for size, some in sorted(by_size.items()):
            self.roots[size] = self._grown(np.unique(np.array(some, float).reshape(len(some), size), axis=0), each, rng)

    def _grown(self, x: np.ndarray, each: float, rng: np.random.Generator) -> int:
        if len(x) * each <= LEAF_ROWS or len(x) < 2 * FANOUT:
            self.leaves += 1
            return ~(self.leaves - 1)
        some = x[rng.choice(len(x), min(len(x), 3 * FANOUT), replace=False)]
        between = distances(some, some)
        chosen = [0]
        while len(chosen) < FANOUT:
            chosen.append(int(between[chosen].min(axis=0).argmax()))
        points = some[chosen]
        nearest = distances(x, points).argmin(axis=1)
        at = len(self.nodes)
        self.nodes.append(Node(points, []))
        self.nodes[at].children = [self._grown(x[nearest == j], each, rng) for j in range(FANOUT)]
        return at

    def paths(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(node, rows, their distances to its points, the nearest one) on the way down; x has one dimension."""
        todo = [(self.roots.get(x.shape[1], -1), np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at >= 0 and len(rows):
                far = distances(x[rows], self.nodes[at].points)
                nearest = far.argmin(axis=1)
                yield at, rows, far, nearest
                todo += [(child, rows[nearest == j]) for j, child in enumerate(self.nodes[at].children)]

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        root = self.roots.get(x.shape[1])
        # dimensions that the sample lacks have leaves below 0
        out = np.full(len(x), ~root if root is not None and root < 0 else -1 - x.shape[1])
        for at, rows, _, nearest in self.paths(x):
            child = np.array(self.nodes[at].children)[nearest]
            out[rows[child < 0]] = ~child[child < 0]
        return out

    def set_ranges(self, ranges: dict[tuple[int, int], tuple[list[float], list[float], float, float]]) -> None:
        """Per node and subtree: the distances from each point, and the squared lengths."""
        for at, node in enumerate(self.nodes):
            count = len(node.children)
            node.near, node.far = np.full((count, count), np.inf), np.full((count, count), -np.inf)
            node.shortest, node.longest = np.full(count, np.inf), np.full(count, -np.inf)
            for j in range(count):
                if (at, j) in ranges:
                    node.near[:, j], node.far[:, j], node.shortest[j], node.longest[j] = ranges[at, j]

    def reached(self, x: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of x) whose annuli meet what the leaf may hold.

        ``lows`` and ``highs`` hold the windows of scores per row; an empty one has low > high.
        """
        root = self.roots.get(x.shape[1], x.shape[1])
        if x.shape[1] not in self.roots:
            yield -1 - x.shape[1], np.arange(len(x))
            return
        todo, squares = [(root, np.arange(len(x)))], (x * x).sum(axis=1)
        while todo:
            at, rows = todo.pop()
            if at < 0:
                yield ~at, rows
                continue
            node = self.nodes[at]
            here = distances(x[rows], node.points)
            low, high, own = lows[rows].astype(float), highs[rows].astype(float), squares[rows][:, None]
            for j, child in enumerate(node.children):
                if node.shortest[j] > node.longest[j]:
                    continue
                nearest = np.maximum(np.maximum(here - node.far[:, j], node.near[:, j] - here), 0).max(axis=1)[:, None]
                farthest = (here + node.far[:, j]).min(axis=1)[:, None]
                inner = np.sqrt(np.maximum(own + node.shortest[j] - 2 * high, 0))
                outer = np.sqrt(np.maximum(own + node.longest[j] - 2 * low, -1).clip(0))
                some = own + node.longest[j] >= 2 * low * (1 - 1e-9)
                slack = 1e-6 * (1 + farthest)
                meets = (low <= high) & some & (nearest <= outer + slack) & (farthest >= inner - slack)
                mine = rows[meets.any(axis=1)]
                if len(mine):
                    todo.append((child, mine))


def by_dimension(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of the vectors of each dimension."""
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield rows, flat[starts[rows][:, None] + np.arange(size)].reshape(len(rows), size)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v): rows that take part, components scaled and rounded down."""
    scaled = F.transform(vectors["embedding"].cast("array<double>"), lambda x: x * SCALE)
    rows = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["label"].cast("long").alias("label"), scaled.alias("s"))
    whole = F.forall("s", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(1 << 31)))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("s").isNotNull() & whole)
    rows = rows.select("vec_id", F.struct("label", F.transform("s", lambda x: F.floor(x)).alias("v")).alias("row"))
    return rows.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.*")


def entries_of(rows: DataFrame, most: int) -> DataFrame:
    """(label, v, ids): distinct vectors of a label with their smallest ids, ``most`` of them."""
    order = Window.partitionBy("label", "v").orderBy("vec_id")
    first = rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    return first.groupBy("label", "v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))


@dataclass
class Index:
    """Entries with their leaves, the tree with its ranges, and the entries of each leaf."""

    entries: DataFrame
    tree: Tree
    sizes: DataFrame


def index_of(entries: DataFrame) -> Index:
    """Fits the tree on a sample, files every entry in its leaf and takes the ranges over all of them."""
    total, size = entries.agg(F.count("*"), F.max(F.size("v"))).first()
    sample = entries.select("v", F.xxhash64("v").alias("hash")).orderBy("hash", "v")
    sample = sample.limit(min(SAMPLE_ROWS, max(100, SAMPLE_BYTES // (8 * max(1, size or 0)))))
    tree = Tree()
    tree.fit([np.array(r["v"]) for r in sample.select("v").collect()], total)
    schema = T.StructType([field("leaf", "long"), *entries.schema.fields])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = np.zeros(batch.num_rows, np.int64)
            for rows, x in by_dimension(batch.column("v")):
                leaf[rows] = tree.leaf_of(x.astype(float))
            yield pa.RecordBatch.from_arrays([pa.array(leaf), *batch.columns], names=schema.names)

    filed = stored(entries.mapInArrow(file, schema))
    kinds = [("node", "long"), ("child", "long"), ("point", "long"), ("near", "double"), ("far", "double"), ("shortest", "double"), ("longest", "double")]
    ranges = T.StructType([field(*k) for k in kinds])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for _, x in by_dimension(batch.column(0)):
                x = x.astype(float)
                squares = (x * x).sum(axis=1)
                for at, rows, far, nearest in tree.paths(x):
                    for j in np.unique(nearest).tolist():
                        mine = nearest == j
                        lengths = squares[rows[mine]]
                        now = [far[mine].min(axis=0), far[mine].max(axis=0), lengths.min(), lengths.max()]
                        old = found.get((at, j), now)
                        found[at, j] = [f(a, b) for f, a, b in zip((np.minimum, np.maximum) * 2, old, now)]
        rows = [(at, j, i, n, f, float(s), float(b)) for (at, j), (near, far, s, b) in found.items() for i, (n, f) in enumerate(zip(near.tolist(), far.tolist()))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=ranges.names)

    merged = filed.select("v").mapInArrow(measure, ranges).groupBy("node", "child", "point").agg(
        *[f(name).alias(name) for f, name in ((F.min, "near"), (F.max, "far"), (F.min, "shortest"), (F.max, "longest"))]
    )
    held: dict[tuple[int, int], tuple] = {}
    for r in merged.orderBy("node", "child", "point").collect():  # bounded by the tree, which the sample bounds
        near, far, _, _ = held.setdefault((r["node"], r["child"]), ([], [], r["shortest"], r["longest"]))
        near.append(r["near"])
        far.append(r["far"])
    tree.set_ranges(held)
    return Index(filed, tree, stored(filed.groupBy("leaf").agg(F.count("*").alias("rows"))))


def _routed(queries: DataFrame, tree: Tree, home: bool) -> DataFrame:
    """(leaf, anchor, label, v, slots): each query once per leaf to search, its own leaf or all others."""
    schema = T.StructType([field("leaf", "long"), *queries.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1_000):
                some = batch.slice(at, 1_000)
                slots = some.column("slots").to_pylist()
                width = max([len(s) for s in slots] + [1])
                lows, highs = np.full((len(slots), width), HIGHEST), np.full((len(slots), width), LOWEST)
                for i, mine in enumerate(slots):
                    for k, slot in enumerate(mine):
                        lows[i, k], highs[i, k] = slot["low"], slot["high"]
                for rows, x in by_dimension(some.column("v")):
                    own = tree.leaf_of(x.astype(float))
                    if home:
                        found = ((leaf, np.flatnonzero(own == leaf)) for leaf in np.unique(own).tolist())
                    else:
                        found = tree.reached(x.astype(float), lows[rows], highs[rows])
                    for leaf, mine in found:
                        mine = mine if home else mine[own[mine] != leaf]
                        if len(mine):
                            taken = some.take(pa.array(rows[mine]))
                            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), leaf)), *taken.columns], names=schema.names)

    return queries.mapInArrow(run, schema)


FOUND = T.StructType([field("anchor", "long"), field("slot", "long"), field("id", "long"), field("score", "long")])


class Block:
    """Entries of one block of a leaf, ordered by their smallest ids."""

    def __init__(self, labels: list[np.ndarray], vectors: list[np.ndarray], ids: list[list[int]]):
        order = np.argsort([i[0] for i in ids], kind="stable")
        self.x = np.concatenate(vectors)[order]
        self.ids = [ids[i] for i in order]
        self.labels = np.concatenate(labels)[order]
        self.largest = int(np.abs(self.x).max(initial=0))

    def scores(self, q: np.ndarray) -> np.ndarray:
        bound = self.largest * int(np.abs(q).max(initial=0)) * self.x.shape[1]
        if bound < 1 << 53:
            return (q.astype(float) @ self.x.T.astype(float)).astype(np.int64)
        if bound < 1 << 63:
            return q @ self.x.T
        return np.clip(q.astype(object) @ self.x.T.astype(object), LOWEST, HIGHEST).astype(np.int64)

    def best(self, scores: np.ndarray, anchor: int, label: int, low: int, high: int, k: int, same: bool) -> list[tuple[int, int]]:
        """The first k (score, id) of one query: scores within the window, the anchor itself left out."""
        there = np.flatnonzero((scores >= low) & (scores <= high) & ((self.labels == label) == same))
        # an entry more, as the anchor may be the smallest id of one
        if len(there) > k + 1:
            mine = scores[there]
            least = np.partition(mine, len(mine) - k - 1)[len(mine) - k - 1]
            above, level = there[mine > least], there[mine == least]
            there = np.concatenate([above, level[: k + 1 - len(above)]])
        found = [(int(scores[i]), n) for i in there.tolist() for n in self.ids[i] if n != anchor]
        return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def _evaluated(index: Index, routed: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, id, score): the first k of every query and slot in every block that it visits."""
    asked = routed.groupBy("leaf").agg(F.count("*").alias("queries"))
    # one row per leaf, and leaves are bounded by the sample
    units = index.sizes.join(asked, "leaf").select(
        "leaf",
        F.ceil(F.col("rows") / BLOCK_ROWS).alias("blocks"),
        F.ceil(F.col("queries") / PART_ROWS).alias("parts"),
    )
    units = F.broadcast(stored(units))

    def upto(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    entries = index.entries.join(units, "leaf").select(
        "leaf", F.pmod(F.xxhash64("v", "label"), F.col("blocks")).alias("block"), upto("parts").alias("part"),
        F.lit(0).alias("kind"), F.lit(None).cast("long").alias("anchor"), "label", "v", "ids", F.lit(None).cast(SLOTS).alias("slots"),
    )
    queries = routed.join(units, "leaf").withColumn("part", F.pmod(F.xxhash64("anchor"), F.col("parts"))).select(
        "leaf", upto("blocks").alias("block"), "part", F.lit(1).alias("kind"), "anchor", "label", "v", F.lit(None).cast("array<long>").alias("ids"), "slots",
    )
    unit = ["leaf", "block", "part"]
    together = entries.unionByName(queries).repartition(*unit).sortWithinPartitions(*unit, "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, block = None, ([], [], []), None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                *key, kind = keys[a].tolist()
                some = batch.slice(a, b - a)
                if key != now:
                    now, held, block = key, ([], [], []), None
                x = next(m for _, m in by_dimension(some.column("v")))
                if kind == 0:
                    held[0].append(some.column("label").to_numpy())
                    held[1].append(x)
                    held[2].extend(some.column("ids").to_pylist())
                    continue
                if not held[2]:
                    continue
                block = block or Block(*held)
                anchors, labels, slots = (some.column(c).to_pylist() for c in ("anchor", "label", "slots"))
                for at in range(0, b - a, AT_ONCE):
                    found = []
                    for i, scores in enumerate(block.scores(x[at : at + AT_ONCE]), at):
                        for slot in slots[i]:
                            best = block.best(scores, anchors[i], labels[i], slot["low"], slot["high"], k, same)
                            found += [(anchors[i], slot["slot"], n, score) for score, n in best]
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=FOUND.names)

    return together.mapInArrow(run, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def search(index: Index, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(anchor, slot, id, score, nth): the first k entries' rows per query and slot.

    ``queries`` holds anchor, label, v and slots (slot, low, high); ``same`` asks for rows
    of the query's label, otherwise for those of all others.
    """
    own = stored(_first(_evaluated(index, stored(_routed(queries, index.tree, True)), k, same), k))
    # whoever has found k rows needs no lower score than the last of them
    full = own.groupBy("anchor", "slot").agg(F.count("*").alias("number"), F.min("score").alias("least")).where(F.col("number") == k)
    full = full.groupBy("anchor").agg(F.map_from_entries(F.collect_list(F.struct("slot", "least"))).alias("least"))
    narrowed = F.transform(
        "slots",
        lambda s: F.struct(s["slot"].alias("slot"), F.greatest(s["low"], F.col("least")[s["slot"]]).alias("low"), s["high"].alias("high")),
    )
    rest = queries.join(full, "anchor", "left").withColumn("slots", F.when(F.col("least").isNull(), F.col("slots")).otherwise(narrowed))
    rest = stored(rest.select("anchor", "label", "v", "slots"))
    others = _evaluated(index, stored(_routed(rest, index.tree, False)), k, same)
    return _first(own.drop("nth").unionByName(others), k)


def mine(
    rows: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``rows`` holds vec_id, label and v as ``usable`` gives them. The positives of an anchor
    are the first rows of its label; the negatives of a positive are the first rows of other
    labels whose score is at least ``low_percent`` and at most ``high_percent`` of its own.
    """
    rows = stored(rows)
    index = index_of(stored(entries_of(rows, max(positives, negatives) + 1)))
    asking = rows.where(anchors).select(F.col("vec_id").alias("anchor"), "label", "v")
    every = F.array(F.struct(F.lit(0).cast("long").alias("slot"), F.lit(LOWEST).alias("low"), F.lit(HIGHEST).alias("high")))
    near = search(index, stored(asking.withColumn("slots", every.cast(SLOTS))), positives, True)
    near = stored(near.select("anchor", F.col("nth").cast("long").alias("slot"), F.col("id").alias("positive"), F.col("score").alias("ps")))
    # the least and the largest whole score within the percentages
    window = F.struct(
        "slot",
        F.expr(f"(big * {low_percent} + pmod(-big * {low_percent}, 100)) div 100").alias("low"),
        F.expr(f"(big * {high_percent} - pmod(big * {high_percent}, 100)) div 100").alias("high"),
    )
    near_big = near.withColumn("big", F.col("ps").cast("decimal(20,0)"))
    windows = near_big.select("anchor", window.alias("w")).where("w.low <= w.high")
    windows = windows.groupBy("anchor").agg(F.sort_array(F.collect_list("w")).cast(SLOTS).alias("slots"))  # one per positive
    far = search(index, stored(asking.join(windows, "anchor")), negatives, False)
    return far.join(near, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"),
        F.col("positive").alias("positive_id"),
        F.col("nth").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        F.col("ps").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )
