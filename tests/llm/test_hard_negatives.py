"""Hard negatives against a search over all rows."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, divisor, positives=5, negatives=3):
    used = {}
    for i, label, v in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) or abs(256 * x) >= 2**31 for x in v):
            continue
        row = (label, [math.floor(256 * float(np.float32(x))) for x in v])
        used[i] = min(used.get(i, row), row)
    out = []
    for a, (label, v) in used.items():
        if a % divisor:
            continue
        scores = [(-sum(x * y for x, y in zip(v, w)), i, m == label) for i, (m, w) in used.items() if i != a and len(w) == len(v)]
        near, far = (sorted(s[:2] for s in scores if s[2] == same) for same in (True, False))
        for p, positive in near[:positives]:
            fits = [(s, n) for s, n in far if 50 * -p <= 100 * -s <= 95 * -p][:negatives]
            out += [(a, positive, r, n, -p, -s) for r, (s, n) in enumerate(fits, 1)]
    return sorted(out)


def mined(spark, rows, divisor=10):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash")).repartition(4)
    out = hn.mine(hn.usable(frame), F.col("vec_id") % divisor == 0)
    return sorted(tuple(r) for r in out.collect())


@pytest.fixture
def small_units(monkeypatch):
    """Trees of several levels, leaves of several blocks and blocks of several parts from few rows."""
    for name, value in (("LEAF_ROWS", 20), ("BLOCK_ROWS", 7), ("PART_ROWS", 5), ("FANOUT", 4), ("AT_ONCE", 3)):
        monkeypatch.setattr(hn, name, value)


def clustered(rng, count, size, spread):
    centres = rng.normal(size=(12, size))
    x = centres[rng.integers(0, 12, count)] + spread * rng.normal(size=(count, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("size, spread", [(2, 0.3), (8, 0.2), (16, 1.0)])
def test_against_all_rows(spark, small_units, size, spread):
    rng = np.random.default_rng(size)
    x = clustered(rng, 500, size, spread)
    rows = [(i, int(rng.integers(0, 3)), v.tolist()) for i, v in enumerate(x)]
    got = mined(spark, rows)
    assert got == plain(rows, 10) and len(got) > 100


def test_odd_rows_ties_and_copies(spark, small_units):
    rng = np.random.default_rng(7)
    x = np.round(clustered(rng, 150, 4, 0.4) * 4) / 4  # many ties
    rows = [(i, int(rng.integers(0, 2)), v.tolist()) for i, v in enumerate(x)]
    rows += [(1_000 + i, i % 2, x[0].tolist()) for i in range(300)]  # a third and more are copies
    rows += [(2_000 + i, 0, (x[1] + 0.004 * rng.normal(size=4)).tolist()) for i in range(100)]
    rows += [(3_000, None, [1.0] * 4), (3_010, 1, None), (3_020, 1, [None] * 4), (3_030, 1, [math.nan] * 4), (3_040, 1, [math.inf] + [0.0] * 3),
             (3_050, 1, []), (3_051, 0, []), (3_060, 0, [1.0, 2.0]), (3_061, 1, [1.0, 1.0]), (3_062, 0, [2.0, 2.0]), (3_070, 0, [1e30] * 4),
             (None, 1, x[3].tolist()), (0, 1, x[5].tolist()), (0, 0, x[6].tolist()), (7, 0, x[7].tolist()), (3_080, 1, [0.0] * 4),
             (3_090, 0, [8e6, 8e6, 1.0, 1.0]), (3_091, 0, [8e6, 8e6, 2.0, 1.0]), (3_092, 1, [7e6, 7e6, 1.0, 1.0])]
    assert mined(spark, rows) == plain(rows, 10)


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, 1, [1.0, 0.0])]) == []
    rows = [(0, 1, [1.0, 0.0]), (1, 1, [1.0, 0.0]), (2, 2, [0.7, 0.0])]
    assert mined(spark, rows) == [(0, 1, 1, 2, 65536, 45824)] == plain(rows, 10)


def test_tree_leaves_out_subtrees_and_finds_all():
    """Every row of a window lies in a leaf that is reached; narrow windows do not reach all leaves."""
    rng = np.random.default_rng(3)
    x = np.floor(256 * clustered(rng, 4_000, 3, 0.1))
    tree = hn.Tree()
    tree.fit(list(x[:2_000]), 100_000)
    found = {}
    for at, rows, far, nearest in tree.paths(x):
        for j in np.unique(nearest).tolist():
            mine = nearest == j
            lengths = (x[rows[mine]] ** 2).sum(axis=1)
            found[at, j] = (far[mine].min(axis=0), far[mine].max(axis=0), lengths.min(), lengths.max())
    tree.set_ranges(found)
    leaf = tree.leaf_of(x)
    assert tree.leaves > 30 and len(tree.nodes) > 3
    q = x[:50]
    scores = q @ x.T
    lows = np.quantile(scores, 0.6, axis=1).astype(np.int64)[:, None]
    highs = np.quantile(scores, 0.62, axis=1).astype(np.int64)[:, None]
    visits = np.zeros((50, tree.leaves), bool)
    for at, rows in tree.reached(q, lows, highs):
        visits[rows, at] = True
    inside = (scores >= lows) & (scores <= highs)
    assert all(visits[i, leaf[j]] for i, j in zip(*np.nonzero(inside)))
    assert visits.mean() < 0.5


def test_units_stay_small(spark, small_units):
    """The units of a leaf that holds most rows are bounded blocks."""
    rows = [(i, i % 2, [1.0 + i / 4_000, 0.5]) for i in range(400)]
    index = hn.index_of(hn.stored(hn.entries_of(hn.usable(spark.createDataFrame(rows, SCHEMA)), 6)))
    assert index.entries.count() == sum(r["rows"] for r in index.sizes.collect())
    assert mined(spark, rows, 5) == plain(rows, 5)
