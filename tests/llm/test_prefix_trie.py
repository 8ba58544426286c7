"""The conversation trie against one built turn by turn."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tallyframe.llm import prefix_trie


def plain(rows):
    """The contract's rows, by a dictionary of starts."""
    own = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    members = {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    totals = {}
    for node in sorted(members, key=len, reverse=True):
        below = [totals[x] for x in children.get(node, [])]
        saved = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        totals[node] = (sum(a for a, _ in below) or 1, saved + sum(b for _, b in below))
    out = []
    for node, some in members.items():
        ends = ",".join(str(c) for c in some if len(built[c]) == len(node))
        parent = members[node[:-1]][0] if node else None
        out.append((some[0], len(node), parent, len(some), len(children.get(node, [])), *totals[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def made(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).repartition(5)
    return sorted(map(tuple, prefix_trie.rebuilt_trie(frame).select(*COLUMNS).collect()))


def test_against_plain_trie(spark):
    rng = random.Random(1)
    rows = []
    for c in range(400):
        if rng.random() < 0.1:
            continue
        rows += [(c, t, rng.choice(["user", None]), rng.choice(["a", "bé", "", None])) for t in range(rng.randint(1, 14))]
    # long ones that share most of their turns, ties, null turns, repeated rows, rows without an id
    for c in (1_000, 1_001, 1_002, 1_003, 1_017):
        rows += [(c, t, "user", f"t{t if t < 2_500 + c % 7 else c}") for t in range(2_600)]
    rows += [(2_000, 1, "user", x) for x in "cab"] + [(2_001, None, "user", "first"), (2_001, 0, "user", "second")]
    rows += [(2_005, 0, "user", "same")] * 3 + [(None, 0, "user", "lost"), (2_011, 5, None, None)]
    assert made(spark, rows) == plain(rows)


def test_copies_and_nested_chains(spark):
    """Many copies of one conversation, and starts that hang on one another."""
    rows = [(5 * c, t, "u", "copy") for c in range(300) for t in range(3)]
    rows += [(10_000 + 5 * c, t, "u", f"x{t}") for c in range(60) for t in range(60 - c)]
    rows += [(20_000 + 5 * c, t, "u", f"y{t}" if t < c else f"y{t} {c}") for c in range(60) for t in range(c + 2)]
    assert made(spark, rows) == plain(rows)


def test_empty_and_single(spark):
    assert made(spark, []) == [] and made(spark, [(None, 1, "u", "x")]) == []
    assert made(spark, [(7, 1, "u", "x")]) == plain([(7, 1, "u", "x")])
    lone = [(c, 0, "u", "x") for c in range(20)]
    assert made(spark, lone) == plain(lone)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_block_size_does_not_matter(spark, block):
    rng = random.Random(2)
    rows = [(c, t, "u", rng.choice("ab")) for c in range(80) for t in range(rng.randint(1, 9))]
    turns = prefix_trie.stored(prefix_trie.ordered(spark.createDataFrame(rows, SCHEMA)))
    turns, convs = prefix_trie.with_heads(turns)
    got = prefix_trie.prefix_trie(turns, convs, block).select(*COLUMNS).collect()
    assert sorted(map(tuple, got)) == plain(rows)


def test_hot_keys_are_broadcast(spark):
    rows = spark.range(100).selectExpr("id", "IF(id < 90, 0, id) AS k")
    lookup = spark.createDataFrame([(0, "hot", 2_000_000), (95, "cold", 1)], "k long, v string, n long")
    inner = prefix_trie.looked_up(rows, lookup, "k", "n").groupBy("v").count().collect()
    assert {tuple(r) for r in inner} == {("hot", 90), ("cold", 1)}
    assert prefix_trie.looked_up(rows, lookup, "k", "n", outer=True).count() == 100
