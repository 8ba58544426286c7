"""The trie of conversations that start with the same turns, by hashing blocks of turns.

A node is a distinct sequence of first turns (role, text); its members are the
conversations that start with it.

1. Every turn becomes a 128-bit digest of its place, role and text where it lies, so
   texts never move. The digest of a sequence is the exclusive or of its turns'.
2. Turns are put into blocks of ``BLOCK``, and conversations are grouped by the digests
   of what lies before a block and of the block itself. A block that thousands of
   conversations share is one row from here on.
3. A block without siblings is a chain of nodes with the same members. Only where
   several blocks follow the same start, their turns are compared one by one.
4. Nodes with the same smallest member form a chain down to that conversation's end, and
   a chain hangs on a node of another. Totals of chains are carried up by pointer
   doubling, in as many rounds as the logarithm of the chains' nesting, and then summed
   along each chain.

Rows are ordered by turn, null first, then by role, by the first letters of the text and
by its digest. Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left
out; repeated rows are turns like others. A conversation without turns is a member of
the root only. An empty table has no root. Extra columns are ignored.

No step gathers the turns, children or members of one key: orders and running folds of a
long conversation are split into stretches, a node with very many children is looked up
by a broadcast of the few such nodes, and the ids of a node's ended conversations are
hashed as a sorted stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyframe.llm.shared import field, stored
from tallyframe.operators.ranking import line_numbers

#: Turns in a block.
BLOCK = 8
#: Letters of a text that order rows of the same turn and role.
TIE_LETTERS = 64
#: Rows of one key that a running fold orders in one piece.
STRETCH = 1_024
#: A key with more than this part of all rows, divided by the shuffle partitions, is broadcast.
HOT = 4


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, bytes): turns numbered from 1, their digests and the UTF-8 bytes of their texts."""
    role = F.coalesce(conversations["role"].cast("string"), F.lit(""))
    text = F.coalesce(conversations["text"].cast("string"), F.lit(""))
    digest = F.md5(F.concat_ws(":", F.octet_length(role).cast("string"), role, text).cast("binary"))
    rows = conversations.where(conversations["conv_id"].isNotNull()).select(
        conversations["conv_id"].cast("long").alias("conv_id"),
        conversations["turn"].alias("turn"),
        role.alias("role"),
        F.substring(text, 1, TIE_LETTERS).alias("letters"),
        *[F.conv(F.substring(digest, at, 15), 16, 10).cast("long").alias(name) for at, name in ((1, "a"), (17, "b"))],
        F.octet_length(text).cast("long").alias("bytes"),
    )
    numbered = line_numbers(stored(rows), ["conv_id", "turn", "role", "letters", "a", "b"], ["conv_id"], "pos")
    return numbered.select("conv_id", "pos", "a", "b", "bytes")


def with_heads(turns: DataFrame, family: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, and (conv_id, turns) of all of them.

    Conversation c gets the first h turns of conversation c - c % family in place of its
    own first h, with h = crc32(c) % most.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    sizes = stored(sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % family).alias("base")))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("own").alias("base_own"))
    convs = sizes.join(first, "base", "left").withColumn("head", F.least("h", F.coalesce("base_own", F.lit(0))))
    convs = stored(convs.select("conv_id", "base", "head", (F.col("head") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("turns")))
    # at most `family` conversations and `most` turns meet on a base
    heads = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")
    heads = convs.join(heads, "base").where("pos <= head").select(*turns.columns)
    tails = turns.where(F.col("pos") > h)
    # a shorter head moves the tail up; only such conversations are looked up
    shorter = convs.where(F.col("head") < h).select("conv_id", (h - F.col("head")).alias("_up"))
    asked = tails.join(shorter, "conv_id", "left_semi").groupBy("conv_id").agg(F.count("*").alias("_asks"))
    moved = looked_up(tails, shorter.join(asked, "conv_id"), "conv_id", "_asks", outer=True)
    tails = moved.withColumn("pos", F.col("pos") - F.coalesce("_up", F.lit(0))).select(*turns.columns)
    return heads.unionByName(tails), convs.select("conv_id", "turns")


def looked_up(rows: DataFrame, lookup: DataFrame, key: str, asks: str, outer: bool = False) -> DataFrame:
    """Rows joined with a frame of one row per key; ``asks`` says how many rows hold the key.

    Keys that hold more than their share of a quarter of a shuffle partition's rows are
    broadcast: there are at most HOT times the shuffle partitions of them.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = lookup.agg(F.sum(asks)).first()[0] or 0
    is_hot = F.col(asks) * HOT * tasks > max(total, 1_000_000)
    hot = lookup.where(is_hot).drop(asks)
    taken = rows.join(F.broadcast(hot), key)
    others = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    rest = others.join(lookup.where(~is_hot).drop(asks), key, "left" if outer else "inner")
    return taken.unionByName(rest)


def running(
    rows: DataFrame,
    key: str,
    order: str,
    folds: dict[str, Column],
    fold: Callable[[Column], Column],
    apply: Callable[[Column, Column], Column],
    backwards: bool = False,
) -> DataFrame:
    """Adds, per row, the fold over the rows of its key before it, in stretches of consecutive numbers.

    The stretches of a key are folded on their own, then their totals, one row each.
    """
    names = list(folds)
    by = F.col(order).desc() if backwards else F.col(order)
    rows = rows.withColumn("_stretch", F.floor(F.col(order) / STRETCH)).withColumns({f"_{n}": c for n, c in folds.items()})
    rows = rows.repartition(key, "_stretch")
    inside = Window.partitionBy(key, "_stretch").orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    nothing = F.lit(0).cast("long")
    out = rows.withColumns({n: F.coalesce(fold(F.col(f"_{n}")).over(inside), nothing) for n in names})
    # only keys of several stretches need what lies before a stretch
    several = (F.min("_stretch").over(Window.partitionBy(key)) < F.max("_stretch").over(Window.partitionBy(key)))
    totals = rows.groupBy(key, "_stretch").agg(*[fold(F.col(f"_{n}")).alias(f"_{n}") for n in names])
    totals = totals.withColumn("_several", several).where("_several")
    turn = F.col("_stretch").desc() if backwards else F.col("_stretch")
    between = Window.partitionBy(key).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "_stretch", *[F.coalesce(fold(F.col(f"_{n}")).over(between), nothing).alias(f"_before_{n}") for n in names])
    out = out.join(before, [key, "_stretch"], "left")
    out = out.withColumns({n: apply(F.col(n), F.coalesce(f"_before_{n}", nothing)) for n in names})
    return out.drop("_stretch", *[f"_{n}" for n in names], *[f"_before_{n}" for n in names])


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def blocks_of(turns: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, block, x, y, turns, n, px, py): digests of each block of turns and of all turns before it."""
    placed = turns.select(
        "conv_id",
        "pos",
        F.xxhash64("a", "b", "pos").alias("x"),
        F.xxhash64(F.lit("second"), "b", "pos", "a").alias("y"),
        "bytes",
    )
    blocks = placed.groupBy("conv_id", F.floor((F.col("pos") - 1) / size).alias("block")).agg(
        F.bit_xor("x").alias("x"),
        F.bit_xor("y").alias("y"),
        F.count("*").alias("n"),
        F.sort_array(F.collect_list(F.struct("pos", "x", "y", "bytes"))).alias("turns"),  # at most `size`
    )
    return running(blocks, "conv_id", "block", {"px": F.col("x"), "py": F.col("y")}, F.bit_xor, _xor)


def nodes_of(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """(x, y, depth, conv_id, n_convs, bytes, px, py): every node, its digest and its parent's."""
    start = ["px", "py", "block"]
    groups = blocks.groupBy(*start, "x", "y", "n").agg(
        F.count("*").alias("members"), F.min("conv_id").alias("conv_id"), F.first("turns").alias("turns")
    )
    groups = stored(groups.select(F.struct(*start).alias("start"), "members", "conv_id", "turns"))
    siblings = groups.groupBy("start").agg(
        F.count("*").alias("siblings"), F.first(F.struct("members", "conv_id", "turns")).alias("only")
    )
    siblings = stored(siblings.withColumn("only", F.when(F.col("siblings") == 1, F.col("only"))))
    chains = _turn_by_turn(siblings.where("siblings = 1").select("start", "only.*"))
    meeting = looked_up(groups, siblings.where("siblings > 1").select("start", "siblings"), "start", "siblings")
    parted = _turn_by_turn(meeting).groupBy("x", "y", "depth").agg(
        F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"),
        *[F.first(name).alias(name) for name in ("bytes", "px", "py")],
    )
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = root.select(
        zero.alias("x"), zero.alias("y"), zero.alias("depth"), "conv_id", "n_convs", zero.alias("bytes"), none.alias("px"), none.alias("py")
    )
    return chains.unionByName(parted).unionByName(root)


def _turn_by_turn(groups: DataFrame) -> DataFrame:
    """The nodes along each group's turns."""

    def upto(name: str, count: Column) -> Column:
        some = F.slice(F.col("turns"), F.lit(1), count)
        return F.aggregate(some, F.col(f"start.p{name}"), lambda all_, t: _xor(all_, t[name]))

    along = F.transform(
        F.col("turns"),
        lambda t, i: F.struct(
            upto("x", i + 1).alias("x"),
            upto("y", i + 1).alias("y"),
            t["pos"].cast("long").alias("depth"),
            t["bytes"].alias("bytes"),
            upto("x", i).alias("px"),
            upto("y", i).alias("py"),
        ),
    )
    return groups.select("conv_id", F.col("members").alias("n_convs"), F.inline(along))


def chain_totals(chains: DataFrame) -> DataFrame:
    """(conv_id, parent, at, leaves, saved): totals of each chain and of all that hang on it.

    ``chains`` holds conv_id, parent (null for one), at, and the chain's own leaves and saved.
    A round adds what hangs at a distance that doubles.
    """
    state = stored(chains.withColumn("pointer", F.col("parent")))
    while state.where("pointer is not null").limit(1).count():
        sums = state.where("pointer is not null").groupBy(F.col("pointer").alias("conv_id")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"), F.count("*").alias("asks")
        )
        added = state.join(sums, "conv_id", "left").withColumns({
            "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0)),
            "saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
        })
        added = stored(added.drop("more_leaves", "more_saved"))
        ahead = added.where("asks > 0").select(F.col("conv_id").alias("pointer"), F.col("pointer").alias("next"), "asks")
        moved = looked_up(added.where("pointer is not null").drop("asks"), ahead, "pointer", "asks")
        moved = moved.withColumn("pointer", F.col("next")).drop("next")
        state = stored(moved.unionByName(added.where("pointer is null").drop("asks")))
    return state.drop("pointer")


def ends_of(blocks: DataFrame, convs: DataFrame) -> DataFrame:
    """(x, y, ends_sha256): SHA-256 of the ids, ascending and joined by commas, that end at a node."""
    ends = blocks.groupBy("conv_id").agg(F.bit_xor("x").alias("x"), F.bit_xor("y").alias("y"))
    zero = F.lit(0).cast("long")
    ends = ends.unionByName(convs.where("turns = 0").select("conv_id", zero.alias("x"), zero.alias("y")))
    schema = T.StructType([field("x", "long"), field("y", "long"), field("ends_sha256", "string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest, done = None, None, []
        for batch in batches:
            for x, y, conv_id in zip(*[c.to_pylist() for c in batch.columns]):
                if (x, y) == node:
                    digest.update(b",%d" % conv_id)
                else:
                    if node:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (x, y), hashlib.sha256(b"%d" % conv_id)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=schema.names)
                done = []
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v]) for v in (*node, digest.hexdigest())], names=schema.names)

    sorted_ends = ends.select("x", "y", "conv_id").repartition("x", "y").sortWithinPartitions("x", "y", "conv_id")
    return sorted_ends.mapInArrow(run, schema)


def prefix_trie(turns: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` holds conv_id, pos from 1, the digest (a, b) and bytes; ``convs`` all
    conversations with the number of their turns. conv_id and depth name a node.
    """
    blocks = stored(blocks_of(turns, block))
    nodes = stored(nodes_of(blocks, convs))
    children = nodes.where("px is not null").groupBy(F.col("px").alias("x"), F.col("py").alias("y"))
    children = children.agg(F.count("*").alias("n_children"))
    nodes = stored(nodes.join(children, ["x", "y"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))))
    own_saved = (F.col("n_convs") - 1) * F.col("bytes")
    is_leaf = (F.col("n_children") == 0).cast("long")
    chains = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"),
        F.min_by(F.struct("px", "py"), "depth").alias("above"),
        F.sum(is_leaf).alias("leaves"),
        F.sum(own_saved).alias("saved"),
    )
    chains = stored(chains)
    above = nodes.where("n_children > 0").select(F.struct(F.col("x").alias("px"), F.col("y").alias("py")).alias("above"),
                                                 F.col("conv_id").alias("parent"), F.col("n_children").alias("asks"))
    hung = looked_up(chains.where("above.px is not null"), above, "above", "asks")
    root = chains.where("above.px is null").withColumn("parent", F.lit(None).cast("long"))
    totals = chain_totals(hung.unionByName(root).select("conv_id", "parent", "top", "leaves", "saved"))
    totals = stored(totals)
    hanging = totals.where("parent is not null").groupBy(F.col("parent").alias("conv_id"), (F.col("top") - 1).alias("depth"))
    hanging = hanging.agg(F.sum("leaves").alias("h_leaves"), F.sum("saved").alias("h_saved"))
    tops = totals.select("conv_id", F.col("top").alias("depth"), F.struct("parent").alias("up"))
    here = nodes.join(hanging, ["conv_id", "depth"], "left").join(tops, ["conv_id", "depth"], "left")
    here = here.withColumns({
        "at_leaves": is_leaf + F.coalesce("h_leaves", F.lit(0)),
        "at_saved": own_saved + F.coalesce("h_saved", F.lit(0)),
    })
    below = {"d_leaves": F.col("at_leaves"), "d_saved": F.col("at_saved")}
    summed = running(here, "conv_id", "depth", below, F.sum, lambda a, b: a + b, backwards=True)
    ended = summed.join(ends_of(blocks, convs), ["x", "y"], "left")
    return ended.select(
        "conv_id",
        "depth",
        F.when(F.col("up").isNotNull(), F.col("up.parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        (F.col("at_leaves") + F.col("d_leaves")).alias("n_leaves"),
        (F.col("at_saved") + F.col("d_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def rebuilt_trie(conversations: DataFrame, family: int = 5, most: int = 9) -> DataFrame:
    """The trie of conversations that start with the first turns of their family's first one."""
    turns, convs = with_heads(stored(ordered(conversations)), family, most)
    return prefix_trie(turns, convs)
