"""Prefix trie of conversations: blocks of turns are hashed and grouped first, single turns only where siblings diverge."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Turns in a block.
BLOCK = 4
#: Blocks of one conversation whose running sums are made in one group.
SPAN = 4096
#: Conversations whose first turns are taken from the first of them.
FAMILY, HEADS = 100, 6
#: Conversation numbers in one piece of the list of those that end at a node.
PIECE = 4096


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, place of the turn in it from 1, digest and code points of the turn.

    Places are found by ranges of (conversation, turn), so a conversation with a third of all turns has many tasks; texts
    are read once and stay where they are. Turns with the same number (nulls first) lie by role, then by digest.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256))
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn"), role.alias("role"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    order = ["c", F.col("turn").asc_nulls_first(), "role", "digest", F.col("_row")]
    placed = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = common.materialise(placed.select("c", "digest", "chars", F.monotonically_increasing_id().alias("_row")), "turns").withColumn("_part", F.shiftright("_row", 33))
    runs = placed.groupBy("c", "_part").agg(F.count(F.lit(1)).alias("n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = runs.select("c", "_part", (before - F.col("_first") + 1).alias("_shift"))
    return placed.join(runs.hint("merge"), ["c", "_part"]).select("c", (F.col("_row") + F.col("_shift")).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame) -> DataFrame:
    """The turns of each conversation c after its first ones are those of c - c % FAMILY: c, depth, digest, chars."""
    base, heads = F.col("c") - F.col("c") % FAMILY, F.crc32(F.col("c").cast("string")) % HEADS
    first = turns.filter((F.col("c") % FAMILY == 0) & (F.col("place") < HEADS)).select(F.col("c").alias("base"), "place", "digest", "chars")
    convs = turns.select("c").distinct().select("c", base.alias("base"), heads.alias("h"))
    taken = convs.join(first, "base").filter("place <= h").select("c", F.col("place").alias("depth"), "digest", "chars")
    own = turns.withColumns({"base": base, "h": heads})
    families = own.groupBy("base").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(F.col("c") == F.col("base"), F.col("place"))), F.lit(0)).alias("size"))
    own = common.join_groups(own.filter("place > h"), common.materialise(families, "families"), ["base"], "n")
    depth = F.col("place") - F.col("h") + F.least("h", "size")
    return taken.unionByName(own.select("c", depth.alias("depth"), "digest", "chars"))


def _mix(*columns: str) -> list[Column]:
    """128 bits of the values."""
    return [F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("second"), *columns).alias("y")]


def blocks(turns: DataFrame, size: int) -> DataFrame:
    """Of each conversation and block of ``size`` turns: its turns with the hashes up to each from the block's start, and of all
    turns before the block: their hash (qx, qy) and code points (qz). px, py, pz: the same with the block.

    A turn's hash takes in its depth, and those of a prefix are joined by exclusive or, so prefixes are summed in any
    order: within SPAN blocks, and over the spans.
    """
    hashed = turns.select("c", "depth", *_mix("depth", "digest"), "chars")
    own = hashed.groupBy("c", F.floor((F.col("depth") - 1) / size).alias("k")).agg(
        F.sort_array(F.collect_list(F.struct("depth", "x", "y", "chars"))).alias("turns"), F.bit_xor("x").alias("bx"), F.bit_xor("y").alias("by"), F.sum("chars").alias("bz")
    )  # at most ``size`` turns in a block
    own = common.materialise(own.withColumn("span", F.floor(F.col("k") / SPAN)), "blocks")
    earlier = lambda w, s: [F.coalesce(F.bit_xor(f"{s}x").over(w), F.lit(0)), F.coalesce(F.bit_xor(f"{s}y").over(w), F.lit(0)), F.coalesce(F.sum(f"{s}z").over(w), F.lit(0))]
    named = lambda names, columns: [c.alias(n) for n, c in zip(names, columns)]
    spans = own.groupBy("c", "span").agg(F.bit_xor("bx").alias("sx"), F.bit_xor("by").alias("sy"), F.sum("bz").alias("sz"))
    spans = spans.select("c", "span", *named(["ax", "ay", "az"], earlier(W.partitionBy("c").orderBy("span").rowsBetween(W.unboundedPreceding, -1), "s")))
    within = W.partitionBy("c", "span").orderBy("k").rowsBetween(W.unboundedPreceding, -1)
    out = own.select("*", *named(["ix", "iy", "iz"], earlier(within, "b"))).join(spans.hint("merge"), ["c", "span"])
    out = out.select("c", "k", "turns", "bx", "by", "bz", F.col("ax").bitwiseXOR(F.col("ix")).alias("qx"), F.col("ay").bitwiseXOR(F.col("iy")).alias("qy"), (F.col("az") + F.col("iz")).alias("qz"))
    out = out.select("c", "k", "turns", "qx", "qy", "qz", F.col("qx").bitwiseXOR(F.col("bx")).alias("px"), F.col("qy").bitwiseXOR(F.col("by")).alias("py"), (F.col("qz") + F.col("bz")).alias("pz"))
    return common.materialise(out, "prefixes")


def groups(rows: DataFrame) -> DataFrame:
    """Conversations with the same turns before a block, and if their blocks differ: then siblings diverge inside it."""
    return rows.groupBy("k", "qx", "qy").agg(F.count(F.lit(1)).alias("m"), F.min("c").alias("least"), ((F.min("px") != F.max("px")) | (F.min("py") != F.max("py"))).alias("diverges"))


def turn_prefixes(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each turn of the blocks: depth, its prefix (x, y) and the one before it (qx, qy), code points of the turn and before it (zp)."""
    upto = lambda n, c: F.aggregate(F.slice("turns", 1, n), F.col(f"q{c}"), lambda a, t: a.bitwiseXOR(t[c]))
    before = lambda n: F.aggregate(F.slice("turns", 1, n), F.col("qz"), lambda a, t: a + t["chars"])
    node = lambda t, i: F.struct(t["depth"].alias("depth"), upto(i + 1, "x").alias("x"), upto(i + 1, "y").alias("y"), upto(i, "x").alias("qx"), upto(i, "y").alias("qy"), t["chars"].alias("chars"), before(i).alias("zp"))
    return rows.select(*more, F.explode(F.transform("turns", node)).alias("t")).select(*more, "t.*")


NODE = ["depth", "x", "y"]


def nodes_of(marked: DataFrame, sums: dict[str, Column]) -> DataFrame:
    """Each node with its members' count and least, and the ``sums`` over its members of columns of ``marked``.

    Where siblings diverge inside a block, its turns are grouped one by one; where they don't, every turn of the block has the
    members of the block, so those of the least member stand for all.
    """
    totals = [f(name).alias(name) for name, f in sums.items()]
    same = F.first("qx").alias("qx"), F.first("qy").alias("qy"), F.first("chars").alias("chars"), F.first("zp").alias("zp")
    split = turn_prefixes(marked.filter("diverges"), "c", *sums).groupBy(*NODE).agg(*same, F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), *totals)
    whole = marked.filter("NOT diverges")
    joint = whole.groupBy("k", "qx", "qy").agg(F.count(F.lit(1)).alias("n_convs"), F.min_by(F.struct("turns", "qz"), "c").alias("own"), F.min("c").alias("conv_id"), *totals)
    joint = turn_prefixes(joint.withColumns({"turns": F.col("own.turns"), "qz": F.col("own.qz")}), "n_convs", "conv_id", *sums)
    return split.unionByName(joint.select(*split.columns))


def ends(last: DataFrame) -> DataFrame:
    """The digest of the ascending numbers of the conversations that end at each node, where several do.

    A node's numbers are joined in pieces of PIECE numbers, wherever they lie; a node's pieces then pass one task in
    order, which holds one piece at a time: the digest of a list has to be made from its start.
    """
    several = common.materialise(last.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "several")
    part = F.floor(F.col("c") / PIECE).alias("part")
    pieces = common.join_groups(last, several, NODE, "n").groupBy(*NODE, part).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list("c")), lambda c: c.cast("string"))).alias("piece"))
    schema = pa.schema([("depth", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("ends_sha256", pa.string())])

    def run(stream):
        node, state = None, None
        for batch in stream:
            out = []
            for depth, x, y, piece in zip(*(c.to_pylist() for c in batch.columns)):
                if (depth, x, y) != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = (depth, x, y), sha256(piece.encode())
                else:
                    state.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out) if out else [[]] * 4, schema.types)], schema=schema)
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*node, state.hexdigest()), schema.types)], schema=schema)

    ordered = pieces.repartition(*NODE).sortWithinPartitions(*NODE, "part").select(*NODE, "piece")
    return ordered.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int | None = None) -> DataFrame:
    """A row for each node of the trie of the rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Blocks of turns are hashed with all that comes before them, so conversations are grouped by their successive blocks
    at once; a block's turns are grouped one by one only where the members of its group diverge inside it. What a subtree sums
    up is a sum over its top's members, so no node is carried to all its ancestors: leaves are the members that stand for
    a leaf, and a member saves the turns up to the depth from which it is the least of its node.

    Null roles and texts are empty, null turns come first, turns with one number lie by role and the SHA-256 of role and
    text, repeated rows are turns each; c % FAMILY has the sign of c, as in SQL. Rows without a conv_id are left out. A conversation that is rebuilt without turns is a
    member of the root alone. No conversations: no rows. Other columns are ignored.

    Texts are read once and never moved; a third of all rows in one conversation is spread by ranges of its turns, a third of
    all conversations in one node by partial sums; rows of the largest conversations and nodes stay in place in joins.
    """
    since = common.mark()
    turns = numbered(conversations)
    convs = turns.select("c").distinct()
    rows = blocks(rebuilt(turns), block or BLOCK)
    marked = common.materialise(common.join_groups(rows, common.materialise(groups(rows), "groups"), ["k", "qx", "qy"], "m"), "marked")
    found = common.materialise(nodes_of(marked, {}), "nodes")

    zero = F.lit(0).cast("long")
    end = F.struct(F.array_max("turns")["depth"].alias("depth"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("pz").alias("z"))
    last = marked.groupBy("c").agg(F.max_by(end, "k").alias("end"), F.count(F.lit(1)).alias("n_blocks"))
    least = found.groupBy(F.col("conv_id").alias("c")).agg(F.min_by("zp", "depth").alias("zr"), F.count(F.lit(1)).alias("n_nodes"))  # zr: what comes before the first node that c is the least of
    children = found.groupBy((F.col("depth") - 1).alias("depth"), F.col("qx").alias("x"), F.col("qy").alias("y")).agg(F.count(F.lit(1)).alias("n_children"))
    leaves = found.join(children.hint("merge"), NODE, "left_anti").select(F.col("conv_id").alias("c"), F.lit(1).cast("long").alias("leaf"))
    members = convs.join(last.hint("merge"), "c", "left").join(least.hint("merge"), "c", "left").join(leaves.hint("merge"), "c", "left")
    filled = [F.coalesce(n, zero).alias(n) for n in ("leaf", "n_blocks", "n_nodes")]
    members = common.materialise(members.select("c", "end", F.coalesce("zr", "end.z", zero).alias("zr"), *filled), "members")

    summed = common.join_groups(marked, members.select("c", "zr", "leaf", "n_blocks"), ["c"], "n_blocks")
    nodes = common.join_groups(nodes_of(summed, {"zr": F.sum, "leaf": F.sum}), members.select(F.col("c").alias("conv_id"), F.col("zr").alias("own"), "n_nodes"), ["conv_id"], "n_nodes")
    saved = F.col("zr") - F.col("own") - (F.col("n_convs") - 1) * F.col("zp")
    nodes = nodes.select(*NODE, "qx", "qy", "conv_id", "n_convs", F.col("leaf").alias("n_leaves"), saved.alias("saved_tokens"))
    root = members.agg(F.min("c").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.greatest(F.sum("leaf"), F.lit(1)).alias("n_leaves"), F.sum("zr").alias("saved_tokens")).filter("n_convs > 0")
    nodes = nodes.unionByName(root.select(*[zero.alias(c) for c in (*NODE, "qx", "qy")], "conv_id", "n_convs", "n_leaves", "saved_tokens"))
    nodes = common.materialise(nodes.join(children.hint("merge"), NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "nodes")

    parents = nodes.filter("n_children > 0").select((F.col("depth") + 1).alias("depth"), F.col("x").alias("qx"), F.col("y").alias("qy"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("_n"))
    stops = common.materialise(members.select("c", F.coalesce("end.depth", zero).alias("depth"), F.coalesce("end.x", zero).alias("x"), F.coalesce("end.y", zero).alias("y")), "stops")
    counted = stops.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_ends"), F.min("c").alias("end"))
    out = common.join_groups(nodes, parents, ["depth", "qx", "qy"], "_n", "left").join(counted.hint("merge"), NODE, "left").join(ends(stops).hint("merge"), NODE, "left")
    alone = F.sha2(F.coalesce(F.col("end").cast("string"), F.lit("")), 256)
    digest = F.when(F.col("n_ends") > 1, F.col("ends_sha256")).otherwise(alone)
    return common.sweep(since, out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", digest.alias("ends_sha256")))
