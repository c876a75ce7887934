"""Prefix trie of conversations as a distributed burst trie.

A node is a distinct sequence of first turns; a turn is its role and text.  Its id is a pair of 64-bit hashes of role, text and place, a prefix is named by
the xor of its turns' ids, so every task names a node alike.  Conversations are cut into pieces of ``PIECE`` turns, so no row holds an unbounded one.

1. A container holds the distinct pieces (suffixes) below one trie head: the prefix before them.  Copies are one suffix with a number of members.
2. A container of more than ``LIMIT`` suffixes bursts: each goes to the container of its next turn id, whose head becomes a node.  Rounds
   go on until none is too large, ``PIECE`` at most.
3. Containers are sorted and swept: a stack holds the path of the suffix at hand; a node leaves it with its members, smallest member, leaves and saved tokens.
4. What containers found goes up: to burst heads by the heads each suffix left above it; to the earlier pieces of long conversations by what
   each of them has in later pieces (a conversation saves the bytes of the turns whose node a smaller conversation names; it adds a leaf if it names one).

Numbers of conversations and turns of one conversation are bounded nowhere: copies are summed before the shuffle, a hot first turn bursts, a hot
conversation is numbered by ranges (``operators.skew``), member ids are hashed as a sorted stream.

Defined cases: a null conversation id is no conversation; turns sort by turn (null first), then role and text; a null role or text is empty; repeated rows are
turns of their own; an empty table gives no rows, not even a root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.operators.skew import number_within, running
from rankspark.session import pin

#: Turns of a piece.
PIECE = 64
#: Suffixes of a container that does not burst.
LIMIT = 4096


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, x, y, bytes) of every turn: x and y identify role and text."""
    rows = conversations.select(F.col(f"`{conv_id}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"),
                                F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("conv is not null")
    placed = number_within(rows, ["conv"], [F.col("turn").asc_nulls_first(), "role", "text"], "pos", counted=rows.select("conv"))
    return placed.select("conv", (F.col("pos") + 1).alias("pos"), F.xxhash64(F.lit(1), "role", "text").alias("x"),
                         F.xxhash64(F.lit(2), "role", "text").alias("y"), F.octet_length("text").cast("long").alias("bytes"))


def _swept(containers: DataFrame) -> DataFrame:
    """Nodes below the heads of ``containers``, and per container a row of its totals (``top``).

    Input: hx, hy (head), k (piece), depth, at (turns of the items that the head holds), items (x, y, bytes), low, members, more (members with later pieces), above.
    """
    out = ("x long, y long, px long, py long, depth long, bytes long, conv long, members long, leaves long, saved long, leaf boolean, "
           "top boolean, above array<struct<x:long,y:long>>")

    def sweep(batches: Iterator) -> Iterator:
        import pyarrow as pa
        names = ["x", "y", "px", "py", "depth", "bytes", "conv", "members", "leaves", "saved", "leaf", "top", "above"]
        types = [pa.int64()] * 10 + [pa.bool_(), pa.bool_(), pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))]
        made: list[tuple] = []
        head, above = None, None
        # open nodes: [turn id, x, y, bytes, smallest member, members, leaves, saved, has children, members with later pieces]
        stack: list[list] = []

        def close() -> None:
            _, x, y, size, low, members, leaves, saved, inner, more = stack.pop()
            leaf = not inner and not more
            saved += (members - 1) * size if stack else 0
            if not stack:
                made.append((x, y, None, None, depth, 0, low, members, leaves + leaf, saved, leaf, True, above))
                return
            up = stack[-1]
            made.append((x, y, up[1], up[2], depth + len(stack), size, low, members, leaves + leaf, saved, leaf, False, None))
            up[4], up[5], up[6], up[7], up[8] = min(up[4], low), up[5] + members, up[6] + leaves + leaf, up[7] + saved, True

        def packed() -> pa.RecordBatch:
            cols = list(zip(*made, strict=True)) if made else [[]] * len(names)
            made.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)
        depth = 0
        for batch in batches:
            col = {n: batch.column(n) for n in batch.schema.names}
            plain = {n: col[n].to_pylist() for n in ("hx", "hy", "k", "depth", "at", "low", "members", "more")}
            items, bounds = col["items"].flatten(), col["items"].offsets.to_pylist()
            xs, ys, sizes = (items.field(k).to_pylist() for k in range(3))
            for r in range(batch.num_rows):
                own, at = (plain["hx"][r], plain["hy"][r], plain["k"][r]), plain["at"][r]
                if own != head:
                    while stack:
                        close()
                    head, above, depth = own, col["above"][r].as_py(), plain["depth"][r]
                    stack.append([None, own[0], own[1], 0, plain["low"][r], 0, 0, 0, False, 0])
                a, b = bounds[r] - bounds[0] + at, bounds[r + 1] - bounds[0]
                path = list(zip(xs[a:b], ys[a:b], strict=True))
                shared = 0
                while shared < len(path) and shared + 1 < len(stack) and stack[shared + 1][0] == path[shared]:
                    shared += 1
                while len(stack) > shared + 1:
                    close()
                for k in range(shared, len(path)):
                    up = stack[-1]
                    stack.append([path[k], up[1] ^ path[k][0], up[2] ^ path[k][1], sizes[a + k], plain["low"][r], 0, 0, 0, False, 0])
                end = stack[-1]
                end[4], end[5], end[9] = min(end[4], plain["low"][r]), end[5] + plain["members"][r], end[9] + plain["more"][r]
            if len(made) > 10_000:
                yield packed()
        while stack:
            close()
        yield packed()

    dealt = containers.repartition("hx", "hy").sortWithinPartitions("hx", "hy", "k", "items")
    return dealt.mapInArrow(sweep, out)


def _burst(suffixes: DataFrame, limit: int, piece: int) -> tuple[DataFrame, DataFrame | None]:
    """Containers of at most ``limit`` suffixes, and the heads made on the way (None if no container was too large)."""
    done, heads, open_ = [], [], suffixes
    for _ in range(piece + 1):
        large = pin(open_.groupBy("hx", "hy", "k").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("hx", "hy", "k"), "large")
        if large.isEmpty():
            break
        done.append(open_.join(large, ["hx", "hy", "k"], "left_anti"))
        item = F.col("items")[F.col("at")]
        # one suffix of a container at most has no turn left: it ends at the head, which has counted it and has children
        next_ = open_.join(large, ["hx", "hy", "k"], "left_semi").where(F.col("at") < F.size("items")).withColumns({
            "px": F.col("hx"), "py": F.col("hy"), "hx": F.col("hx").bitwiseXOR(item["x"]), "hy": F.col("hy").bitwiseXOR(item["y"]),
            "depth": F.col("depth") + 1, "bytes": item["bytes"], "at": F.col("at") + 1})
        own = F.struct(F.col("hx").alias("x"), F.col("hy").alias("y"))
        moved = pin(next_.withColumn("above", F.concat("above", F.array(own))), "burst")
        heads.append(moved.groupBy("hx", "hy", "px", "py", "depth", "bytes").agg(F.min("low").alias("conv"), F.sum("members").alias("members"), F.first("above").alias("above")))
        open_ = moved.drop("px", "py", "bytes")
    done.append(open_)
    return reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, heads) if heads else None


def turn_trie(turns: DataFrame, conversations: DataFrame, limit: int = LIMIT, piece: int = PIECE) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: conv, pos (gapless from 1), x, y (identify the turn), bytes; ``conversations``: conv, all of them, also those without turns.
    """
    at = F.col("pos")
    turns = turns.select("conv", "pos", F.floor((at - 1) / piece).alias("k"), F.xxhash64("x", "pos").alias("x"), F.xxhash64("y", "pos", F.lit(3)).alias("y"), "bytes")
    pieces = pin(turns.groupBy("conv", "k").agg(  # at most ``piece`` turns
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "x", "y", "bytes"))), lambda t: F.struct(t["x"], t["y"], t["bytes"])).alias("items"),
        F.bit_xor("x").alias("dx"), F.bit_xor("y").alias("dy"), F.sum("bytes").alias("total")), "pieces")
    lasts = pieces.groupBy("conv").agg(F.max("k").alias("last"))
    alone = pieces.join(pin(lasts.where("last > 0"), "long"), "conv", "left")
    first = alone.where("last is null").withColumns({"hx": F.lit(0).cast("long"), "hy": F.lit(0).cast("long"), "last": F.lit(0).cast("long")})
    long = alone.where("last is not null")
    for d in "xy":
        long = running(long, ["conv"], ["k"], f"d{d}", "xor", f"e{d}").withColumn(f"h{d}", F.col(f"e{d}").bitwiseXOR(F.col(f"d{d}"))).drop(f"e{d}")
    no_items = F.array().cast("array<struct<x:long,y:long,bytes:long>>")
    none = conversations.select("conv").distinct().join(lasts.select("conv"), "conv", "left_anti").select(
        "conv", F.lit(0).cast("long").alias("k"), no_items.alias("items"), *[F.lit(0).cast("long").alias(c) for c in ("dx", "dy", "total", "last", "hx", "hy")])
    own = first.unionByName(long).unionByName(none, allowMissingColumns=True)
    own = pin(own.withColumns({"ex": F.col("hx").bitwiseXOR(F.col("dx")), "ey": F.col("hy").bitwiseXOR(F.col("dy"))}), "paths")
    root = F.struct(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"))
    suffixes = (own.groupBy("hx", "hy", "k", "ex", "ey").agg(F.min("conv").alias("low"), F.count("*").alias("members"), F.count_if(F.col("k") < F.col("last")).alias("more"),
                                                             F.first("items").alias("items"))
                .select("hx", "hy", "k", (F.col("k") * piece).alias("depth"), F.lit(0).alias("at"), "items", "low", "members", "more",
                        F.when(F.col("k") == 0, F.array(root)).otherwise(F.array().cast("array<struct<x:long,y:long>>")).alias("above")))
    containers, heads = _burst(pin(suffixes, "suffixes"), limit, piece)
    swept = pin(_swept(containers), "swept")
    below = swept.where("not top")
    base = own.where("k = 0").agg(F.min("conv").alias("conv"), F.count("*").alias("members")).where("members > 0")
    no = lambda kind: F.lit(None).cast(kind)
    base = base.select(F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), no("long").alias("px"), no("long").alias("py"), F.lit(0).cast("long").alias("depth"),
                       F.lit(0).cast("long").alias("bytes"), "conv", "members", F.array(root).alias("above"))
    tops = base if heads is None else base.unionByName(heads.withColumnsRenamed({"hx": "x", "hy": "y"}))
    tops = pin(tops, "heads")
    # what containers and heads hold goes to every head above
    up = swept.where("top").select(F.explode("above").alias("h"), "leaves", "saved").unionByName(
        tops.select(F.explode("above").alias("h"), F.lit(0).cast("long").alias("leaves"), ((F.col("members") - 1) * F.col("bytes")).alias("saved")))
    sums = up.groupBy(F.col("h.x").alias("x"), F.col("h.y").alias("y")).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    fields = ["x", "y", "px", "py", "depth", "bytes", "conv", "members", "leaves", "saved"]
    nodes = pin(below.select(*fields).unionByName(tops.join(sums, ["x", "y"]).select(*fields)), "nodes")
    nodes = _with_later_pieces(nodes, own, piece)
    kids = nodes.where("px is not null").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"))
    parents = nodes.select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv").alias("parent_conv_id"))
    ends = own.where("k = last").select(F.col("ex").alias("x"), F.col("ey").alias("y"), "conv")
    return (nodes.join(parents, ["px", "py"], "left").join(kids, ["x", "y"], "left").join(_member_digests(ends), ["x", "y"], "left")
            .select(F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("members").alias("n_convs"), F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
                    F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("ends_sha256")))


def _with_later_pieces(nodes: DataFrame, own: DataFrame, piece: int) -> DataFrame:
    """``nodes`` with the leaves and saved tokens that conversations of several pieces have in pieces below a node's."""
    many = pin(own.where("last > 0").select("conv", "k", "last", "total", "items", "hx", "hy", "ex", "ey"), "many")
    if many.isEmpty():
        return nodes
    named = nodes.where("depth > 0").groupBy("conv", F.floor((F.col("depth") - 1) / piece).alias("k")).agg(F.sum("bytes").alias("named"))
    inner = nodes.where("px is not null").select(F.col("px").alias("ex"), F.col("py").alias("ey")).distinct()
    tips = many.where("k = last").join(inner, ["ex", "ey"], "left_anti").select("conv", "ex", "ey")
    leaf = tips.join(nodes.select("conv", F.col("x").alias("ex"), F.col("y").alias("ey")), ["conv", "ex", "ey"]).select("conv", F.lit(1).cast("long").alias("leaf"))
    each = many.join(named, ["conv", "k"], "left").withColumn("foreign", F.col("total") - F.coalesce("named", F.lit(0)))
    summed = running(each, ["conv"], [F.desc("k")], "foreign", "sum", "upto").join(leaf, "conv", "left")
    later = summed.where("k < last").select(F.explode(_prefixes("hx", "hy", "items", F.col("k") == 0)).alias("n"), (F.col("upto") - F.col("foreign")).alias("more_saved"),
                                            F.coalesce("leaf", F.lit(0).cast("long")).alias("more_leaves"))
    more = later.groupBy(F.col("n.x").alias("x"), F.col("n.y").alias("y")).agg(F.sum("more_saved").alias("more_saved"), F.sum("more_leaves").alias("more_leaves"))
    return pin(nodes.join(more, ["x", "y"], "left").withColumns({"saved": F.col("saved") + F.coalesce("more_saved", F.lit(0)),
                                                                 "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0))}).drop("more_saved", "more_leaves"), "nodes")


def _prefixes(x: str, y: str, items: str, with_head: Column) -> Column:
    """Names of the prefixes that end within a piece (at most PIECE), and of its head if asked for."""
    start = F.array(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))

    def step(names: Column, item: Column) -> Column:
        last = F.element_at(names, -1)
        return F.concat(names, F.array(F.struct(last["x"].bitwiseXOR(item["x"]).alias("x"), last["y"].bitwiseXOR(item["y"]).alias("y"))))
    names = F.aggregate(items, start, step)
    return F.when(with_head, names).otherwise(F.slice(names, F.lit(2), F.size(items)))


def _member_digests(ends: DataFrame) -> DataFrame:
    """(x, y, digest): SHA-256 of the ids of the conversations that end at a node, hashed as they stream by in order."""
    def stream(batches: Iterator) -> Iterator:
        import pyarrow as pa
        key, state, made = None, None, []
        for batch in batches:
            for x, y, conv in zip(*[batch.column(c).to_pylist() for c in ("x", "y", "conv")], strict=True):
                if (x, y) != key:
                    if state:
                        made.append((*key, state.hexdigest()))
                    key, state = (x, y), hashlib.sha256(str(conv).encode())
                else:
                    state.update(f",{conv}".encode())
            if len(made) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["x", "y", "digest"])
                made = []
        if state:
            made.append((*key, state.hexdigest()))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made, strict=True)], ["x", "y", "digest"])
    return ends.repartition("x", "y").sortWithinPartitions("x", "y", "conv").mapInArrow(stream, "x long, y long, digest string")
