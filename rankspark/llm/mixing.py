"""Mixing sources to target weights, with DataFrame functions only.

Tokens of a source are packed, document after document, into blocks of ``block`` tokens; the last one of a source may be shorter.
A source takes as many tokens as its target says: whole passes over all its blocks, then a part of a pass.  Each pass is cut into slots of one block.
The number of slots of each source in each output shard is a multinomial draw (each slot draws its shard by hash), given
the source's total, so totals meet the targets while shards vary as a draw does.  Slot numbers of a source run through its shards; slot i
of a pass reads block p(i), where p is the source's own pseudorandom permutation of its full blocks, and the short block comes last.
Slots and blocks are joined by (source, block).

Targets: weights repeat over the sources in code point order (null last); sources share ``share`` times all tokens by
weight; no target exceeds ``most`` times its source's tokens, the excess is shared again by weight.  The level at which that ends has
a closed form over the sources sorted by capacity per weight.

A document's place in its source comes from sums over ``CHUNKS`` hashed chunks and a running sum within a chunk, so a source
with a third of all rows is no task of its own.

Defined cases: a null or empty text has no tokens and nothing is taken of it; a null source is a source of its own, the last; repeated
rows are documents of their own; documents sort by chunk of the id, id, size; an empty table gives no rows; extra columns pass through when named in ``keep``
(all by default), but one named like a result is replaced by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.session import pin

TOKEN = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BLOCK = 64
SHARDS = 64
SEED = "mix"
RESULTS = ("size", "source_size", "target", "taken")
#: Hashed parts of a source in which tokens are summed side by side (three hex digits).
CHUNKS = 4096
#: Slots that one row stands for before it is exploded.
RANGE = 4096
#: Slots that a task enumerates.
TASK_SLOTS = 250_000
#: A table of so many sources at most is broadcast.
FEW_SOURCES = 10_000
#: Four primes; a block count below 10^24 is divisible by three of them at most.
PRIMES = (1000003, 1000033, 1000037, 1000039)


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, s, source_size, target, want): s numbers the sources, want is the target in whole tokens.  The windows see one row per source."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name, every = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    own = (totals.withColumn("s", F.row_number().over(by_name)).withColumn("cap", F.col("source_size") * most)
           .withColumn("w", F.element_at(F.lit(list(weights)), F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1))
           .withColumn("all_tokens", F.sum("source_size").over(every) * F.lit(share)).withColumn("all_weights", F.sum("w").over(every)))
    own = own.withColumn("ratio", F.col("cap") / F.col("w"))
    before = Window.orderBy("ratio", "s").rowsBetween(Window.unboundedPreceding, -1)
    filled, used = F.coalesce(F.sum("cap").over(before), F.lit(0)), F.coalesce(F.sum("w").over(before), F.lit(0))
    own = own.withColumn("level", (F.col("all_tokens") - filled) / (F.col("all_weights") - used))
    # full sources come first in this order; the level of the first that is not full holds for all the rest
    level = F.max(F.when(F.col("ratio") > F.col("level"), F.col("level"))).over(every)
    target = F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("w") * level)
    return (own.withColumn("target", target).withColumn("want", F.floor(F.col("target") + 0.5))
            .select("source", "s", "source_size", "target", "want"))


def _number(*parts: Column) -> Column:
    """Eight hex digits of a hash of the parts, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def keys_of_permutation(df: DataFrame, n: str, name: str, seed: str) -> DataFrame:
    """``df`` with the column ``key``: what ``permuted`` needs to know for a permutation of 0 .. n-1 of its own, once per row of ``df``."""
    own, bits = F.col(name), F.length(F.bin(F.col(n))) - 1
    prime = F.lit(PRIMES[-1])
    for p in reversed(PRIMES[:-1]):
        prime = F.when(F.col(n) % p != 0, F.lit(p)).otherwise(prime)
    return df.withColumn("key", F.struct(
        F.col(n).alias("n"), prime.cast("long").alias("prime"), F.pow(F.lit(2), bits).cast("long").alias("low"),
        F.pow(F.lit(2), F.ceil(bits / 2)).cast("long").alias("half"),
        *[_number(F.lit(seed), F.lit(str(r)), own).alias(f"plus{r}") for r in range(3)],
        *[(_number(F.lit(seed), F.lit(f"odd{r}"), own) % 1_000_000 * 2 + 1).alias(f"odd{r}") for r in range(2)]))


def permuted(df: DataFrame, i: str, out: str) -> DataFrame:
    """``out``: a permutation of i = 0 .. key.n - 1: three affine maps modulo n, between them a mix of the numbers below the largest power of two.

    Step after step is a column of its own, so none is computed twice.
    """
    x, k = F.col(i), F.col("key")
    for r in range(3):
        df = df.withColumn(f"__x{r}", (x * k["prime"] + k[f"plus{r}"]) % k["n"])
        x = F.col(f"__x{r}")
        if r < 2:
            df = df.withColumn(f"__y{r}", (x * k[f"odd{r}"]) % k["low"])
            y = F.col(f"__y{r}")
            df = df.withColumn(f"__z{r}", F.when(x < k["low"], y.bitwiseXOR(F.expr(f"__y{r} div key.half"))).otherwise(x))
            x = F.col(f"__z{r}")
    return df.withColumn(out, x).drop(*[f"__{c}{r}" for c in "xyz" for r in range(3)])


@dataclass
class Mix:
    """``placed``: every document with size, s, start (its first token's place in the source) and its source's columns.
    ``slots``: (s, pass, block, shard, slot, upto), upto tokens from the block's start.  ``pieces``: which words of which document a slot takes."""

    placed: DataFrame
    slots: DataFrame
    pieces: DataFrame


def mix(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, block: int = BLOCK, shards: int = SHARDS, seed: str = SEED) -> Mix:
    keep = docs.columns if keep is None else keep
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    size = F.coalesce(F.regexp_count(F.col(f"`{text}`").cast("string"), F.lit(TOKEN)), F.lit(0)).cast("long")
    chunk = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit(""))), 1, 3), 16, 10).cast("int")
    sized = pin(docs.select(*named, F.col(f"`{doc_id}`").alias("id"), F.col(f"`{source}`").cast("string").alias("source"), size.alias("size"))
                .withColumn("chunk", chunk), "sizes")
    targets = pin(source_targets(sized, weights, share, most), "targets")
    known = F.broadcast(targets) if targets.count() <= FEW_SOURCES else targets
    rows = sized.join(known.withColumnRenamed("source", "name"), F.col("source").eqNullSafe(F.col("name"))).drop("name")
    sums = rows.groupBy("s", "chunk").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("s").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)  # at most CHUNKS rows
    base = sums.select("s", "chunk", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    inside = Window.partitionBy("s", "chunk").orderBy("id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(base, ["s", "chunk"])
              .withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside", "chunk"))
    placed = pin(placed, "placed")

    slots = _slots(targets, block, shards, seed)
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    cut = (placed.where("size > 0").select("s", "start", "size", "id", F.explode(F.sequence(first, last)).alias("block"))
           .withColumn("from", F.greatest("start", F.col("block") * block))
           .withColumn("to", F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)))
    # the planner takes exploded rows for as few as the rows before; neither side has a bound, so neither is broadcast
    pieces = (cut.hint("merge").join(slots.hint("merge"), ["s", "block"]).withColumn("n", F.least("to", F.col("block") * block + F.col("upto")) - F.col("from")).where("n > 0")
              .select("s", "start", "size", "id", "pass", "shard", "slot", (F.col("from") - F.col("start")).alias("first"), "n"))
    return Mix(placed, slots, pieces)


def _slots(targets: DataFrame, block: int, shards: int, seed: str) -> DataFrame:
    full, rest_len = F.floor(F.col("source_size") / block), F.col("source_size") % block
    t = targets.where("source_size > 0").select(
        "s", F.coalesce("source", F.lit("\u0000null")).alias("name"), full.alias("full"), rest_len.alias("short"),
        (full + (rest_len > 0).cast("long")).alias("blocks"), F.floor(F.col("want") / F.col("source_size")).alias("passes"),
        (F.col("want") % F.col("source_size")).alias("rest"))
    t = t.withColumn("n", F.col("passes") * F.col("blocks") + F.ceil(F.col("rest") / block)).where("n > 0")
    slots = t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    tasks = int(slots // TASK_SLOTS + 1)  # few rows stand for many slots, so their number must not decide the tasks
    # the draw: every slot picks its shard; one count per source and shard is kept
    ranges = (t.select("s", "name", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANGE))).alias("r"))
              .repartition(tasks, "s", "r"))
    one = ranges.select("s", F.explode(F.sequence(F.col("r") * RANGE, F.least(F.col("n"), (F.col("r") + 1) * RANGE) - 1)).alias("draw"), "name")
    drawn = (one.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), F.col("name"), F.col("draw")), F.lit(shards)).cast("int"))
             .groupBy("s", "shard").agg(F.count("*").alias("count")))
    before = Window.partitionBy("s").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    counted = drawn.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    known = keys_of_permutation(t.withColumn("full1", F.greatest("full", F.lit(1))), "full1", "name", seed)
    numbered = counted.join(known, "s").repartition(tasks, "s", "shard").withColumn("slot", F.explode(F.sequence(F.col("base"), F.col("base") + F.col("count") - 1)))
    at = numbered.withColumn("pass", F.floor(F.col("slot") / F.col("blocks"))).withColumn("i", F.col("slot") % F.col("blocks"))
    at = permuted(at, "i", "p")
    b = F.when(F.col("i") < F.col("full"), F.col("p")).otherwise(F.col("full"))
    whole = F.when(F.col("i") < F.col("full"), F.lit(block)).otherwise(F.col("short"))
    left = F.col("rest") - F.col("i") * block  # of the pass that isn't whole
    upto = F.when(F.col("pass") < F.col("passes"), whole).otherwise(F.least(whole, left))
    # never null: else the join would ask for that before the steps above, by computing all of them in one filter
    return at.select("s", "pass", F.coalesce(b, F.lit(0)).alias("block"), "shard", "slot", upto.alias("upto"))


def taken_words(mixed: Mix, keep: list[str]) -> DataFrame:
    """``keep`` columns of every document with size, source_size, target and taken (words the mix takes, repeats counted)."""
    taken = mixed.pieces.groupBy("s", "start").agg(F.sum("n").alias("taken"))
    some = mixed.placed.where("size > 0").join(taken, ["s", "start"], "left")
    none = mixed.placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return some.unionByName(none).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep) if c not in RESULTS], "size", "source_size", "target",
                                         F.coalesce("taken", F.lit(0)).alias("taken"))


def mixed_documents(docs: DataFrame, keep: list[str] | None = None, text: str = "text", doc_id: str = "doc_id", source: str = "source", **how) -> DataFrame:
    """``keep`` columns (all by default) once for each pass that takes words of a document.  The text is the document's own where the pass takes all its words, else the
    words taken, in order, with single spaces."""
    keep = docs.columns if keep is None else keep
    place = {c: f"c{i}" for i, c in enumerate(dict.fromkeys([*keep, text, doc_id, source]))}  # columns of any name keep out of the way
    rows = pin(docs.select(*[F.col(f"`{c}`").alias(p) for c, p in place.items()], F.monotonically_increasing_id().alias("row")), "rows")  # written once, so the number stays
    made = mix(rows, ["row"], place[doc_id], place[text], place[source], **how)
    stretch = F.sort_array(F.collect_list(F.struct("first", "n")))
    passes = made.pieces.groupBy("s", "start", "size", "pass").agg(stretch.alias("stretches"), F.sum("n").alias("taken"))
    row = made.placed.where("size > 0").select("s", "start", F.col("k0").alias("row"))
    own = F.col(place[text])
    found = F.regexp_extract_all(own.cast("string"), F.lit(TOKEN), F.lit(0))
    some = F.array_join(F.flatten(F.transform("stretches", lambda x: F.slice(F.col("found"), x["first"].cast("int") + 1, x["n"].cast("int")))), " ")
    taken = passes.join(row.hint("merge"), ["s", "start"]).select("row", "stretches", (F.col("taken") == F.col("size")).alias("whole"))
    joined = rows.join(taken, "row").withColumn("found", F.when(~F.col("whole"), found))
    words = F.when(F.col("whole"), own).otherwise(some)
    return joined.select(*[(words if c == text else F.col(place[c])).alias(c) for c in keep])
