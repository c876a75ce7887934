"""Sharding by longest processing time: groups of equal texts, largest first, go to the least loaded shard.

A heap over all groups would not be bounded, but groups of one size are alike to it.  The heap takes the sizes with their numbers of groups, largest
first; a run of k groups of size s goes to the shards as k single steps would: they take the k least of load + i s over shards and
i = 0, 1, ...  The groups of a size are numbered, and a group's number says which shard it goes to.  So every group is placed by
longest processing time.  The driver gets one row per distinct size, fewer than the root of twice the bytes.

Texts are shuffled once, to join their slots; all else works on ids and digests.

Defined cases: a null text counts no bytes and shares the group of the empty text; a null id sorts first among slots; repeated rows are one group and get
slots of their own; an empty table gives no rows; extra columns pass through when named in ``keep``, but one named like a result is replaced by it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators.skew import number_within
from rankspark.session import pin

#: Parts of a shard that are numbered side by side.
PARTS = 1024
#: What a row costs besides its text.
ROW_BYTES = 8
#: Runs of more groups than this are placed by their level, shorter ones step by step.
STEPS = 64
#: A table of so many sizes at most is broadcast.
FEW_SIZES = 20_000
RESULTS = ("size", "text_crc32", "shard", "slot")


def longest_first(sizes: Iterable[tuple[int, int]], shards: int, steps: int = STEPS) -> dict[int, list[int]]:
    """Size -> how many of its groups each shard takes, from (size, number of groups); equal loads go to the smaller shard."""
    loads = np.zeros(shards, np.int64)
    out = {}
    for size, groups in sorted(sizes, reverse=True):
        before, left = loads.copy(), groups
        if left > steps:
            # the highest level up to which no more than ``left`` groups fit: what lies under it is taken in any order
            low, high = int(loads.min()) - 1, int(loads.max()) + size * left
            while low < high:
                level = (low + high + 1) // 2
                fit = int(np.maximum(0, (level - loads) // size + 1).sum())
                low, high = (level, high) if fit <= left else (low, level - 1)
            taken = np.maximum(0, (low - loads) // size + 1)
            loads += taken * size
            left -= int(taken.sum())
        heap = [(int(x), s) for s, x in enumerate(loads)]
        heapq.heapify(heap)
        for _ in range(left):
            load, s = heap[0]
            heapq.heapreplace(heap, (load + size, s))
        for load, s in heap:
            loads[s] = load
        out[size] = ((loads - before) // size).tolist()
    return out


def placed_groups(narrow: DataFrame, shards: int) -> DataFrame:
    """(digest, shard) of every group.  ``narrow``: digest and size of every row."""
    spark = narrow.sparkSession
    groups = pin(narrow.groupBy("digest").agg(F.sum("size").alias("total")), "groups")
    runs = [(r["total"], r["n"]) for r in groups.groupBy("total").agg(F.count("*").alias("n")).collect()]  # one row per size
    plan = [(size, np.cumsum(counts).tolist()) for size, counts in longest_first(runs, shards).items()]
    upto = spark.createDataFrame(plan, "total long, upto array<long>")
    upto = F.broadcast(upto) if len(plan) <= FEW_SIZES else upto
    ranked = number_within(groups, ["total"], ["digest"], "rank")
    return ranked.join(upto, "total").select("digest", F.size(F.filter("upto", lambda x: x <= F.col("rank"))).alias("shard"))


def shard_documents(docs: DataFrame, shards: int, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``keep`` columns (all by default) of ``docs`` with size, text_crc32, shard and slot (from 0 in each shard, part by part, by id)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    body, own = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.col(f"`{doc_id}`")
    row = F.md5(F.concat(F.coalesce(F.concat(F.lit("="), own.cast("string")), F.lit("null")), F.lit("|"), F.md5(body)))
    sized = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], row.alias("row"),
                        (F.octet_length(body) + ROW_BYTES).cast("long").alias("size"), F.crc32(body).alias("crc"))
    narrow = pin(docs.select(row.alias("row"), own.alias("id"), F.md5(body).alias("digest"), (F.octet_length(body) + ROW_BYTES).cast("long").alias("size")), "sizes")
    rows = narrow.groupBy("row").agg(F.first("id").alias("id"), F.first("digest").alias("digest"), F.count("*").alias("copies"))
    where = rows.join(placed_groups(narrow, shards), "digest").withColumn("part", F.pmod(F.xxhash64("row"), F.lit(PARTS)).cast("int"))
    slots = numbered(where, shards)
    again = F.row_number().over(Window.partitionBy("row").orderBy(F.lit(0)))  # copies of one row are alike
    return sized.join(slots.hint("merge"), "row").select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "size", F.col("crc").alias("text_crc32"), "shard", (F.col("first") + again - 1).cast("long").alias("slot"))


def numbered(rows: DataFrame, shards: int) -> DataFrame:
    """(row, shard, first): gapless numbers from 0 within each shard, part after part; a task numbers one part of one shard."""
    rows = pin(rows, "placed")
    counts = rows.groupBy("shard", "part").agg(F.sum("copies").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # at most PARTS rows a shard
    base = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    if shards * PARTS <= 200_000:
        base = F.broadcast(base)
    inside = Window.partitionBy("shard", "part").orderBy("id", "digest").rowsBetween(Window.unboundedPreceding, -1)
    place = F.coalesce(F.sum("copies").over(inside), F.lit(0))
    return rows.withColumn("place", place).join(base, ["shard", "part"]).select("row", "shard", (F.col("base") + F.col("place")).alias("first"))
