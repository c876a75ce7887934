"""Ordering and numbering that hold when one key owns a third of all rows.

A plain window over a key puts all rows of that key in one task.  The helpers
here use the plain window for keys below a row bound and a range-partitioned
form for the keys above it.  The bound is ``spark.rankspark.heavy.rows``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.session import pin

HEAVY_KEY = "spark.rankspark.heavy.rows"
HEAVY_ROWS = 1_000_000
#: A broadcast of heavy keys is only hinted up to this many keys.
BROADCAST_KEYS = 200_000


def heavy_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(HEAVY_KEY, str(HEAVY_ROWS)))


def split_heavy(df: DataFrame, keys: Sequence[str], max_rows: int | None = None,
                counted: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``max_rows`` rows, and the rest (None if there are none).

    ``counted`` may name a cheaper frame holding the same key columns row for row.
    At most total/max_rows keys can be heavy, so the key list is small by
    arithmetic; it is broadcast only after its size is known.
    """
    keys = list(keys)
    max_rows = max_rows or heavy_rows(df.sparkSession)
    source = counted if counted is not None else df
    heavy = source.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_rows).select(*keys)
    found = heavy.limit(BROADCAST_KEYS + 1).collect()
    if not found:
        return df, None
    heavy = heavy.select(*[F.col(k).alias(f"_heavy{i}") for i, k in enumerate(keys)])
    if len(found) <= BROADCAST_KEYS:
        heavy = F.broadcast(df.sparkSession.createDataFrame(found, heavy.schema))
    # null is a key like any other
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_heavy{i}")) for i, k in enumerate(keys)])
    return df.join(heavy, same, "left_anti"), df.join(heavy, same, "left_semi")


def dense_index(df: DataFrame, order: Sequence[str | Column], name: str = "row_id") -> DataFrame:
    """0-based position in the total order, without a single-task window.

    A range sort numbers rows inside each partition; the numbered table is
    pinned so both readers see the same partitions; the per-partition start
    offsets are a table with one row per partition.
    """
    cols = df.columns
    placed = pin(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()), "dense")
    part = F.shiftright("_mid", 33)
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    placed = placed.select(*cols, part.alias("_part"), inside.alias("_at"))
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # one row per range partition: bounded by the shuffle width, not by the data
    return (placed.join(F.broadcast(starts), "_part")
            .select(*cols, (F.col("_start") + F.col("_at")).alias(name)))


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys of which null is one."""
    named = right.select(*[F.col(k).alias(f"_same{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_same{i}")) for i, k in enumerate(keys)])
    return left.join(named, same).drop(*[f"_same{i}" for i in range(len(keys))])


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str,
                  max_rows: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """0-based position of each row inside its key group."""
    keys = list(keys)
    light, heavy = split_heavy(df, keys, max_rows, counted)
    window = Window.partitionBy(*keys).orderBy(*order)
    out = light.withColumn(name, (F.row_number().over(window) - 1).cast("bigint"))
    if heavy is None:
        return out
    placed = dense_index(heavy, [*keys, *order], "_g")
    first = placed.groupBy(*keys).agg(F.min("_g").alias("_first"))
    # one row per heavy key, see split_heavy for the bound
    return out.unionByName(same_keys(placed, F.broadcast(first), keys)
                           .select(*df.columns, (F.col("_g") - F.col("_first")).alias(name)))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: str | Column, kind: str,
            name: str, max_rows: int | None = None, before: bool = False) -> DataFrame:
    """Running ``sum``, ``max`` or ``xor`` (of longs) of ``value`` inside each key, current row included; with ``before`` only of the rows
    before it (null for the first)."""
    keys = list(keys)
    combine = {"sum": F.sum, "max": F.max, "xor": F.bit_xor}[kind]
    size = max_rows or heavy_rows(df.sparkSession)
    cols = df.columns
    df = df.withColumn("_v", F.col(value) if isinstance(value, str) else value)
    light, heavy = split_heavy(df, keys, max_rows)
    last = -1 if before else 0
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, last)
    out = light.withColumn(name, combine("_v").over(upto)).select(*cols, name)
    if heavy is None:
        return out
    placed = dense_index(heavy, [*keys, *order], "_g").withColumn("_piece", F.floor(F.col("_g") / size))
    inside = Window.partitionBy(*keys, "_piece").orderBy("_g").rowsBetween(Window.unboundedPreceding, last)
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    prefix = (placed.groupBy(*keys, "_piece").agg(combine("_v").alias("_t"))
              .select(*keys, "_piece", combine("_t").over(earlier).alias("_prefix")))
    joined = same_keys(placed.withColumn("_in", combine("_v").over(inside)), prefix, [*keys, "_piece"])
    # a null is a piece without rows or values so far
    add = {"sum": lambda a, b: a + b, "max": F.greatest, "xor": lambda a, b: a.bitwiseXOR(b)}[kind]
    both = F.coalesce(add(F.col("_in"), F.col("_prefix")), "_in", "_prefix")
    return out.unionByName(joined.select(*cols, both.alias(name)))


def step_back(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: dict[str, tuple[str, int]],
              max_rows: int | None = None) -> DataFrame:
    """lag (positive steps) or lead (negative steps) inside each key: ``{new: (column, steps)}``."""
    keys = list(keys)
    size = max_rows or heavy_rows(df.sparkSession)
    light, heavy = split_heavy(df, keys, max_rows)

    def shifted(frame: DataFrame, window) -> DataFrame:
        for new, (col, steps) in columns.items():
            frame = frame.withColumn(new, (F.lag(col, steps) if steps > 0 else F.lead(col, -steps)).over(window))
        return frame

    out = shifted(light, Window.partitionBy(*keys).orderBy(*order))
    if heavy is None:
        return out
    behind = max([s for _, s in columns.values() if s > 0], default=0)
    ahead = max([-s for _, s in columns.values() if s < 0], default=0)
    placed = dense_index(heavy, [*keys, *order], "_g")
    piece, at = F.floor(F.col("_g") / size), F.col("_g") % size
    # rows near a piece border are repeated in the neighbour so its windows can see them
    copies = F.array_compact(F.array(
        F.struct(piece.alias("piece"), F.lit(False).alias("halo")),
        F.when(at >= size - behind, F.struct((piece + 1).alias("piece"), F.lit(True).alias("halo"))),
        F.when(at < ahead, F.struct((piece - 1).alias("piece"), F.lit(True).alias("halo")))))
    spread = placed.withColumn("_c", F.explode(copies)).withColumn("_piece", F.col("_c.piece"))
    windowed = shifted(spread, Window.partitionBy(*keys, "_piece").orderBy("_g"))
    return out.unionByName(windowed.where(~F.col("_c.halo")).select(*df.columns, *columns))
