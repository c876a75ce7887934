"""Date splits and split-integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Ranges = Mapping[str, tuple[int, int]]


def _inside(lo: int, hi: int, column: str, stored_as_time: bool) -> Column:
    """Inclusive yyyymmdd range as a comparison on the stored column, so that it reaches the scan."""
    if not stored_as_time:
        return F.col(column).between(lo, hi)
    first = datetime.strptime(str(lo), "%Y%m%d")
    after = datetime.strptime(str(hi), "%Y%m%d") + timedelta(days=1)
    def at(t: datetime) -> Column:
        return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")
    return (F.col(column) >= at(first)) & (F.col(column) < at(after))


def split_column(ranges: Ranges, date: str = "date", stored_as_time: bool = False) -> Column:
    """Name of the range the row falls in; null outside all ranges."""
    out = None
    for name, (lo, hi) in ranges.items():
        hit = _inside(lo, hi, date, stored_as_time)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def assign_split(df: DataFrame, ranges: Ranges, date: str = "date", name: str = "split",
                 stored_as_time: bool = False) -> DataFrame:
    """Name the split of each row and drop the rows outside all ranges.

    ``stored_as_time``: ``date`` is a timestamp column; the ranges become timestamp bounds.
    """
    lo = min(r[0] for r in ranges.values())
    hi = max(r[1] for r in ranges.values())
    kept = df.where(_inside(lo, hi, date, stored_as_time))
    named = kept.withColumn(name, split_column(ranges, date, stored_as_time))
    spans = sorted(ranges.values())
    gapless = all(_next_day(a[1]) == b[0] for a, b in zip(spans, spans[1:]))
    return named if gapless else named.where(F.col(name).isNotNull())


def pick_split(df: DataFrame, ranges: Ranges, split: str, date: str = "date", stored_as_time: bool = False) -> DataFrame:
    """The rows of one split, by a plain range filter on the stored column."""
    return df.where(_inside(*ranges[split], date, stored_as_time))


def _next_day(day: int) -> int:
    return int((datetime.strptime(str(day), "%Y%m%d") + timedelta(days=1)).strftime("%Y%m%d"))


def check_ranges(ranges: Ranges) -> list[tuple[str, str]]:
    """Pairs of range names that overlap."""
    items = sorted(ranges.items(), key=lambda kv: kv[1])
    return [(a, b) for (a, (_, hi)), (b, (lo, _)) in zip(items, items[1:]) if lo <= hi]


def split_sizes(df: DataFrame, ranges: Ranges, date: str = "date", stored_as_time: bool = False) -> DataFrame:
    """Rows per split; only the date column is read."""
    return assign_split(df.select(date), ranges, date, "split", stored_as_time).groupBy("split").agg(F.count(F.lit(1)).alias("rows"))


def leaked_rows(df: DataFrame, cols: Sequence[str], split: str = "split") -> DataFrame:
    """Full rows that occur under more than one split name."""
    per = df.groupBy(*cols).agg(F.min(split).alias("_a"), F.max(split).alias("_b"), F.count(F.lit(1)).alias("copies"))
    return per.where(F.col("_a") != F.col("_b")).select(*cols, "copies")


def coverage(df: DataFrame, parent: Ranges, parts: Ranges, date: str = "date") -> DataFrame:
    """Rows inside ``parent`` and how many of them no part, or more than one part, claims."""
    claims = sum((F.col(date).between(lo, hi).cast("int") for lo, hi in parts.values()), F.lit(0))
    inside = assign_split(df.select(date), parent, date)
    return inside.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum((claims == 0).cast("bigint")).alias("unclaimed"),
        F.sum((claims > 1).cast("bigint")).alias("claimed_twice"))


#: Rows that a task of ``difference_rows`` counts when it is told their number.
TASK_ROWS = 500_000


def difference_rows(left: DataFrame, right: DataFrame, rows: int | None = None) -> DataFrame:
    """Rows on one side only, with multiplicity; empty when the frames hold the same rows.

    Counted by group, so copies of one row collapse before the shuffle.  Where most rows differ from each other that would only fill the
    memory of the tasks that read: with ``rows``, about how many both sides have, rows are dealt out first, ``TASK_ROWS`` to a task.
    """
    cols = left.columns
    both = (left.select(*cols, F.lit(1).alias("_d"))
            .unionByName(right.select(*cols, F.lit(-1).alias("_d"))))
    if rows is not None:
        both = both.repartition(rows // TASK_ROWS + 1, *cols)
    return both.groupBy(*cols).agg(F.sum("_d").alias("surplus")).where(F.col("surplus") != 0)


def repeated_pairs(df: DataFrame, by: Sequence[str], pair: Sequence[str]) -> DataFrame:
    """Share of rows in repeated pairs, and the largest multiplicity."""
    per = df.groupBy(*by, *pair).agg(F.count(F.lit(1)).alias("n"))
    repeated = F.when(F.col("n") > 1, F.col("n")).otherwise(0)
    return per.groupBy(*by).agg(F.sum("n").alias("rows"), F.sum(repeated).alias("repeated_rows"),
                                (F.sum(repeated) / F.sum("n")).alias("repeated_share"),
                                F.max("n").alias("max_copies"))


def pair_sparsity(df: DataFrame, by: Sequence[str], pair: Sequence[str], approximate: bool = False) -> DataFrame:
    """Rows per distinct pair."""
    if approximate:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"),
                                   F.approx_count_distinct(F.struct(*pair)).alias("pairs")) \
                 .withColumn("rows_per_pair", F.col("rows") / F.col("pairs"))
    per = df.groupBy(*by, *pair).agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*by).agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("pairs"),
                                (F.sum("n") / F.count(F.lit(1))).alias("rows_per_pair"))
