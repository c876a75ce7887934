"""Exact quantile edges with linear interpolation, in two narrow passes."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interior(buckets: int) -> list[float]:
    return [i / buckets for i in range(1, buckets)]


def exact_quantiles(df: DataFrame, column: str, probs: Sequence[float], accuracy: int = 500_000) -> list[float]:
    """Linear-interpolated quantiles, exact at any size.

    Pass 1 brackets each target rank with a mergeable sketch.  Pass 2 histograms the values
    inside the brackets (about 6/accuracy of the rows each) and only counts the
    rest, so no task ever holds the full set of distinct values.
    """
    if not probs:
        return []
    base = df.select(F.col(column).cast("double").alias("x")).where(F.col("x").isNotNull())
    # the bracket must hold a few rows on each side of the rank, so small inputs take a wider one
    widths = [3.0 / accuracy, 3e-4, 3e-2]
    asked = [min(1.0, max(0.0, p + s)) for w in widths for p in probs for s in (-w, w)]
    row = base.agg(F.count("x").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"),
                   F.percentile_approx("x", asked, accuracy).alias("q")).first()
    n = row["n"]
    if n == 0:
        return []
    level = next((j for j, w in enumerate(widths) if w * n >= 3), None)
    brackets, ranks, fractions = [], [], []
    for i, p in enumerate(probs):
        h = p * (n - 1)
        if level is None:
            brackets.append((row["lo"], row["hi"]))
        else:
            at = 2 * (level * len(probs) + i)
            brackets.append((row["lo"] if p <= widths[level] else row["q"][at],
                             row["hi"] if p + widths[level] >= 1 else row["q"][at + 1]))
        ranks.append((i, math.floor(h), min(math.floor(h) + 1, n - 1)))
        fractions.append(h - math.floor(h))

    in_any = reduce(or_, [F.col("x").between(lo, hi) for lo, hi in brackets])
    below = sum((F.lit(lo) <= F.col("x")).cast("int") for lo, _ in brackets)
    # outside the brackets only the slot between two of them matters
    hist = base.groupBy(F.when(in_any, F.col("x")).alias("x"), below.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    order = sorted(range(len(probs)), key=lambda i: brackets[i][0])
    parts = F.array_compact(F.array(*[
        F.when(F.col("x").between(*brackets[i]), F.struct(F.lit(i).alias("i"), F.col("x").alias("x")))
        .when(F.col("slot") <= at, F.struct(F.lit(i).alias("i"), F.lit(None).cast("double").alias("x")))
        for at, i in enumerate(order)]))
    spread = (hist.select("n", F.explode(parts).alias("p")).groupBy("p.i", "p.x").agg(F.sum("n").alias("n")))
    running = Window.partitionBy("i").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    wanted = df.sparkSession.createDataFrame(ranks, "i int, r0 bigint, r1 bigint")
    picks = (spread.withColumn("upto", F.sum("n").over(running))
             .join(F.broadcast(wanted), "i")          # one row per requested quantile
             .groupBy("i")
             .agg(F.min(F.when(F.col("upto") > F.col("r0"), F.col("x"))).alias("v0"),
                  F.min(F.when(F.col("upto") > F.col("r1"), F.col("x"))).alias("v1")).collect())
    found = {r["i"]: (r["v0"], r["v1"]) for r in picks}
    return [found[i][0] + (found[i][1] - found[i][0]) * f for i, f in enumerate(fractions)]


def count_quantiles(counts: DataFrame, column: str, probs: Sequence[float]) -> list[float]:
    """Quantiles over per-key counts.

    The histogram of counts has at most sqrt(2 * total rows) distinct values,
    so the weighted built-in percentile is bounded.
    """
    hist = counts.groupBy(column).agg(F.count(F.lit(1)).alias("freq"))
    row = hist.agg(F.percentile(F.col(column).cast("double"), F.array(*[F.lit(p) for p in probs]),
                                F.col("freq")).alias("q")).first()
    return list(row["q"] or [])
