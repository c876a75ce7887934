"""Paired candidate-versus-parent statistics over per-user scores."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import MIX_PRIME, hash60
from rankspark.operators.skew import number_within
from rankspark.session import pin

# The decision thresholds.
CONTINUE_P, CONTINUE_MARGIN = 0.8, 0.0
CONFIRM_P = 0.9
PROMOTE_MARGIN = 0.0005
NO_OP_EPSILON = 1e-9

#: Values (8 bytes each) of one group that a resampling task holds, and draws that it makes at least.
BLOCK_VALUES = 1 << 22
TASK_DRAWS = 400_000_000
#: Groups whose sizes are sent to the tasks at most.
BROADCAST_ROWS = 500_000

#: Cumulative Poisson(1) probabilities; a uniform draw exceeds as many of them as its weight.  The next one lies beyond the
#: largest draw below 1.
POISSON_CDF = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462,
               0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253,
               0.999998874797402, 0.9999998885745217, 0.9999999899522336, 0.9999999991684123)


def paired_deltas(scores: DataFrame, pairs: DataFrame, value: str = "primary") -> DataFrame:
    """candidate - parent on matched (seed, user).

    ``scores``: (node_id, seed, user_id, value), one row per key.  ``pairs``: (node_id, parent_id).
    """
    cand = scores.join(pairs, "node_id").select("node_id", "parent_id", "seed", "user_id", F.col(value).alias("_c"))
    parent = scores.select(F.col("node_id").alias("parent_id"), "seed", "user_id", F.col(value).alias("_p"))
    return (cand.join(parent, ["parent_id", "seed", "user_id"])
            .select("node_id", "parent_id", "seed", "user_id", (F.col("_c") - F.col("_p")).alias("delta")))


def _lower_bound(means: Column, draws: int) -> Column:
    """Order statistic int(0.05 * n), 0-based, of the n collected replicate means (a replicate may have drawn nothing)."""
    sorted_means = F.array_sort(F.collect_list(means))
    return F.get(sorted_means, F.floor(F.lit(0.05) * F.size(sorted_means)).cast("int"))


def _poisson_sums(deltas: DataFrame, by: list[str], order: Sequence[str], draws: int, seed: int) -> DataFrame:
    """Weights and weighted deltas per (by, replicate): a task sums all replicates of its rows, so only sums are shuffled."""
    rows = deltas.select(*by, "delta", hash60(F.lit(seed), *by, *order).alias("_h"))
    schema = rows.select(*by).schema.add("b", "integer").add("w", "double").add("wd", "double")
    cdf, low, b = np.array(POISSON_CDF), (1 << 30) - 1, np.arange(draws, dtype=np.int64)

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for _, part in batch.groupby(by, dropna=False, sort=False):
                total = np.zeros((2, draws))
                h, delta = part["_h"].to_numpy(np.int64), part["delta"].to_numpy(np.float64)
                for at in range(0, len(part), 1000):
                    own = h[at:at + 1000, None]
                    x = ((own & low) + b * 1000003) % MIX_PRIME
                    y = (x * x + (own >> 30)) % MIX_PRIME
                    draw = ((y * y + (own & low)) % MIX_PRIME) / float(MIX_PRIME)
                    weight = np.searchsorted(cdf, draw, side="right").astype(np.float64)
                    total += weight.sum(axis=0), delta[at:at + 1000] @ weight
                out = pd.concat([part[by].iloc[:1]] * draws, ignore_index=True)
                yield out.assign(b=b.astype(np.int32), w=total[0], wd=total[1])
    return rows.mapInPandas(add_up, schema).groupBy(*by, "b").agg(F.sum("w").alias("w"), F.sum("wd").alias("wd"))


def _packed(numbered: DataFrame, by: list[str]) -> DataFrame:
    """Values of positions [block * BLOCK_VALUES, ...) of a group as bytes in one row; ``known`` has a byte for each that is not null."""
    rows = numbered.select(*by, F.floor(F.col("_i") / BLOCK_VALUES).alias("block"), "_i", "delta")
    rows = rows.repartition(*by, "block").sortWithinPartitions(*by, "block", "_i").drop("_i")
    schema = rows.select(*by, "block").schema.add("values", "binary").add("known", "binary")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, parts = None, []

        def done() -> pd.DataFrame:
            values = np.concatenate(parts)
            return head[[*by, "block"]].assign(values=[np.nan_to_num(values, nan=0.0, posinf=np.inf, neginf=-np.inf).tobytes()], known=[(~np.isnan(values)).tobytes()])
        for batch in batches:
            for _, part in batch.groupby([*by, "block"], dropna=False, sort=False):
                first = part.iloc[:1]
                if head is not None and not head[[*by, "block"]].reset_index(drop=True).equals(first[[*by, "block"]].reset_index(drop=True)):
                    yield done()
                    parts = []
                head = first
                parts.append(part["delta"].to_numpy(np.float64))
        if parts:
            yield done()
    return rows.mapInPandas(pack, schema)


def _multinomial_sums(deltas: DataFrame, by: list[str], order: Sequence[str], draws: int, seed: int) -> DataFrame:
    """Draws and their sum per (by, replicate).  A task makes the draws of some rows of a group and looks them up in one block of its values."""
    numbered = pin(number_within(deltas.select(*by, *order, "delta"), by, list(order), "_i").select(*by, "_i", "delta"), "numbered")
    sizes = pin(numbered.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")), "sizes")
    few = sizes.agg(F.count(F.lit(1)).alias("groups"), F.sum("_n").alias("rows")).first()
    tasks = max(deltas.sparkSession.sparkContext.defaultParallelism, -(-(few["rows"] or 0) * draws // TASK_DRAWS))
    share = -(-(few["rows"] or 0) // tasks) or 1                              # rows of a task
    rows = numbered.join(F.broadcast(sizes) if few["groups"] <= BROADCAST_ROWS else sizes, by).select(
        *by, "_n", hash60(F.lit(seed), *by, "_i").alias("_h"), F.pmod("_i", F.ceil(F.col("_n") / share)).alias("part"))
    last = F.floor((F.col("_n") - 1) / BLOCK_VALUES)
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    parts = F.ceil(F.col("_n") / share)
    blocks = _packed(numbered, by).join(F.broadcast(sizes) if few["groups"] <= BROADCAST_ROWS else sizes, by).withColumn(
        "part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_n")
    schema = numbered.select(*by).schema.add("b", "integer").add("w", "double").add("wd", "double")
    low, b = (1 << 30) - 1, np.arange(draws, dtype=np.int64)

    def add_up(own: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        if own.empty or block.empty:
            return pd.DataFrame(columns=[*by, "b", "w", "wd"])
        values, known = np.frombuffer(block["values"].iloc[0], np.float64), np.frombuffer(block["known"].iloc[0], np.bool_).astype(np.float64)
        start, n, total = int(block["block"].iloc[0]) * BLOCK_VALUES, int(own["_n"].iloc[0]), np.zeros((2, draws))
        whole, h = len(values) == n, own["_h"].to_numpy(np.int64)
        for at in range(0, len(h), 500):
            part = h[at:at + 500, None]
            x = ((part & low) + b * 1000003) % MIX_PRIME
            first = (x * x + (part >> 30)) % MIX_PRIME
            # 62 bits: any position can be drawn
            place = (first * (1 << 31) + (first * first + (part & low)) % MIX_PRIME) % n
            if whole:
                total += known[place].sum(axis=0), values[place].sum(axis=0)
            else:
                place -= start
                here = (place >= 0) & (place < len(values))
                place[~here] = 0
                total += (known[place] * here).sum(axis=0), np.where(here, values[place], 0.0).sum(axis=0)
        out = pd.concat([own[by].iloc[:1]] * draws, ignore_index=True)
        return out.assign(b=b.astype(np.int32), w=total[0], wd=total[1])
    keys = [*by, "part", "block"]
    sums = rows.groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(add_up, schema)
    return sums.groupBy(*by, "b").agg(F.sum("w").alias("w"), F.sum("wd").alias("wd"))


def paired_bootstrap(deltas: DataFrame, by: Sequence[str] = ("node_id",), draws: int = 500, seed: int = 0,
                     method: str = "poisson", order: Sequence[str] = ("seed", "user_id"),
                     cluster: str | None = None) -> DataFrame:
    """Mean delta, share of replicate means above 0, one-sided 5% lower bound.

    ``poisson`` (default) weights each row independently per replicate; each task sends one sum per group and
    replicate.  ``multinomial`` resamples n of n with replacement: tasks draw positions for their rows and look them up in a
    block of the group's values, so sums are shuffled, not n * draws rows.  ``cluster`` averages per that key first, so repeated
    seeds of a user count once.
    """
    by = list(by)
    if cluster:
        deltas = deltas.groupBy(*by, cluster).agg(F.avg("delta").alias("delta"))
        order = [cluster]
    if method == "poisson":
        means = _poisson_sums(deltas, by, order, draws, seed).where("w > 0").select(*by, "b", (F.col("wd") / F.col("w")).alias("m"))
    elif method == "multinomial":
        means = _multinomial_sums(deltas, by, order, draws, seed).where("w > 0").select(*by, "b", (F.col("wd") / F.col("w")).alias("m"))
    else:
        raise ValueError(f"unknown method {method!r}")
    # at most ``draws`` rows per group from here on
    stats = means.groupBy(*by).agg(F.avg((F.col("m") > 0).cast("double")).alias("p_positive"),
                                   _lower_bound(F.col("m"), draws).alias("lower_95"))
    centre = deltas.groupBy(*by).agg(F.avg("delta").alias("mean_delta"), F.count(F.lit(1)).alias("n"))
    return centre.join(stats, by)


def with_missing(stats: DataFrame, nodes: DataFrame, by: Sequence[str] = ("node_id",)) -> DataFrame:
    """Nodes without any shared (seed, user) get zeros, never nulls."""
    out = nodes.select(*by).join(stats, list(by), "left")
    return out.fillna({"mean_delta": 0.0, "p_positive": 0.0, "lower_95": 0.0, "n": 0})


def no_op_nodes(deltas: DataFrame, by: Sequence[str] = ("node_id",), seed: int | None = None) -> DataFrame:
    """True where every shared user scores as the parent does; nodes that share none are absent."""
    rows = deltas if seed is None else deltas.where(F.col("seed") == seed)
    return rows.groupBy(*by).agg((F.max(F.abs("delta")) < NO_OP_EPSILON).alias("no_op"),
                                 F.count(F.lit(1)).alias("shared"))


def continue_locally(p="p_positive", lower="lower_95", margin: float = CONTINUE_MARGIN) -> Column:
    return (F.col(p) > CONTINUE_P) & (F.col(lower) > margin)


def wants_confirm(score: str, champion, p="p_positive", lower="lower_95") -> Column:
    return (F.col(p) >= CONFIRM_P) & (F.col(lower) > 0) & (F.col(score) > champion)


def promotes(mean="mean_delta", lower="lower_95", margin: float = PROMOTE_MARGIN) -> Column:
    """Both statistics must come from the confirm split, paired on that split."""
    return (F.col(mean) > margin) & (F.col(lower) > 0)


def seed_summary(reports: DataFrame, by: Sequence[str] = ("node_id",), value: str = "primary") -> DataFrame:
    """Mean over the seeds that ran, population deviation and range; nulls are skipped."""
    return reports.groupBy(*by).agg(
        F.avg(value).alias("mean"), F.stddev_pop(value).alias("spread"),
        (F.max(value) - F.min(value)).alias("range"), F.count(value).alias("seeds"))


def ablation_deltas(full: DataFrame, ablated: DataFrame, by: Sequence[str] = ("study_id",), value: str = "primary") -> DataFrame:
    """Score lost when a component is removed: (by, component, delta)."""
    base = full.select(*by, F.col(value).alias("_full"))
    return ablated.join(base, list(by)).select(*by, "component", (F.col("_full") - F.col(value)).alias("delta"))
