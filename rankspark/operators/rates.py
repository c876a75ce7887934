"""Train-only rates and their lookup onto any split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import smoothed_rate
from rankspark.operators.skew import dense_index


def rate_table(df: DataFrame, keys: Sequence[str | Column], label: str = "label",
               pos: str = "pos", imp: str = "imp") -> DataFrame:
    """Positives and impressions per key; keys may be expressions."""
    return df.groupBy(*keys).agg(F.sum(label).cast("bigint").alias(pos), F.count(F.lit(1)).alias(imp))


def rate_sets(df: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Sums by each key alone and over all rows, from one scan: ``_set`` (the key's name, empty for all rows), the keys, ``_pos``,
    ``_imp`` and ``_known`` (rows with a label).  A null key is a group of its own.
    """
    keys = list(keys)
    # every key has a bit in the grouping id, set where the key is not grouped by
    every = (1 << len(keys)) - 1
    names = F.create_map(*[F.lit(x) for i, k in enumerate(keys) for x in (every - (1 << (len(keys) - 1 - i)), k)], F.lit(every), F.lit(""))
    out = df.select(*keys, F.col(label).alias("_label")).groupingSets([[k] for k in keys] + [[]], *keys).agg(
        F.grouping_id().cast("int").alias("_id"), F.coalesce(F.sum("_label").cast("bigint"), F.lit(0)).alias("_pos"),
        F.count(F.lit(1)).alias("_imp"), F.count("_label").alias("_known"))
    return out.withColumn("_set", names[F.col("_id")]).drop("_id")


def global_rate(df: DataFrame, label: str = "label") -> float:
    """One number, needed by every row of the lookup."""
    row = df.agg(F.avg(F.col(label).cast("double")).alias("m")).first()
    return row["m"] if row["m"] is not None else 0.0


def group_sizes(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"))


def group_offsets(df: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """Start and end of each group in the layout sorted by (group, order)."""
    placed = dense_index(df.select(*dict.fromkeys([group, *order])), [group, *order], "_g")
    return placed.groupBy(group).agg(F.min("_g").alias("start"), (F.max("_g") + 1).alias("end"))


def pair_eligibility(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Positive and negative counts; a group is eligible when it has both."""
    per = df.groupBy(group).agg(F.sum(label).cast("bigint").alias("pos"),
                                F.sum(1 - F.col(label)).cast("bigint").alias("neg"))
    return per.withColumn("eligible", (F.col("pos") > 0) & (F.col("neg") > 0))


def lookup(df: DataFrame, dim: DataFrame, keys: Sequence[str] | str, default: dict | None = None) -> DataFrame:
    """Left join with defaults for missing keys.

    ``dim`` has one row per key.  No broadcast is forced: the planner broadcasts a dim below
    its threshold and otherwise sort-merges, where skewed keys are split at run time.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    out = df.join(dim, keys, "left")
    for name, value in (default or {}).items():
        out = out.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return out


def unseen(df: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Rows whose key never occurs in train."""
    return df.join(train.select(key).distinct(), key, "left_anti")


def popularity_scores(train: DataFrame, df: DataFrame, item: str = "item_id", label: str = "label",
                      prior: float = 20.0, name: str = "score") -> DataFrame:
    """Smoothed train rate of the item; an unseen item gets exactly the global rate."""
    mean = global_rate(train, label)
    rates = rate_table(train, [item], label, "_pos", "_imp")
    return (lookup(df, rates, item)
            .withColumn(name, smoothed_rate("_pos", "_imp", prior, mean)).drop("_pos", "_imp"))
