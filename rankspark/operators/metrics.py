"""Grouped ranking metrics: tie-corrected AUC, nDCG@k and their roll-ups.

``per_group_scores`` is the one computation behind all reports.  Groups below the
heavy bound use one exchange and one sort; heavier groups are decomposed so that no
task sees a whole group (see ``_heavy_groups``).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.operators.skew import number_within, running, same_keys, split_heavy


@dataclass(frozen=True)
class Metric:
    """A metric of the caller's own, computed in the same pass as the built-in ones.

    ``sums``: (label, position from 1 by score) -> named aggregates over the rows of a group.
    ``value``: (rows, pos, those aggregates by name) -> the group's value; a group whose value is null does not count.
    ``weight``: the same arguments -> the group's weight in the mean over groups; all groups weigh the same without it.
    """
    name: str
    sums: Callable[[Column, Column], Mapping[str, Column]]
    value: Callable[[Column, Column, Mapping[str, Column]], Column]
    weight: Callable[[Column, Column, Mapping[str, Column]], Column] | None = None

    def aggregates(self) -> list[Column]:
        return [a.alias(f"_{self.name}_{s}") for s, a in self.sums(F.col("_y"), F.col("_at")).items()]

    def columns(self) -> list[Column]:
        named = {s: F.col(f"_{self.name}_{s}") for s in self.sums(F.col("_y"), F.col("_at"))}
        at = (F.col("rows"), F.col("pos"), named)
        weight = self.weight(*at) if self.weight else F.lit(1.0)
        return [self.value(*at).cast("double").alias(self.name), weight.cast("double").alias(f"{self.name}_weight")]

    def mean(self) -> Column:
        weight = F.when(F.col(self.name).isNotNull(), F.col(f"{self.name}_weight"))
        return F.coalesce(F.sum(weight * F.col(self.name)) / F.nullif(F.sum(weight), F.lit(0.0)), F.lit(0.0)).alias(self.name)


def _log2(x: Column) -> Column:
    return F.log2(x)


def _discount(position: Column) -> Column:
    """Discount of a 1-based position."""
    return F.lit(1.0) / _log2(position + F.lit(1.0))


def _ideal_dcg(pos: Column, k: int) -> Column:
    """Best DCG@k with ``pos`` relevant rows."""
    total = F.lit(0.0)
    for i in range(1, k + 1):
        total = total + F.when(pos >= i, _discount(F.lit(float(i)))).otherwise(0.0)
    return total


def _light_groups(df: DataFrame, keys: list[str], tiebreak: Sequence[str], k: int, extra: Sequence[Metric] = ()) -> DataFrame:
    """Average rank and position from one hash exchange and one sort.

    The count over the default range frame reaches the last row with the same score, so rank and count
    enclose the tie; no window needs the score as a partition key.
    """
    by_score = Window.partitionBy(*keys).orderBy("_neg")
    stable = Window.partitionBy(*keys).orderBy("_neg", *tiebreak)
    ranked = (df.withColumn("_at", F.row_number().over(stable)).withColumn("_rank", F.rank().over(by_score))
              .withColumn("_upto", F.count(F.lit(1)).over(by_score)))
    hit = F.col("_y") == 1
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("_y").cast("bigint").alias("pos"),
        F.sum(F.when(hit, (F.col("_rank") + F.col("_upto")) / 2.0).otherwise(0.0)).alias("_rank_sum"),
        F.sum(F.when(hit & (F.col("_at") <= k), _discount(F.col("_at"))).otherwise(0.0)).alias("_dcg"),
        *[a for m in extra for a in m.aggregates()])


def _heavy_groups(df: DataFrame, keys: list[str], tiebreak: Sequence[str], k: int, extra: Sequence[Metric] = ()) -> DataFrame:
    """The same sums for groups too large for one task.

    Equal scores collapse before the shuffle.  The collapsed histogram is range-partitioned
    on (group, score), each piece sums its own ranks, and the pieces of a group
    combine through the number of rows in the pieces before them.  The top k rows
    come from a row-number limit that Spark applies on the map side first.  Metrics of the
    caller's own may need every position, which a range sort gives.
    """
    hist = df.groupBy(*keys, "_neg").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("p"))
    pieces = hist.repartitionByRange(*keys, "_neg").withColumn("_piece", F.spark_partition_id())
    inside = Window.partitionBy(*keys, "_piece").orderBy("_neg").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n").over(inside), F.lit(0))
    summed = (pieces.withColumn("_ahead", ahead).groupBy(*keys, "_piece")
              .agg(F.sum("n").alias("n"), F.sum("p").alias("p"),
                   F.sum(F.col("p") * (F.col("_ahead") + (F.col("n") + 1) / 2.0)).alias("s")))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    sums = (summed.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
            .groupBy(*keys)
            .agg(F.sum("n").alias("rows"), F.sum("p").cast("bigint").alias("pos"),
                 F.sum(F.col("s") + F.col("p") * F.col("_before")).alias("_rank_sum")))
    stable = Window.partitionBy(*keys).orderBy("_neg", *tiebreak)
    head = df.withColumn("_at", F.row_number().over(stable)).where(F.col("_at") <= k)
    dcg = head.groupBy(*keys).agg(
        F.sum(F.when(F.col("_y") == 1, _discount(F.col("_at"))).otherwise(0.0)).alias("_dcg"))
    sums = same_keys(sums, dcg, keys)
    if extra:
        placed = number_within(df, keys, ["_neg", *tiebreak], "_before", max_rows=1).withColumn("_at", F.col("_before") + 1)
        sums = same_keys(sums, placed.groupBy(*keys).agg(*[a for m in extra for a in m.aggregates()]), keys)
    return sums


def per_group_scores(df: DataFrame, group: Sequence[str] | str, label: str = "label", score: str = "score",
                     tiebreak: Sequence[str] = ("row_id",), k: int = 5, max_rows: int | None = None,
                     counted: DataFrame | None = None, extra: Sequence[Metric] = ()) -> DataFrame:
    """One row per group: rows, pos, auc, ndcg, primary, discriminative, and value and weight of each metric in ``extra``.

    AUC is 0.5 for one-class groups; nDCG is 0 for groups without a positive.
    Equal scores keep the ``tiebreak`` order in nDCG and count half in AUC.
    """
    keys = [group] if isinstance(group, str) else list(group)
    keep = list(dict.fromkeys([*keys, *tiebreak]))
    # 0.0 - x also maps -0.0 to 0.0, so both zeros tie
    base = df.select(*keep, F.col(label).cast("int").alias("_y"),
                     (F.lit(0.0) - F.col(score).cast("double")).alias("_neg"))
    light, heavy = split_heavy(base, keys, max_rows, counted)
    sums = _light_groups(light, keys, tiebreak, k, extra)
    if heavy is not None:
        sums = sums.unionByName(_heavy_groups(heavy, keys, tiebreak, k, extra))
    n, p = F.col("rows").cast("double"), F.col("pos").cast("double")
    mixed = (F.col("pos") > 0) & (F.col("pos") < F.col("rows"))
    wins = p * (n + 1) - F.col("_rank_sum") - p * (p + 1) / 2
    auc = F.when(mixed, wins / (p * (n - p))).otherwise(0.5)
    ndcg = F.when(F.col("pos") > 0, F.col("_dcg") / _ideal_dcg(F.col("pos"), k)).otherwise(0.0)
    return (sums.withColumn("auc", auc).withColumn("ndcg", ndcg)
            .select(*keys, "rows", "pos", "auc", "ndcg",
                    ((F.col("auc") + F.col("ndcg")) / 2).alias("primary"), mixed.alias("discriminative"),
                    *[c for m in extra for c in m.columns()]))


def summarise(per_group: DataFrame, by: Sequence[str] = (), extra: Sequence[Metric] = ()) -> DataFrame:
    """GAUC (positive-weighted over discriminative groups), mean nDCG and their average; then the weighted mean of each own metric."""
    weight = F.when(F.col("discriminative"), F.col("pos"))
    out = per_group.groupBy(*by).agg(
        F.coalesce(F.sum(weight * F.col("auc")) / F.sum(weight), F.lit(0.5)).alias("gauc"),
        F.coalesce(F.avg("ndcg"), F.lit(0.0)).alias("ndcg"),
        F.count(F.lit(1)).alias("users"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), *[m.mean() for m in extra])
    return out.select(*by, "gauc", "ndcg", ((F.col("gauc") + F.col("ndcg")) / 2).alias("primary"), "users", "rows", *[m.name for m in extra])


def ranking_report(df: DataFrame, group: str = "user_id", label: str = "label", score: str = "score",
                   tiebreak: Sequence[str] = ("row_id",), k: int = 5, by: Sequence[str] = (),
                   max_rows: int | None = None, counted: DataFrame | None = None, extra: Sequence[Metric] = ()) -> DataFrame:
    scores = per_group_scores(df, [*by, group], label, score, tiebreak, k, max_rows, counted, extra)
    return summarise(scores, by, extra)


def per_user_primary(df: DataFrame, group: Sequence[str] | str = "user_id", digits: int = 6, **kwargs) -> DataFrame:
    """Primary of the groups that carry ranking signal, rounded half-even."""
    keys = [group] if isinstance(group, str) else list(group)
    scores = per_group_scores(df, keys, **kwargs)
    return scores.where("discriminative").select(*keys, F.bround("primary", digits).alias("primary"))


def discriminative_groups(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    per = df.groupBy(group).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("rows"))
    return per.where((F.col("pos") > 0) & (F.col("pos") < F.col("rows")))


def average_ranks(df: DataFrame, group: str, score: str = "score", max_rows: int | None = None) -> DataFrame:
    """Ascending average rank of every distinct score in a group."""
    hist = df.groupBy(group, score).agg(F.count(F.lit(1)).alias("n"))
    upto = running(hist, [group], [score], "n", "sum", "_upto", max_rows)
    return upto.select(group, score, "n", (F.col("_upto") - (F.col("n") - 1) / 2.0).alias("avg_rank"))


def composition(df: DataFrame, by: Sequence[str], group: str, label: str = "label") -> DataFrame:
    """Users, and the shares that are all-negative, all-positive and discriminative."""
    per = df.groupBy(*by, group).agg(F.sum(label).alias("pos"), F.count(F.lit(1)).alias("n"))
    def share(cond: Column) -> Column:
        return F.avg(cond.cast("double"))
    return per.groupBy(*by).agg(
        F.count(F.lit(1)).alias("users"),
        share(F.col("pos") == 0).alias("all_negative"),
        share(F.col("pos") == F.col("n")).alias("all_positive"),
        share((F.col("pos") > 0) & (F.col("pos") < F.col("n"))).alias("discriminative"))


def top_k(df: DataFrame, group: str, score: str, tiebreak: Sequence[str], k: int) -> DataFrame:
    """Best k rows per group; the limit runs on the map side before the shuffle."""
    window = Window.partitionBy(group).orderBy(F.col(score).desc(), *tiebreak)
    return df.withColumn("position", F.row_number().over(window)).where(F.col("position") <= k)


def pair_outcomes(df: DataFrame, group: str, label: str = "label", score: str = "score",
                  max_rows: int | None = None) -> DataFrame:
    """Positive/negative pairs per group that are ordered right, wrong or tied.

    Counted from the score histogram; the pairs themselves are never produced.
    """
    hist = df.groupBy(group, F.col(score).cast("double").alias("_s")).agg(
        F.sum(label).alias("p"), (F.count(F.lit(1)) - F.sum(label)).alias("m"))
    ties = hist.groupBy(group).agg(F.sum(F.col("p") * F.col("m")).alias("tied"))
    auc = per_group_scores(df, group, label, score, tiebreak=(), max_rows=max_rows)
    pairs = F.col("pos") * (F.col("rows") - F.col("pos"))
    right = F.col("auc") * F.col("pairs") - F.col("tied") / 2.0
    return (auc.where("discriminative").withColumn("pairs", pairs).join(ties, group)
            .select(group, "pairs", "tied", F.round(right).cast("bigint").alias("concordant"))
            .withColumn("discordant", F.col("pairs") - F.col("tied") - F.col("concordant")))
