"""Categorical ids in order of first appearance, fitted on train only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.operators.skew import dense_index
from rankspark.session import pin

UNKNOWN = "UNK"
#: A field of at most so many values is sent to the tasks.
BROADCAST_VALUES = 100_000

Fields = Mapping[str, Column]


def named_fields(*names: str) -> dict[str, Column]:
    return {n: F.col(n) for n in names}


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(UNKNOWN))


@dataclass
class CategoricalIndexer:
    """Field name -> value expression; extend by adding entries."""

    fields: Fields

    def fit(self, train: DataFrame, order: Sequence[str]) -> "IndexerModel":
        # rows get their place in the order by one range sort, so that the first place of a value is a minimum of numbers: those are hashed,
        # a minimum of structs would sort every cell
        texts = [_text(c).alias(f"_v{i}") for i, c in enumerate(self.fields.values())]
        placed = train.select(*[F.col(o).alias(f"_o{i}") if isinstance(o, str) else o.alias(f"_o{i}") for i, o in enumerate(order)], *texts)
        placed = placed.orderBy(*[f"_o{i}" for i in range(len(order))]).withColumn("_first", F.monotonically_increasing_id())
        cells = F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"_v{i}").alias("value")) for i in range(len(texts))])
        # one scan for all fields; the partial minimum runs before the shuffle
        first = placed.select("_first", F.explode(cells).alias("c")).groupBy("c.field", "c.value").agg(F.min("_first").alias("_first"))
        # written once: every field reads its own part, none numbers the values again
        ids = pin(dense_index(first, ["field", "_first"], "_g")
                  .select("field", "value", (F.col("_g") + F.col("field")).alias("feature_id")), "ids")
        sizes = {r["field"]: r["n"] for r in
                 ids.groupBy("field").agg(F.count(F.lit(1)).alias("n")).collect()}   # one row per field
        return IndexerModel(dict(self.fields), ids, [sizes.get(i, 0) for i in range(len(self.fields))])


@dataclass
class IndexerModel:
    fields: Fields
    ids: DataFrame
    sizes: list[int]

    @property
    def offsets(self) -> list[int]:
        """Global id of each field's first value; every field ends with its unknown slot."""
        return [sum(self.sizes[:i]) + i for i in range(len(self.sizes))]

    @property
    def unknown_ids(self) -> list[int]:
        return [o + n for o, n in zip(self.offsets, self.sizes)]

    @property
    def dim(self) -> int:
        return sum(self.sizes) + len(self.sizes)

    def vocabulary(self) -> DataFrame:
        names = F.create_map(*[x for i, n in enumerate(self.fields) for x in (F.lit(i), F.lit(n))])
        starts = F.create_map(*[x for i, o in enumerate(self.offsets) for x in (F.lit(i), F.lit(o))])
        return self.ids.select(names[F.col("field")].alias("field"), "value",
                               (F.col("feature_id") - starts[F.col("field")]).alias("local_id"), "feature_id")

    def subset(self, names: Sequence[str]) -> "IndexerModel":
        """The model that a fit on these fields alone would give."""
        if list(names) == list(self.fields):
            return self
        at = [list(self.fields).index(n) for n in names]
        out = IndexerModel({n: self.fields[n] for n in names}, self.ids, [self.sizes[i] for i in at])
        field = F.create_map(*[F.lit(x) for j, i in enumerate(at) for x in (i, j)])
        shift = F.create_map(*[F.lit(x) for j, i in enumerate(at) for x in (i, out.offsets[j] - self.offsets[i])])
        out.ids = self.ids.where(F.col("field").isin(at)).select(
            field[F.col("field")].alias("field"), "value", (F.col("feature_id") + shift[F.col("field")]).alias("feature_id"))
        return out

    def narrowed(self, features: Column, names: Sequence[str]) -> Column:
        """Features of this model's rows as those of ``subset(names)``."""
        at, offsets = [list(self.fields).index(n) for n in names], self.subset(names).offsets
        return F.array(*[(features[i] + F.lit(offsets[j] - self.offsets[i])).cast("bigint") for j, i in enumerate(at)])

    def transform(self, df: DataFrame, features: str = "features") -> DataFrame:
        out = df
        for i, (name, expr) in enumerate(self.fields.items()):
            side = self.ids.where(F.col("field") == i).select(
                F.col("value").alias(f"_k{i}"), F.col("feature_id").alias(f"_f{i}"))
            if self.sizes[i] <= BROADCAST_VALUES:       # a few hot values must not become a shuffle key
                side = F.broadcast(side)
            out = out.withColumn(f"_k{i}", _text(expr)).join(side, f"_k{i}", "left")
            out = out.withColumn(f"f_{name}", F.coalesce(F.col(f"_f{i}"), F.lit(self.unknown_ids[i])).cast("bigint"))
            out = out.drop(f"_k{i}", f"_f{i}")
        return out.withColumn(features, F.array(*[f"f_{n}" for n in self.fields]))
