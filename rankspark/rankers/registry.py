"""Rankers by name: what each may learn from, what it gives back, and one report over any set of them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import partial, reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import hash_uniform, smoothed_rate
from rankspark.operators.dense import DenseFeatures, DenseModel
from rankspark.operators.metrics import Metric, ranking_report
from rankspark.operators.rates import global_rate, lookup, rate_table
from rankspark.operators.vocab import CategoricalIndexer
from rankspark.rankers.boost import BoostConfig, BoostedRanker, train_boosted
from rankspark.rankers.fm import FMConfig, FMModel, train_fm
from rankspark.rankers.study import together
from rankspark.session import pin


@dataclass(frozen=True)
class Task:
    """The rows a ranker fits on (``train``) and stops by (``select``), and what their columns mean."""
    train: DataFrame
    select: DataFrame
    user: str
    item: str
    keys: Sequence[str]
    fields: Mapping[str, Column]                            # of the factorization machines
    dense: DenseFeatures = field(default_factory=DenseFeatures)   # of the boosted trees
    label: str = "label"
    fm: FMConfig = FMConfig()
    boost: BoostConfig = BoostConfig()
    prior: float = 20.0
    monitor: Metric | None = None                           # what early stopping watches; None: the primary


class Scorer(Protocol):
    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with one more column; higher is better."""
        ...


#: Factories by name; add to them with ``register``.
RANKERS: dict[str, Callable[[Task], Scorer]] = {}


def register(name: str) -> Callable:
    """Decorator that names a factory; a name can be taken once."""
    def add(factory: Callable[[Task], Scorer]) -> Callable[[Task], Scorer]:
        if name in RANKERS:
            raise ValueError(f"a ranker named {name} exists")
        RANKERS[name] = factory
        return factory
    return add


def fit(name: str, task: Task) -> Scorer:
    if name not in RANKERS:
        raise KeyError(f"no ranker named {name}; known: {', '.join(sorted(RANKERS))}")
    return RANKERS[name](task)


def compare(task: Task, report: Mapping[str, DataFrame], names: Sequence[str], extra: Sequence[Metric] = ()) -> DataFrame:
    """Fit the named rankers, several at a time, and report each on each split: one row per (ranker, split).

    All scores go through one report, so the splits are grouped once whatever the number of rankers.
    """
    fitted = together([partial(fit, n, task) for n in names])
    kept = list(dict.fromkeys([task.user, task.label, *task.keys]))
    parts = [scorer.transform(df).select(F.lit(n).alias("ranker"), F.lit(split).alias("split"), *kept, "score")
             for n, scorer in zip(names, fitted, strict=True) for split, df in report.items()]
    scored = reduce(DataFrame.unionByName, parts)
    return ranking_report(scored, task.user, task.label, tiebreak=list(task.keys), by=["ranker", "split"], extra=extra)


# ---- the library's own rankers ------------------------------------------------

@dataclass
class _ByItemRate:
    task: Task
    rates: DataFrame
    mean: float

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        found = lookup(df, self.rates, self.task.item)
        return found.select(*df.columns, smoothed_rate("_pos", "_imp", self.task.prior, self.mean).alias(name))


@dataclass
class _ByKey:
    keys: Sequence[str]
    seed: int

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        return df.withColumn(name, hash_uniform(F.lit(self.seed), *self.keys))


@dataclass
class _ByFields:
    task: Task
    indexer: CategoricalIndexer
    model: FMModel

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        return self.model.transform(self.indexer.transform(df), list(self.task.keys), name=name).select(*df.columns, name)


@dataclass
class _ByTrees:
    dense: DenseModel
    model: BoostedRanker

    def transform(self, df: DataFrame, name: str = "score") -> DataFrame:
        return self.model.transform(self.dense.transform(df), name).select(*df.columns, name)


@register("popularity")
def _popularity(task: Task) -> Scorer:
    rates = pin(rate_table(task.train, [task.item], task.label, "_pos", "_imp"), "item_rates")
    return _ByItemRate(task, rates, global_rate(task.train, task.label))


@register("random")
def _random(task: Task) -> Scorer:
    return _ByKey(task.keys, task.fm.seed)


def _machine(loss: str, task: Task) -> Scorer:
    keys = list(task.keys)
    indexer = CategoricalIndexer(task.fields).fit(task.train, keys)
    model = train_fm(indexer.transform(task.train), indexer.transform(task.select), indexer.dim, len(task.fields), task.user, keys,
                     replace(task.fm, loss=loss), label=task.label, monitor=task.monitor)
    return _ByFields(task, indexer, model)


def _trees(objective: str, task: Task) -> Scorer:
    spec = replace(task.dense, user=task.user, item=task.item, label=task.label)
    dense = spec.fit(task.train)
    model = train_boosted(pin(dense.transform(task.train), "dense_train"), pin(dense.transform(task.select), "dense_select"), task.user, list(task.keys),
                          task.boost, task.label, objective, task.monitor)
    return _ByTrees(dense, model)


for _loss in ("pointwise", "bpr", "softmax"):
    register(f"fm_{_loss}")(partial(_machine, _loss))
for _objective in ("binary", "lambdarank"):
    register(f"gbt_{_objective}")(partial(_trees, _objective))
