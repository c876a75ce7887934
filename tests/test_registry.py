"""Metrics and rankers that a caller adds without touching the library."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators.dense import DenseFeatures
from rankspark.operators.metrics import Metric, per_group_scores, ranking_report
from rankspark.operators.rates import global_rate, rate_sets, rate_table
from rankspark.rankers import boost as G
from rankspark.rankers import fm
from rankspark.rankers import registry as R

PRECISION = Metric("precision", lambda y, at: {"hits": F.sum(F.when(at <= 2, y).otherwise(0))}, lambda rows, pos, s: s["hits"] / F.lit(2.0))
MRR = Metric("mrr", lambda y, at: {"first": F.min(F.when(y == 1, at))}, lambda rows, pos, s: 1.0 / s["first"], weight=lambda rows, pos, s: pos)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(5)
    data = [(i, None if i % 11 == 0 else "hot" if i % 3 == 0 else f"u{i % 9}", int(rng.random() < 0.3), float(rng.integers(0, 8))) for i in range(240)]
    data += [(900, "none", 0, 1.0), (901, "none", 0, 2.0)]
    return data, spark.createDataFrame(data, "row_id bigint, user_id string, label int, score double")


@pytest.mark.parametrize("bound", [None, 5])
def test_own_metrics_match_a_plain_loop(rows, bound):
    data, df = rows
    want, weights = {}, {}
    for user in {r[1] for r in data}:
        mine = sorted((r for r in data if r[1] == user), key=lambda r: (-r[3], r[0]))
        places = [n for n, r in enumerate(mine, 1) if r[2]]
        want[user] = (sum(r[2] for r in mine[:2]) / 2, 1 / places[0] if places else None)
        weights[user] = len(places)
    got = per_group_scores(df, "user_id", max_rows=bound, extra=[PRECISION, MRR]).collect()
    assert {r["user_id"]: (r["precision"], r["mrr"]) for r in got} == want
    report = ranking_report(df, max_rows=bound, extra=[PRECISION, MRR]).first()
    assert report["precision"] == pytest.approx(np.mean([p for p, _ in want.values()]))
    known = [u for u in want if want[u][1] is not None]
    assert report["mrr"] == pytest.approx(sum(weights[u] * want[u][1] for u in known) / sum(weights[u] for u in known))
    plain = ranking_report(df, max_rows=bound).first()
    assert [report[c] for c in plain.asDict()] == pytest.approx(list(plain))


def test_own_metrics_of_no_rows(rows):
    report = ranking_report(rows[1].limit(0), extra=[PRECISION, MRR]).first()
    assert (report["precision"], report["mrr"], report["users"]) == (0.0, 0.0, 0)


@pytest.fixture(scope="module")
def log(spark):
    """Items whose rates differ, over users, authors and tabs."""
    rng = np.random.default_rng(6)
    rate = rng.random(20)
    data = []
    for n in range(3000):
        item = int(rng.integers(20))
        data.append((n, f"u{rng.integers(30)}", item, item % 4, f"t{rng.integers(3)}", float(rng.integers(1, 90)), int(rng.random() < rate[item])))
    df = spark.createDataFrame(data, "row_id bigint, user_id string, item_id int, author_id int, tab string, duration_ms double, label int")
    return df.where("row_id < 2200").cache(), df.where("row_id between 2200 and 2599").cache(), df.where("row_id >= 2600").cache()


def task(log, **kw):
    fields = {"user_id": F.col("user_id").cast("string"), "item_id": F.col("item_id").cast("string")}
    return R.Task(log[0], log[1], "user_id", "item_id", ["row_id"], fields, fm=fm.FMConfig(k=4, lr=0.1, epochs=4, patience=2, init_std=0.1),
                  boost=G.BoostConfig(rounds=4, patience=2, learning_rate=0.5, max_depth=3, min_rows=20), **kw)


def test_every_named_ranker_beats_random(log):
    names = ["random", "popularity", "fm_pointwise", "fm_bpr", "fm_softmax", "gbt_binary", "gbt_lambdarank"]
    got = {r["ranker"]: r for r in R.compare(task(log), {"test": log[2]}, names, [PRECISION]).collect()}
    assert set(got) == set(names) and {r["rows"] for r in got.values()} == {400}
    for name in names[1:]:
        assert got[name]["primary"] > got["random"]["primary"] + 0.05, name
        assert got[name]["precision"] > got["random"]["precision"], name


def test_a_new_ranker_needs_only_a_name(log, monkeypatch):
    monkeypatch.setattr(R, "RANKERS", dict(R.RANKERS))

    class ByLabel:
        def transform(self, df, name="score"):
            return df.withColumn(name, F.col("label"))
    R.register("oracle")(lambda task: ByLabel())
    got = {r["ranker"]: r["primary"] for r in R.compare(task(log), {"test": log[2]}, ["oracle", "popularity"]).collect()}
    assert got["oracle"] > got["popularity"]
    with pytest.raises(ValueError, match="exists"):
        R.register("oracle")(lambda task: ByLabel())
    with pytest.raises(KeyError, match="known: "):
        R.fit("no such", task(log))


@pytest.mark.parametrize("name", ["fm_pointwise", "gbt_binary"])
def test_early_stopping_watches_the_given_metric(log, name):
    worse = Metric("early", lambda y, at: {"n": F.count(F.lit(1))}, lambda rows, pos, s: -s["n"].cast("double"))
    scorer = R.fit(name, task(log, monitor=worse))
    history = scorer.model.history
    watched = [h[2] if isinstance(h, tuple) else h for h in history]
    assert len(set(watched)) == 1 and watched[0] < -1       # never better than the first: patience ends it
    assert len(history) == 3


def test_rate_sets_equal_single_tables(spark, log):
    train = log[0].unionByName(spark.createDataFrame([(9000, None, 3, None, "t0", 1.0, 1), (9001, None, 99, None, "t9", 1.0, None)], log[0].schema))
    keys = ["item_id", "author_id", "user_id", "tab"]
    sets = rate_sets(train, keys).cache()
    for key in keys:
        want = {(r[0], r[1] or 0, r[2]) for r in rate_table(train, [key]).collect()}
        assert {(r[key], r["_pos"], r["_imp"]) for r in sets.where(F.col("_set") == key).collect()} == want
    whole = sets.where("_set = ''").first()
    assert whole["_pos"] / whole["_known"] == pytest.approx(global_rate(train))
    plan = rate_sets(log[0], keys)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") == 1


def test_dense_features_of_an_empty_train(log):
    model = DenseFeatures().fit(log[0].limit(0))
    assert model.mean == 0.0
    assert model.transform(log[2]).where("item_is_new = 1").count() == 400
