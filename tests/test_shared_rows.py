"""Joined rows are written once and read by every later step; rules, boosting and studies leave out work that nothing reads."""

import random

from pyspark.sql import functions as F

from rankspark.operators import rules as G
from rankspark.operators.dense import DenseFeatures
from rankspark.operators.skew import running


def test_rows_meet_their_item_once(spark):
    rows = spark.createDataFrame([(u, i, i % 2, "t", 10.0, (u + i) % 2) for u in range(6) for i in range(5)],
                                 "user_id long, item_id long, author_id long, tab string, duration_ms double, label int")
    model = DenseFeatures().fit(rows)
    assert not hasattr(model, "cross")      # the cross is a part of the item's row
    out = model.transform(rows)
    sums = rows.groupBy("item_id").agg(F.sum("label").alias("p"), F.count("*").alias("n"))
    # one bucket only, so a cell holds all rows of its item
    assert {b for (b,) in model.users.select("_bucket").distinct().collect()} == {0}
    want = {r["item_id"]: (r["p"] + 10.0 * (r["p"] + 20.0 * model.mean) / (r["n"] + 20.0)) / (r["n"] + 10.0) for r in sums.collect()}
    for r in out.collect():
        assert abs(r["item_rate_by_user_bucket"] - want[r["item_id"]]) < 1e-12


def test_running_before_this_row(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(2), i, rng.choice([None, rng.randrange(100)])) for i in range(60)]
    df = spark.createDataFrame(rows, "k int, i int, v long")
    for kind, combine in (("max", max), ("sum", lambda a, b: a + b)):
        want, last = {}, {}
        for k, i, v in rows:
            want[i] = last.get(k)
            if v is not None:
                last[k] = v if last.get(k) is None else combine(last[k], v)
        for bound in (1000, 4):
            got = {r["i"]: r["m"] for r in running(df, ["k"], ["i"], "v", kind, "m", max_rows=bound, before=True).collect()}
            assert got == want


def test_only_the_named_rules_are_scanned(spark):
    df = spark.createDataFrame([(1, "wget http://x\nlong_view = 1\nsplit = 'test'")], "id int, text string")
    every = [(r["rule"], r["detail"]) for r in G.rule_hits(df, "id").collect()]
    assert {r for r, _ in every} >= {1, 3}
    for n in G.RULES:
        out = G.rule_hits(df, "id", only=(n,))
        assert [(r["rule"], r["detail"]) for r in out.collect()] == [h for h in every if h[0] == n]
