"""Rows that splits lose or repeat, counted by tasks of a bounded number of rows."""

import random
from collections import Counter

from rankspark.operators import splits as P
from rankspark.plans import features

COLS = "order_id long, line_no int, item_id long, author_id long, date int"


def sides(spark):
    rng = random.Random(5)
    row = lambda: (rng.randrange(6), rng.randrange(2), 1, rng.choice([None, 2]), 20200101)
    left, right = [row() for _ in range(60)], [row() for _ in range(50)]
    want = Counter(left)
    want.subtract(right)
    return spark.createDataFrame(left, COLS), spark.createDataFrame(right, COLS), {k: n for k, n in want.items() if n}


def test_rows_are_dealt_out_by_their_number(spark, monkeypatch):
    left, right, want = sides(spark)
    monkeypatch.setattr(P, "TASK_ROWS", 10)
    for rows in (None, 0, 110):
        out = P.difference_rows(left, right, rows)
        assert {tuple(r)[:5]: r["surplus"] for r in out.collect()} == want
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert ("RepartitionByExpression" in plan) == (rows is not None)
    assert P.difference_rows(left, right, 110).rdd.getNumPartitions() == 12


def test_differing_lines_meet_their_orders(spark):
    left, right, _ = sides(spark)
    orders = spark.createDataFrame([(0,), (1,), (1,), (4,), (9,)], "order_id long")
    got = features.with_orders(P.difference_rows(left, right, 110), orders)
    want = P.difference_rows(left.join(orders, "order_id"), right.join(orders, "order_id"))
    assert want.columns == got.columns and want.dtypes == got.dtypes
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) != []


def test_split_round_trip_finds_lost_and_repeated_rows(spark, monkeypatch):
    SF = "/root/testdata/sf0.001"
    assert features.split_round_trip(spark, SF).count() == 0
    # only the first year is left in a split
    monkeypatch.setattr(features.T, "SPLITS", {"train": (19950101, 19951231)})
    rows = features.T.impressions(spark, SF)
    lost = features.split_round_trip(spark, SF)
    assert lost.where("surplus < 1 or date between 19950101 and 19951231").count() == 0
    assert lost.groupBy().sum("surplus").first()[0] == rows.where("date not between 19950101 and 19951231").count() > 0
