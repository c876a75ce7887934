import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.operators import quantiles as Q
from rankspark.operators import skew as K


def hot(spark, n=600):
    rng = random.Random(1)
    rows = [("hot" if i % 3 == 0 else f"k{i % 20}", i, rng.choice([None, rng.random()]), rng.randrange(9)) for i in range(n)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, at int, v double, n int").repartition(5)


def as_set(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_dense_index_is_the_sorted_position(spark):
    df = hot(spark)
    got = [r["row_id"] for r in K.dense_index(df, ["at"]).orderBy("at").collect()]
    assert got == list(range(600))


def test_split_heavy(spark):
    light, heavy = K.split_heavy(hot(spark), ["k"], 100)
    assert {r["k"] for r in heavy.select("k").distinct().collect()} == {"hot"}
    assert light.count() + heavy.count() == 600
    assert K.split_heavy(hot(spark), ["k"], 1000)[1] is None


@pytest.mark.parametrize("bound", [100, 7])
def test_heavy_forms_equal_plain_windows(spark, bound):
    df = hot(spark)
    assert as_set(K.number_within(df, ["k"], ["at"], "i", bound)) == as_set(K.number_within(df, ["k"], ["at"], "i"))
    for kind, col in (("sum", "n"), ("max", "v"), ("xor", "n")):
        assert as_set(K.running(df, ["k"], ["at"], col, kind, "r", bound)) == as_set(K.running(df, ["k"], ["at"], col, kind, "r"))
    steps = {"b3": ("n", 3), "b1": ("n", 1), "f2": ("v", -2)}
    assert as_set(K.step_back(df, ["k"], ["at"], steps, bound)) == as_set(K.step_back(df, ["k"], ["at"], steps))


@pytest.mark.parametrize("n,accuracy", [(1, 100), (7, 100), (90, 200), (5000, 2000), (20000, 500000)])
def test_exact_quantiles_match_numpy(spark, n, accuracy):
    rng = np.random.default_rng(n)
    x = np.where(rng.random(n) < 0.3, 5.0, rng.normal(0, 100, n))      # a third of the rows share one value
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    probs = Q.interior(10)
    assert np.allclose(Q.exact_quantiles(df, "x", probs, accuracy), np.quantile(x, probs), rtol=0, atol=1e-9)


def test_count_quantiles(spark):
    counts = [1, 1, 2, 3, 5, 8, 13, 13]
    df = spark.createDataFrame([(c,) for c in counts], "imp bigint")
    assert np.allclose(Q.count_quantiles(df, "imp", Q.interior(10)), np.quantile(counts, Q.interior(10)))


def test_scratch_is_shared_and_required_on_clusters(spark):
    from rankspark import session
    assert session.pin(spark.range(3)).count() == 3
    assert session.scratch_root(spark) == session.scratch_root(spark)

    class Conf:
        def __init__(self, value):
            self.value = value

        def get(self, key, default):
            return self.value or default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        def __init__(self, value=None):
            self.conf = Conf(value)

    assert session.scratch_root(Session("hdfs://shared/scratch/")) == "hdfs://shared/scratch"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch_root(Session())


def test_scalar_helpers(spark):
    from rankspark import functions as R
    row = spark.range(1).select(
        R.general_format(F.lit(0.5)).alias("a"), R.general_format(F.lit(1234567.0)).alias("b"), R.general_format(F.lit(0.0)).alias("c"),
        R.general_format(F.lit(-0.00001234567)).alias("d"), R.general_format(F.lit(100.0)).alias("e"),
        R.bucket_left(F.lit(1.0), [0.5, 1.0, 2.0]).alias("f"), R.sigmoid(F.lit(-1000.0)).alias("g"), R.softplus(F.lit(800.0)).alias("h"),
        R.binary_label(F.lit("0")).alias("i"), R.binary_label(F.lit("")).alias("j"), R.binary_label(F.lit(None).cast("string")).alias("k"),
        R.smoothed_rate(F.lit(2), F.lit(3), 20.0, 0.5).alias("l"), R.smoothed_rate(F.lit(None), F.lit(None), 20.0, 0.25).alias("m"),
        R.topic_key(F.lit("  A  b\tC ")).alias("n"), R.map_mean(F.expr("map('0', 1.0D, '1', null, '2', 2.0D)")).alias("o")).first()
    assert [row[c] for c in "abcde"] == [f"{v:.6g}" for v in (0.5, 1234567.0, 0.0, -0.00001234567, 100.0)]
    assert row["f"] == int(np.searchsorted([0.5, 1.0, 2.0], 1.0))
    assert row["g"] == pytest.approx(1 / (1 + np.exp(30))) and row["h"] == 800.0
    assert (row["i"], row["j"], row["k"]) == (0, 1, 1)
    assert row["l"] == pytest.approx(12 / 23) and row["m"] == 0.25
    assert row["n"] == "a b c" and row["o"] == 1.5


def test_null_is_a_heavy_key_like_any_other(spark):
    df = spark.createDataFrame([(None if i % 2 else "a", i) for i in range(40)], "k string, v bigint")
    light, heavy = K.split_heavy(df, ["k"], 10)
    assert light.count() == 0 and heavy.count() == 40
    got = {(r["k"], r["v"]): r["n"] for r in K.number_within(df, ["k"], ["v"], "n", 10).collect()}
    assert got == {(None if i % 2 else "a", i): i // 2 for i in range(40)}
    total = {(r["k"], r["v"]): r["t"] for r in K.running(df, ["k"], ["v"], "v", "sum", "t", 10).collect()}
    assert total[(None, 39)] == sum(range(1, 40, 2)) and total[("a", 38)] == sum(range(0, 40, 2))
