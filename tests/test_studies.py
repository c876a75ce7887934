import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from rankspark.operators import paired as B
from rankspark.operators import studies as X


def scores(spark, nodes):
    rows = [(n, s, u, v) for n, seeds in nodes.items() for s, users in seeds.items() for u, v in users.items()]
    return spark.createDataFrame(rows, "node_id string, seed int, user_id string, primary double")


PAIR = [("cand", "parent")]


def deltas(spark, cand, parent):
    pairs = spark.createDataFrame(PAIR, "node_id string, parent_id string")
    return B.paired_deltas(scores(spark, {"cand": cand, "parent": parent}), pairs)


def test_bootstrap_known_lift(spark):
    d = deltas(spark, {0: {"u1": .7, "u2": .6}, 1: {"u1": .72, "u2": .61}}, {0: {"u1": .5, "u2": .5}, 1: {"u1": .5, "u2": .5}})
    r = B.paired_bootstrap(d, draws=200).first()
    assert r["mean_delta"] > .1 and r["p_positive"] == 1.0 and r["lower_95"] > 0


def test_bootstrap_without_shared_seed_is_zero(spark):
    d = deltas(spark, {0: {"u1": .7}}, {1: {"u1": .5}})
    nodes = spark.createDataFrame([("cand",)], "node_id string")
    r = B.with_missing(B.paired_bootstrap(d, draws=50), nodes).first()
    assert (r["mean_delta"], r["p_positive"], r["lower_95"]) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("method", ["multinomial", "poisson"])
def test_bootstrap_matches_theory(spark, method):
    rng = random.Random(3)
    vals = [rng.gauss(0.02, 0.3) for _ in range(400)]
    df = spark.createDataFrame([("n", 0, f"u{i}", v) for i, v in enumerate(vals)], "node_id string, seed int, user_id string, delta double")
    r = B.paired_bootstrap(df, draws=1000, method=method).first()
    mean = sum(vals) / 400
    se = math.sqrt(sum((v - mean) ** 2 for v in vals) / 400) / 20
    assert r["mean_delta"] == pytest.approx(mean)
    assert r["lower_95"] == pytest.approx(mean - 1.645 * se, abs=0.15 * se)
    assert r["p_positive"] == pytest.approx(0.5 * (1 + math.erf(mean / se / math.sqrt(2))), abs=0.04)


def test_multinomial_draws_meet_blocks_of_values(spark, monkeypatch):
    """Tasks look their draws up in blocks of a group; the result is that of one table of all values."""
    rows = [(g, 0, f"u{i:03d}", (i * 37 % 101) / 100 - 0.45) for g, n in (("a", 53), ("b", 20), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame([*rows, ("b", 0, "u900", None)], "node_id string, seed int, user_id string, delta double")
    monkeypatch.setattr(B, "BLOCK_VALUES", 7)
    got = {r["node_id"]: r for r in B.paired_bootstrap(df, draws=40, method="multinomial").collect()}
    for g in "abc":
        values = [r[3] for r in rows if r[0] == g] + [None] * (g == "b")
        means = []
        for b in range(40):
            drawn = []
            for i in range(len(values)):
                h = int(hashlib.md5(f"0|{g}|{i}".encode()).hexdigest()[:15], 16)
                low, prime = h & (1 << 30) - 1, B.MIX_PRIME
                first = (((low + b * 1000003) % prime) ** 2 + (h >> 30)) % prime
                drawn.append(values[(first * 2 ** 31 + (first * first + low) % prime) % len(values)])
            drawn = [v for v in drawn if v is not None]
            means.append(sum(drawn) / len(drawn))
        assert got[g]["p_positive"] == pytest.approx(sum(m > 0 for m in means) / 40)
        assert got[g]["lower_95"] == pytest.approx(sorted(means)[2])


def test_clustered_bootstrap_averages_seeds_first(spark):
    d = deltas(spark, {s: {"u1": .6, "u2": .4} for s in range(3)}, {s: {"u1": .5, "u2": .5} for s in range(3)})
    assert B.paired_bootstrap(d, draws=50, cluster="user_id").first()["n"] == 2


@pytest.mark.parametrize("cand,parent,want", [
    ({"u1": .5, "u2": .6}, {"u1": .5, "u2": .6}, True), ({"u1": .5}, {"u1": .5001}, False),
    ({"u1": .5}, {"u2": .5}, None), ({}, {"u1": .5}, None)])
def test_no_op(spark, cand, parent, want):
    r = B.no_op_nodes(deltas(spark, {0: cand}, {0: parent}), seed=0).first()
    assert (r and r["no_op"]) == want


@pytest.mark.parametrize("stats,want", [((.0007, .95, .0002), True), ((.0007, .60, -.0004), False), ((-.002, .10, -.005), False)])
def test_continue(spark, stats, want):
    df = spark.createDataFrame([stats], "mean_delta double, p_positive double, lower_95 double")
    assert df.select(B.continue_locally().alias("c")).first()["c"] == want


@pytest.mark.parametrize("stats,want", [((.0010, .0003), True), ((.0002, .0001), False), ((.0010, -.0001), False)])
def test_promote(spark, stats, want):
    df = spark.createDataFrame([stats], "mean_delta double, lower_95 double")
    assert df.select(B.promotes().alias("c")).first()["c"] == want


def series(spark, values, col="iter_primary"):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(values)], f"study_id string, iter int, {col} double")


def listed(df, col):
    return [r[col] for r in df.orderBy("iter").collect()]


@pytest.mark.parametrize("bound", [None, "2"])
@pytest.mark.parametrize("values,best,improvement", [
    ([.60, .58], [.60, .60], [None, None]), ([None], [.5946], [None]),
    ([.5960, .5970, .5975, .5990], [.5960, .5970, .5975, .5990], [None, None, .0029, .0030])])
def test_trajectory(spark, values, best, improvement, bound):
    if bound:
        spark.conf.set("spark.rankspark.heavy.rows", bound)
    try:
        t = X.running_best(series(spark, values), "iter_primary", .5946)
        assert listed(t, "running_best") == best
        got = listed(X.improvement_score(t, .5946), "improvement_score")
    finally:
        spark.conf.unset("spark.rankspark.heavy.rows")
    assert [g if g is None else round(g, 10) for g in got] == improvement


@pytest.mark.parametrize("values,want", [([.5, .51, .511, .5115, .5116], True), ([.5, .51, .52, .55, .60], False), ([.5, .5, .5], False)])
def test_plateau(spark, values, want):
    t = X.running_best(series(spark, values), "iter_primary", 0.0)
    assert listed(X.plateau(t, epsilon=.002, window=3), "plateau")[-1] == want


@pytest.mark.parametrize("values,want", [
    ({"a": .01, "b": .001, "c": .005}, "b"), ({"x": .02, "b": .006, "a": .006}, "a"), ({"a": .005, "b": .001}, None),
    ({"features": .02365, "regularization": .00044, "capacity": .00041}, "capacity")])
def test_weakest(spark, values, want):
    df = spark.createDataFrame([("s", k, v) for k, v in values.items()], "study_id string, component string, delta double")
    assert X.weakest_component(df).first()["component"] == want


def test_triage_takes_the_most_uncertain_of_the_rest(spark):
    rows = [("s", i, .60 - i / 100, 3) for i in range(4)] + [("s", 4, None, 0)]
    df = spark.createDataFrame(rows, "study_id string, id int, score double, runs int")
    mean, std = X.posterior("score", "runs")
    df = df.withColumn("post_mean", mean).withColumn("post_std", std)
    got = {r["id"]: r["reason"] for r in X.triage(df, keep=3, order=["id"]).collect()}
    assert got == {0: "mean", 1: "mean", 4: "wildcard"}
    assert {r["id"] for r in X.triage(df.where("id < 2"), keep=3, order=["id"]).collect()} == {0, 1}
    assert {r["id"] for r in X.triage(df, keep=3, wildcard=False, order=["id"]).collect()} == {0, 1, 2}


def test_ucb_prefers_unvisited(spark):
    df = spark.createDataFrame([("s", 0, .9, 5, 10.0), ("s", 1, .1, 0, 0.0), ("s", 2, .1, 0, 0.0)],
                               "study_id string, id int, primary double, visits int, seconds double")
    assert X.ucb_pick(df, order=["id"]).first()["id"] == 1
    one = X.ucb_scores(df.where("id = 0")).first()["ucb"]
    assert one == pytest.approx(.9 + .7 * math.sqrt(math.log(5) / 5) - .05 * 10 / 60)


def node(spark, rows):
    return spark.createDataFrame(rows, "study_id string, id int, iter int, status string, primary double, operation string, runs int")


def test_stop_and_summary(spark):
    n = node(spark, [("s", 0, 1, "open", .60, "improve", 1), ("s", 1, 2, "closed", .59, "fix", 1)])
    assert not X.global_stop(n, 10, .55).first()["stop"]
    assert X.global_stop(n, 2, .55).first()["stop"]                       # no iterations remain
    assert X.global_stop(n.where("status = 'closed'"), 10, .55).first()["stop"]
    s = X.final_summary(n, .55).first()
    assert s["still_baseline"] and s["best_unconfirmed"] == .60 and s["promotions"] == 0
    s = X.final_summary(n.withColumn("status", F.lit("promoted")), .55).first()
    assert not s["still_baseline"] and s["best"] == .60 and s["best_unconfirmed"] is None


def test_refine_trigger(spark):
    rows = [("s", i, i, "open", .56, "improve", 1) for i in range(2)] + [("s", 2, 2, "closed", .50, "refine", 1)]
    rows += [("s", i, i, "open", .57 + i / 1000, "improve", 1) for i in range(3, 6)]
    r = X.refine_triggers(node(spark, rows), .55).first()
    assert (r["improves"], r["cadence"], r["target"]) == (3, True, 5)
    low = X.refine_triggers(node(spark, [("s", 0, 0, "open", .5504, "improve", 1)]), .55).first()
    assert not low["cadence"] and low["target"] is None


def test_text_ids_and_log_order(spark):
    """Ids are names; the log decides ties."""
    rows = [("s", "b", 1, 0, "open", .60, "improve", 1, 2, 6.0), ("s", "a", 1, 1, "open", .60, "improve", 1, 2, 6.0), ("s", "fcb3faae", 2, 2, "promoted", .58, "refine", 1, 2, 6.0),
            ("s", "0aa", 3, 3, "promoted", .58, "improve", 1, 0, 6.0), ("s", "zz", 3, 4, "open", .57, "improve", 0, 0, 6.0)]
    df = spark.createDataFrame(rows, "study_id string, node string, iter int, seq int, status string, primary double, operation string, runs int, visits int, seconds double")
    how = {"id": "node", "order": ["iter", "seq"]}
    assert X.champion(df, .5, **how).first()["node"] == "fcb3faae"
    assert X.ucb_pick(df.where("status = 'open'"), **how).first()["node"] == "zz"
    assert X.ucb_pick(df.where("visits > 0"), **how).first()["node"] == "b"
    mean, std = X.posterior("primary", "runs")
    picked = X.triage(df.withColumn("post_mean", mean).withColumn("post_std", std), keep=2, **how).collect()
    assert {r["node"]: r["reason"] for r in picked} == {"b": "mean", "zz": "wildcard"}
    grid = spark.createDataFrame([("s", "slow", .6), ("s", "fast", .6), ("s", "none", .1)], "study_id string, pace string, score double")
    assert X.best_config(grid, ["study_id"], ["pace"], "score").first()["pace"] == "fast"
    scores = spark.createDataFrame([("s", 2, .1), ("s", 3, .0005)], "study_id string, iter int, improvement_score double")
    r = X.refine_triggers(df, .55, scores, **how).first()
    assert (r["improves"], r["cadence"], r["plateau"], r["target"]) == (1, False, True, "b")  # two improvements in one iteration


def test_sessions(spark):
    df = spark.createDataFrame([("s", i, e) for i, e in enumerate([10.0, 30.0, 5.0, 25.0, 40.0])], "study_id string, iter int, elapsed_s double")
    r = X.session_wallclock(df).first()
    assert (r["total_s"], r["sessions"], r["iterations"]) == (70.0, 2, 5)


def test_lineage(spark):
    rows = [(i, i - 1 if i else None) for i in range(37)] + [(100, None), (101, 100)]
    got = {r["id"]: (r["root"], r["depth"]) for r in X.lineage_roots(spark.createDataFrame(rows, "id int, parent_id int")).collect()}
    assert got == {**{i: (0, i) for i in range(37)}, 100: (100, 0), 101: (100, 1)}
    with pytest.raises(ValueError):
        X.lineage_roots(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent_id int"))


def test_exhausted_and_proposals(spark):
    rows = [("s", "a", "closed", d) for d in (None, -.1, .0001, -.2, .00015)] + [("s", "b", "closed", .01)] * 5 + [("s", "c", "closed", -.1)] * 4
    df = spark.createDataFrame(rows, "study_id string, component string, status string, mean_delta double")
    assert [r["component"] for r in X.exhausted_families(df).collect()] == ["a"]
    d = spark.createDataFrame([("slow", "Scores are FLAT", .9), ("slow", "rising", .4), ("slow", "rising", None), ("slow", "rising", .5)],
                              "bottleneck string, evidence string, confidence double")
    assert [r["proposals"] for r in X.proposal_counts(d).collect()] == [3, 3, 1, 1]


def test_implausible(spark):
    df = spark.createDataFrame([("s", i, i, v) for i, v in enumerate([.59, .60, .63, None, .64, .87])], "study_id string, iter int, id int, primary double")
    assert sorted(r["id"] for r in X.implausible_scores(df, "primary").collect()) == [2, 5]
