import math
import random

import pytest

from rankspark.operators import metrics as M


def frame(spark, rows):
    data = [(i, u, y, float(s)) for i, (u, y, s) in enumerate(rows)]
    return spark.createDataFrame(data, "row_id bigint, user_id string, label int, score double")


def report(spark, rows, **kw):
    return M.ranking_report(frame(spark, rows), **kw).first()


def brute(rows, k=5):
    """Pairwise AUC and textbook nDCG per user."""
    users = {}
    for u, y, s in rows:
        users.setdefault(u, []).append((y, s))
    out = {}
    for u, items in users.items():
        pos, neg = [s for y, s in items if y], [s for y, s in items if not y]
        auc = 0.5
        if pos and neg:
            auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
        ranked = [y for y, _ in sorted(items, key=lambda t: -t[1])][:k]
        best = sorted((y for y, _ in items), reverse=True)[:k]
        def dcg(ys):
            return sum(y / math.log2(i + 2) for i, y in enumerate(ys))
        out[u] = (len(items), len(pos), auc, dcg(ranked) / dcg(best) if pos else 0.0)
    return out


def test_all_tied(spark):
    r = report(spark, [("u1", y, 0.5) for y in (0, 1, 0, 1)])
    assert r["gauc"] == 0.5 and r["users"] == 1 and r["rows"] == 4


def test_one_class_users(spark):
    up = report(spark, [("u1", 1, s) for s in (0.1, 0.9, 0.5)])
    assert up["ndcg"] == 1.0 and up["gauc"] == 0.5
    down = report(spark, [("u1", 0, s) for s in (0.1, 0.9, 0.5)])
    assert down["ndcg"] == 0.0 and down["gauc"] == 0.5


def test_separable_and_two_users(spark):
    assert report(spark, [("u1", 0, 0.1), ("u1", 1, 0.9), ("u1", 0, 0.2), ("u1", 1, 0.8)])["gauc"] == 1.0
    r = report(spark, [("u1", 0, 0.1), ("u1", 1, 0.9), ("u2", 1, 0.2), ("u2", 0, 0.8)])
    assert r["gauc"] == pytest.approx(0.5)
    assert r["ndcg"] == pytest.approx((1 + 1 / math.log2(3)) / 2)
    assert r["primary"] == pytest.approx((r["gauc"] + r["ndcg"]) / 2)


def test_empty_report(spark):
    r = M.ranking_report(frame(spark, []).where("false")).first()
    assert (r["gauc"], r["ndcg"], r["users"], r["rows"]) == (0.5, 0.0, 0, 0)


def test_per_user_primary_keeps_mixed_users(spark):
    rows = [("mixed", 1, 0.9), ("mixed", 0, 0.1), ("allpos", 1, 0.3), ("allneg", 0, 0.2)]
    got = M.per_user_primary(frame(spark, rows)).collect()
    assert [(r["user_id"], r["primary"]) for r in got] == [("mixed", 1.0)]


@pytest.mark.parametrize("max_rows", [10_000, 40, 3])
def test_against_brute_force_with_one_heavy_user(spark, max_rows):
    """A third of all rows belong to one user; every bound gives the same numbers."""
    rng = random.Random(5)
    rows = [("hot" if i % 3 == 0 else f"u{i % 40}", int(rng.random() < 0.4), rng.choice([0.1, 0.2, 0.2, rng.random()]))
            for i in range(900)]
    want = brute(rows)
    got = {r["user_id"]: r for r in M.per_group_scores(frame(spark, rows), "user_id", max_rows=max_rows).collect()}
    assert set(got) == set(want)
    for u, (n, pos, auc, ndcg) in want.items():
        r = got[u]
        assert (r["rows"], r["pos"]) == (n, pos)
        assert r["auc"] == pytest.approx(auc, abs=1e-12)
        assert r["ndcg"] == pytest.approx(ndcg, abs=1e-12)


def test_heavy_user_with_one_score(spark):
    rows = [("hot", i % 2, 0.5) for i in range(300)] + [("u", i % 2, i) for i in range(6)]
    r = M.ranking_report(frame(spark, rows), max_rows=10).first()
    s = M.ranking_report(frame(spark, rows)).first()
    assert r["gauc"] == pytest.approx(s["gauc"]) and r["ndcg"] == pytest.approx(s["ndcg"])


def test_signed_zero_scores_tie(spark):
    r = report(spark, [("u", 1, 0.0), ("u", 0, -0.0)])
    assert r["gauc"] == 0.5


@pytest.mark.parametrize("max_rows", [None, 4])
def test_pair_outcomes_and_average_ranks(spark, max_rows):
    rng = random.Random(2)
    rows = [(f"u{i % 3}", int(rng.random() < 0.5), rng.randrange(5)) for i in range(60)]
    df = frame(spark, rows)
    got = {r["user_id"]: r for r in M.pair_outcomes(df, "user_id", max_rows=max_rows).collect()}
    for u in ("u0", "u1", "u2"):
        pos = [s for v, y, s in rows if v == u and y]
        neg = [s for v, y, s in rows if v == u and not y]
        assert got[u]["concordant"] == sum(p > n for p in pos for n in neg)
        assert got[u]["discordant"] == sum(p < n for p in pos for n in neg)
        assert got[u]["tied"] == sum(p == n for p in pos for n in neg)
    ranks = {(r["user_id"], r["score"]): r["avg_rank"] for r in M.average_ranks(df, "user_id", max_rows=max_rows).collect()}
    for u in ("u0", "u1", "u2"):
        mine = [s for v, _, s in rows if v == u]
        for s in set(mine):
            assert ranks[(u, float(s))] == sum(x < s for x in mine) + (mine.count(s) + 1) / 2


def test_plan_has_one_exchange_on_the_light_path(spark):
    df = frame(spark, [("u1", 1, 0.3), ("u2", 0, 0.2)])
    plan = M._light_groups(df.selectExpr("user_id", "row_id", "label as _y", "0.0 - score as _neg"), ["user_id"], ["row_id"], 5) \
            ._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Sort [") == 1
