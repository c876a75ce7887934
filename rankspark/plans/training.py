"""Registered ranker queries.

The table's own labels carry no signal.  The trained factorization machines therefore learn labels planted by a hash of the item and
run until early stopping ends them; what they report (rows, users, whether the scores beat chance, whether the best epoch was
restored) has SQL.  Single updates over the whole train split are compared number by number.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import hash_uniform
from rankspark.operators.dense import DenseFeatures
from rankspark.operators.metrics import ranking_report
from rankspark.operators.pairs import sample_pairs as draw_pairs
from rankspark.plans import features as P
from rankspark.plans import sqltext as S
from rankspark.plans.ranking import KEY, rounded, split_impressions
from rankspark.rankers import boost as G
from rankspark.rankers import fm
from rankspark.rankers import registry as R
from rankspark.rankers import study as Y
from rankspark.session import pin

#: Runs to early stopping.
TRAINED = fm.FMConfig(k=16, lr=0.02)
#: Studies of many runs.
SMALL = fm.FMConfig(k=8, lr=0.1, patience=1, min_gain=0.002)
STEP = fm.FMConfig(k=3, lr=0.01)
#: Boosting to early stopping.
BOOSTED = G.BoostConfig(rounds=600, patience=2, learning_rate=0.5, max_depth=4, min_rows=20, min_gain=0.002)
#: Share of the way from chance to the planted scores that a trained machine has to make.
NEAR = 0.5
K = 4


def pair_sample(spark, sf_dir):
    train = P.train_rows(spark, sf_dir).select("user_id", "label", *KEY)
    out = draw_pairs(train, "user_id", KEY, negatives=2, seed=7, epoch=1)
    return out.select("user_id", *KEY, "draw", *[f"neg_{k}" for k in KEY])


def fm_score_relational(spark, sf_dir):
    """FM scores of all rows under parameters drawn from a hash of the feature id."""
    rows = split_impressions(spark, sf_dir)
    model = P.base_indexer(rows)
    u = lambda *p: hash_uniform(*p, "feature_id") - 0.5
    params = model.vocabulary().select("feature_id", u(F.lit("w")).alias("w"), *[(u(F.lit("v"), F.lit(j)) * 0.4).alias(f"v{j}") for j in range(K)])
    # later splits hold values that train never saw: their unknown slots have no parameters
    return rounded(fm.fm_scores(model.transform(rows), params, KEY, k=K, bias=0.25), "score")


def _planted(rows):
    """Labels that mostly depend on the item."""
    return rows.withColumn("label", (hash_uniform(F.lit("item"), "item_id") * 0.8 + hash_uniform(F.lit("noise"), *KEY) * 0.2 > 0.6).cast("int"))


def _trained(spark, sf_dir, config):
    rows = pin(_planted(split_impressions(spark, sf_dir)), "planted")       # edges, vocabulary, encoding and reports read them
    indexer = P.base_indexer(rows)
    kept = ["user_id", "label", *KEY, "features"]
    encoded = {s: pin(indexer.transform(rows.where(F.col("split") == s)).select(*kept), "encoded") for s in ("train", "valid_search", "test")}
    select = encoded["valid_search"]
    model = fm.train_fm(encoded["train"], select, indexer.dim, 5, "user_id", KEY, config)
    primary = lambda name: ranking_report(model.transform(encoded[name], KEY), tiebreak=KEY).first()["primary"]
    known = lambda score: ranking_report(select.withColumn("score", score), tiebreak=KEY).first()["primary"]
    chance, optimum = known(hash_uniform(F.lit(0), *KEY)), known(hash_uniform(F.lit("item"), "item_id"))
    best = max(h[2] for h in model.history)
    losses = [h[1] for h in model.history]
    test = rows.where("split = 'test'")
    return test.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users")).select(
        "*", F.lit(best > chance + NEAR * (optimum - chance)).alias("near_optimum"), F.lit(abs(primary("valid_search") - best) < 1e-9).alias("best_restored"),
        F.lit(primary("test") > chance).alias("beats_chance_on_test"), F.lit(losses[-1] < losses[0]).alias("loss_falls"),
        F.lit(len(losses) < config.epochs and best not in [h[2] for h in model.history[-config.patience:]]).alias("stopped_by_patience"))


def fm_pointwise(spark, sf_dir):
    return _trained(spark, sf_dir, TRAINED)


def fm_bpr(spark, sf_dir):
    return _trained(spark, sf_dir, fm.replace(TRAINED, loss="bpr"))


def fm_softmax(spark, sf_dir):
    return _trained(spark, sf_dir, fm.replace(TRAINED, loss="softmax", negatives=4))


def _step(spark, sf_dir, config):
    """Parameters after one update over all train rows from the hashed start."""
    rows = pin(split_impressions(spark, sf_dir).where("split = 'train'"), "rows")    # edges, vocabulary and encoding read them
    indexer = P.base_indexer(rows)
    out = fm.full_step(indexer.transform(rows.where("split = 'train'")), indexer.dim, 5, "user_id", KEY, config)
    return rounded(out, "w", *fm.vector_names(config.k), "bias", "loss")


def fm_step_pointwise(spark, sf_dir):
    return _step(spark, sf_dir, STEP)


def fm_step_bpr(spark, sf_dir):
    return _step(spark, sf_dir, fm.replace(STEP, loss="bpr", negatives=2))


def fm_step_softmax(spark, sf_dir):
    return _step(spark, sf_dir, fm.replace(STEP, loss="softmax", negatives=4))


def fm_table_engine(spark, sf_dir):
    """The engine that keeps parameters in a table makes the same update."""
    return _step(spark, sf_dir, fm.replace(STEP, engine="table"))


def _planted_splits(spark, sf_dir, rows=None):
    rows = pin(_planted(split_impressions(spark, sf_dir) if rows is None else rows), "planted")
    train, select = rows.where("split = 'train'"), rows.where("split = 'valid_search'")
    known = lambda score: ranking_report(select.withColumn("score", score), tiebreak=KEY).first()["primary"]
    chance, optimum = known(hash_uniform(F.lit(0), *KEY)), known(hash_uniform(F.lit("item"), "item_id"))
    return rows, train, select, chance + NEAR * (optimum - chance)


def grid_search(spark, sf_dir):
    """Two learning rates, one of them far too small, with three seeds each; the winner scores the test split."""
    rows, train, select, near = _planted_splits(spark, sf_dir)
    fields = P._fields(P._duration_edges(train))
    indexer, model, runs = Y.best_model(fields, train, select, "user_id", KEY, SMALL, {"lr": (1e-6, SMALL.lr)}, (0, 1, 2))
    test = rows.where("split = 'test'")
    scored = ranking_report(model.transform(indexer.transform(test), KEY), tiebreak=KEY)
    best = max(r[2] for r in runs)
    return scored.select("users", "rows", F.lit(len(runs)).alias("runs"), F.lit(model.config.lr).alias("lr"), F.lit(best > near).alias("near_optimum"),
                         F.lit(max(h[2] for h in model.history) == best).alias("winner_returned"))


def field_ablation(spark, sf_dir):
    rows, train, select, near = _planted_splits(spark, sf_dir, P.wide_rows(spark, sf_dir))
    base = P._fields(P._duration_edges(train))
    sets = {m: {**base, **P.named_fields(*extra)} for m, extra in P.FIELD_SETS.items()}
    out = Y.field_set_runs(sets, train, select, {"valid_search": select}, "user_id", KEY, SMALL)
    return out.select("mode", "n_fields", "split", "seeds", (F.col("primary") > near).alias("near_optimum"), (F.col("spread") < 0.05).alias("steady"))


def ablation_runs(spark, sf_dir):
    """Labels depend on the item, so no removed component takes the machine below the planted bound."""
    rows, train, select, near = _planted_splits(spark, sf_dir)
    fields = P._fields(P._duration_edges(train))
    out = Y.ablation_runs(fields, train, select, "user_id", "item_id", KEY, SMALL)
    return out.select("component", (F.col("primary") > near).alias("near_optimum"), (F.abs("delta") < 0.1).alias("small_delta"))


def oof_scores(spark, sf_dir):
    """Users, rows and quality of each fold's scores, made by machines that never saw the fold."""
    rows, train, select, near = _planted_splits(spark, sf_dir)
    indexer = P.base_indexer(rows)
    out = pin(Y.oof_scores(indexer.transform(train), indexer.transform(select), indexer.dim, 5, "user_id", KEY, SMALL, folds=3), "oof")
    known = ranking_report(out.withColumn("score", F.col("oof_score")), tiebreak=KEY).first()["primary"]
    return out.groupBy("fold").agg(F.count("*").alias("rows"), F.count_if(F.col("oof_score").isNull()).alias("unscored")).withColumn("near_optimum", F.lit(known > near))


def _boosted(spark, sf_dir, objective, config):
    """Planted labels again; rounds go on until patience ends them."""
    rows = pin(_planted(split_impressions(spark, sf_dir)), "planted")
    rows = pin(DenseFeatures().fit(rows.where("split = 'train'")).transform(rows), "dense")
    select, test = rows.where("split = 'valid_search'"), rows.where("split = 'test'")
    model = G.train_boosted(rows.where("split = 'train'"), select, "user_id", KEY, config, objective=objective)
    primary = lambda df, score: ranking_report(df.withColumn("score", score), tiebreak=KEY).first()["primary"]
    chance, optimum = primary(select, hash_uniform(F.lit(0), *KEY)), primary(select, hash_uniform(F.lit("item"), "item_id"))
    best = max(model.history)
    scored = ranking_report(model.transform(test), tiebreak=KEY).first()["primary"]
    return test.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users")).select(
        "*", F.lit(best > chance + NEAR * (optimum - chance)).alias("near_optimum"), F.lit(scored > chance).alias("beats_chance_on_test"),
        F.lit(len(model.trees) == len(model.history) - config.patience).alias("stopped_by_patience"))


def gbt_binary(spark, sf_dir):
    return _boosted(spark, sf_dir, "binary", BOOSTED)


def gbt_lambdarank(spark, sf_dir):
    return _boosted(spark, sf_dir, "lambdarank", BOOSTED)


#: What ``ranker_comparison`` runs; the first two have no trained part, so SQL states their primary.
COMPARED = ("popularity", "random", "fm_pointwise", "gbt_binary")


def ranker_comparison(spark, sf_dir):
    """Named rankers on the planted labels, all through one report over the select and the test split."""
    rows, train, select, near = _planted_splits(spark, sf_dir)
    task = R.Task(train, select, "user_id", "item_id", KEY, P._fields(P._duration_edges(train)), fm=SMALL, boost=BOOSTED)
    out = R.compare(task, {"valid_search": select, "test": rows.where("split = 'test'")}, COMPARED)
    stated = F.when(F.col("ranker").isin(*COMPARED[:2]), F.round("primary", 6))
    near_optimum = F.when(F.col("split") == "valid_search", F.col("primary") > near)
    return out.select("ranker", "split", "users", "rows", stated.alias("stated_primary"), near_optimum.alias("near_optimum"))


def lambda_gradients(spark, sf_dir):
    """Gradients of all train rows at scores with many ties inside a user."""
    train = P.train_rows(spark, sf_dir).select("user_id", "label", *KEY).withColumn("score", (F.col("item_id") % 101) / 10.0)
    out = G.lambda_gradients(train, "user_id", KEY, truncation=5)
    return rounded(out.select(*KEY, "lam", "hess"), "lam", "hess")


QUERIES = {f.__name__: f for f in (
    pair_sample, fm_score_relational, fm_pointwise, fm_bpr, fm_softmax, fm_step_pointwise, fm_step_bpr, fm_step_softmax, fm_table_engine, grid_search, field_ablation,
    ablation_runs, oof_scores, gbt_binary, gbt_lambdarank, ranker_comparison, lambda_gradients)}

_W = f"WITH {S.SPLIT_IMP}"
_TEXT = " || '|' || ".join(KEY)
_FIELDS = ", ".join(f"f_{n}" for n in P._BASE)

_TRAINED = _W + """ SELECT count(*) AS "rows", count(DISTINCT user_id) AS users, true AS near_optimum, true AS best_restored, true AS beats_chance_on_test,
      true AS loss_falls, true AS stopped_by_patience
    FROM simp WHERE split = 'test'"""

_BOOSTED = _W + """ SELECT count(*) AS "rows", count(DISTINCT user_id) AS users, true AS near_optimum, true AS beats_chance_on_test, true AS stopped_by_patience
    FROM simp WHERE split = 'test'"""




def _comparison_sql() -> str:
    """Popularity and random on the planted labels; the trained rankers give booleans."""
    item, noise = S.uniform("'item|' || item_id"), S.uniform(f"'noise|' || {_TEXT}")
    return _W + f""", p AS (SELECT * REPLACE (({item} * 0.8 + {noise} * 0.2 > 0.6)::INTEGER AS label) FROM simp),
      g AS (SELECT avg(label::DOUBLE) AS m FROM p WHERE split = 'train'),
      rates AS (SELECT item_id, sum(label) AS a, count(*) AS b FROM p WHERE split = 'train' GROUP BY 1),
      scored AS (SELECT 'popularity' AS ranker, p.*, (coalesce(a, 0) + 20.0::DOUBLE * m) / (coalesce(b, 0) + 20.0::DOUBLE) AS score
          FROM p LEFT JOIN rates USING (item_id), g
        UNION ALL SELECT 'random', *, {S.uniform(f"'0|' || {_TEXT}")} FROM p),
      src AS (SELECT * FROM scored WHERE split IN ('valid_search', 'test')), {S.user_metrics("src", "ranker, split, user_id", S.KEY)},
      r AS ({S.report(by="ranker, split")})
      SELECT name AS ranker, split, users, "rows", CASE WHEN name = ranker THEN "primary" END AS stated_primary,
        CASE WHEN split = 'valid_search' THEN name <> 'random' END AS near_optimum
      FROM r JOIN (SELECT unnest({list(COMPARED)}) AS name) ON name = ranker OR (ranker = 'random' AND name NOT IN ('popularity', 'random'))"""


def _step_sql(loss: str, negatives: int = 0) -> str:
    """Forward pass, gradient and the first Adam update over all train examples."""
    vs = range(STEP.k)
    normal = lambda j: (f"{STEP.init_std} * sqrt(-2 * ln(greatest({S.uniform(f"'0|a|' || feature_id || '|{j}'")}, 1e-12)))"  # noqa: E731
                        f" * cos(2 * pi() * {S.uniform(f"'0|b|' || feature_id || '|{j}'")})")
    if loss == "pointwise":
        slots = f"SELECT {_TEXT} AS ex, 0 AS slot, label, [{_FIELDS}] AS xs FROM enc JOIN train USING ({S.KEY})"
        graded = "SELECT *, p - label AS g, -(label * ln(p + 1e-9) + (1 - label) * ln(1 - p + 1e-9)) AS lost FROM (SELECT *, 1 / (1 + exp(-z)) AS p FROM z)"
    else:
        slots = f"""SELECT * FROM (SELECT DISTINCT p.ex, 0 AS slot, 1 AS label, [{", ".join(f"e.f_{n}" for n in P._BASE)}] AS xs FROM drawn p JOIN enc e USING ({S.KEY}))
          UNION ALL SELECT ex, draw + 1, 1, [{", ".join(f"e.f_{n}" for n in P._BASE)}] FROM drawn p JOIN enc e ON {" AND ".join(f"p.neg_{k} = e.{k}" for k in KEY)}"""
        if loss == "bpr":
            graded = f"""SELECT *, CASE WHEN slot = 0 THEN -sum(r) OVER (PARTITION BY ex) ELSE r END AS g,
              CASE WHEN slot = 0 THEN 0 ELSE ln(1 + exp(z - z0)) / {negatives} END AS lost
              FROM (SELECT *, CASE WHEN slot > 0 THEN 1 / (1 + exp(z0 - z)) / {negatives} ELSE 0 END AS r
                FROM (SELECT *, max(CASE WHEN slot = 0 THEN z END) OVER (PARTITION BY ex) AS z0 FROM z))"""
        else:
            graded = """SELECT *, exp(z) / t - (slot = 0)::INT AS g, CASE WHEN slot = 0 THEN ln(t) - z ELSE 0 END AS lost
              FROM (SELECT *, sum(exp(z)) OVER (PARTITION BY ex) AS t FROM z)"""
    drawn = "" if loss == "pointwise" else f"""c AS (SELECT user_id, sum(1 - label)::BIGINT AS n FROM train GROUP BY 1 HAVING sum(label) > 0 AND sum(1 - label) > 0),
      neg AS (SELECT user_id, {S.KEY}, row_number() OVER (PARTITION BY user_id ORDER BY {S.KEY}) - 1 AS k FROM train WHERE label = 0),
      pos AS (SELECT t.*, draw, {_TEXT} AS ex, {S.hash60(f"'0|1|' || {_TEXT} || '|' || draw")} % n AS k
        FROM train t JOIN c USING (user_id), (SELECT unnest(range({negatives}))::INTEGER AS draw) WHERE label = 1),
      drawn AS (SELECT ex, draw, {", ".join(f"pos.{k}" for k in KEY)}, {", ".join(f"neg.{k} AS neg_{k}" for k in KEY)}
        FROM pos JOIN neg ON pos.user_id = neg.user_id AND pos.k = neg.k),"""
    return _W + f""", {P._EDGES}, {P._vocab_sql(P._BASE)},
      enc AS ({P._encode_sql(list(P._BASE), P._qualified(P._BASE), "train")}), {drawn}
      params AS (SELECT feature_id, 0.0::DOUBLE AS w, {", ".join(f"{normal(j)} AS v{j}" for j in vs)}
        FROM (SELECT unnest(range((SELECT max(unk) + 1 FROM unk))) AS feature_id)),
      slots AS ({slots}),
      occ AS (SELECT ex, slot, label, unnest(xs) AS feature_id FROM slots),
      z AS (SELECT ex, slot, label, sum(w) + 0.5 * ({" + ".join(f"pow(sum(v{j}), 2) - sum(v{j} * v{j})" for j in vs)}) AS z,
        {", ".join(f"sum(v{j}) AS s{j}" for j in vs)} FROM occ JOIN params USING (feature_id) GROUP BY 1, 2, 3),
      graded AS ({graded}),
      n AS (SELECT count(DISTINCT ex)::DOUBLE AS n, sum(g) AS gb, sum(lost) AS lost FROM graded),
      grads AS (SELECT feature_id, sum(g) / any_value(n) AS gw, {", ".join(f"sum(g * s{j}) / any_value(n) AS g{j}" for j in vs)}
        FROM occ JOIN graded USING (ex, slot), n GROUP BY 1),
      whole AS (SELECT p.*, coalesce(gw, 0) + {STEP.l2} * w AS gw, {", ".join(f"coalesce(g{j} - gw * v{j}, 0) + {STEP.l2} * v{j} AS g{j}" for j in vs)}
        FROM params p LEFT JOIN grads USING (feature_id))
      SELECT feature_id, round(w - {STEP.lr} * gw / (abs(gw) + 1e-8), 6) AS w,
        {", ".join(f"round(v{j} - {STEP.lr} * g{j} / (abs(g{j}) + 1e-8), 6) AS v{j}" for j in vs)},
        round({"0.0::DOUBLE" if loss == "bpr" else f"-{STEP.lr} * gb / n"}, 6) AS bias, round(lost / n, 6) AS loss FROM whole, n"""

SQL = {
    "pair_sample": _W + f""", c AS (SELECT user_id, sum(1 - label)::BIGINT AS n FROM train GROUP BY 1 HAVING sum(label) > 0 AND sum(1 - label) > 0),
        neg AS (SELECT user_id, {S.KEY}, row_number() OVER (PARTITION BY user_id ORDER BY {S.KEY}) - 1 AS k FROM train WHERE label = 0),
        pos AS (SELECT t.*, draw, {S.hash60(f"'7|1|' || {_TEXT} || '|' || draw")} % n AS k
          FROM train t JOIN c USING (user_id), (SELECT unnest([0, 1])::INTEGER AS draw) WHERE label = 1)
        SELECT pos.user_id, {", ".join(f"pos.{k}" for k in KEY)}, draw, {", ".join(f"neg.{k} AS neg_{k}" for k in KEY)}
        FROM pos JOIN neg ON pos.user_id = neg.user_id AND pos.k = neg.k""",
    "fm_score_relational": _W + f""", {P._EDGES}, {P._vocab_sql(P._BASE)},
        params AS (SELECT feature_id, {S.uniform("'w|' || feature_id")} - 0.5 AS w, """ + ", ".join(
            f"({S.uniform(chr(39) + f'v|{j}|' + chr(39) + ' || feature_id')} - 0.5) * 0.4 AS v{j}" for j in range(K)) + """ FROM vocab),
        enc AS (""" + P._encode_sql(list(P._BASE), P._qualified(P._BASE), "simp") + f"""),
        slots AS (SELECT {S.KEY}, unnest([f_user_id, f_item_id, f_author_id, f_tab, f_dur_bucket]) AS feature_id FROM enc)
        SELECT {S.KEY}, round(0.25 + sum(w) + 0.5 * (""" + " + ".join(f"pow(sum(v{j}), 2) - sum(v{j} * v{j})" for j in range(K))
        + f"), 6) AS score FROM slots LEFT JOIN (SELECT feature_id, w, v0, v1, v2, v3 FROM params UNION ALL SELECT unk, 0, 0, 0, 0, 0 FROM unk) USING (feature_id) GROUP BY {S.KEY}",
    "grid_search": _W + f""" SELECT count(DISTINCT user_id) AS users, count(*) AS "rows", 6::INTEGER AS runs, {SMALL.lr}::DOUBLE AS lr, true AS near_optimum, true AS winner_returned
        FROM simp WHERE split = 'test'""",
    "field_ablation": " UNION ALL ".join(f"""SELECT '{m}' AS mode, {5 + len(extra)}::INTEGER AS n_fields, 'valid_search' AS split, 3::BIGINT AS seeds, true AS near_optimum, true AS steady"""
                                         for m, extra in P.FIELD_SETS.items()),
    "ablation_runs": " UNION ALL ".join(f"SELECT '{c}' AS component, true AS near_optimum, true AS small_delta" for c in Y.ABLATIONS),
    "oof_scores": _W + f""" SELECT ('0x' || substr(md5('0|fold|' || {_TEXT}), 1, 8))::BIGINT % 3 AS fold, count(*) AS "rows", 0::BIGINT AS unscored, true AS near_optimum FROM train GROUP BY 1""",
    "ranker_comparison": _comparison_sql(),
    "gbt_binary": _BOOSTED, "gbt_lambdarank": _BOOSTED,
    "fm_pointwise": _TRAINED, "fm_bpr": _TRAINED, "fm_softmax": _TRAINED,
    "fm_step_pointwise": _step_sql("pointwise"), "fm_table_engine": _step_sql("pointwise"),
    "fm_step_bpr": _step_sql("bpr", 2), "fm_step_softmax": _step_sql("softmax", 4),
    "lambda_gradients": _W + f""", r AS (SELECT user_id, label, {S.KEY}, (item_id % 101) / 10.0::DOUBLE AS s,
          row_number() OVER (PARTITION BY user_id ORDER BY (item_id % 101) / 10.0::DOUBLE DESC, {S.KEY}) - 1 AS p FROM train),
        ideal AS (SELECT user_id, sum(CASE WHEN b < 5 THEN 1 / log2(b + 2) ELSE 0 END) AS m FROM (SELECT user_id, label,
          row_number() OVER (PARTITION BY user_id ORDER BY label DESC) - 1 AS b FROM train) WHERE label = 1 GROUP BY 1),
        pair AS (SELECT a.user_id, a.p AS ap, b.p AS bp, 1 / (1 + exp(a.s - b.s)) AS rho,
            abs(1 / log2(a.p + 2) - 1 / log2(b.p + 2)) / m AS d
          FROM r a JOIN r b ON a.user_id = b.user_id AND a.label = 1 AND b.label = 0 AND least(a.p, b.p) < 5 JOIN ideal ON ideal.user_id = a.user_id),
        g AS (SELECT user_id, ap AS p, rho * d AS lam, rho * (1 - rho) * d AS hess FROM pair
          UNION ALL SELECT user_id, bp, -rho * d, rho * (1 - rho) * d FROM pair),
        t AS (SELECT user_id, p, sum(lam) AS lam, sum(hess) AS hess FROM g GROUP BY 1, 2)
        SELECT {", ".join(f"r.{k}" for k in KEY)}, round(coalesce(lam, 0.0), 6) AS lam, round(coalesce(hess, 0.0), 6) AS hess
        FROM r LEFT JOIN t ON r.user_id = t.user_id AND r.p = t.p""",
}
