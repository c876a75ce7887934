"""Registered experiment-analytics queries over study tables derived from the orders and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import hash_uniform
from rankspark.operators import metrics as M
from rankspark.operators import paired as B
from rankspark.operators import rates as R
from rankspark.operators import studies as X
from rankspark.plans import sqltext as S
from rankspark.plans.ranking import KEY, rounded, split_impressions
from rankspark.session import pin, scratch_path
from rankspark.sources import jsonl as J
from rankspark.sources import tables as T
from rankspark.sources.logs import last_per_key

BASELINE = 0.55
SEEDS = (0, 1, 2)


# ---- per-user scores of four scorers ----------------------------------------

def scored_nodes(spark, sf_dir, split: str):
    """Three runs of four scorers on one split: random root, its exact copy, item and author rates."""
    rows = pin(split_impressions(spark, sf_dir).where(F.col("split").isin("train", split)), "rows")
    train = rows.where("split = 'train'")
    part = R.popularity_scores(train, rows.where(F.col("split") == split), name="_item")
    part = R.popularity_scores(train, part, item="author_id", name="_author")
    cells = []
    for s in SEEDS:
        chance = hash_uniform(F.lit(s), *KEY)
        for node, score in (("root", chance), ("copy", chance), ("item", F.col("_item")), ("author", F.col("_author"))):
            cells.append(F.struct(F.lit(node).alias("node_id"), F.lit(s).alias("seed"), score.alias("score")))
    # dealt out by user before a row becomes twelve: the groups of a user meet without another shuffle
    part = part.select("user_id", "label", *KEY, "_item", "_author").repartition("user_id")
    return part.select("user_id", "label", *KEY, F.inline(F.array(*cells)))


def per_user_scores(spark, sf_dir, split="valid_search"):
    return pin(M.per_user_primary(scored_nodes(spark, sf_dir, split), ["node_id", "seed", "user_id"], tiebreak=KEY))


def _pairs(scores):
    """Every other node is compared with the root."""
    return scores.select("node_id").distinct().where("node_id <> 'root'").withColumn("parent_id", F.lit("root"))


def _deltas(spark, sf_dir, split="valid_search"):
    scores = per_user_scores(spark, sf_dir, split)
    return B.paired_deltas(scores, _pairs(scores))


def paired_deltas(spark, sf_dir):
    return rounded(_deltas(spark, sf_dir), "delta")


def paired_bootstrap(spark, sf_dir):
    out = B.paired_bootstrap(pin(_deltas(spark, sf_dir)))
    return rounded(out, "mean_delta", "p_positive", "lower_95")


def clustered_bootstrap(spark, sf_dir):
    out = B.paired_bootstrap(pin(_deltas(spark, sf_dir)), cluster="user_id")
    return rounded(out, "mean_delta", "p_positive", "lower_95")


def poisson_bootstrap(spark, sf_dir):
    """Other draws than the default's."""
    out = B.paired_bootstrap(pin(_deltas(spark, sf_dir)), draws=200, seed=1)
    return rounded(out, "mean_delta", "p_positive", "lower_95")


def multinomial_bootstrap(spark, sf_dir):
    out = B.paired_bootstrap(pin(_deltas(spark, sf_dir)), method="multinomial")
    return rounded(out, "mean_delta", "p_positive", "lower_95")


def no_op_candidates(spark, sf_dir):
    return B.no_op_nodes(_deltas(spark, sf_dir), seed=0)


def seed_reports(spark, sf_dir, split="valid_search"):
    return M.ranking_report(scored_nodes(spark, sf_dir, split), tiebreak=KEY, by=["node_id", "seed"])


def seed_mean_spread(spark, sf_dir):
    out = B.seed_summary(seed_reports(spark, sf_dir))
    return rounded(out, "mean", "spread", "range")


def component_ablation(spark, sf_dir):
    """Score each scorer loses against the best one, per seed, as if its signal were removed."""
    reports = pin(seed_reports(spark, sf_dir).withColumnRenamed("seed", "study_id"))
    full = reports.where("node_id = 'item'")
    out = B.ablation_deltas(full, reports.where("node_id <> 'item'").withColumnRenamed("node_id", "component"))
    return rounded(out, "delta")


def decision_continue(spark, sf_dir):
    stats = B.paired_bootstrap(pin(_deltas(spark, sf_dir)))
    return stats.select("node_id", B.continue_locally().alias("keep_exploring"))


def decision_confirm(spark, sf_dir):
    stats = B.paired_bootstrap(pin(_deltas(spark, sf_dir)))
    means = B.seed_summary(seed_reports(spark, sf_dir))
    root = means.where("node_id = 'root'").select(F.col("mean").alias("champion"), F.lit("root").alias("parent_id"))
    joined = stats.join(means.select("node_id", "mean"), "node_id").withColumn("parent_id", F.lit("root")).join(root, "parent_id")
    return joined.select("node_id", B.wants_confirm("mean", F.col("champion")).alias("confirm"))


def decision_promote(spark, sf_dir):
    stats = B.paired_bootstrap(pin(_deltas(spark, sf_dir, "valid_confirm")))
    return stats.select("node_id", B.promotes().alias("promote"))


# ---- study tables -----------------------------------------------------------

def study_nodes(spark, sf_dir):
    """Orders as experiment nodes: five studies, one iteration per month."""
    o = T.table(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    evidence = F.array(*[F.lit(x) for x in ("invariant", "refuted_under_context", "failed_implementation", "no_op", "timeout")])
    return o.select(
        F.col("o_orderpriority").alias("study_id"), key.alias("id"), F.substring(F.md5(key.cast("string")), 1, 12).alias("node"),
        ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("iter"),
        F.element_at(F.array(F.lit("draft"), F.lit("improve"), F.lit("fix"), F.lit("refine")), (cust % 4 + 1).cast("int")).alias("operation"),
        F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "P", "promoted").otherwise("closed").alias("status"),
        F.when(cust % 6 < 5, F.element_at(evidence, F.least(cust % 6 + 1, F.lit(5)).cast("int"))).alias("evidence_type"),
        F.when(key % 13 != 0, F.concat(F.lit("c"), (key % 9).cast("string"))).alias("component"),
        F.when(key % 11 != 0, F.round(F.lit(0.5) + (cents % 1000) / 10000.0, 4)).alias("primary"),
        F.when(key % 7 != 0, F.round((cents % 4001 - 3900) / 1000000.0, 6)).alias("mean_delta"),
        F.when(cust % 10 > 0, F.concat(F.lit("raise c"), (key % 9).cast("string"), F.lit(" by "), (cents % 50).cast("string"))).alias("mechanism"),
        (cust % 5).alias("visits"), (cents % 900).cast("double").alias("seconds"), (key % 4).alias("runs"))


def study_iterations(spark, sf_dir):
    """Best score per iteration (no-ops are not evidence) and the clock, which restarts every 20 iterations."""
    n = study_nodes(spark, sf_dir)
    scored = F.when(F.coalesce("evidence_type", F.lit("")) != "no_op", F.col("primary"))
    return (n.groupBy("study_id", "iter").agg(F.max(scored).alias("iter_primary"),
                                              F.count(F.lit(1)).alias("candidates"))
            .withColumn("elapsed_s", ((F.col("iter") % 20 + 1) * 100).cast("double") + F.col("iter") % 7))


def _trajectory(spark, sf_dir):
    return X.running_best(study_iterations(spark, sf_dir), "iter_primary", BASELINE)


def running_best(spark, sf_dir):
    return _trajectory(spark, sf_dir).select("study_id", "iter", "iter_primary", "running_best")


def improvement_score(spark, sf_dir):
    out = X.improvement_score(_trajectory(spark, sf_dir), BASELINE)
    return rounded(out.select("study_id", "iter", "improvement_score"), "improvement_score")


def plateau_flag(spark, sf_dir):
    return X.plateau(_trajectory(spark, sf_dir)).select("study_id", "iter", "plateau")


def promotion_ladder(spark, sf_dir):
    nodes = study_nodes(spark, sf_dir).where("status = 'promoted'")
    return X.promotion_ladder(nodes, "primary", BASELINE).select("study_id", "iter", "id", "primary")


def implausible_jumps(spark, sf_dir):
    nodes = study_nodes(spark, sf_dir).select("study_id", "iter", "id", "primary")     # rows are sorted and written whole
    return X.implausible_scores(nodes, "primary", threshold=0.5995)


def wallclock_by_session(spark, sf_dir):
    return rounded(X.session_wallclock(study_iterations(spark, sf_dir)), "mean_s")


def global_stop(spark, sf_dir):
    return X.global_stop(study_nodes(spark, sf_dir), 85, BASELINE)


def refine_trigger(spark, sf_dir):
    """Nodes are named by text; their place in the log decides."""
    scores = X.improvement_score(_trajectory(spark, sf_dir), BASELINE)
    return X.refine_triggers(study_nodes(spark, sf_dir), BASELINE, scores, id="node")


def ucb_pick(spark, sf_dir):
    nodes = study_nodes(spark, sf_dir).where("status = 'open'")
    return rounded(X.ucb_pick(nodes, id="node"), "ucb")


def ucb_scores(spark, sf_dir):
    nodes = study_nodes(spark, sf_dir).where("status = 'open'")
    return rounded(X.ucb_scores(nodes).select("study_id", "id", "ucb"), "ucb")


def triage_pick(spark, sf_dir):
    mean, std = X.posterior(F.coalesce("primary", F.lit(0.5)), "runs")
    nodes = study_nodes(spark, sf_dir).where("status = 'open'").withColumn("post_mean", mean).withColumn("post_std", std)
    return rounded(X.triage(nodes, id="node").select("study_id", "node", "post_mean", "post_std", "reason"), "post_mean", "post_std")


def weakest_component(spark, sf_dir):
    nodes = study_nodes(spark, sf_dir)
    per = nodes.groupBy("study_id", "component").agg((F.max("primary") - F.avg("primary") - 0.047).alias("delta"))
    return X.weakest_component(per.where("component IS NOT NULL"))


def champion(spark, sf_dir):
    return rounded(X.champion(study_nodes(spark, sf_dir), BASELINE, id="node"), "vs_baseline")


def final_summary(spark, sf_dir):
    return rounded(X.final_summary(study_nodes(spark, sf_dir), BASELINE), "vs_baseline")


def best_config(spark, sf_dir):
    nodes = study_nodes(spark, sf_dir).where("primary IS NOT NULL")
    grid = nodes.groupBy("study_id", F.concat(F.lit("x"), F.col("visits").cast("string")).alias("lr_step"), F.col("runs").alias("negatives")).agg(F.avg("primary").alias("score"))
    return rounded(X.best_config(grid, ["study_id"], ["lr_step", "negatives"], "score"), "score")


def prior_attempts(spark, sf_dir):
    return X.prior_attempts(study_nodes(spark, sf_dir))


def status_filters(spark, sf_dir):
    """Open scored nodes that are not drafts, and promoted ones."""
    n = study_nodes(spark, sf_dir)
    return n.where("status = 'promoted' OR (status = 'open' AND runs > 0 AND operation <> 'draft')").select("study_id", "iter", "id", "status")


# ---- roll-ups and log repair ------------------------------------------------

def evidence_distribution(spark, sf_dir):
    return X.evidence_distribution(study_nodes(spark, sf_dir), id="node")


def exhausted_families(spark, sf_dir):
    return X.exhausted_families(study_nodes(spark, sf_dir))


def outcome_tally(spark, sf_dir):
    """An attempt is one component in one iteration and operation."""
    return X.outcome_tally(study_nodes(spark, sf_dir), by=["study_id", "iter", "component", "operation"])


def token_rollup(spark, sf_dir):
    turns = T.table(spark, sf_dir, "conversations").select(
        F.col("role").alias("kind"), F.length("text").cast("bigint").alias("input_tokens"), F.col("turn").alias("output_tokens"))
    return X.token_totals(turns)


def budget_counters(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").withColumnRenamed("user_id", "study_id")
    return X.budget_counters(ev, ["click", "error", "purchase", "signup", "view"])


def access_counts(spark, sf_dir):
    return X.access_counts(T.table(spark, sf_dir, "events").withColumnRenamed("event_type", "split"))


def policy_violations(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").withColumnRenamed("event_type", "split")
    return X.policy_violations(ev, {"purchase": 12, "signup": 15}, by=["user_id"])


def summary_table(spark, sf_dir):
    docs = T.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.regexp_replace("text", "[^ -~]", "?").alias("hypothesis"))
    # there are more nodes than documents
    nodes = study_nodes(spark, sf_dir).join(docs, "id", "left").withColumn("hypothesis", F.coalesce("hypothesis", F.concat(F.lit("idea "), "id")))
    rows = nodes.withColumn("parent", F.when(F.col("id") % 3 > 0, F.col("id") * 1000003)).withColumn(
        "confirm", F.when(F.col("status") == "promoted", F.col("primary")))
    return X.summary_table(rows)


def latest_state(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    return last_per_key(ev, ["user_id"], "event_id", ["event_type", "value"])


def merged_logs(spark, sf_dir):
    """Two logs of the same ids: the newer log wins, then the later line."""
    ev = T.table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").alias("id"), "event_id", "event_type", "value")
    old = ev.where("event_type <> 'click'").withColumn("log", F.lit(0))
    new = ev.where("event_type = 'click'").withColumn("log", F.lit(1))
    at = F.struct("log", "event_id")
    return last_per_key(old.unionByName(new).withColumn("at", at), ["id"], "at", ["log", "event_id", "event_type", "value"])


_EVENT = "iter int, id bigint, status string, value double"


def _event_json(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events")
    return ev.select("event_id", F.to_json(F.struct(
        (F.col("event_id") % 50).cast("int").alias("iter"), F.col("event_id").alias("id"), F.col("event_type").alias("status"),
        "value")).alias("value"))


def tolerant_jsonl(spark, sf_dir):
    """Log with torn and blank lines: the whole lines survive."""
    j = _event_json(spark, sf_dir)
    torn = (F.when(F.col("event_id") % 31 == 5, F.expr("substring(value, 1, length(value) - 4)"))
            .when(F.col("event_id") % 31 == 6, "").otherwise(F.col("value")))
    path = scratch_path(spark, "jsonl")
    j.select(torn.alias("value")).write.text(path)
    return J.read_jsonl(spark, path, _EVENT)


def recovered_records(spark, sf_dir):
    """Up to eight records glued on one line by a literal backslash-n, some cut short."""
    j = _event_json(spark, sf_dir)
    cut = F.when(F.col("event_id") % 41 == 7, F.expr("substring(value, 1, length(value) - 6)")).otherwise(F.col("value"))
    # a group holds eight consecutive ids
    glued = (j.select(F.expr("event_id DIV 8").alias("line"), F.struct("event_id", cut.alias("t")).alias("r"))
             .groupBy("line").agg(F.array_sort(F.collect_list("r")).alias("rs"))
             .select("line", F.array_join(F.transform("rs", lambda r: r["t"]), "\\n").alias("value")))
    out = J.recover_glued(glued, _EVENT)
    return out.groupBy("line").agg(F.sum(F.col("ok").cast("bigint")).alias("records"),
                                   F.sum((~F.col("ok")).cast("bigint")).alias("skipped"),
                                   F.sum(F.when(F.col("ok"), F.col("id"))).alias("id_sum"))


def flattened_progress(spark, sf_dir):
    """One document per 64 consecutive events with their days, flattened back to events."""
    ev = T.table(spark, sf_dir, "events").withColumn("doc", F.expr("event_id DIV 64"))
    cand = F.struct(F.col("event_id").cast("string").alias("id"), F.col("value").alias("primary"), F.col("event_type").alias("status"))
    # a document holds at most 64 candidates, so the lists are bounded
    days = ev.groupBy("doc", F.dayofmonth("ts").alias("iter")).agg(F.collect_list(cand).alias("candidates"))
    docs = days.groupBy("doc").agg(F.collect_list(F.struct("iter", (F.col("iter") * 60.0).alias("elapsed_s"), "candidates")).alias("iterations"))
    path = scratch_path(spark, "progress")
    docs.write.json(path)
    read = spark.read.schema(J.PROGRESS_SCHEMA + ", doc bigint").json(path)
    return J.flatten_progress(read, ["doc"]).select("doc", "iter", "elapsed_s", "id", "primary", "status")


def lineage(spark, sf_dir):
    ev = T.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") > 0, F.expr("(event_id - 1) DIV 3")).alias("parent_id"))
    return X.lineage_roots(ev)


QUERIES = {f.__name__: f for f in (
    paired_deltas, paired_bootstrap, clustered_bootstrap, poisson_bootstrap, multinomial_bootstrap, no_op_candidates, seed_mean_spread,
    component_ablation, decision_continue, decision_confirm, decision_promote, running_best, improvement_score,
    plateau_flag, promotion_ladder, implausible_jumps, wallclock_by_session, global_stop, refine_trigger,
    ucb_pick, ucb_scores, triage_pick, weakest_component, champion, final_summary, best_config, prior_attempts,
    status_filters, evidence_distribution, exhausted_families, outcome_tally, token_rollup, budget_counters,
    access_counts, policy_violations, summary_table, latest_state, merged_logs, tolerant_jsonl,
    recovered_records, flattened_progress, lineage)}

# ---- SQL --------------------------------------------------------------------

_KEYTEXT = "'|' || order_id || '|' || line_no || '|' || item_id || '|' || author_id || '|' || date"


def _scored_sql(split: str) -> str:
    rnd = S.uniform(f"seed || {_KEYTEXT}")
    return f"""WITH {S.SPLIT_IMP}, g AS (SELECT avg(label::DOUBLE) AS m FROM train),
ir AS (SELECT item_id, sum(label) AS p, count(*) AS n FROM train GROUP BY 1),
ar AS (SELECT author_id, sum(label) AS p, count(*) AS n FROM train GROUP BY 1),
part AS (SELECT s.*, (coalesce(ir.p, 0) + 20.0::DOUBLE * m) / (coalesce(ir.n, 0) + 20.0::DOUBLE) AS i_score,
    (coalesce(ar.p, 0) + 20.0::DOUBLE * m) / (coalesce(ar.n, 0) + 20.0::DOUBLE) AS a_score
  FROM simp s LEFT JOIN ir USING (item_id) LEFT JOIN ar USING (author_id), g WHERE split = '{split}'),
seeds AS (SELECT unnest([0, 1, 2])::INTEGER AS seed),
chance AS (SELECT part.*, seed, {rnd} AS r_score FROM part, seeds),
src AS (SELECT node_id, c.*, CASE node_id WHEN 'item' THEN i_score WHEN 'author' THEN a_score ELSE r_score END AS score
  FROM chance c, (SELECT unnest(['root', 'copy', 'item', 'author']) AS node_id)),
{S.user_metrics("src", "node_id, seed, user_id", S.KEY)},
pu AS (SELECT node_id, seed, user_id, round_even((auc + ndcg) / 2, 6) AS pr FROM um WHERE pos > 0 AND pos < n),
deltas AS (SELECT c.node_id, 'root' AS parent_id, c.seed, c.user_id, c.pr - p.pr AS delta
  FROM pu c JOIN pu p ON c.seed = p.seed AND c.user_id = p.user_id AND p.node_id = 'root' WHERE c.node_id <> 'root'),
rep AS (SELECT node_id, seed, (coalesce(sum(CASE WHEN pos > 0 AND pos < n THEN pos * auc END)
    / sum(CASE WHEN pos > 0 AND pos < n THEN pos END), 0.5) + avg(ndcg)) / 2 AS pr FROM um GROUP BY 1, 2)"""


def _multinomial_means() -> str:
    first, second = S.replicate_mix("h", "b")
    return f"""hashed AS (SELECT node_id, n, {S.hash60("'0|' || node_id || '|' || i")} AS h FROM num),
pick AS (SELECT node_id, b, ({first}::BIGINT * 2147483648 + {second}) % n AS j FROM hashed, (SELECT unnest(range(500)) AS b)),
means AS (SELECT pick.node_id, b, avg(delta) AS m FROM pick JOIN num ON pick.node_id = num.node_id AND j = i GROUP BY 1, 2)"""


def _poisson_means(key: str, draws: int, seed: int) -> str:
    weight = " + ".join(f"({c}::DOUBLE <= u)::INT" for c in B.POISSON_CDF)
    return f"""hashed AS (SELECT node_id, delta, {S.hash60(f"'{seed}|' || node_id || '|' || {key}")} AS h FROM num),
w AS (SELECT node_id, b, delta, {S.replicate_mix("h", "b")[1]} / 2147483647.0::DOUBLE AS u FROM hashed, (SELECT unnest(range({draws})) AS b)),
means AS (SELECT node_id, b, sum(k * delta) / sum(k) AS m FROM (SELECT node_id, b, delta, {weight} AS k FROM w) GROUP BY 1, 2)"""


def _boot_sql(split: str, cluster: bool = False, method: str = "poisson", draws: int = 500, seed: int = 0) -> str:
    source = "(SELECT node_id, user_id, 0 AS seed, avg(delta) AS delta FROM deltas GROUP BY 1, 2)" if cluster else "deltas"
    means = _multinomial_means() if method == "multinomial" else _poisson_means("user_id" if cluster else "seed || '|' || user_id", draws, seed)
    return _scored_sql(split) + f""",
num AS (SELECT node_id, seed, user_id, delta, row_number() OVER (PARTITION BY node_id ORDER BY seed, user_id) - 1 AS i,
    count(*) OVER (PARTITION BY node_id) AS n FROM {source}),
{means},
low AS (SELECT node_id, m FROM (SELECT node_id, m, row_number() OVER (PARTITION BY node_id ORDER BY m) AS r FROM means) WHERE r = {int(0.05 * draws) + 1}),
boot AS (SELECT node_id, (SELECT avg(delta) FROM num WHERE num.node_id = means.node_id) AS mean_delta,
    (SELECT count(*) FROM num WHERE num.node_id = means.node_id) AS n, avg((m > 0)::INT::DOUBLE) AS p_positive,
    (SELECT m FROM low WHERE low.node_id = means.node_id) AS lower_95 FROM means GROUP BY node_id)"""


_BOOT_OUT = """ SELECT node_id, round(mean_delta, 6) AS mean_delta, n, round(p_positive, 6) AS p_positive,
    round(lower_95, 6) AS lower_95 FROM boot"""

NODES = """nodes AS (SELECT o_orderpriority AS study_id, o_orderkey AS id, substr(md5(o_orderkey::VARCHAR), 1, 12) AS node,
  ((year(o_orderdate) - 1995) * 12 + month(o_orderdate))::INTEGER AS iter,
  (['draft', 'improve', 'fix', 'refine'])[o_custkey % 4 + 1] AS operation,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'P' THEN 'promoted' ELSE 'closed' END AS status,
  CASE WHEN o_custkey % 6 < 5 THEN (['invariant', 'refuted_under_context', 'failed_implementation', 'no_op', 'timeout'])[o_custkey % 6 + 1] END AS evidence_type,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'c' || (o_orderkey % 9) END AS component,
  CASE WHEN o_orderkey % 11 <> 0 THEN round(0.5::DOUBLE + (cents % 1000) / 10000.0::DOUBLE, 4) END AS "primary",
  CASE WHEN o_orderkey % 7 <> 0 THEN round((cents % 4001 - 3900) / 1000000.0::DOUBLE, 6) END AS mean_delta,
  CASE WHEN o_custkey % 10 > 0 THEN 'raise c' || (o_orderkey % 9) || ' by ' || (cents % 50) END AS mechanism,
  o_custkey % 5 AS visits, (cents % 900)::DOUBLE AS seconds, o_orderkey % 4 AS runs
  FROM (SELECT *, round(o_totalprice * 100)::BIGINT AS cents FROM orders))"""

ITERS = f"""WITH {NODES}, its AS (SELECT study_id, iter,
  max(CASE WHEN coalesce(evidence_type, '') <> 'no_op' THEN "primary" END) AS iter_primary, count(*) AS candidates,
  ((iter % 20 + 1) * 100)::DOUBLE + iter % 7 AS elapsed_s FROM nodes GROUP BY 1, 2),
traj AS (SELECT *, greatest({BASELINE}::DOUBLE, max(iter_primary) OVER (PARTITION BY study_id ORDER BY iter
    ROWS UNBOUNDED PRECEDING)) AS rb FROM its)"""

_N = f"WITH {NODES} "

SQL = {
    "paired_deltas": _scored_sql("valid_search") + " SELECT node_id, parent_id, seed, user_id, round(delta, 6) AS delta FROM deltas",
    "paired_bootstrap": _boot_sql("valid_search") + _BOOT_OUT,
    "clustered_bootstrap": _boot_sql("valid_search", True) + _BOOT_OUT,
    "poisson_bootstrap": _boot_sql("valid_search", draws=200, seed=1) + _BOOT_OUT,
    "multinomial_bootstrap": _boot_sql("valid_search", method="multinomial") + _BOOT_OUT,
    "no_op_candidates": _scored_sql("valid_search") + """ SELECT node_id, max(abs(delta)) < 1e-9 AS no_op, count(*) AS shared
        FROM deltas WHERE seed = 0 GROUP BY 1""",
    "seed_mean_spread": _scored_sql("valid_search") + """ SELECT node_id, round(avg(pr), 6) AS mean, round(stddev_pop(pr), 6) AS spread,
        round(max(pr) - min(pr), 6) AS "range", count(pr) AS seeds FROM rep GROUP BY 1""",
    "component_ablation": _scored_sql("valid_search") + """ SELECT a.seed AS study_id, a.node_id AS component, round(f.pr - a.pr, 6) AS delta
        FROM rep a JOIN rep f ON a.seed = f.seed AND f.node_id = 'item' WHERE a.node_id <> 'item'""",
    "decision_continue": _boot_sql("valid_search") + " SELECT node_id, p_positive > 0.8 AND lower_95 > 0 AS keep_exploring FROM boot",
    "decision_confirm": _boot_sql("valid_search") + """ SELECT node_id, p_positive >= 0.9 AND lower_95 > 0 AND
        (SELECT avg(pr) FROM rep WHERE rep.node_id = boot.node_id) > (SELECT avg(pr) FROM rep WHERE node_id = 'root') AS confirm FROM boot""",
    "decision_promote": _boot_sql("valid_confirm") + " SELECT node_id, mean_delta > 0.0005 AND lower_95 > 0 AS promote FROM boot",
    "running_best": ITERS + " SELECT study_id, iter, iter_primary, rb AS running_best FROM traj",
    "improvement_score": ITERS + f""" SELECT study_id, iter, round(CASE WHEN j = 3 THEN rb - {BASELINE}::DOUBLE WHEN j > 3 THEN rb - back END, 6)
        AS improvement_score FROM (SELECT *, row_number() OVER w AS j, lag(rb, 3) OVER w AS back FROM traj
        WINDOW w AS (PARTITION BY study_id ORDER BY iter))""",
    "plateau_flag": ITERS + """ SELECT study_id, iter, CASE WHEN j > 3 THEN recent - before <= 0.002 ELSE false END AS plateau FROM (
        SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY iter) AS j,
          max(rb) OVER (PARTITION BY study_id ORDER BY iter ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS recent,
          max(rb) OVER (PARTITION BY study_id ORDER BY iter ROWS BETWEEN UNBOUNDED PRECEDING AND 3 PRECEDING) AS before FROM traj)""",
    "promotion_ladder": _N + f"""SELECT study_id, iter, id, "primary" FROM (SELECT *, greatest({BASELINE}::DOUBLE, coalesce(max("primary") OVER (
          PARTITION BY study_id ORDER BY iter, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS prev
        FROM nodes WHERE status = 'promoted') WHERE "primary" > prev""",
    "implausible_jumps": _N + """SELECT study_id, iter, id, "primary" FROM (SELECT *, max("primary") OVER (PARTITION BY study_id
          ORDER BY iter, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM nodes)
        WHERE "primary" > 0.8645 OR "primary" > 0.5995::DOUBLE OR "primary" - prev > 0.02::DOUBLE""",
    "wallclock_by_session": ITERS + """ SELECT study_id, sum(e) AS total_s, count(e) AS sessions, count(*) AS iterations,
        round(sum(e) / count(*), 6) AS mean_s FROM (SELECT study_id, CASE WHEN nx IS NULL OR nx < elapsed_s THEN elapsed_s END AS e
          FROM (SELECT *, lead(elapsed_s) OVER (PARTITION BY study_id ORDER BY iter) AS nx FROM its)) GROUP BY 1""",
    "global_stop": _N + f"""SELECT study_id, greatest(85 - last_iter, 0)::INTEGER AS remaining, open_nodes,
        greatest(85 - last_iter, 0) <= 0 OR open_nodes = 0 OR coalesce(best_open + 0.01::DOUBLE * greatest(85 - last_iter, 0) - champ < 0.002, true) AS stop
        FROM (SELECT study_id, max(iter) AS last_iter, max(CASE WHEN status = 'open' THEN "primary" END) AS best_open,
          sum((status = 'open')::INT)::BIGINT AS open_nodes,
          greatest(coalesce(max(CASE WHEN status = 'promoted' THEN "primary" END), 0), {BASELINE}::DOUBLE) AS champ
          FROM nodes GROUP BY 1)""",
    "refine_trigger": ITERS + f""", imp AS (SELECT study_id, iter, CASE WHEN j = 3 THEN rb - {BASELINE}::DOUBLE WHEN j > 3 THEN rb - back END AS score
          FROM (SELECT *, row_number() OVER w AS j, lag(rb, 3) OVER w AS back FROM traj WINDOW w AS (PARTITION BY study_id ORDER BY iter))),
        x AS (SELECT study_id, max(CASE WHEN operation = 'refine' THEN (iter, id) END) AS l FROM nodes GROUP BY 1)
        SELECT s.study_id, coalesce(c, 0)::BIGINT AS improves, coalesce(c, 0) >= 3 AS cadence,
          coalesce((SELECT score FROM imp WHERE imp.study_id = s.study_id ORDER BY iter DESC LIMIT 1) <= 0.001::DOUBLE, false) AS plateau, target
        FROM (SELECT DISTINCT study_id FROM nodes) s
        LEFT JOIN (SELECT n.study_id, count(DISTINCT iter) AS c FROM nodes n JOIN x
          ON x.study_id = n.study_id AND operation = 'improve' AND (l IS NULL OR (iter, id) > l) GROUP BY 1) u USING (study_id)
        LEFT JOIN (SELECT study_id, node AS target FROM nodes WHERE status = 'open' AND runs > 0 AND "primary" > {BASELINE}::DOUBLE + 0.0005::DOUBLE
          QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY "primary" DESC, iter, id) = 1) t USING (study_id)""",
    "ucb_pick": _N + """SELECT study_id, node, round(ucb, 6) AS ucb FROM (SELECT *, CASE WHEN visits = 0 THEN 'inf'::DOUBLE ELSE coalesce("primary", 0)
          + 0.7::DOUBLE * sqrt(ln(sum(visits) OVER (PARTITION BY study_id)) / visits)
          - 0.05::DOUBLE * (seconds / 60.0::DOUBLE) END AS ucb FROM nodes WHERE status = 'open')
        QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY ucb DESC, iter, id) = 1""",
    "ucb_scores": _N + """SELECT study_id, id, CASE WHEN visits = 0 THEN 'inf'::DOUBLE ELSE round(coalesce("primary", 0)
          + 0.7::DOUBLE * sqrt(ln(t) / visits) - 0.05::DOUBLE * (seconds / 60.0::DOUBLE), 6) END AS ucb
        FROM (SELECT *, sum(visits) OVER (PARTITION BY study_id) AS t FROM nodes WHERE status = 'open')""",
    "triage_pick": _N + """, s AS (SELECT study_id, iter, id, node, CASE WHEN runs > 0 THEN coalesce("primary", 0.5) ELSE 0.5 END AS m,
          CASE WHEN runs > 0 THEN 0.02::DOUBLE / sqrt(runs) ELSE 0.2 END AS sd FROM nodes WHERE status = 'open'),
        r AS (SELECT *, row_number() OVER (PARTITION BY study_id ORDER BY m DESC, iter, id) AS k FROM s)
        SELECT study_id, node, round(m, 6) AS post_mean, round(sd, 6) AS post_std, reason FROM (
          SELECT *, 'mean' AS reason FROM r WHERE k <= 2 UNION ALL
          (SELECT *, 'wildcard' AS reason FROM r WHERE k > 2 QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY sd DESC, m DESC, iter, id) = 1))""",
    "weakest_component": _N + """, d AS (SELECT study_id, component, max("primary") - avg("primary") - 0.047::DOUBLE AS delta FROM nodes
          WHERE component IS NOT NULL GROUP BY 1, 2)
        SELECT study_id, CASE WHEN max(delta) > 0.005 THEN arg_min(component, (delta, component)) END AS component FROM d GROUP BY 1""",
    "champion": _N + f"""SELECT study_id, node, iter, "primary" AS score, cnt AS promoted, round("primary" - {BASELINE}::DOUBLE, 6) AS vs_baseline
        FROM (SELECT *, count(*) OVER (PARTITION BY study_id) AS cnt FROM nodes WHERE status = 'promoted')
        QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY coalesce("primary", 0) DESC, iter, id) = 1""",
    "final_summary": _N + f"""SELECT study_id, best, round(best - {BASELINE}::DOUBLE, 6) AS vs_baseline, abs(best - {BASELINE}::DOUBLE) < 1e-9 AS still_baseline,
        CASE WHEN seen > best + 1e-9 THEN seen END AS best_unconfirmed, promotions, iterations FROM (
        SELECT study_id, greatest({BASELINE}::DOUBLE, coalesce(max(CASE WHEN status = 'promoted' THEN "primary" END), 0)) AS best,
          max("primary") AS seen, sum((status = 'promoted')::INT)::BIGINT AS promotions, count(DISTINCT iter) AS iterations FROM nodes GROUP BY 1)""",
    "best_config": _N + """SELECT study_id, lr_step, negatives, round(score, 6) AS score FROM (SELECT study_id, 'x' || visits AS lr_step, runs AS negatives, avg("primary") AS score
        FROM nodes WHERE "primary" IS NOT NULL GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY study_id ORDER BY round(score, 12) DESC, lr_step, negatives) = 1""",
    "prior_attempts": _N + """SELECT study_id, component, row_number() OVER (PARTITION BY study_id, component ORDER BY iter, id) AS attempt,
        id, mechanism, mean_delta FROM nodes WHERE operation = 'refine' AND component IS NOT NULL""",
    "status_filters": _N + """SELECT study_id, iter, id, status FROM nodes WHERE status = 'promoted'
        OR (status = 'open' AND runs > 0 AND operation <> 'draft')""",
    "evidence_distribution": _N + """SELECT status, ev AS evidence_type, count(*) AS nodes,
        array_to_string(list(substr(node, 1, 8) ORDER BY iter, id)[:5], ', ') || CASE WHEN count(*) > 5 THEN '...' ELSE '' END AS ids
        FROM (SELECT *, coalesce(evidence_type, '-') AS ev FROM nodes) GROUP BY 1, 2""",
    "exhausted_families": _N + """SELECT study_id, component, count(*) AS attempts, sum((status = 'promoted')::INT)::BIGINT AS promotions,
        greatest(coalesce(max(mean_delta), 0), 0.0) AS best_delta FROM nodes WHERE component IS NOT NULL GROUP BY 1, 2
        HAVING count(*) >= 5 AND greatest(coalesce(max(mean_delta), 0), 0.0) < 0.0002""",
    "outcome_tally": _N + """, n AS (SELECT *, (study_id, iter, coalesce(component, '-'), operation) AS a FROM nodes)
        SELECT study_id, iter, component, operation, coalesce(evidence_type, 'unresolved') AS outcome, count(*) AS nodes
        FROM n WHERE a IN (SELECT a FROM n GROUP BY a HAVING count("primary") = 0) GROUP BY 1, 2, 3, 4, 5""",
    "token_rollup": """SELECT coalesce(role, 'TOTAL') AS kind, count(*) AS calls, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens,
        (sum(length(text)) + sum(turn))::BIGINT AS total FROM conversations GROUP BY ROLLUP (role)""",
    "budget_counters": "SELECT user_id AS study_id, " + ", ".join(
        f'sum((event_type = \'{k}\')::INT)::BIGINT AS "{k}"' for k in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "access_counts": "SELECT event_type AS split, count(*) AS accesses FROM events GROUP BY 1",
    "policy_violations": """SELECT user_id, event_type AS split, count(*) AS accesses, CASE event_type WHEN 'purchase' THEN 12 ELSE 15 END::INTEGER AS allowed
        FROM events WHERE event_type IN ('purchase', 'signup') GROUP BY 1, 2 HAVING count(*) > CASE event_type WHEN 'purchase' THEN 12 ELSE 15 END""",
    "summary_table": _N + """SELECT iter, id, CASE WHEN id % 3 > 0 THEN substr((id * 1000003)::VARCHAR, 1, 8) ELSE 'root' END AS parent,
        CASE WHEN length(h) > 80 THEN substr(h, 1, 80) || '...' ELSE h END AS hypothesis, coalesce(component, '-') AS component,
        coalesce(printf('%.4f', "primary"), '-') AS score, coalesce(printf('%+.4f', round(mean_delta::DECIMAL(18, 10), 4)::DOUBLE + 0.0), '-') AS delta, status,
        concat_ws(' ; ', evidence_type, CASE WHEN status = 'promoted' AND "primary" IS NOT NULL THEN printf('confirm=%.4f', "primary") END) AS notes
        FROM (SELECT nodes.*, coalesce(regexp_replace(text, '[^ -~]', '?', 'g'), 'idea ' || id) AS h FROM nodes LEFT JOIN documents ON doc_id = id)""",
    "latest_state": """SELECT user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
    "merged_logs": """SELECT k AS id, log, event_id, event_type, value FROM (SELECT *, json_extract_string(props, '$.k') AS k, (event_type = 'click')::INTEGER AS log
        FROM events) QUALIFY row_number() OVER (PARTITION BY k ORDER BY log DESC, event_id DESC) = 1""",
    "tolerant_jsonl": """SELECT (event_id % 50)::INTEGER AS iter, event_id AS id, event_type AS status, value FROM events WHERE event_id % 31 NOT IN (5, 6)""",
    "recovered_records": """SELECT event_id // 8 AS line, sum((event_id % 41 <> 7)::INT)::BIGINT AS records, sum((event_id % 41 = 7)::INT)::BIGINT AS skipped,
        sum(CASE WHEN event_id % 41 <> 7 THEN event_id END)::BIGINT AS id_sum FROM events GROUP BY 1""",
    "flattened_progress": """SELECT event_id // 64 AS doc, day(ts)::INTEGER AS iter, day(ts) * 60.0::DOUBLE AS elapsed_s, event_id::VARCHAR AS id, value AS "primary", event_type AS status FROM events""",
    "lineage": """WITH RECURSIVE up AS (SELECT event_id AS id, event_id AS cur, 0::BIGINT AS depth FROM events UNION ALL
        SELECT id, (cur - 1) // 3, depth + 1 FROM up WHERE cur > 0) SELECT id, cur AS root, depth FROM up WHERE cur = 0""",
}
