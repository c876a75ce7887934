"""Registered ranking-metric queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions import hash_uniform
from rankspark.operators import metrics as M
from rankspark.operators.rates import popularity_scores
from rankspark.operators.splits import assign_split, pick_split
from rankspark.plans import sqltext as S
from rankspark.sources import tables as T

KEY = list(T.ROW_KEY)


def rounded(df: DataFrame, *cols: str, digits: int = 6) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(c, digits))
    return df


def split_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_split(T.impressions(spark, sf_dir), T.SPLITS, "shown_at", stored_as_time=True).drop("shown_at")


def split_rows(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    """One split; its date range is a pushed filter."""
    return pick_split(T.impressions(spark, sf_dir), T.SPLITS, split, "shown_at", stored_as_time=True).drop("shown_at")


def scored_by_popularity(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    return popularity_scores(split_rows(spark, sf_dir, "train"), split_rows(spark, sf_dir, split))


def random_score(seed) -> Column:
    return hash_uniform(F.lit(seed), *T.ROW_KEY)


def _report(df: DataFrame, counted: DataFrame, **kw) -> DataFrame:
    out = M.ranking_report(df, tiebreak=KEY, counted=counted, **kw)
    return rounded(out, "gauc", "ndcg", "primary")


def _members(spark, sf_dir, split):
    return split_rows(spark, sf_dir, split)


def report_popularity(spark, sf_dir):
    return _report(scored_by_popularity(spark, sf_dir, "test"), _members(spark, sf_dir, "test"))


def report_random(spark, sf_dir):
    test = _members(spark, sf_dir, "test")
    return _report(test.withColumn("score", random_score(0)), test)


def report_ceiling(spark, sf_dir):
    test = _members(spark, sf_dir, "test")
    return _report(test.withColumn("score", F.col("label")), test)


def report_by_split(spark, sf_dir):
    rows = split_impressions(spark, sf_dir)
    scored = popularity_scores(rows.where("split = 'train'"), rows)
    return _report(scored, rows, by=["split"])


def report_doc_length(spark, sf_dir):
    df = T.document_scores(spark, sf_dir)
    out = M.ranking_report(df, group="source", score="n_chars", tiebreak=["doc_id"])
    return rounded(out, "gauc", "ndcg", "primary")


def report_events(spark, sf_dir):
    df = T.event_impressions(spark, sf_dir)
    out = M.ranking_report(df, score="duration_ms", tiebreak=["row_id"])
    return rounded(out, "gauc", "ndcg", "primary")


#: Metrics that the report does not have, as a caller would state them.
PRECISION = M.Metric("precision", lambda label, at: {"hits": F.sum(F.when(at <= 3, label).otherwise(0))}, lambda rows, pos, s: s["hits"] / F.lit(3.0))
FIRST_HIT = M.Metric("mrr", lambda label, at: {"first": F.min(F.when(label == 1, at))}, lambda rows, pos, s: F.lit(1.0) / s["first"],
                     weight=lambda rows, pos, s: rows)


def report_own_metrics(spark, sf_dir):
    """Precision at 3 over all users, and the reciprocal place of the first positive, weighted by rows, over users who have one."""
    out = _report(scored_by_popularity(spark, sf_dir, "test"), _members(spark, sf_dir, "test"), extra=[PRECISION, FIRST_HIT])
    return rounded(out, "precision", "mrr")


def per_user_auc(spark, sf_dir):
    df = scored_by_popularity(spark, sf_dir, "test")
    out = M.per_group_scores(df, "user_id", tiebreak=KEY, counted=_members(spark, sf_dir, "test"))
    return rounded(out.select("user_id", "rows", "pos", "auc", "discriminative"), "auc")


def per_user_ndcg(spark, sf_dir):
    df = scored_by_popularity(spark, sf_dir, "test")
    out = M.per_group_scores(df, "user_id", tiebreak=KEY, counted=_members(spark, sf_dir, "test"))
    return rounded(out.select("user_id", "ndcg"), "ndcg")


def per_user_primary(spark, sf_dir):
    df = scored_by_popularity(spark, sf_dir, "valid_search")
    return M.per_user_primary(df, "user_id", tiebreak=KEY, counted=_members(spark, sf_dir, "valid_search"))


def fractional_ranks(spark, sf_dir):
    """Average rank by ascending score inside each user; equal scores share it."""
    df = T.event_impressions(spark, sf_dir).withColumn("score", F.floor("duration_ms"))
    return M.average_ranks(df, "user_id")


def topk_per_user(spark, sf_dir):
    df = scored_by_popularity(spark, sf_dir, "test")
    out = M.top_k(df, "user_id", "score", KEY, 5)
    return rounded(out.select("user_id", "position", "item_id", "order_id", "line_no", "score"), "score")


def discriminative_users(spark, sf_dir):
    out = M.discriminative_groups(_members(spark, sf_dir, "test"), "user_id")
    return out.select("user_id", F.col("pos").cast("bigint").alias("pos"), "rows")


def pair_outcomes(spark, sf_dir):
    return M.pair_outcomes(scored_by_popularity(spark, sf_dir, "valid_search"), "user_id")


_TEST_POP = f"WITH {S.POPULARITY}, src AS (SELECT * FROM pop WHERE split = 'test'),"
_SEARCH_POP = f"WITH {S.POPULARITY}, src AS (SELECT * FROM pop WHERE split = 'valid_search'),"
_KEY_TEXT = "'|' || order_id || '|' || line_no || '|' || item_id || '|' || author_id || '|' || date"

QUERIES = {
    "ranking_report_popularity": report_popularity,
    "ranking_report_random": report_random,
    "ranking_report_ceiling": report_ceiling,
    "ranking_report_by_split": report_by_split,
    "ranking_report_doc_length": report_doc_length,
    "ranking_report_events": report_events,
    "ranking_report_own_metrics": report_own_metrics,
    "per_user_auc": per_user_auc,
    "per_user_ndcg": per_user_ndcg,
    "per_user_primary": per_user_primary,
    "fractional_ranks": fractional_ranks,
    "topk_per_user": topk_per_user,
    "discriminative_users": discriminative_users,
    "pair_outcomes": pair_outcomes,
}

SQL = {
    "ranking_report_popularity": _TEST_POP + S.user_metrics("src", "user_id", S.KEY) + S.report(),
    "ranking_report_random": f"""WITH {S.SPLIT_IMP}, src AS (SELECT *, {S.uniform("'0" + _KEY_TEXT[1:])} AS score
        FROM simp WHERE split = 'test'),""" + S.user_metrics("src", "user_id", S.KEY) + S.report(),
    "ranking_report_ceiling": f"WITH {S.SPLIT_IMP}, src AS (SELECT *, label AS score FROM simp WHERE split = 'test'),"
        + S.user_metrics("src", "user_id", S.KEY) + S.report(),
    "ranking_report_by_split": f"WITH {S.POPULARITY}," + S.user_metrics("pop", "split, user_id", S.KEY)
        + S.report(by="split"),
    "ranking_report_doc_length": """WITH src AS (SELECT doc_id, source, n_chars AS score, quality AS label
        FROM documents JOIN labels USING (doc_id)),""" + S.user_metrics("src", "source", "doc_id") + S.report(),
    "ranking_report_events": """WITH src AS (SELECT event_id, user_id, value AS score,
        CAST(event_type = 'purchase' AS INTEGER) AS label FROM events),"""
        + S.user_metrics("src", "user_id", "event_id") + S.report(),
    "ranking_report_own_metrics": _TEST_POP + S.user_metrics("src", "user_id", S.KEY) + f""", own AS (SELECT user_id, count(*) AS n,
          sum(CASE WHEN place <= 3 THEN label ELSE 0 END) / 3.0::DOUBLE AS p3, 1.0::DOUBLE / min(CASE WHEN label = 1 THEN place END) AS rr
        FROM um_r GROUP BY 1)
        SELECT * FROM ({S.report()}), (SELECT round(avg(p3), 6) AS "precision",
          round(sum(n * rr) / sum(CASE WHEN rr IS NOT NULL THEN n END), 6) AS mrr FROM own)""",
    "per_user_auc": _TEST_POP + S.user_metrics("src", "user_id", S.KEY)
        + """SELECT user_id, n AS "rows", pos, round(auc, 6) AS auc, pos > 0 AND pos < n AS discriminative FROM um""",
    "per_user_ndcg": _TEST_POP + S.user_metrics("src", "user_id", S.KEY)
        + "SELECT user_id, round(ndcg, 6) AS ndcg FROM um",
    "per_user_primary": _SEARCH_POP + S.user_metrics("src", "user_id", S.KEY)
        + """SELECT user_id, round_even((auc + ndcg) / 2, 6) AS "primary" FROM um WHERE pos > 0 AND pos < n""",
    "fractional_ranks": """SELECT user_id, score, count(*) AS n, any_value(r) AS avg_rank FROM (
        SELECT user_id, score, rank() OVER (PARTITION BY user_id ORDER BY score)
          + (count(*) OVER (PARTITION BY user_id, score) - 1) / 2.0::DOUBLE AS r
        FROM (SELECT user_id, floor(value)::BIGINT AS score FROM events)) GROUP BY 1, 2""",
    "topk_per_user": _TEST_POP[:-1] + f""" SELECT user_id, position::INTEGER AS position, item_id, order_id, line_no,
        round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id
          ORDER BY score DESC, {S.KEY}) AS position FROM src) WHERE position <= 5""",
    "discriminative_users": f"""WITH {S.SPLIT_IMP} SELECT user_id, sum(label)::BIGINT AS pos, count(*) AS "rows"
        FROM simp WHERE split = 'test' GROUP BY 1 HAVING sum(label) BETWEEN 1 AND count(*) - 1""",
    "pair_outcomes": _SEARCH_POP[:-1] + """ SELECT a.user_id, count(*) AS pairs,
        sum((a.score = b.score)::INT)::BIGINT AS tied, sum((a.score > b.score)::INT)::BIGINT AS concordant,
        sum((a.score < b.score)::INT)::BIGINT AS discordant
        FROM src a JOIN src b ON a.user_id = b.user_id AND a.label = 1 AND b.label = 0 GROUP BY 1""",
}
