"""Guards: numeric validity, prediction files, provenance of input columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import is_finite
from rankspark.operators.metrics import ranking_report

# Outcome statistics that are not known at prediction time.
NON_CAUSAL_COLUMNS = (
    "show_cnt", "show_user_num", "play_cnt", "play_user_num", "play_duration", "complete_play_cnt",
    "complete_play_user_num", "valid_play_cnt", "valid_play_user_num", "long_time_play_cnt", "long_time_play_user_num",
    "short_time_play_cnt", "short_time_play_user_num", "play_progress", "comment_stay_duration", "like_cnt",
    "like_user_num", "click_like_cnt", "double_click_cnt", "cancel_like_cnt", "cancel_like_user_num", "comment_cnt",
    "comment_user_num", "direct_comment_cnt", "reply_comment_cnt", "delete_comment_cnt", "delete_comment_user_num",
    "comment_like_cnt", "comment_like_user_num", "follow_cnt", "follow_user_num", "cancel_follow_cnt",
    "cancel_follow_user_num", "share_cnt", "share_user_num", "download_cnt", "download_user_num", "report_cnt",
    "report_user_num", "reduce_similar_cnt", "reduce_similar_user_num", "collect_cnt", "collect_user_num",
    "cancel_collect_cnt", "cancel_collect_user_num", "direct_comment_user_num", "reply_comment_user_num",
    "share_all_cnt", "share_all_user_num", "outsite_share_all_cnt",
)

# Signals of the same row that may only be loss targets.
AUXILIARY_SIGNALS = ("is_click", "is_like", "is_follow", "is_comment", "is_forward", "play_time_ms")

PREDICTION_HEADER = "row_id,user_id,video_id,score"


def check_provenance(columns: Iterable[str], point_in_time: bool = False,
                     deny: Sequence[str] = NON_CAUSAL_COLUMNS) -> None:
    """Raise when a requested column is on the deny list."""
    if point_in_time:
        return
    denied = set(deny)
    offending = [c for c in columns if c in denied]
    if offending:
        raise ValueError(f"columns not known at prediction time: {offending}")


def provenance_violations(listing: DataFrame, deny: DataFrame, column: str = "column_name") -> DataFrame:
    """Catalog form: distinct listing rows whose column is denied."""
    return listing.distinct().join(deny.select(column).distinct(), column, "left_semi")


def validity_rules(user: str = "user_id", label: str = "label", score: str = "score") -> dict[str, Column]:
    """Rule name -> true where the row violates it."""
    y = F.col(label).cast("double")
    return {"score_not_finite": ~is_finite(score),
            "label_not_binary": F.coalesce(~y.isin(0.0, 1.0), F.lit(True)),
            "user_missing": F.col(user).isNull()}


def validity_violations(df: DataFrame, row_id: str = "row_id", rules: Mapping[str, Column] | None = None) -> DataFrame:
    """Per broken rule: number of rows and the first of them.  One pass, no row shuffle."""
    rules = dict(rules or validity_rules())
    sums = df.agg(*[F.sum(c.cast("bigint")).alias(f"n_{k}") for k, c in rules.items()],
                  *[F.min(F.when(c, F.col(row_id))).alias(f"f_{k}") for k, c in rules.items()])
    cells = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"n_{k}").alias("violations"),
                               F.col(f"f_{k}").alias("first_row")) for k in rules])
    return sums.select(F.inline(cells)).where(F.col("violations") > 0)


def validated_report(df: DataFrame, split: str, sizes: Mapping[str, int], row_id: str = "row_id",
                     **kwargs) -> DataFrame:
    """``ranking_report`` behind the guards: known split, right row count, valid numbers."""
    if split not in sizes:
        raise ValueError(f"unknown split {split!r}, expected one of {sorted(sizes)}")
    rows = df.count()
    if rows == 0:
        raise ValueError("empty input")
    broken = validity_violations(df, row_id).collect()      # at most one row per rule
    if broken:
        raise ValueError("; ".join(f"{r['rule']}: {r['violations']} rows, first {r['first_row']}" for r in broken))
    if rows != sizes[split]:
        raise ValueError(f"{rows} rows, but split {split!r} has {sizes[split]}")
    return ranking_report(df, tiebreak=[row_id], **kwargs)


def prediction_violations(lines: DataFrame, expected: DataFrame, user: str = "user_id", item: str = "item_id") -> DataFrame:
    """Compare a prediction file with the rows it should score, line by line.

    ``lines``: (line, text) with 0-based data lines; ``expected``: (row_id, user, item).  A full
    outer join on the dense position finds missing and surplus lines too.  The label is
    never read.  Each bad line reports the first check it fails.
    """
    # one column more than a line may have: what lands there is surplus
    f = F.from_csv("text", "s_row string, s_user string, s_item string, s_score string, s_more string", {"escape": '"'})
    # commas outside quotes: those before which an even number of quotes stands
    n = F.size(F.split("text", ',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1))
    got = lines.select("line", n.alias("n_fields"), f.alias("f")).select("line", "n_fields", "f.s_row", "f.s_user", "f.s_item", "f.s_score")
    want = expected.select(F.col("row_id").alias("line"), F.col(user).cast("string").alias("e_user"),
                           F.col(item).cast("string").alias("e_item"), F.lit(True).alias("_want"))
    both = got.join(want, "line", "full_outer")
    number = F.expr("try_cast(s_score AS double)")
    kind = (F.when(F.col("n_fields").isNull(), "missing_row")
            .when(F.col("n_fields") != 4, "field_count")
            .when(~F.expr("try_cast(s_row AS bigint)").eqNullSafe(F.col("line")), "row_id")
            .when(F.col("_want").isNull(), "surplus_row")
            .when(~(F.col("s_user").eqNullSafe(F.col("e_user")) & F.col("s_item").eqNullSafe(F.col("e_item"))),
                  "alignment")
            .when(number.isNull(), "score_not_number")
            .when(~is_finite(number), "score_not_finite"))
    return both.select("line", kind.alias("violation")).where(F.col("violation").isNotNull())


def prediction_verdict(violations: DataFrame) -> DataFrame:
    """One row: pass flag, number of bad lines, the first bad line and its violation."""
    out = violations.agg(F.count(F.lit(1)).alias("violations"), F.min("line").alias("first_line"),
                         F.min_by("violation", "line").alias("first_violation"))
    return out.select((F.col("violations") == 0).alias("passed"), "violations", "first_line", "first_violation")
