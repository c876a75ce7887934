"""Search-history queries.  Every operator takes a study key, so one job covers any number of runs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions import clip_text
from rankspark.operators.skew import running, step_back
from rankspark.session import pin

# Thresholds of the search policy.
WEAKEST_MIN_DELTA = 0.005
EXHAUSTED_ATTEMPTS, EXHAUSTED_DELTA = 5, 0.0002
STOP_MARGIN, GAIN_PER_ITERATION = 0.002, 0.01
UCB_EXPLORATION, UCB_COST = 0.7, 0.05
PRIOR_MEAN, PRIOR_STD, RUN_STD = 0.5, 0.2, 0.02
REFINE_CADENCE, REFINE_PLATEAU, REFINE_MIN_GAIN = 3, 0.001, 0.0005
BASELINE_EPSILON = 1e-9
IMPLAUSIBLE_CEILING, IMPLAUSIBLE_JUMP = 0.8645, 0.02
SEALED_LIMITS = {"test": 1}
PLATEAU_WORDS = ("plateau", "stagnant", "stagnated", "no improvement", "flat")

STUDY = ("study_id",)
#: Place in the log; decides ties, so ids may be text.
LOG_ORDER = ("iter", "id")


# ---- trajectories -----------------------------------------------------------

def running_best(df: DataFrame, value: str, baseline: float, study: Sequence[str] = STUDY,
                 order: Sequence[str] = ("iter",), name: str = "running_best") -> DataFrame:
    """Best so far, starting from the baseline; iterations without a score carry it forward."""
    out = running(df, study, order, value, "max", "_best")
    return out.withColumn(name, F.greatest(F.col("_best"), F.lit(baseline))).drop("_best")


def improvement_score(df: DataFrame, baseline: float, best: str = "running_best", steps: int = 3,
                      study: Sequence[str] = STUDY, order: Sequence[str] = ("iter",)) -> DataFrame:
    """Best now minus best ``steps`` iterations ago; the baseline counts as the entry before the first."""
    back = step_back(df, study, order, {"_then": (best, steps), "_first": (best, steps - 1)})
    then = F.when(F.col("_then").isNull() & F.col("_first").isNotNull(), F.lit(baseline)).otherwise(F.col("_then"))
    if steps == 1:
        then = F.coalesce(F.col("_then"), F.lit(baseline))
    return back.withColumn("improvement_score", F.col(best) - then).drop("_then", "_first")


def plateau(df: DataFrame, best: str = "running_best", epsilon: float = 0.002, window: int = 3,
            study: Sequence[str] = STUDY, order: Sequence[str] = ("iter",)) -> DataFrame:
    """True where the last ``window`` entries did not beat the entries before them by more than epsilon.

    On a running best, max(last N) - max(before) <= epsilon reduces to one lag.
    """
    back = step_back(df, study, order, {"_then": (best, window)})
    return back.withColumn("plateau", F.coalesce(F.col(best) - F.col("_then") <= epsilon, F.lit(False))).drop("_then")


def promotion_ladder(df: DataFrame, value: str, baseline: float, study: Sequence[str] = STUDY,
                     order: Sequence[str] = ("iter", "id")) -> DataFrame:
    """Rows that set a strictly higher score than everything before them."""
    best = running_best(df.where(F.col(value).isNotNull()), value, baseline, study, order)
    back = step_back(best, study, order, {"_prev": ("running_best", 1)})
    return back.where(F.col(value) > F.coalesce("_prev", F.lit(baseline))).drop("_prev", "running_best")


def implausible_scores(df: DataFrame, value: str, threshold: float | None = None, study: Sequence[str] = STUDY,
                       order: Sequence[str] = ("iter", "id")) -> DataFrame:
    """Scores above the ceiling, above a threshold, or a jump over the best score before them."""
    back = running(df, study, order, value, "max", "_prev", before=True)
    jump = F.coalesce(F.col(value) - F.col("_prev") > IMPLAUSIBLE_JUMP, F.lit(False))
    over = F.col(value) > F.lit(threshold) if threshold is not None else F.lit(False)
    flag = (F.col(value) > IMPLAUSIBLE_CEILING) | over | jump
    return back.where(F.coalesce(flag, F.lit(False))).drop("_prev")


def session_wallclock(df: DataFrame, elapsed: str = "elapsed_s", study: Sequence[str] = STUDY,
                      order: Sequence[str] = ("iter",)) -> DataFrame:
    """Total time over sessions: the clock restarts on resume, so add up each session's last reading."""
    ahead = step_back(df, study, order, {"_next": (elapsed, -1)})
    last = F.when(F.col("_next").isNull() | (F.col("_next") < F.col(elapsed)), F.col(elapsed))
    return ahead.groupBy(*study).agg(F.sum(last).alias("total_s"), F.count(last).alias("sessions"),
                                     F.count(F.lit(1)).alias("iterations"),
                                     (F.sum(last) / F.count(F.lit(1))).alias("mean_s"))


# ---- picks ------------------------------------------------------------------

def posterior(scores: str | Column, runs: str | Column) -> tuple[Column, Column]:
    """Mean and deviation of a node's final score; a broad prior before its first run."""
    scores = F.col(scores) if isinstance(scores, str) else scores
    runs = F.col(runs) if isinstance(runs, str) else runs
    ran = runs > 0
    return (F.when(ran, scores).otherwise(PRIOR_MEAN),
            F.when(ran, F.lit(RUN_STD) / F.sqrt(runs)).otherwise(PRIOR_STD))


def _first_rows(df: DataFrame, study: Sequence[str], order: Sequence[Column | str], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each study.  The rank limit prunes on the map side, so a large study shuffles only its head."""
    place = F.row_number().over(Window.partitionBy(*study).orderBy(*order))
    return df.withColumn("_r", place).where(F.col("_r") <= n).drop("_r")


def triage(df: DataFrame, mean: str = "post_mean", std: str = "post_std", keep: int = 3, wildcard: bool = True,
           study: Sequence[str] = STUDY, id: str = "id", order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """The best ``keep - 1`` by mean plus the most uncertain of the rest; ties go to the earlier in the log."""
    study = list(study)
    by_mean = [F.col(mean).desc(), *order]
    if not wildcard:
        return _first_rows(df, study, by_mean, keep).withColumn("reason", F.lit("mean"))
    sizes = df.groupBy(*study).agg(F.count(F.lit(1)).alias("_n"))
    enough = sizes.where(F.col("_n") > max(keep - 1, 1)).select(*study)
    few = _first_rows(df, study, by_mean, keep).join(enough, study, "left_anti").withColumn("reason", F.lit("mean"))
    rest, top = df.join(enough, study, "left_semi"), None
    if keep >= 2:
        top = _first_rows(df, study, by_mean, keep - 1).join(enough, study, "left_semi")
        rest = rest.join(top.select(*study, id), [*study, id], "left_anti")
    wild = _first_rows(rest, study, [F.col(std).desc(), F.col(mean).desc(), *order]).withColumn("reason", F.lit("wildcard"))
    out = few.unionByName(wild)
    return out if top is None else out.unionByName(top.withColumn("reason", F.lit("mean")))


def ucb_scores(df: DataFrame, score: str = "primary", visits: str = "visits", seconds: str = "seconds",
               study: Sequence[str] = STUDY) -> DataFrame:
    """Value plus exploration minus cost; unvisited nodes are infinite."""
    total = df.groupBy(*study).agg(F.sum(visits).alias("_total"))
    bonus = F.lit(UCB_EXPLORATION) * F.sqrt(F.log(F.greatest(F.col("_total"), F.lit(1)).cast("double")) / F.col(visits))
    value = F.coalesce(F.col(score), F.lit(0.0)) + bonus - F.lit(UCB_COST) * (F.col(seconds) / 60.0)
    return (df.join(total, list(study))
            .withColumn("ucb", F.when(F.col(visits) == 0, F.lit(float("inf"))).otherwise(value)).drop("_total"))


def ucb_pick(df: DataFrame, id: str = "id", order: Sequence[str] = LOG_ORDER, study: Sequence[str] = STUDY, **cols) -> DataFrame:
    """The open node with the highest score; the earliest in the log wins ties."""
    best = _first_rows(ucb_scores(df, study=study, **cols), study, [F.col("ucb").desc(), *order])
    return best.select(*study, id, "ucb")


def weakest_component(deltas: DataFrame, min_delta: float = WEAKEST_MIN_DELTA, study: Sequence[str] = STUDY) -> DataFrame:
    """Component with the smallest delta, or null when no delta is meaningful."""
    return deltas.groupBy(*study).agg(
        F.when(F.max("delta") > min_delta, F.min_by("component", F.struct("delta", "component"))).alias("component"))


def champion(df: DataFrame, baseline: float, score: str = "primary", study: Sequence[str] = STUDY, id: str = "id",
             order: Sequence[str] = LOG_ORDER) -> DataFrame:
    promoted = df.where("status = 'promoted'")
    counts = promoted.groupBy(*study).agg(F.count(F.lit(1)).alias("promoted"))
    best = _first_rows(promoted, study, [F.coalesce(F.col(score), F.lit(0.0)).desc(), *order])
    return best.join(counts, list(study)).select(*study, id, "iter", F.col(score).alias("score"), "promoted",
                                                 (F.col(score) - F.lit(baseline)).alias("vs_baseline"))


def best_config(grid: DataFrame, by: Sequence[str], config: Sequence[str], score: str) -> DataFrame:
    """Best configuration per group by validation score; ties go to the settings that sort first, numbers or text."""
    return _first_rows(grid, by, [F.col(score).desc(), *config]).select(*by, *config, score)


# ---- policy decisions -------------------------------------------------------

def global_stop(nodes: DataFrame, budget: int, baseline: float, study: Sequence[str] = STUDY) -> DataFrame:
    """Stop when nothing is open, no iterations remain, or no open node can reach the champion."""
    remaining = F.greatest(F.lit(budget) - F.col("last_iter"), F.lit(0))
    per = nodes.groupBy(*study).agg(
        F.max("iter").alias("last_iter"),
        F.max(F.when(F.col("status") == "open", F.col("primary"))).alias("best_open"),
        F.sum((F.col("status") == "open").cast("bigint")).alias("open_nodes"),
        F.greatest(F.max(F.when(F.col("status") == "promoted", F.col("primary"))), F.lit(baseline)).alias("champion"))
    reach = F.col("best_open") + F.lit(GAIN_PER_ITERATION) * F.col("remaining")
    stop = ((F.col("remaining") <= 0) | (F.col("open_nodes") == 0)
            | F.coalesce(reach - F.col("champion") < STOP_MARGIN, F.lit(True)))
    return per.withColumn("remaining", remaining).withColumn("stop", stop).select(*study, "remaining", "open_nodes", "stop")


def refine_triggers(nodes: DataFrame, baseline: float, improvements: DataFrame | None = None, study: Sequence[str] = STUDY,
                    id: str = "id", order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """Per study: iterations that improved since the last refine in the log, both triggers, and the node to refine.

    ``improvements`` (study, iter, improvement_score) gives the plateau trigger its latest score.
    """
    study, at = list(study), F.struct(*order)
    last = nodes.groupBy(*study).agg(F.max(F.when(F.col("operation") == "refine", at)).alias("_last"))
    # an iteration counts once, however many candidates it held
    since = (nodes.join(last, study).where((F.col("operation") == "improve") & (F.col("_last").isNull() | (at > F.col("_last"))))
             .groupBy(*study).agg(F.count_distinct("iter").alias("improves")))
    usable = nodes.where((F.col("status") == "open") & (F.col("runs") > 0) & (F.col("primary") > baseline + REFINE_MIN_GAIN))
    target = _first_rows(usable, study, [F.col("primary").desc(), *order]).select(*study, F.col(id).alias("target"))
    out = last.join(since, study, "left").join(target, study, "left")
    flat = F.lit(None).cast("boolean")
    if improvements is not None:
        recent = improvements.groupBy(*study).agg(F.max_by("improvement_score", "iter").alias("_recent"))
        out, flat = out.join(recent, study, "left"), plateau_trigger(F.col("_recent"))
    improves = F.coalesce("improves", F.lit(0))
    return out.select(*study, improves.alias("improves"), (improves >= REFINE_CADENCE).alias("cadence"), flat.alias("plateau"), "target")


def plateau_trigger(improvement: Column) -> Column:
    return F.coalesce(improvement <= REFINE_PLATEAU, F.lit(False))


def final_summary(nodes: DataFrame, baseline: float, study: Sequence[str] = STUDY) -> DataFrame:
    """Best confirmed score, whether it still is the baseline, and the best unconfirmed one."""
    per = nodes.groupBy(*study).agg(
        F.greatest(F.max(F.when(F.col("status") == "promoted", F.col("primary"))), F.lit(baseline)).alias("best"),
        F.max("primary").alias("seen"), F.sum((F.col("status") == "promoted").cast("bigint")).alias("promotions"),
        F.count_distinct("iter").alias("iterations"))
    return per.select(*study, "best", (F.col("best") - F.lit(baseline)).alias("vs_baseline"),
                      (F.abs(F.col("best") - F.lit(baseline)) < BASELINE_EPSILON).alias("still_baseline"),
                      F.when(F.col("seen") > F.col("best") + BASELINE_EPSILON, F.col("seen")).alias("best_unconfirmed"),
                      "promotions", "iterations")


def prior_attempts(nodes: DataFrame, study: Sequence[str] = STUDY, order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """Refine attempts per component in log order, with their mechanism: position by running count."""
    refined = nodes.where("operation = 'refine' AND component IS NOT NULL").withColumn("_one", F.lit(1))
    return (running(refined, [*study, "component"], list(order), "_one", "sum", "attempt")
            .select(*study, "component", "attempt", "id", "mechanism", "mean_delta"))


# ---- roll-ups ---------------------------------------------------------------

def evidence_distribution(nodes: DataFrame, by: Sequence[str] = ("status", "evidence_type"), keep: int = 5, id: str = "id",
                          order: Sequence[str] = LOG_ORDER) -> DataFrame:
    """Count per status and evidence type, with the first 8 characters of the first ids in log order."""
    rows = nodes.withColumn("evidence_type", F.coalesce("evidence_type", F.lit("-")))
    counts = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("nodes"))
    first = Window.partitionBy(*by).orderBy(*order)
    short = F.substring(F.col(id).cast("string"), 1, 8).alias("id")
    head = (rows.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= keep)
            .groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("_r", short))).alias("_ids")))   # at most ``keep``
    ids = F.concat_ws(", ", F.transform("_ids", lambda s: s["id"]))
    return counts.join(head, list(by)).select(*by, "nodes", F.concat(
        ids, F.when(F.col("nodes") > keep, "...").otherwise("")).alias("ids"))


def token_totals(calls: DataFrame, kind: str = "kind") -> DataFrame:
    """Calls and tokens per kind with a total row."""
    out = calls.withColumn(kind, F.coalesce(kind, F.lit("unknown"))).rollup(kind).agg(
        F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("input_tokens", F.lit(0))).alias("input_tokens"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).alias("output_tokens"), F.grouping(kind).alias("_all"))
    return out.select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(kind)).alias(kind), "calls", "input_tokens",
                      "output_tokens", (F.col("input_tokens") + F.col("output_tokens")).alias("total"))


def exhausted_families(nodes: DataFrame, study: Sequence[str] = STUDY) -> DataFrame:
    per = nodes.where(F.col("component").isNotNull()).groupBy(*study, "component").agg(
        F.count(F.lit(1)).alias("attempts"), F.sum((F.col("status") == "promoted").cast("bigint")).alias("promotions"),
        F.greatest(F.max("mean_delta"), F.lit(0.0)).alias("best_delta"))
    return per.where((F.col("attempts") >= EXHAUSTED_ATTEMPTS) & (F.col("best_delta") < EXHAUSTED_DELTA))


def access_counts(log: DataFrame, split: str = "split") -> DataFrame:
    return log.groupBy(split).agg(F.count(F.lit(1)).alias("accesses"))


def policy_violations(log: DataFrame, limits: dict[str, int] | None = None, split: str = "split",
                      by: Sequence[str] = ()) -> DataFrame:
    """Sealed splits read more often than allowed."""
    limits = limits or SEALED_LIMITS
    allowed = F.create_map(*[x for k, v in limits.items() for x in (F.lit(k), F.lit(v))])
    counts = log.where(F.col(split).isin(*limits)).groupBy(*by, split).agg(F.count(F.lit(1)).alias("accesses"))
    return counts.withColumn("allowed", allowed[F.col(split)]).where(F.col("accesses") > F.col("allowed"))


def outcome_tally(nodes: DataFrame, by: Sequence[str] = ("study_id", "iter")) -> DataFrame:
    """Why nothing scored: outcome counts of iterations without any score."""
    silent = nodes.groupBy(*by).agg(F.count("primary").alias("_s")).where("_s = 0").select(*[F.col(c).alias(f"_by_{c}") for c in by])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by])   # null is a group too
    return (nodes.join(silent, same, "left_semi")
            .groupBy(*by, F.coalesce("evidence_type", F.lit("unresolved")).alias("outcome"))
            .agg(F.count(F.lit(1)).alias("nodes")))


def budget_counters(events: DataFrame, kinds: Sequence[str], study: Sequence[str] = STUDY, kind: str = "event_type",
                    amount: str | None = None) -> DataFrame:
    """One row per study, one counter column per event kind."""
    value = F.sum(amount) if amount else F.count(F.lit(1))
    out = events.groupBy(*study).pivot(kind, list(kinds)).agg(value)
    return out.fillna(0, list(kinds))


def summary_table(nodes: DataFrame, width: int = 80) -> DataFrame:
    """Report rows with derived text; numbers round half up at 4 digits; sort by (iter, id) when writing."""
    def signed(c: str) -> Column:
        return F.format_string("%+.4f", F.round(c, 4))
    score = F.coalesce(F.format_string("%.4f", F.col("primary")), F.lit("-"))
    note = F.concat_ws(" ; ", F.col("evidence_type"), F.when(F.col("confirm").isNotNull(), F.format_string("confirm=%.4f", F.col("confirm"))))
    return nodes.select("iter", "id", F.coalesce(F.substring(F.col("parent").cast("string"), 1, 8), F.lit("root")).alias("parent"),
                        clip_text("hypothesis", width).alias("hypothesis"), F.coalesce("component", F.lit("-")).alias("component"),
                        F.when(F.col("primary").isNull(), "-").otherwise(score).alias("score"),
                        F.when(F.col("mean_delta").isNull(), "-").otherwise(signed("mean_delta")).alias("delta"),
                        "status", note.alias("notes"))


def proposal_counts(diagnoses: DataFrame, confidence: str = "confidence", low: float = 0.5) -> DataFrame:
    """3 proposals when confidence is low or the text speaks of a plateau, else 1."""
    text = F.lower(F.concat_ws(" ", F.coalesce("bottleneck", F.lit("")), F.coalesce("evidence", F.lit(""))))
    flat = text.rlike("|".join(PLATEAU_WORDS))
    unsure = F.coalesce(F.col(confidence), F.lit(1.0)) < low
    return diagnoses.withColumn("proposals", F.when(unsure | flat, 3).otherwise(1))


# ---- lineage ----------------------------------------------------------------

def lineage_roots(nodes: DataFrame, node: str = "id", parent: str = "parent_id") -> DataFrame:
    """Root and depth of every node by pointer doubling: log2(depth) joins.

    Each round doubles the distance a pointer covers.  The looked-up side has one row per node, so a
    popular ancestor only skews the other side, which the join splits at run time.  A depth beyond the number of
    nodes means that links form a cycle.
    """
    state = pin(nodes.select(F.col(node).alias("id"), F.coalesce(parent, node).alias("up"),
                             F.col(parent).isNotNull().cast("bigint").alias("depth")), "lineage")
    count = state.count()
    while True:
        step = state.select(F.col("id").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        far = F.coalesce("_d", F.lit(0))
        moved = pin(state.join(step, "up", "left").select(
            "id", F.coalesce("_up", "up").alias("up"), (F.col("depth") + far).alias("depth"),
            (far > 0).alias("_open")), "lineage")
        state = moved.drop("_open")
        seen = moved.agg(F.max("depth").alias("deep"), F.bool_or("_open").alias("open")).first()
        if not seen["open"]:
            return state.select(F.col("id").alias(node), F.col("up").alias("root"), "depth")
        if seen["deep"] > count:
            raise ValueError("parent links form a cycle")
