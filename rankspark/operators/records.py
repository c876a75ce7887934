"""Validation of JSON records, run logs and experiment fingerprints."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import is_finite
from rankspark.operators.rules import any_word, text_lines

# The record shapes.  text: non-empty string; unit: number in [0, 1]; texts: list
# of strings; flag: boolean; string: any string; a tuple lists the allowed values.
DIAGNOSIS = {"bottleneck": "text", "evidence": "text", "confidence": "unit", "component": "text",
             "edit_radius": ("small", "large"), "expected_cost": "text", "incompatibilities": "texts",
             "uncertainty": "unit"}
LITERATURE = {"mechanism": "text", "assumptions": "texts", "contradictory_findings": "texts",
              "dataset_compatibility": "texts", "implementation_cost": "text", "primary_citation": "text"}
HYPOTHESIS = {"mechanism": "text", "success_criterion_paired": "text", "implementation_sketch": "text"}
REFINEMENT = {**HYPOTHESIS, "component": "text"}
AUDIT = {"pass": "flag", "violations": "texts", "notes": "string"}
DEDUP = {"duplicate": "flag", "reasoning": "text"}

# Wording that marks a comparison with the parent, and one that names a tier.
DELTA_WORDS = ("delta", "improve", "increase", "over the parent", "vs. parent", "vs parent", "relative to parent",
               "compared to parent", "+", "-")
TIER_WORDS = ("tier", "val-", "validation", "fold", "split")

METRICS_MARK = "##CODEGEN_METRICS##"
DIVERGED = r"(?iU)\b(nan|inf|-inf|\+inf)\b|overflow|loss diverged|not finite"
METRIC_NAMES = {"primary": "primary", "gauc": "GAUC", "ndcg5": "nDCG@5"}


def _field_problem(doc: str, name: str, kind) -> Column:
    value = F.try_variant_get(doc, f"$['{name}']", "variant")
    kind_of = F.schema_of_variant(value)
    as_text = F.try_variant_get(doc, f"$['{name}']", "string")
    number = F.try_variant_get(doc, f"$['{name}']", "double")
    is_text = kind_of == "STRING"
    if isinstance(kind, tuple):
        ok = is_text & as_text.isin(*kind)
    elif kind == "text":
        ok = is_text & as_text.rlike(r"\S")
    elif kind == "string":
        ok = is_text
    elif kind == "flag":
        ok = kind_of == "BOOLEAN"
    elif kind == "unit":
        ok = kind_of.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$") & number.between(0.0, 1.0)
    else:
        ok = kind_of.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY<>")
    return F.when(value.isNull(), "missing").when(~F.coalesce(ok, F.lit(False)), "invalid")


def record_violations(df: DataFrame, key: Sequence[str], text: str, spec: Mapping[str, object]) -> DataFrame:
    """(key, field, violation) for each broken field of each record; all checks stay in the row."""
    docs = df.select(*key, F.col(text).alias("_t"), F.try_parse_json(text).alias("_d"))
    is_object = F.coalesce(F.schema_of_variant("_d").startswith("OBJECT"), F.lit(False))
    known = F.array(*[F.lit(k) for k in spec])
    unknown = F.transform(F.array_except(F.json_object_keys("_t"), known),
                          lambda k: F.struct(k.alias("field"), F.lit("unknown").alias("violation")))
    fields = F.array(*[F.struct(F.lit(k).alias("field"), _field_problem("_d", k, kind).alias("violation"))
                       for k, kind in spec.items()])
    broken = F.filter(fields, lambda s: s["violation"].isNotNull())
    whole = F.array(F.struct(F.lit("").alias("field"), F.lit("not an object").alias("violation")))
    none = F.array().cast("array<struct<field:string,violation:string>>")
    return docs.select(*key, F.inline(F.when(is_object, F.concat(F.coalesce(unknown, none), broken)).otherwise(whole)))


def criterion_problem(text: Column) -> Column:
    """Null when the criterion compares with the parent and names a tier."""
    return (F.when(~any_word(text, DELTA_WORDS), "no comparison wording")
            .when(~any_word(text, TIER_WORDS), "no tier named"))


def verdict_problem(passed: Column, violations: Column) -> Column:
    """An audit passes exactly when it lists no violation."""
    return (F.when(passed & (F.size(violations) > 0), "passes with violations")
            .when(~passed & (F.size(violations) == 0), "fails without violations"))


def count_problem(items: Column, expected: Column) -> Column:
    return F.when(F.size(items) != expected, "wrong number of items")


def tolerant_json(text: Column) -> Column:
    """JSON text inside a model reply: fenced block, whole text, or the outermost braces or brackets."""
    body = F.trim(text)
    fence = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    inner = F.when(body.rlike(r"(?s)```(?:json)?\s*.*?\s*```"), fence).otherwise(body)
    braces = F.regexp_extract(inner, r"(?s)\{.*\}", 0)
    brackets = F.regexp_extract(inner, r"(?s)\[.*\]", 0)
    return (F.when(F.try_parse_json(inner).isNotNull(), inner)
            .when((braces != "") & F.try_parse_json(braces).isNotNull(), braces)
            .when((brackets != "") & F.try_parse_json(brackets).isNotNull(), brackets))


def parse_run_logs(df: DataFrame, key: str = "run_id", text: str = "text", exit_code: str = "exit_code",
                   timed_out: str | None = None) -> DataFrame:
    """Status and metrics of each run log.

    The last marker line that parses wins; without one, the last scraped value of each metric.
    Any non-finite token, or value of the marker object, makes the run diverged; no metrics (an empty object has none)
    makes it an error.
    """
    marks = F.filter(text_lines(F.col(text)), lambda l: l.contains(METRICS_MARK))
    after = F.transform(marks, lambda l: F.regexp_extract(l, METRICS_MARK + r"(.*)", 1))
    good = F.filter(after, lambda b: F.try_parse_json(b).isNotNull())
    marker = F.try_element_at(good, F.lit(-1))
    doc = df.withColumn("_m", marker).withColumn("_v", F.try_parse_json("_m"))
    cols = []
    for name, word in METRIC_NAMES.items():
        scraped = F.try_element_at(F.regexp_extract_all(text, F.lit(word + r"\s+([-+0-9.eE]+)"), F.lit(1)), F.lit(-1))
        given = F.try_variant_get("_v", f"$['{word}']", "double")
        cols.append(F.when(F.col("_m").isNotNull(), given).otherwise(scraped.try_cast("double")).alias(name))
    every = F.from_json("_m", "map<string,string>")
    empty = F.trim("_m").rlike(r"(?s)^\{\s*\}$")
    out = doc.select(key, text, exit_code, *([timed_out] if timed_out else []), F.col("_m").isNotNull().alias("_has_marker"),
                     every.alias("_all"), empty.alias("_empty"), *cols)
    bad = F.lit(False)
    for name in METRIC_NAMES:
        bad = bad | F.coalesce(~is_finite(name), F.lit(False)) & F.col(name).isNotNull()
    # every value of the marker object counts, whatever its name; numbers may be written as text
    def number(v: Column) -> Column:
        return F.regexp_replace(v, '^"|"$', "").try_cast("double")     # an overflow comes back as quoted text
    odd = F.exists(F.map_values("_all"), lambda v: number(v).isNotNull() & ~is_finite(number(v)))
    bad = bad | F.coalesce(odd, F.lit(False))
    any_metric = F.when(F.col("_has_marker"), ~F.col("_empty")).otherwise(F.coalesce(*METRIC_NAMES).isNotNull())
    status = F.when(F.col(timed_out), "timeout") if timed_out else F.when(F.lit(False), "timeout")
    status = (status.when(F.col(text).rlike(DIVERGED) | bad, "diverged").when(F.col(exit_code) != 0, "error")
              .when(any_metric, "ok").otherwise("error"))
    return out.select(key, status.alias("status"), *METRIC_NAMES)


# ---- fingerprints -----------------------------------------------------------

# The parts of a structured fingerprint and their defaults.
FINGERPRINT_DEFAULTS = {"loss_type": "pointwise_logloss", "sampler": "uniform", "feature_set": "5field_baseline",
                        "dataset_tier": "pure"}


def semantic_fingerprint(mechanism: str, parts: Mapping[str, str] | None = None) -> Column:
    """array of four strings: the structured parts with defaults, or a hash of the mechanism text."""
    parts = parts or {k: k for k in FINGERPRINT_DEFAULTS}
    given = F.coalesce(*[F.col(c) for c in parts.values()]).isNotNull()
    structured = F.array(*[F.coalesce(F.col(parts[k]), F.lit(d)) for k, d in FINGERPRINT_DEFAULTS.items()])
    text = F.lower(F.regexp_replace(F.coalesce(mechanism, F.lit("")), r"^\s+|\s+$", ""))
    hashed = F.array(F.lit("mechanism_hash"), F.substring(F.sha1(text), 1, 16), F.lit(""), F.lit(""))
    return F.when(given, structured).otherwise(hashed)


def match_fingerprints(candidates: DataFrame, entries: DataFrame, key: str, order: str,
                       fingerprint: str = "fingerprint", width: int = 4) -> DataFrame:
    """Per candidate: exact, near (one part differs) or distinct, and the earliest matching entry.

    Each entry files its order number under its ``width`` leave-one-out keys; a candidate looks its own
    keys up.  Entries shrink to one row per key first, so the join output stays
    one row per (candidate, position) however many entries share a key.
    """
    fp = F.col(fingerprint)

    def keys(df: DataFrame, carry: list[Column]) -> DataFrame:
        cells = F.array(*[F.struct(F.lit(p).alias("p"), F.concat(
            F.slice(fp, 1, p), F.array(F.lit("*")), F.slice(fp, p + 2, width)).alias("k")) for p in range(width)])
        return df.where(F.size(fp) == width).select(*carry, F.explode(cells).alias("c")).select("*", "c.p", "c.k").drop("c")

    first = entries.groupBy(fingerprint).agg(F.min(order).alias("_exact"))
    near = (keys(first, [F.col("_exact")]).groupBy("p", "k").agg(F.min("_exact").alias("_near")))
    exact = candidates.join(first, fingerprint, "left")
    looked = (keys(candidates, [F.col(key)]).join(near, ["p", "k"], "left").groupBy(key).agg(F.min("_near").alias("_near")))
    both = exact.join(looked, key, "left")
    status = (F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_near").isNotNull(), "near").otherwise("distinct"))
    return both.select(key, status.alias("status"), F.coalesce("_exact", "_near").alias("entry"))


def known_fingerprints(candidates: DataFrame, entries: DataFrame, fingerprint: str = "fingerprint") -> DataFrame:
    """Candidates whose fingerprint the evidence store already holds."""
    return candidates.join(entries.select(fingerprint).distinct(), fingerprint, "left_semi")
