"""Leak rules over change texts.

A change is one text value, so all of its lines are in one row.  The scan works on the
line array inside the row: no explode, no shuffle, and any number of changes in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.operators.validate import AUXILIARY_SIGNALS, NON_CAUSAL_COLUMNS

#: Rule numbers: test rows, denied columns, external assets, auxiliary signals.
RULES = (1, 2, 3, 4)

# The patterns of the four rules.  (?U) gives word edges their Unicode meaning.
TEST_EXPLICIT = (r"""(?iU)(get_split\s*\(\s*['"]test['"]|splits\s*\[\s*['"]test['"]\s*\]|--split\s+test|"""
                 r"""split\s*=\s*['"]test['"]|[\w]*_?test_?[\w]*\.csv|\bX_?te\b|\bXte\b|\by_?te\b|\byte\b|"""
                 r"""\btest_split\b|\btest_data\b|\btest_set\b)""")
TEST_TOKEN = r"(?iU)\btest\b"
LOAD_HINT = (r"(?iU)(get_split|load\s*\(|encode\s*\(|read_csv|\.csv|open\s*\(|splits\s*\[|--split|split\s*=|data_dir|"
             r"np\.load|pd\.read|glob\s*\()")
POINT_IN_TIME = r"(?iU)point_in_time\s*=\s*True"
EXTERNAL = (r"(?iU)(from_pretrained|transformers|torchvision\.models|\btimm\b|torch\.hub|load_dataset\s*\(|huggingface|"
            r"hf_hub_download|snapshot_download|\bwget\b|urllib\.request|requests\.get|\bgdown\b|kagglehub|kaggle\s|"
            r"https?://|s3://|gs://|\.pt\b|\.pth\b|\.ckpt\b|\.safetensors\b|\.bin\b|openai|onnxruntime|\bfasttext\b|"
            r"gensim\.downloader)")
INPUT_EXACT_CASE = r"(?U)(\bX\b|X\[|\bX_\w+)"
INPUT_ANY_CASE = (r"(?iU)(FIELDS|features?\b|feat\b|\binput|encode|\braw\b|raw\(|np\.column_stack|np\.concatenate|np\.stack|"
                  r"np\.hstack|self\.V\[|embed|\bemb\b|offsets?)")
TARGET_USE = (r"(?iU)(target|label|\by_|_y\b|loss|aux_loss|bce|logloss|criterion|_head\b|multitask|multi_task|task_weight)")
SEMANTIC = (r"(?iU)(loss|bpr|pairwise|listwise|softmax|sampler|negative|neg_sample|\bFIELDS\b|feature|embed|\bk\s*=|lr\s*=|"
            r"learning_rate|schedule|epochs?\b|optimizer|adam|momentum|dropout|regulari|objective|margin|temperature)")
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
MARKER_REACH = 3


@dataclass(frozen=True)
class RuleSet:
    """Patterns and name lists of the scan; pass another set to scan other material."""

    test_explicit: str = TEST_EXPLICIT
    test_token: str = TEST_TOKEN
    load_hint: str = LOAD_HINT
    denied: Sequence[str] = field(default_factory=lambda: tuple(NON_CAUSAL_COLUMNS))
    marker: str = POINT_IN_TIME
    external: str = EXTERNAL
    auxiliary: Sequence[str] = field(default_factory=lambda: tuple(AUXILIARY_SIGNALS))
    input_exact_case: str = INPUT_EXACT_CASE
    input_any_case: str = INPUT_ANY_CASE
    target: str = TARGET_USE


def text_lines(text: Column) -> Column:
    """Lines without their breaks; a final break opens no extra line."""
    parts = F.split(text, LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def _is_header(line: Column) -> Column:
    return line.startswith("+++")


def added_lines(text: Column) -> Column:
    """array<struct<pos, line>> of added lines; text without any diff mark counts whole."""
    numbered = F.transform(text_lines(text), lambda l, i: F.struct(i.alias("pos"), l.alias("line")))
    marked = F.exists(text_lines(text), lambda l: l.startswith("+") | l.startswith("-") | l.startswith("@@")
                      | l.startswith("diff "))
    plus = F.filter(numbered, lambda s: s["line"].startswith("+") & ~_is_header(s["line"]))
    bare = F.transform(plus, lambda s: F.struct(s["pos"].alias("pos"), F.substring(s["line"], 2, 2**30).alias("line")))
    return F.when(marked, bare).otherwise(numbered)


def without_comment(line: Column) -> Column:
    """Drop a trailing comment unless the line holds a quote."""
    quoted = line.contains('"') | line.contains("'")
    return F.when(quoted, line).otherwise(F.substring_index(line, "#", 1))


def _names_in(code: Column, names: Sequence[str]) -> Column:
    """The listed names that occur as whole words, in list order."""
    pattern = r"(?U)\b(" + "|".join(names) + r")\b"
    found = F.regexp_extract_all(code, F.lit(pattern), F.lit(1))
    return F.when(F.size(found) > 0, F.array_intersect(F.array(*[F.lit(n) for n in names]), found)).otherwise(
        F.array().cast("array<string>"))


def _hit(rule: int, s: Column, detail: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), s["pos"].alias("pos"), detail.alias("detail"), F.trim(s["line"]).alias("line"))


def _rule_test(s: Column, rs: RuleSet) -> Column:
    code = without_comment(s["line"])
    kind = (F.when(code.rlike(rs.test_explicit), "test split")
            .when(code.rlike(rs.test_token) & code.rlike(rs.load_hint), "test near a load"))
    return F.filter(F.array(_hit(1, s, kind)), lambda h: h["detail"].isNotNull())


def _rule_denied(s: Column, rs: RuleSet) -> Column:
    return F.transform(_names_in(without_comment(s["line"]), rs.denied), lambda n: _hit(2, s, n))


def _rule_external(s: Column, rs: RuleSet) -> Column:
    code = without_comment(s["line"])
    return F.filter(F.array(_hit(3, s, F.regexp_extract(code, rs.external, 0))), lambda h: h["detail"] != "")


def _rule_auxiliary(s: Column, rs: RuleSet) -> Column:
    code = without_comment(s["line"])
    is_input = code.rlike(rs.input_exact_case) | code.rlike(rs.input_any_case)
    use = F.when(is_input, ":input").when(~code.rlike(rs.target), ":ambiguous")
    hits = F.transform(_names_in(code, rs.auxiliary), lambda n: _hit(4, s, F.concat(n, use)))
    return F.filter(hits, lambda h: h["detail"].isNotNull())


def raw_hits(added: Column, rs: RuleSet, only: Sequence[int] = RULES) -> Column:
    """Hits of the rules named before excuses, in rule, line and name order."""
    rules = [r for n, r in enumerate((_rule_test, _rule_denied, _rule_external, _rule_auxiliary), 1) if n in only]

    def over_lines(rule) -> Column:
        return F.flatten(F.transform(added, lambda s: rule(s, rs)))

    return F.concat(*[over_lines(r) for r in rules])


def marker_lines(added: Column, rs: RuleSet) -> Column:
    """Positions of the marker lines, to be a column of its own: inside ``excuse`` every hit would look for them again."""
    return F.transform(F.filter(added, lambda s: s["line"].rlike(rs.marker)), lambda s: s["pos"])


def excuse(hits: Column, markers: Column, reach: int = MARKER_REACH) -> Column:
    """Drop rule-2 hits with a marker line of the same change within ``reach`` lines."""
    near = lambda h: F.exists(markers, lambda m: F.abs(m - h["pos"]) <= reach)
    # the second use of ``markers`` also keeps the planner from moving its expression into the function of a hit
    return F.when(F.size(markers) == 0, hits).otherwise(F.filter(hits, lambda h: (h["rule"] != 2) | ~near(h)))


def scan_changes(df: DataFrame, text: str = "text", rules: RuleSet | None = None, excused: bool = True, only: Sequence[int] = RULES) -> DataFrame:
    """Adds ``added`` and ``hits`` arrays to every change; only the rules named are looked for."""
    rs = rules or RuleSet()
    out = df.withColumn("added", added_lines(F.col(text))).withColumn("hits", raw_hits(F.col("added"), rs, only))
    if not (excused and 2 in only):  # an excuse is for rule 2 alone
        return out
    marked = out.withColumn("__markers", marker_lines(F.col("added"), rs))
    return marked.withColumn("hits", excuse(F.col("hits"), F.col("__markers"))).drop("__markers")


def lines_out(df: DataFrame, key: str, arrays: Column | str, first: str) -> DataFrame:
    """One row per struct of ``arrays``, whose field ``first`` is never null.

    A plain inline makes the planner ask for non-empty arrays first, below all projections: every scan would run several times.
    """
    return df.select(key, F.inline_outer(arrays)).where(F.col(first).isNotNull())


def rule_hits(df: DataFrame, key: str, text: str = "text", rules: RuleSet | None = None, excused: bool = True, only: Sequence[int] = RULES) -> DataFrame:
    return lines_out(scan_changes(df, text, rules, excused, only), key, "hits", "rule")


def gate_verdict(df: DataFrame, key: str, text: str = "text", rules: RuleSet | None = None) -> DataFrame:
    """Pass flag and distinct reasons in first-seen order; empty changes fail."""
    blank = F.coalesce(F.trim(F.regexp_replace(F.col(text), r"\s+", " ")) == "", F.lit(True))
    scanned = scan_changes(df.select(key, text), text, rules)
    reasons = F.array_distinct(F.transform("hits", lambda h: F.concat_ws(
        "|", h["rule"].cast("string"), h["detail"], h["line"])))
    why = (F.when(blank, F.array(F.lit("empty change"))).when(F.size("added") == 0, F.array(F.lit("no added lines")))
           .otherwise(reasons))
    return scanned.select(key, why.alias("reasons")).select(key, (F.size("reasons") == 0).alias("passed"), "reasons")


def is_semantic_change(text: Column, pattern: str = SEMANTIC) -> Column:
    """True when an added or removed line carries a model, loss, feature or schedule token."""
    body = F.filter(text_lines(text), lambda l: (l.startswith("+") | l.startswith("-"))
                    & ~_is_header(l) & ~l.startswith("---"))
    return F.array_join(F.transform(body, lambda l: F.substring(l, 2, 2**30)), "\n").rlike(pattern)


def first_by_hash(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Earliest row of each distinct text; copies collapse before the shuffle."""
    return df.groupBy(F.sha1(text).alias("text_hash")).agg(F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))


def any_word(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.lower(text).contains(w) for w in words])
