"""Host-level quality rules, with DataFrame functions only.

Every document is measured once; rules over the measures say which documents fail.  Failures are counted per host and rule, and a host's rate is
shrunk towards the rate of all hosts by a beta prior that is estimated from the hosts themselves: the rate p of a host with f failures among n documents
is (f + m s) / (n + s), where m is the share of failures in all documents and s comes from the intraclass correlation r of
the failures (analysis of variance), s = 1 / r - 1.  So a host of few documents is judged by what hosts are like, one of many by its own.
A host is rejected if the shrunk rate of any rule is above the rule's bound; its verdict is joined back to its documents.

Everything about a document is computed within its row; only counts per host are shuffled, summed before they are.

Defined cases: a null text has no words and fails the rule on few words; a null host is a host of its own; repeated rows are documents of their own; with one
host, or no two documents of a host, s is ``LONE`` (correlation unknown); an empty table gives no rows; extra columns pass through, but one
named like a result is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.session import pin

SPACE = r"[\x20\x09-\x0D]"
TOKEN = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Prior strength where the hosts say nothing about it.
LONE = 10.0
#: Bounds of the correlation, so that the prior stays proper.
LEAST, MOST = 1e-6, 1 - 1e-6
#: A table of so many hosts at most is broadcast.
FEW_HOSTS = 10_000
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

#: Rule -> (which documents fail it, the shrunk rate above which a host is rejected).
RULES: dict[str, tuple[str, float]] = {
    "few_words": ("n_words < 10", 0.5),
    "repeats": ("100 * n_repeat_words > 20 * n_words", 0.5),
    "symbols": ("10 * n_symbols > word_chars", 0.5),
    "dup_lines": ("10 * n_dup_lines > n_words", 0.5),
}


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the MEASURES.

    Windows of five words are sorted by hash with their places, so equal ones meet; the places of those that meet, in order, cover
    min(5, distance to the next) words each.  Lists are zipped with their own shifts, as functions that index lists per element run
    many times slower; they are columns of their own and used twice each, else the planner would compute them once per use.
    """
    docs = docs.drop(*MEASURES)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: F.trim(F.translate(line, "\t\x0b\x0c\r", "    ")) != "")
    n = F.size("__w")
    found = docs.withColumns({"__w": F.regexp_extract_all(body, F.lit(TOKEN), F.lit(0)), "__lines": lines})
    windows = F.greatest(n - (WINDOW - 1), F.lit(0))
    shifted = F.arrays_zip(*[F.slice("__w", k + 1, windows).alias(f"w{k}") for k in range(WINDOW)])
    found = found.withColumns({
        "n_words": n.cast("long"), "word_chars": F.length(F.array_join("__w", "")).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "__h": F.transform(shifted, lambda x: F.xxhash64(x))})
    place = F.when(F.size("__h") > 0, F.sequence(F.lit(0), F.size("__h") - 1)).otherwise(F.array().cast("array<int>"))
    found = found.withColumn("__g", F.sort_array(F.arrays_zip(F.col("__h").alias("h"), place.alias("i"))))
    following = F.arrays_zip(F.col("__g").alias("a"), F.slice("__g", 2, F.greatest(F.size("__g"), F.lit(1))).alias("b"))
    same = F.filter(following, lambda x: x["a"]["h"] == x["b"]["h"])
    places = F.flatten(F.transform(same, lambda x: F.array(x["a"]["i"], x["b"]["i"])))
    found = found.withColumn("__at", F.sort_array(F.array_distinct(places)))
    ends = F.arrays_zip(F.col("__at").alias("a"), F.slice("__at", 2, F.greatest(F.size("__at"), F.lit(1))).alias("b"))
    width = F.transform(ends, lambda x: F.least(F.lit(WINDOW), F.coalesce(x["b"] - x["a"], F.lit(WINDOW))))
    total = F.aggregate(width, F.lit(0).cast("long"), lambda a, x: a + x)
    return found.withColumn("n_repeat_words", total).drop("__w", "__lines", "__h", "__g", "__at")


def host_rates(rows: DataFrame, host: str, rules: list[str]) -> DataFrame:
    """(host, n, and for each rule its failures f_<rule> and shrunk rate p_<rule>).  ``rows``: host and a boolean column per rule."""
    per = rows.groupBy(F.col(f"`{host}`").alias("host")).agg(F.count("*").alias("n"), *[F.count_if(F.col(r)).alias(f"f_{r}") for r in rules])
    n = F.col("n")
    sums = [F.count("*").alias("hosts"), F.sum("n").alias("all"), F.sum(n.cast("double") * n).alias("nn")]
    for r in rules:
        f = F.col(f"f_{r}")
        sums += [F.sum(f).alias(f"f_{r}_all"), F.sum(f.cast("double") * f / n).alias(f"ff_{r}")]
    prior = per.agg(*sums)
    hosts, every = F.col("hosts"), F.col("all")
    mean = F.try_divide  # null where there is one host, or one document a host
    fair = mean(every - mean(F.col("nn"), every), hosts - 1)
    for r in rules:
        m = mean(F.col(f"f_{r}_all"), every)
        between = mean(F.col(f"ff_{r}") - m * F.col(f"f_{r}_all"), hosts - 1)
        within = mean(F.col(f"f_{r}_all") - F.col(f"ff_{r}"), every - hosts)
        below = between + (fair - 1) * within
        corr = F.greatest(F.lit(LEAST), F.least(F.lit(MOST), mean(between - within, below)))
        prior = prior.withColumn(f"m_{r}", m).withColumn(f"s_{r}", F.when(below > 0, 1 / corr - 1).otherwise(F.lit(LONE)))
    prior = prior.select(*[c for r in rules for c in (f"m_{r}", f"s_{r}")])
    return per.join(F.broadcast(prior)).select(  # the prior is one row
        "host", "n", *[f"f_{r}" for r in rules], *[((F.col(f"f_{r}") + F.col(f"m_{r}") * F.col(f"s_{r}")) / (n + F.col(f"s_{r}"))).alias(f"p_{r}") for r in rules])


def judged(docs: DataFrame, text: str = "text", host: str = "source", rules: dict[str, tuple[str, float]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with the MEASURES, ``failed`` (the rules that the document fails) and ``host_rejected``."""
    rules = RULES if rules is None else rules
    keep = docs.columns if keep is None else keep
    results = (*MEASURES, "failed", "host_rejected")
    kept = [c for c in keep if c not in results]
    narrow = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(kept)], F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text"))
    rows = measured(narrow).drop("text")
    for r, (fails, _) in rules.items():
        rows = rows.withColumn(f"r_{r}", F.expr(fails))
    rows = pin(rows, "measured")
    named = {r: f"r_{r}" for r in rules}
    rates = pin(host_rates(rows.select("host", *[F.col(c).alias(r) for r, c in named.items()]), "host", list(rules)), "hosts")
    bad = F.lit(False)
    for r, (_, most) in rules.items():
        bad = bad | (F.col(f"p_{r}") > most)
    verdicts = rates.select(F.col("host").alias("judged"), bad.alias("host_rejected"))
    verdicts = F.broadcast(verdicts) if verdicts.count() <= FEW_HOSTS else verdicts
    failed = F.array_compact(F.array(*[F.when(F.col(c), F.lit(r)) for r, c in named.items()]))
    return rows.join(verdicts, F.col("host").eqNullSafe(F.col("judged"))).select(
        *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], *MEASURES, failed.alias("failed"), "host_rejected")
