"""Quality by Bradley-Terry pairwise ranking.

A document is described by a few shares (repeats, capitals, symbols, ...).  Preference pairs put a good labelled document
against a bad one: every document of the rarer label meets ``PAIRS`` of the other, drawn by hash from its numbered rows, so no cross
join is made.  The logistic loss on differences of the features gives weights, and weights times features are the document's worth.  The
threshold is a quantile of worth: of the quantiles of the labelled rows the one that separates the labels best.  Scores rise with worth
and pass ``CUT`` at the threshold.

Weights and threshold come from every labelled row outside the held-out part.

Defined cases: a null or empty text has features 0 and gets a score like any other; rows without a label, or with a null id, are not
fitted on; repeated label rows count again; without both labels among them every score is the share of label 1; extra columns pass through.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.texts import add_columns
from rankspark.llm.toxicity import known_labels, learnable
from rankspark.operators.skew import dense_index
from rankspark.session import pin

PAIRS = 16
CUT = 0.3
FEATURES = ("length", "word_length", "distinct", "doubled", "most_common", "repeated_lines", "capitals", "digits", "symbols", "bars", "shouts",
            "marked_words", "ended_lines")
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_SYMBOLS = b"#$%&*@^~<>{}[]\\_=+"


def described(text: str | None) -> list[float]:
    data = text.encode("utf-8") if text else b""
    found = data.split()
    if not found:
        return [0.0] * len(FEATURES)
    n, size = len(found), len(data)
    counts = Counter(found)
    lines = [x for x in data.split(b"\n") if x]
    share = lambda drop: (size - len(data.translate(None, drop))) / size
    marked = sum(w[-1] in _SYMBOLS or w in (b"|", b"-") or w.endswith(b"!!") for w in found)
    return [np.log1p(n) / 10, min(size / n / 20, 1.0), len(counts) / n, sum(map(eq, found, found[1:])) / n, (counts.most_common(1)[0][1] - 1) / n,
            1 - len(set(lines)) / len(lines) if lines else 0.0, max(0.0, share(_CAPITALS) - n / size), share(_DIGITS), 5 * share(_SYMBOLS), 5 * share(b"|"), 5 * share(b"!"),
            marked / n, sum(x[-1:] in b".?!" for x in lines) / len(lines) if lines else 0.0]


@dataclass
class Model:
    weights: np.ndarray
    threshold: float
    scale: float

    def scorer(self) -> Callable[[list[str | None]], tuple[list[float]]]:
        at_cut = np.log(CUT / (1 - CUT))

        def score(texts: list[str | None]) -> tuple[list[float]]:
            worth = np.array([described(t) for t in texts]).reshape(-1, len(FEATURES)) @ self.weights
            x = np.clip((worth - self.threshold) / self.scale, -30, 30) + at_cut
            return ((1 / (1 + np.exp(-x))).tolist(),)
        return score


def _with_features(df: DataFrame) -> DataFrame:
    def make():
        return lambda texts: tuple(map(list, zip(*map(described, texts), strict=True)))
    return add_columns(df, {f: "double" for f in FEATURES}, ["text"], make).drop("text")


def preference_pairs(rows: DataFrame, pairs: int = PAIRS) -> DataFrame:
    """Differences of features (``d_`` columns) of (good, bad) pairs with label 1, every other pair turned round with label 0.

    ``rows``: label and the features, numbered 0 .. n-1 within the label by ``number``.
    """
    n = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rare, other = (0, 1) if n[0] <= n[1] else (1, 0)
    draw = F.explode(F.sequence(F.lit(0), F.lit(pairs - 1))).alias("draw")
    asked = rows.where(F.col("label") == rare).select("number", *FEATURES, draw)
    asked = asked.withColumn("partner", F.pmod(F.xxhash64("number", "draw"), F.lit(n[other])))
    found = rows.where(F.col("label") == other).select(F.col("number").alias("partner"), *[F.col(f).alias(f"o_{f}") for f in FEATURES])
    turned = F.col("draw") % 2 == 1
    sign = F.when(turned, -1).otherwise(1) * (1 if rare == 1 else -1)
    return asked.join(found, "partner").select(F.when(turned, 0.0).otherwise(1.0).alias("label"),
                                               *[(sign * (F.col(f) - F.col(f"o_{f}"))).alias(f"d_{f}") for f in FEATURES])


def quantiles(ranked: DataFrame, n: int, shares: list[float]) -> list[float]:
    """Quantiles of ``worth``, interpolated, by the places of the rows in a range sort: no task holds all values."""
    places = [share * (n - 1) for share in shares]
    asked = sorted({int(p) for p in places} | {min(int(p) + 1, n - 1) for p in places})
    found = {r["at"]: r["worth"] for r in dense_index(ranked, ["worth", "id"], "at").where(F.col("at").isin(asked)).select("at", "worth").collect()}
    low = [found[int(p)] for p in places]
    return [x + (found[min(int(p) + 1, n - 1)] - x) * (p - int(p)) for x, p in zip(low, places, strict=True)]


def best_cut(ranked: DataFrame, cuts: list[float], good: int, bad: int) -> int:
    """Place of the cut (ascending) with the highest share of good rows at or above it plus share of bad rows below."""
    reached = F.size(F.filter(F.lit(cuts), lambda c: c <= F.col("worth")))
    at = np.zeros((2, len(cuts) + 1), np.int64)
    for r in ranked.groupBy("label", reached.alias("reached")).agg(F.count("*").alias("n")).collect():   # two rows per cut at most
        at[r["label"], r["reached"]] = r["n"]
    below = at.cumsum(axis=1)[:, :-1]
    return int(np.argmax((good - below[1]) / good + below[0] / bad))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> Model:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    # texts are described before they meet their labels: 13 numbers a document are shuffled, never a text
    described_rows = _with_features(learnable(docs, doc_id, text)).join(known_labels(labels, label, doc_id), "id").select("id", *FEATURES, "label")
    rows = dense_index(pin(described_rows, "labelled"), ["label", *FEATURES, "id"], "number")
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not good or not bad:
        share = (good + 0.5) / (good + bad + 1)
        return Model(np.zeros(len(FEATURES)), -float(np.log(share / (1 - share)) - np.log(CUT / (1 - CUT))), 1.0)
    rows = pin(rows.withColumn("number", F.col("number") - F.when(F.col("label") == 1, bad).otherwise(0)), "described")
    names = [f"d_{f}" for f in FEATURES]
    vectors = VectorAssembler(inputCols=names, outputCol="features").transform(preference_pairs(rows))
    weights = LogisticRegression(fitIntercept=False, regParam=1e-3, maxIter=100).fit(vectors).coefficients.toArray()
    worth = sum((F.col(f) * float(w) for f, w in zip(FEATURES, weights, strict=True)), F.lit(0.0))
    ranked = rows.select("label", "id", worth.alias("worth"))
    cuts = quantiles(ranked, good + bad, [i / 400 for i in range(1, 400)])
    best = best_cut(ranked, cuts, good, bad)
    spread = ranked.agg(F.stddev("worth").alias("s")).first()["s"] or 1.0
    return Model(weights, float(cuts[best]), float(spread) / 3)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    return add_columns(docs, {name: "double"}, [text], model.scorer)
