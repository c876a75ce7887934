"""Results that the contract of a query fixes, stated here once more."""

import pytest
from pyspark.sql import functions as F

from rankspark.llm import quality, queries, toxicity

RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}


def test_url_rules_keep_their_words(spark, tmp_path):
    urls = {1: "http://a.com/en/1", 2: "http://x.example.com/en/77", 3: "http://NET/de/", 4: "https://a.example.net/de/9", 5: "http://example.net/de/8",
            6: "http://b.org/es/?q", 7: "http://net/fr/"}
    want = {1: "com/en/", 2: "example.com/en/7", 3: "net/de/", 4: "net/de/", 5: "example.net/de/8", 6: "org/es/", 7: None}
    spark.createDataFrame(list(urls.items()), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in queries.op2_url_filter(spark, str(tmp_path)).collect()}
    assert got == {k: (r, RULES.get(r, "allow")) for k, r in want.items()}


def test_models_learn_from_every_labelled_row(spark):
    """More rows than the 20,000 that a sample once took; each but the held-out ones is fitted on, repeated labels again."""
    ids = spark.range(30_000).withColumnRenamed("id", "doc_id")
    docs = ids.select("doc_id", F.concat(F.lit("word "), F.when(F.col("doc_id") % 7 == 0, "vile vile").otherwise("fine text")).alias("text"))
    labels = ids.select("doc_id", (F.col("doc_id") % 7 == 0).cast("int").alias("toxic")).unionByName(ids.limit(1).select(F.lit(3).cast("long").alias("doc_id"), F.lit(0).alias("toxic")))
    want = ids.where(~toxicity.held_out()).count() + 1
    rows = toxicity.labelled_rows(docs, labels, "toxic")
    assert rows.count() == want and rows.where(toxicity.held_out("id")).count() == 0
    assert sum(toxicity._informative(rows.select("text", "label"), 8)[1:]) == want


def test_quality_quantiles_are_exact(spark):
    values = [(1.5 * (k * 7919 % 1001), k) for k in range(1001)] + [(3.0, 2000 + k) for k in range(500)]
    df = spark.createDataFrame(values, "worth double, id long")
    shares = [i / 400 for i in range(1, 400)]
    want = df.agg(F.percentile("worth", F.lit(shares)).alias("q")).first()["q"]
    assert quality.quantiles(df, len(values), shares) == pytest.approx(want, abs=1e-9)


def test_portions_keep_every_text():
    texts = ["a" * n for n in (5, toxicity.CHARS, 0, 7, toxicity.CHARS + 1, 3)] + [None]
    found = list(toxicity.portions(texts))
    assert [t for at, part in found for t in part] == texts and all(texts[at:at + len(part)] == part for at, part in found)
    assert all(len(part) == 1 or sum(len(t or "") for t in part) <= toxicity.CHARS for _, part in found) and list(toxicity.portions([])) == []


def test_best_cut_is_that_of_counting(spark):
    rows = [(k % 3 > 0, (k * 37 % 101) / 10 + 2.0 * (k % 3 > 0)) for k in range(300)]
    cuts = [0.5 * k for k in range(26)] + [12.9]
    good = sum(y for y, _ in rows)
    right = [sum(y and w >= c for y, w in rows) / good + sum((not y) and w < c for y, w in rows) / (300 - good) for c in cuts]
    df = spark.createDataFrame([(int(y), w) for y, w in rows], "label int, worth double")
    assert right[quality.best_cut(df, cuts, good, 300 - good)] == pytest.approx(max(right), abs=1e-12)


def test_no_text_is_shuffled_for_the_quality_labels_and_no_label_is_broadcast(spark, monkeypatch):
    """Disk and memory grow with the rows alike at every size: quality joins descriptions, toxicity never broadcasts its labels."""
    from pyspark.sql import functions as F

    from rankspark.llm import quality, toxicity

    docs = spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("Some words "), F.repeat(F.lit("x "), F.col("id").cast("int"))).alias("text"))
    labels = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), (F.col("id") % 2).alias("toxic"))
    seen = []
    pin = quality.pin
    monkeypatch.setattr(quality, "pin", lambda df, name: seen.append((name, df)) or pin(df, name))
    quality.fit(docs, labels)
    joined = dict(seen)["labelled"]
    assert "text" not in joined.columns and joined.count() == toxicity.labelled_rows(docs, labels, "quality").count()
    plan = toxicity.labelled_rows(docs, labels, "toxic")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
