"""The registered corpus queries beside their SQL, and the pipeline beside brute force."""

import collections
import re

import pytest
from compare import compare, duck

import corpus_pipeline
from rankspark.llm import queries, toxicity
from test_corpus_operators import brute_hits, brute_targets
from test_near_copies import brute_kept

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    ok, message, _ = compare(spark, duck(SF), name, queries.QUERIES[name], queries.SQL[name], SF)
    assert ok, message


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
    assert len(corpus_pipeline.STAGES) == 5


def test_scores_keep_the_contract(spark):
    for name, cut in (("op5_toxicity", 0.5), ("op6_quality", 0.3)):
        rows = queries.QUERIES[name](spark, SF).collect()
        assert len(rows) == queries.read(spark, SF, "documents").count()
        assert all(r["predicted"] == int(r["score"] >= cut) and 0 <= r["score"] <= 1 for r in rows)


def test_pipeline_stages(spark):
    """Each stage on the rows its predecessor left, against a plain version of its rule."""
    read = lambda t: queries.read(spark, SF, t)
    docs = read("documents")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept[name] = (before, docs)
        assert docs.columns[:5] == list(corpus_pipeline.COLUMNS)
    before, after = kept["toxicity"]
    model = toxicity.fit(before, read("labels"))
    tame = {r["doc_id"] for r in toxicity.score(before, model).where("score < 0.5").collect()}
    assert {r["doc_id"] for r in after.collect()} == tame
    before, after = kept["near duplicates"]
    assert sorted(r["doc_id"] for r in after.collect()) == brute_kept([(r["doc_id"], r["text"]) for r in before.collect()])
    before, after = kept["decontamination"]
    items = [tuple(r) for r in read("benchmark").collect()]
    assert {r["doc_id"] for r in after.collect()} == {r["doc_id"] for r in before.collect() if not brute_hits(r["text"], items)[1]}
    before, after = kept["mixing"]
    size, got = collections.Counter(), collections.Counter()
    for n, part in ((size, before), (got, after)):
        for r in part.collect():
            n[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    assert all(abs(got[s] - t) <= 0.51 for s, t in brute_targets(size).items())
    before, after = kept["sharding"]
    assert after.count() == before.count()
    assert after.groupBy("text").agg({"shard": "max"}).join(after, "text").where("shard <> `max(shard)`").count() == 0


def test_run_chains_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*corpus_pipeline.COLUMNS, "shard", "slot"] and out.count() > 50
