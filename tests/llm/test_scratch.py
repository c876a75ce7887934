"""Tables written on the way to a result do not stay in the shared folder."""

from pathlib import Path

import pytest

import corpus_pipeline
from rankspark.llm import nearcopies, queries, toxicity
from rankspark.session import passing, pin, scratch_root

SF = "/root/testdata/sf0.001"


def tables(spark):
    return {p.name for p in Path(scratch_root(spark).removeprefix("file:")).iterdir() if "-" in p.name and (p / "_SUCCESS").exists()}


def test_only_named_tables_stay(spark):
    before = tables(spark)
    with passing() as outer:
        first = pin(spark.range(3), "first")
        with passing() as keep:
            pin(spark.range(4), "second")
            third, fourth = keep(pin(spark.range(5), "third")), keep(pin(spark.range(6), "fourth"))
        assert first.count() == 3 and third.count() == 5  # a table of an outer step is not the inner one's to remove
        outer(third)
    assert {Path(third.pinned_path).name} == tables(spark) - before and third.count() == 5
    with pytest.raises(ValueError), passing():
        pin(spark.range(3), "failed")
        raise ValueError
    assert {Path(third.pinned_path).name} == tables(spark) - before
    assert fourth.pinned_path != third.pinned_path


def test_near_copies_and_fit_leave_no_tables_behind(spark):
    docs = queries.read(spark, SF, "documents")
    own = pin(docs.selectExpr("doc_id AS row", "text"), "own")
    before = tables(spark)
    groups = nearcopies.near_copies(own)
    assert {Path(groups.pinned_path).name} == tables(spark) - before
    assert groups.count() == own.count()
    before = tables(spark)
    toxicity.fit(docs, queries.read(spark, SF, "labels"))
    assert tables(spark) == before


def test_a_run_leaves_its_last_rows_alone(spark):
    before = tables(spark)
    out = corpus_pipeline.run(spark, SF)
    assert {Path(out.pinned_path).name} == tables(spark) - before
    assert out.count() > 50
