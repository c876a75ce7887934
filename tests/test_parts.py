"""Training beyond the local bound: rows packed once, and steps that do not depend on the packing."""

from dataclasses import replace

import numpy as np
import pytest

from rankspark.operators.vocab import CategoricalIndexer, named_fields
from rankspark.rankers import fm
from rankspark.rankers import parts as P

CONFIG = fm.FMConfig(k=3, lr=0.05, epochs=2, patience=2)


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    made = [(n, None if n % 50 == 0 else f"u{int(rng.integers(6))}", f"i{int(rng.integers(15))}", "ab"[n % 2], int(rng.random() < 0.4)) for n in range(360)]
    return spark.createDataFrame(made, "row_id bigint, user_id string, item_id string, tab string, label int").cache()


@pytest.mark.parametrize("loss, negatives", [("pointwise", 1), ("bpr", 2), ("softmax", 3)])
def test_a_step_over_parts_is_the_local_step(rows, loss, negatives, monkeypatch):
    """Parts draw the negatives of their users themselves; users beyond the bound are dealt out row by row."""
    config = replace(CONFIG, loss=loss, negatives=negatives)
    indexer = CategoricalIndexer(named_fields("user_id", "item_id", "tab")).fit(rows, ["row_id"])
    encoded = indexer.transform(rows)
    step = lambda: fm.full_step(encoded, indexer.dim, 3, "user_id", ["row_id"], config).orderBy("feature_id").toPandas()
    want = step()
    monkeypatch.setattr(fm, "MAX_LOCAL", 10)
    monkeypatch.setattr(fm, "LEAST_BATCH", 50)
    assert np.allclose(step(), want, atol=1e-9)
    monkeypatch.setattr(fm, "TASK_ROWS", 232)       # a user is heavy from 59 rows on: some are, some are not
    assert np.allclose(step(), want, atol=1e-9)


def test_blocks_hold_any_number_of_features(spark, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 4)
    table = P.made(spark, 10, lambda ids: np.stack([ids, ids * 2.0], axis=1))
    assert [tuple(r) for r in P.unpacked(table, ["a", "b"]).orderBy("feature_id").collect()] == [(i, float(i), 2.0 * i) for i in range(10)]
    again = P.packed_params(P.unpacked(table, ["a", "b"]).where("feature_id <> 5"), ["a", "b"], 10)
    assert P.unpacked(again, ["a", "b"]).where("a = 0 and feature_id > 0").select("feature_id").collect() == [(5,)]
