"""Runs over one encoding share it."""

from pyspark.sql import functions as F

from rankspark.operators.vocab import CategoricalIndexer, named_fields
from rankspark.rankers import fm
from rankspark.rankers import parts as P
from rankspark.rankers import study as Y
from test_parts import CONFIG, rows  # noqa: F401


def test_runs_over_one_encoding_pack_its_rows_once(rows, monkeypatch):
    packed, pinned = [], P.pin
    monkeypatch.setattr(P, "pin", lambda df, label="pinned": (packed.append(label), pinned(df, label))[1])
    monkeypatch.setattr(fm, "MAX_LOCAL", 10)
    fields = named_fields("user_id", "item_id", "tab")
    runs = Y.grid_runs(fields, rows.where("row_id < 250"), rows.where("row_id >= 250"), {"select": rows.where("row_id >= 250")}, "user_id", ["row_id"],
                       CONFIG, {"lr": (0.05, 0.1)}, (0, 1))
    assert runs.count() == 4
    assert packed.count("packed") == 2 + 4      # train and select, and for each run the split it reports


def test_a_subset_of_fields_is_encoded_as_if_fitted_alone(rows):
    train = rows.where("row_id < 100")          # later rows hold values that train never saw
    whole = CategoricalIndexer(named_fields("user_id", "item_id", "tab")).fit(train, ["row_id"])
    alone = CategoricalIndexer(named_fields("tab", "item_id")).fit(train, ["row_id"])
    part = whole.subset(["tab", "item_id"])
    assert part.sizes == alone.sizes and sorted(part.ids.collect()) == sorted(alone.ids.select("field", "value", "feature_id").collect())
    cut = whole.transform(rows).select("row_id", whole.narrowed(F.col("features"), ["tab", "item_id"]).alias("features"))
    assert sorted(cut.collect()) == sorted(alone.transform(rows).select("row_id", "features").collect())


def test_field_sets_are_indexed_together(rows, monkeypatch):
    fits, fit = [], CategoricalIndexer.fit
    monkeypatch.setattr(CategoricalIndexer, "fit", lambda self, *a: (fits.append(list(self.fields)), fit(self, *a))[1])
    base = named_fields("user_id", "item_id")
    train, select = rows.where("row_id < 250"), rows.where("row_id >= 250")
    made, done = Y.encode_sets([base, {**base, "tab": F.col("tab")}, {**base, "item_id": F.upper("item_id")}], train, select, "user_id", ["row_id"])
    assert fits == [["user_id", "item_id", "tab"], ["user_id", "item_id"]]      # the last set means another item
    assert [e.indexer.dim for e in made][0] < [e.indexer.dim for e in made][1]
    done()
