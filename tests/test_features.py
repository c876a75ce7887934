import pytest
from pyspark.sql import functions as F

from rankspark.operators import splits as P
from rankspark.operators.dense import FEATURES, DenseFeatures
from rankspark.operators.pairs import sample_pairs
from rankspark.operators.rates import popularity_scores
from rankspark.operators.vocab import CategoricalIndexer, named_fields
from rankspark.sources import logs as L

SCHEMA = "row_id bigint, date int, user_id string, item_id string, author_id string, tab string, duration_ms double, label int"
TRAIN = [(20220408, "1", "v1", "a1", "1", 1000, 1), (20220409, "1", "v1", "a1", "1", 1000, 1), (20220410, "1", "v2", "a1", "2", 5000, 0),
         (20220411, "2", "v1", "a1", "1", 1000, 0), (20220412, "2", "v2", "a1", "2", 5000, 0), (20220413, "2", "v3", "a2", "1", 9000, 1)]
VALID = [(20220422, "2", "v1", "a1", "1", 1000, 1), (20220423, "1", "v9", "a9", "1", 2000, 0), (20220424, "2", "v2", "a1", "2", 5000, 0)]


def frame(spark, rows):
    return spark.createDataFrame([(i, *r[:5], float(r[5]), r[6]) for i, r in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def model(spark):
    return DenseFeatures().fit(frame(spark, TRAIN))


def features(model, df):
    return {r["row_id"]: r for r in model.transform(df).collect()}


def test_unseen_item_and_user(spark, model):
    rows = features(model, frame(spark, VALID + [(20220424, "99", "v1", "a1", "7", 1000, 0)]))
    new = rows[1]
    assert new["item_is_new"] == 1.0 and new["item_imp_log"] == 0.0 and new["item_rate"] == 0.5
    assert rows[0]["item_rate"] == pytest.approx((2 + 20 * 0.5) / 23)
    assert rows[3]["user_imp_log"] == 0.0 and rows[3]["tab_code"] == -1.0
    # no train cell exists for an unknown user, so the cross falls back to the item rate
    assert rows[3]["item_rate_by_user_bucket"] == rows[3]["item_rate"]
    assert all(r[c] == r[c] for r in rows.values() for c in FEATURES)


def test_label_flip_and_row_pile_up_change_nothing(spark):
    train, valid = frame(spark, TRAIN), frame(spark, VALID)
    ranges = {"train": (20220408, 20220421), "valid": (20220422, 20220428)}
    def run(extra):
        rows = P.assign_split(train.unionByName(extra), ranges)
        out = DenseFeatures().fit(rows.where("split = 'train'")).transform(rows.where("split = 'valid'"))
        return out.where("row_id < 3").select("item_id", "date", *FEATURES)
    base = run(valid)
    flipped = run(valid.withColumn("label", 1 - F.col("label")))
    piled = run(valid.unionByName(spark.range(50).select(
        (F.col("id") + 100).alias("row_id"), F.lit(20220425).alias("date"), F.lit("1").alias("user_id"), F.lit("v9").alias("item_id"),
        F.lit("a9").alias("author_id"), F.lit("1").alias("tab"), F.lit(1.0).alias("duration_ms"), F.lit(1).alias("label"))))
    assert P.difference_rows(base, flipped).isEmpty()
    assert P.difference_rows(base, piled).isEmpty()


def test_vocabulary_is_first_appearance_order(spark):
    train = frame(spark, TRAIN)
    m = CategoricalIndexer(named_fields("user_id", "item_id", "tab")).fit(train, ["row_id"])
    vocab = {(r["field"], r["value"]): (r["local_id"], r["feature_id"]) for r in m.vocabulary().collect()}
    assert vocab[("item_id", "v1")] == (0, 3) and vocab[("item_id", "v3")] == (2, 5) and vocab[("tab", "1")] == (0, 7)
    assert m.dim == 2 + 3 + 2 + 3
    row = {r["row_id"]: r["features"] for r in m.transform(frame(spark, VALID)).collect()}
    assert row[1] == [0, 6, 7]          # unseen item takes the slot after its field's values


def test_popularity_default(spark):
    got = {r["row_id"]: r["score"] for r in popularity_scores(frame(spark, TRAIN), frame(spark, VALID)).collect()}
    assert got[1] == 0.5 and got[0] == pytest.approx(12 / 23)


@pytest.mark.parametrize("bound", [None, "3"])
def test_sampled_negatives_are_uniform_and_from_the_same_user(spark, bound):
    rows = [(20220408, f"u{i % 4}", f"v{i}", "a", "1", 1.0, int(i % 5 == 0 and i % 4 != 3)) for i in range(400)]
    if bound:
        spark.conf.set("spark.rankspark.heavy.rows", bound)
    try:
        pairs = sample_pairs(frame(spark, rows), "user_id", ["row_id"], ["item_id"], negatives=40, seed=1).collect()
    finally:
        spark.conf.unset("spark.rankspark.heavy.rows")
    users = {f"v{i}": f"u{i % 4}" for i in range(400)}
    labels = {f"v{i}": r[6] for i, r in enumerate(rows)}
    assert len(pairs) == sum(labels.values()) * 40          # u3 has no positive
    assert all(users[p["neg_item_id"]] == p["user_id"] and labels[p["neg_item_id"]] == 0 for p in pairs)
    hits = {}
    for p in pairs:
        hits[p["neg_item_id"]] = hits.get(p["neg_item_id"], 0) + 1
    assert len(hits) > 0.99 * sum(1 for v in labels if labels[v] == 0 and users[v] != "u3")


def test_csv_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,user_id,video_id,is_click,tab,duration_ms,long_view\n20220410,0,0,1,1,5000,1\n20220411,7,3,1,1,10,\n")
    (tmp_path / "b.csv").write_text("date,user_id,video_id,is_click,tab,duration_ms,long_view\n20220423,0,1,1,1,6000,0\n20220424,1,4,0,1,6000,2\n")
    (tmp_path / "items.csv").write_text("video_id,author_id,other\n0,100,x\n1,101,y\n0,200,z\n")
    df = L.with_row_id(L.read_impressions(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]))
    rows = df.orderBy("row_id").collect()
    assert [(r["row_id"], r["item_id"], r["label"]) for r in rows] == [(0, "0", 1), (1, "3", 1), (2, "1", 0), (3, "4", 1)]
    items = L.read_dim(spark, str(tmp_path / "items.csv"), "video_id", ["author_id"]).withColumnRenamed("video_id", "item_id")
    joined = L.join_attributes(df, items, "item_id", ["author_id"])
    assert {r["row_id"]: r["author_id"] for r in joined.collect()} == {0: "200", 1: "UNK", 2: "101", 3: "UNK"}
    assert L.preview(spark, {"items": str(tmp_path / "items.csv")}, 2)["items"].count() == 2


def test_split_checks(spark):
    assert P.check_ranges({"a": (1, 5), "b": (5, 9)}) == [("a", "b")]
    assert P.check_ranges({"a": (1, 4), "b": (5, 9)}) == []
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 20)], "x int, date int")
    assert P.difference_rows(df, df.limit(3)).isEmpty()
    assert P.difference_rows(df, df.distinct()).collect()[0]["surplus"] == 1


def test_vocabulary_hashes_first_places_instead_of_sorting_cells(spark, monkeypatch):
    """The first place of a value is a minimum of numbers; nulls of the order come first, as in a sort."""
    from rankspark.operators import vocab

    seen = []
    numbered = vocab.dense_index
    monkeypatch.setattr(vocab, "dense_index", lambda df, *a: seen.append(df) or numbered(df, *a))
    rows = spark.createDataFrame([(2, 1, "b", "x"), (1, 9, "a", None), (None, 5, "c", "y"), (1, 2, "b", "x"), (3, 0, "d", None)], "o int, p int, f string, g string")
    model = vocab.CategoricalIndexer(vocab.named_fields("f", "g")).fit(rows, ["o", "p"])
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan
    got = {(r["field"], r["value"]): r["feature_id"] for r in model.vocabulary().collect()}
    assert got == {("f", "c"): 0, ("f", "b"): 1, ("f", "a"): 2, ("f", "d"): 3, ("g", "y"): 5, ("g", "x"): 6, ("g", "UNK"): 7}
