import pytest

from rankspark.operators import validate as V
from rankspark.sources import logs as L


def scored(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id bigint, user_id string, label double, score double")


def test_provenance():
    V.check_provenance(["tab", "duration_ms"])
    V.check_provenance(["like_cnt"], point_in_time=True)
    with pytest.raises(ValueError, match="like_cnt.*show_cnt"):
        V.check_provenance(["like_cnt", "tab", "show_cnt"])
    assert len(V.NON_CAUSAL_COLUMNS) == len(set(V.NON_CAUSAL_COLUMNS)) == 50


@pytest.mark.parametrize("rows,rule", [
    ([("u", 1.0, float("nan"))], "score_not_finite"), ([("u", 1.0, float("inf"))], "score_not_finite"),
    ([("u", 1.0, None)], "score_not_finite"), ([("u", 2.0, 0.1)], "label_not_binary"),
    ([("u", float("nan"), 0.1)], "label_not_binary"), ([(None, 1.0, 0.1)], "user_missing")])
def test_rejections(spark, rows, rule):
    good = [("a", 1.0, 0.5), ("a", 0.0, 0.4)]
    found = V.validity_violations(scored(spark, good + rows)).collect()
    assert [(r["rule"], r["violations"], r["first_row"]) for r in found] == [(rule, 1, 2)]
    with pytest.raises(ValueError, match=rule):
        V.validated_report(scored(spark, good + rows), "test", {"test": 3})


def test_validated_report(spark):
    df = scored(spark, [("a", 1.0, 0.5), ("a", 0.0, 0.4)])
    assert V.validated_report(df, "test", {"test": 2}).first()["gauc"] == 1.0
    with pytest.raises(ValueError, match="2 rows"):
        V.validated_report(df, "test", {"test": 3})
    with pytest.raises(ValueError, match="unknown split"):
        V.validated_report(df, "other", {"test": 2})
    with pytest.raises(ValueError, match="empty"):
        V.validated_report(df.where("false"), "test", {"test": 0})


WANT = [(0, "0", "1"), (1, "0", "2"), (2, "1", "3"), (3, "1", "4")]


@pytest.mark.parametrize("lines,first", [
    (["0,0,1,-1.5", "1,0,2,-0.5", "2,1,3,0.5", "3,1,4,1.5"], None),
    (["0,0,999,1", "1,0,2,1", "2,1,3,1", "3,1,4,1"], (0, "alignment")),
    (["0,0,1,1", "1,0,2", "2,1,3,1", "3,1,4,1"], (1, "field_count")),
    (["0,0,1,1", "2,0,2,1", "2,1,3,1", "3,1,4,1"], (1, "row_id")),
    (["0,0,1,1", "1,0,2,x", "2,1,3,1", "3,1,4,1"], (1, "score_not_number")),
    (["0,0,1,1", "1,0,2,NaN", "2,1,3,1", "3,1,4,1"], (1, "score_not_finite")),
    (["0,0,1,1", "1,0,2,1", "2,1,3,1"], (3, "missing_row")),
    (["0,0,1,1", "1,0,2,1", "2,1,3,1", "3,1,4,1", "4,1,4,1"], (4, "surplus_row"))])
def test_prediction_files(spark, lines, first):
    got = spark.createDataFrame(list(enumerate(lines)), "line bigint, text string")
    want = spark.createDataFrame(WANT, "row_id bigint, user_id string, item_id string")
    v = V.prediction_verdict(V.prediction_violations(got, want)).first()
    assert v["passed"] == (first is None)
    assert first is None or (v["first_line"], v["first_violation"]) == first


def test_quoted_fields_of_written_predictions(spark, tmp_path):
    df = spark.createDataFrame([(0, "u,1", 'say "a"', 0.5), (1, "u,1", "b", 0.25)], "row_id bigint, user_id string, item_id string, score double")
    L.write_predictions(df, str(tmp_path / "out"))
    lines = L.read_prediction_lines(spark, str(tmp_path / "out"))
    assert V.prediction_verdict(V.prediction_violations(lines, df)).first()["passed"]
    bad = lines.where("line = 0").unionByName(spark.createDataFrame([(1, '1,"u,1",b,0.25,more', True)], "line bigint, text string, header_ok boolean"))
    assert V.prediction_verdict(V.prediction_violations(bad, df)).first()["first_violation"] == "field_count"


def test_prediction_file_header(spark, tmp_path):
    (tmp_path / "p.csv").write_text("row_id,user_id,item_id,score\n0,0,1,0.5\n")
    lines = L.read_prediction_lines(spark, str(tmp_path / "p.csv")).collect()
    assert [(r["line"], r["text"], r["header_ok"]) for r in lines] == [(0, "0,0,1,0.5", False)]


def test_written_predictions_use_short_numbers(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "b", 0.5), (0, "u", "a", 1234567.891)], "row_id bigint, user_id string, item_id string, score double")
    L.write_predictions(df, str(tmp_path / "out"))
    lines = L.read_prediction_lines(spark, str(tmp_path / "out")).orderBy("line").collect()
    assert [r["text"] for r in lines] == ["0,u,a,1.23457e+06", "1,u,b,0.5"]
    assert all(r["header_ok"] for r in lines)
