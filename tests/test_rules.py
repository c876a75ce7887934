import json

import pytest
from pyspark.sql import functions as F

from rankspark.operators import records as C
from rankspark.operators import rules as G
from rankspark.sources import jsonl as J


def verdicts(spark, texts, **kw):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    return {r["id"]: r for r in G.gate_verdict(df, "id", **kw).collect()}


HEAD = "--- a/f.py\n+++ b/f.py\n@@ -1 +1 @@\n"
CASES = [
    ('+ Xte, yte, ute = get_split("test")', False, "1"),
    ("+ rows = load(test_dir, 'test')", False, "1"),
    ("+ feats.append(row['like_cnt'])\n+ feats.append(row['play_duration'])", False, "2"),
    ("+ feats.append(get_value(row,'like_cnt', point_in_time=True))", True, None),
    ("+ fields.append(row['follow_user_num_range'])", True, None),
    ("+from transformers import AutoModel", False, "3"),
    ("+ urllib.request.urlretrieve('https://x/w.pt')", False, "3"),
    ("+ FIELDS.append('is_like')", False, "4"),
    ("+ aux_target = batch['is_like']\n+ aux_loss = bce(aux_head(z), aux_target)", True, None),
    ("+ z = row['is_click']", False, "4"),
    ("+ lr = 0.01  # never touch like_cnt", True, None),
    ("- feats.append(row['like_cnt'])\n+ pass", True, None)]


def test_gate_rules(spark):
    got = verdicts(spark, [HEAD + c[0] for c in CASES])
    for i, (text, ok, rule) in enumerate(CASES):
        assert got[i]["passed"] == ok, (text, got[i]["reasons"])
        assert ok or got[i]["reasons"][0].startswith(rule + "|"), got[i]["reasons"]
    assert {r.split("|")[1] for r in got[2]["reasons"]} == {"like_cnt", "play_duration"}


def test_gate_edges(spark):
    got = verdicts(spark, ["", "  \n ", None, "--- a\n+++ b\n- gone\n", "x = row['like_cnt']",
                           HEAD + "+ a['like_cnt']\n+ 1\n+ 2\n+ point_in_time=True", HEAD + "+ a['like_cnt']\n+ 1\n+ 2\n+ 3\n+ point_in_time=True"])
    assert [got[i]["reasons"] for i in range(4)] == [["empty change"]] * 3 + [["no added lines"]]
    assert not got[4]["passed"]            # bare text counts whole
    assert got[5]["passed"] and not got[6]["passed"]      # three lines away, then four


def test_repeated_reasons_collapse(spark):
    got = verdicts(spark, [HEAD + "+ a = row['like_cnt']\n+ a = row['like_cnt']\n+ b = row['show_cnt']"])
    assert len(got[0]["reasons"]) == 2


def test_semantic_change(spark):
    df = spark.createDataFrame([("+ x = softmax(z)",), ("+ import os\n- axis=1",), ("+++ loss.py\n--- loss.py\n context loss",)], "t string")
    assert [r[0] for r in df.select(G.is_semantic_change(F.col("t"))).collect()] == [True, False, False]


GOOD = {"bottleneck": "b", "evidence": "e", "confidence": 1, "component": "loss", "edit_radius": "small", "expected_cost": "low",
        "incompatibilities": [], "uncertainty": 0.25}


@pytest.mark.parametrize("change,want", [
    ({}, set()), ({"bottleneck": "  "}, {("bottleneck", "invalid")}), ({"confidence": True}, {("confidence", "invalid")}),
    ({"confidence": 1.5}, {("confidence", "invalid")}), ({"confidence": "0.5"}, {("confidence", "invalid")}),
    ({"edit_radius": "huge"}, {("edit_radius", "invalid")}), ({"incompatibilities": ["a", 1]}, {("incompatibilities", "invalid")}),
    ({"incompatibilities": ["a", "b"]}, set()), ({"extra": 1}, {("extra", "unknown")}), ({"evidence": None}, {("evidence", "invalid")}),
    ({"evidence": ...}, {("evidence", "missing")})])
def test_record_checks(spark, change, want):
    rec = {k: v for k, v in {**GOOD, **change}.items() if v is not ...}
    df = spark.createDataFrame([(1, json.dumps(rec))], "id int, t string")
    got = {(r["field"], r["violation"]) for r in C.record_violations(df, ["id"], "t", C.DIAGNOSIS).collect()}
    assert got == want


def test_broken_records(spark):
    df = spark.createDataFrame([(1, "[1]"), (2, "{oops"), (3, None), (4, '{"pass": true, "violations": [], "notes": ""}')], "id int, t string")
    got = {(r["id"], r["violation"]) for r in C.record_violations(df, ["id"], "t", C.AUDIT).collect()}
    assert got == {(1, "not an object"), (2, "not an object"), (3, "not an object")}


def test_cross_fields(spark):
    row = spark.range(1).select(
        C.criterion_problem(F.lit("improves over the parent on the val-search tier")).alias("a"), C.criterion_problem(F.lit("primary above 0.6 on the tier")).alias("b"),
        C.criterion_problem(F.lit("a delta of 0.1")).alias("c"), C.verdict_problem(F.lit(True), F.array(F.lit("x"))).alias("d"),
        C.verdict_problem(F.lit(False), F.array().cast("array<string>")).alias("e")).first()
    assert list(row) == [None, "no comparison wording", "no tier named", "passes with violations", "fails without violations"]


@pytest.mark.parametrize("text,code,want", [
    ('x\n##CODEGEN_METRICS## {"primary": 0.6, "GAUC": 0.7}', 0, ("ok", .6)), ("GAUC 0.6 | nDCG@5 0.5 | primary 0.55\nprimary 0.56", 0, ("ok", .56)),
    ("epoch 1 loss nan", 0, ("diverged", None)), ("done", 0, ("error", None)), ("primary 0.5", 1, ("error", .5)),
    ("##CODEGEN_METRICS## {\"primary\": 0.6}\n##CODEGEN_METRICS## {oops", 0, ("ok", .6)), ("info banana", 0, ("error", None))])
def test_run_logs(spark, text, code, want):
    df = spark.createDataFrame([(1, text, code)], "run_id int, text string, exit_code int")
    r = C.parse_run_logs(df).first()
    assert (r["status"], r["primary"]) == want


@pytest.mark.parametrize("mark,want", [("{}", "error"), ('{"loss": 1e999, "primary": 0.5}', "diverged"), ('{"loss": "-inf", "primary": 0.5}', "diverged"),
                                       ('{"loss": [1], "note": "fine"}', "ok"), ("5", "ok")])
def test_all_values_of_a_marker_count(spark, mark, want):
    df = spark.createDataFrame([(1, "primary 0.5\n" + C.METRICS_MARK + mark, 0)], "run_id int, text string, exit_code int")
    assert C.parse_run_logs(df).first()["status"] == want


def test_tolerant_json(spark):
    texts = ['{"a": 1}', 'text ```json\n{"a": 1}\n``` more', 'so {"a": 1} it is', "list [1, 2] here", "nothing"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(C.tolerant_json(F.col("t"))).collect()] == ['{"a": 1}'] * 3 + ["[1, 2]", None]


def test_fingerprints(spark):
    entries = [(0, ["a", "b", "c", "d"]), (1, ["a", "b", "c", "x"]), (2, ["p", "q", "r", "s"]), (3, ["a", "b"])]
    cands = [(10, ["a", "b", "c", "d"]), (11, ["a", "b", "c", "z"]), (12, ["a", "b", "y", "z"]), (13, ["p", "q", "r2", "s"]), (14, ["a", "b"])]
    e = spark.createDataFrame(entries, "id int, fingerprint array<string>")
    c = spark.createDataFrame(cands, "id int, fingerprint array<string>")
    got = {r["id"]: (r["status"], r["entry"]) for r in C.match_fingerprints(c, e, "id", "id").collect()}
    assert got == {10: ("exact", 0), 11: ("near", 0), 12: ("distinct", None), 13: ("near", 2), 14: ("exact", 3)}
    assert sorted(r["id"] for r in C.known_fingerprints(c, e).collect()) == [10, 14]


# ---- logs -------------------------------------------------------------------

def test_torn_lines_and_missing_file(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"split":"test"}\n{"split": "test", trunca\n\n{"split":"valid_confirm"}\n[1]\n')
    got = J.read_jsonl(spark, str(tmp_path / "a.jsonl"), J.AUDIT_SCHEMA)
    assert sorted(r["split"] for r in got.collect()) == ["test", "valid_confirm"]
    assert J.read_jsonl(spark, str(tmp_path / "none.jsonl"), J.AUDIT_SCHEMA).count() == 0


def test_glued_records(spark):
    line = '{"iter": 1, "id": "a", "note": "x } {"}\\n{"iter": 2, "id": "b"}\\n{"iter": 3, "id'
    df = spark.createDataFrame([(line,), ('{"iter": 4, "id": "c"}',)], "value string")
    got = J.recover_glued(df, "iter int, id string")
    assert sorted(r["id"] for r in got.where("ok").collect()) == ["a", "b", "c"]
    assert got.where("not ok").count() == 1


def test_node_schema_reads_nested_maps(spark, tmp_path):
    rec = {"iter": 1, "id": "n1", "per_seed_primary": {"0": .5}, "per_user_by_seed": {"0": {"u": .4}}, "seeds_run": [0], "status": "open"}
    (tmp_path / "n.jsonl").write_text(json.dumps(rec) + "\n")
    row = J.read_jsonl(spark, str(tmp_path / "n.jsonl"), J.NODE_SCHEMA).first()
    assert row["per_user_by_seed"] == {"0": {"u": .4}} and row["per_seed_primary"] == {"0": .5}
