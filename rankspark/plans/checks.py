"""Registered queries of the change rules, record checks and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import records as C
from rankspark.operators import rules as G
from rankspark.operators import studies as X
from rankspark.plans.ranking import rounded
from rankspark.sources import tables as T

#: A rule set over the words of the document table, so that whole texts produce hits.
PROSE = G.RuleSet(
    test_explicit=r"(?iU)\blicense\b", test_token=r"(?U)\bthe\b", load_hint=r"(?U)\bshan",
    denied=("of", "le", "der", "que", "and"), marker=r"(?U)\bto\b", external=r"(?iU)(github|copyright|released)",
    auxiliary=("la", "die", "on"), input_exact_case=r"(?U)\bTh", input_any_case=r"(?iU)ation", target=r"(?iU)(sch|ment|tion)")


def changes(spark, sf_dir):
    """Documents as change texts: lines added, removed and kept in turn; every fifth text stays bare."""
    lines = F.split("text", "\n")
    mark = F.array(F.lit("+"), F.lit("-"), F.lit(" "))
    marked = F.array_join(F.transform(lines, lambda l, i: F.concat(F.element_at(mark, i % 3 + 1), l)), "\n")
    return T.table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise(marked).alias("text"))


def added_lines(spark, sf_dir):
    out = G.lines_out(changes(spark, sf_dir), "doc_id", G.added_lines(F.col("text")), "pos")
    return out.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum("pos").alias("pos_sum"),
                                     F.sum(F.length("line")).alias("chars"))


def rule_hits(spark, sf_dir):
    out = G.rule_hits(changes(spark, sf_dir), "doc_id", rules=PROSE, excused=False)
    return out.groupBy("doc_id", "rule", "detail").agg(F.count(F.lit(1)).alias("hits"), F.min("pos").alias("first_pos"))


def rule_hits_excused(spark, sf_dir):
    out = G.rule_hits(changes(spark, sf_dir), "doc_id", rules=PROSE, only=(2,))
    return out.groupBy("doc_id", "detail").agg(F.count(F.lit(1)).alias("hits"), F.min("pos").alias("first_pos"))


def gate_verdict(spark, sf_dir):
    out = G.gate_verdict(changes(spark, sf_dir), "doc_id", rules=PROSE)
    return out.select("doc_id", "passed", F.size("reasons").alias("n_reasons"),
                      F.try_element_at("reasons", F.lit(1)).alias("first_reason"))


def external_asset_hits(spark, sf_dir):
    """The standard rule set over whole pages with their addresses, and over whole documents."""
    docs = T.table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = T.table(spark, sf_dir, "pages").select(
        (-1 - F.col("page_id")).alias("doc_id"), F.concat_ws("\n", "url", "html").alias("text"))
    hits = G.rule_hits(docs.unionByName(pages), "doc_id", only=(3,))
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.min_by("detail", "pos").alias("first_detail"))


def semantic_changes(spark, sf_dir):
    return changes(spark, sf_dir).select("doc_id", G.is_semantic_change(F.col("text"), r"(?iU)\b(license|erthe|chaux|shan)").alias("semantic"))


def text_hash_dedup(spark, sf_dir):
    return G.first_by_hash(T.table(spark, sf_dir, "documents"), "doc_id")


def diagnoses(spark, sf_dir):
    """Conversation turns as diagnosis records, with faults of every kind."""
    c = T.table(spark, sf_dir, "conversations")
    conv, turn = F.col("conv_id"), F.col("turn")
    rec = F.struct(
        F.col("text").alias("bottleneck"), F.when(conv % 5 != 0, F.col("role")).alias("evidence"),
        F.when(conv % 11 != 3, (turn * 3).cast("double") / 10).alias("confidence"),
        F.when(conv % 7 == 0, "  ").otherwise("loss").alias("component"),
        F.when(turn % 3 == 0, "small").when(turn % 3 == 1, "large").otherwise("huge").alias("edit_radius"),
        F.lit("one run").alias("expected_cost"), F.array(F.col("role")).alias("incompatibilities"),
        F.lit(0.5).alias("uncertainty"), F.when(conv % 9 == 0, turn).alias("note"))
    text = F.to_json(rec)
    text = F.when(conv % 13 == 6, F.regexp_replace(text, r'"uncertainty":0\.5', '"uncertainty":true')).otherwise(text)
    return c.select("conv_id", "turn", F.when(conv % 17 == 8, F.concat(F.lit("["), text)).otherwise(text).alias("record"))


def record_violations(spark, sf_dir):
    return C.record_violations(diagnoses(spark, sf_dir), ["conv_id", "turn"], "record", C.DIAGNOSIS)


def cross_field_violations(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations")
    lead = F.when(F.col("turn") % 4 == 0, "Delta over the parent on ").when(F.col("turn") % 4 == 1, "Score on ").otherwise("")
    tail = F.when(F.col("conv_id") % 3 == 0, "the validation split").otherwise("these rows")
    listed = F.when(F.col("conv_id") % 2 == 0, F.array("role")).otherwise(F.array().cast("array<string>"))
    problems = F.array_compact(F.array(C.criterion_problem(F.concat(lead, tail)),
                                       C.verdict_problem(F.col("turn") % 2 == 0, listed),
                                       C.count_problem(listed, F.lit(1))))
    return c.select("conv_id", "turn", F.explode(problems).alias("problem"))


def reply_json(spark, sf_dir):
    """JSON objects pulled out of chatty replies."""
    c = T.table(spark, sf_dir, "conversations")
    body = F.to_json(F.struct("conv_id", "turn"))
    reply = (F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Here it is:\n```json\n"), body, F.lit("\n```\nDone.")))
             .when(F.col("turn") % 4 == 1, F.concat(F.col("role"), F.lit(" says "), body, F.lit(" as asked")))
             .when(F.col("turn") % 4 == 2, body).otherwise(F.concat(F.lit("{"), body)))
    return c.select("conv_id", "turn", C.tolerant_json(reply).alias("json"))


def run_log_status(spark, sf_dir):
    """Events as run logs of five shapes."""
    ev = T.table(spark, sf_dir, "events")
    v = F.format_string("%.2f", "value")
    text = (F.when(F.col("event_type") == "click", F.concat(F.lit("epoch 1\n##CODEGEN_METRICS## {\"primary\": "), v, F.lit(", \"GAUC\": 0.5}\nbye")))
            .when(F.col("event_type") == "view", F.concat(F.lit("primary 0.1\nGAUC 0.25 | nDCG@5 0.5 | primary "), v))
            .when(F.col("event_type") == "error", F.concat(F.lit("loss NaN at step "), v))
            .when(F.col("event_type") == "signup", F.concat(F.lit("finished after "), v))
            .otherwise(F.concat(F.lit("##CODEGEN_METRICS## {\"primary\": 0.75}\n##CODEGEN_METRICS## {\"primary\": "), v)))
    logs = ev.select(F.col("event_id").alias("run_id"), text.alias("text"), (F.col("event_id") % 10 == 0).cast("int").alias("exit_code"),
                     (F.col("event_id") % 23 == 0).alias("late"))
    return C.parse_run_logs(logs, timed_out="late")


def _ideas(spark, sf_dir):
    p = T.table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array(
        F.col("p_type"), F.col("p_brand"), F.concat(F.lit("s"), (F.col("p_size") % 5).cast("string")),
        F.substring_index("p_name", " ", 1)).alias("fingerprint"))


def near_duplicate_fingerprints(spark, sf_dir):
    ideas = _ideas(spark, sf_dir)
    return C.match_fingerprints(ideas.where("id % 2 = 1"), ideas.where("id % 2 = 0"), "id", "id")


def exact_duplicates(spark, sf_dir):
    ideas = _ideas(spark, sf_dir)
    return C.known_fingerprints(ideas.where("id % 2 = 1"), ideas.where("id % 2 = 0")).select("id")


def idea_fingerprints(spark, sf_dir):
    d = T.table(spark, sf_dir, "documents")
    rows = d.select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.col("lang")).alias("loss_type"),
                    F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("sampler"), F.lit(None).cast("string").alias("feature_set"),
                    F.lit(None).cast("string").alias("dataset_tier"))
    return rows.select("doc_id", F.array_join(C.semantic_fingerprint("text"), "/").alias("fingerprint"))


def proposal_counts(spark, sf_dir):
    c = T.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("bottleneck"),
        F.when(F.col("conv_id") % 6 == 0, "No improvement for a week").otherwise(F.col("role")).alias("evidence"),
        F.when(F.col("turn") > 0, F.col("turn") * 0.15).alias("confidence"))
    return X.proposal_counts(c).select("conv_id", "turn", "proposals")


QUERIES = {f.__name__: f for f in (
    added_lines, rule_hits, rule_hits_excused, gate_verdict, external_asset_hits, semantic_changes, text_hash_dedup,
    record_violations, cross_field_violations, reply_json, run_log_status, near_duplicate_fingerprints,
    exact_duplicates, idea_fingerprints, proposal_counts)}

# ---- SQL --------------------------------------------------------------------

_L, _R = r"(^|[^\p{L}\p{M}\p{N}_])", r"($|[^\p{L}\p{M}\p{N}_])"

_ADDED = """WITH doc AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) - 1 AS pos, len(ls) AS n FROM doc),
marked AS (SELECT doc_id, pos, n, CASE WHEN doc_id % 5 = 0 THEN l ELSE (['+', '-', ' '])[pos % 3 + 1] || l END AS l FROM numbered),
full_lines AS (SELECT * FROM marked WHERE NOT (pos = n - 1 AND l = '')),
diffy AS (SELECT doc_id, bool_or(starts_with(l, '+') OR starts_with(l, '-') OR starts_with(l, '@@') OR starts_with(l, 'diff ')) AS d FROM full_lines GROUP BY 1),
added AS (SELECT doc_id, pos, CASE WHEN d THEN substr(l, 2) ELSE l END AS line FROM full_lines JOIN diffy USING (doc_id)
  WHERE NOT d OR (starts_with(l, '+') AND NOT starts_with(l, '+++'))),
code AS (SELECT *, CASE WHEN contains(line, '"') OR contains(line, '''') THEN line ELSE string_split(line, '#')[1] END AS c FROM added)"""


_HITS = _ADDED + f""",
hits AS (
  SELECT doc_id, 1 AS rule, pos, 0 AS k, CASE WHEN regexp_matches(c, '(?i){_L}license{_R}') THEN 'test split' ELSE 'test near a load' END AS detail, line
    FROM code WHERE regexp_matches(c, '(?i){_L}license{_R}') OR (regexp_matches(c, '{_L}the{_R}') AND regexp_matches(c, '{_L}shan'))
  UNION ALL SELECT doc_id, 2, pos, k, nm, line FROM code, (SELECT unnest(['of', 'le', 'der', 'que', 'and']) AS nm, unnest([1, 2, 3, 4, 5]) AS k)
    WHERE regexp_matches(c, '{_L}' || nm || '{_R}')
  UNION ALL SELECT doc_id, 3, pos, 0, regexp_extract(c, '(?i)(github|copyright|released)'), line FROM code WHERE regexp_matches(c, '(?i)(github|copyright|released)')
  UNION ALL SELECT doc_id, 4, pos, k, nm || CASE WHEN regexp_matches(c, '{_L}Th') OR regexp_matches(c, '(?i)ation') THEN ':input' ELSE ':ambiguous' END, line
    FROM code, (SELECT unnest(['la', 'die', 'on']) AS nm, unnest([1, 2, 3]) AS k) WHERE regexp_matches(c, '{_L}' || nm || '{_R}')
    AND (regexp_matches(c, '{_L}Th') OR regexp_matches(c, '(?i)ation') OR NOT regexp_matches(c, '(?i)(sch|ment|tion)'))),
markers AS (SELECT DISTINCT doc_id, pos AS mpos FROM added WHERE regexp_matches(line, '{_L}to{_R}')),
kept AS (SELECT * FROM hits h WHERE rule <> 2 OR NOT EXISTS (SELECT 1 FROM markers m WHERE m.doc_id = h.doc_id AND abs(mpos - pos) <= 3))"""

_FP = """WITH f AS (SELECT p_partkey AS id, p_type AS a, p_brand AS b, 's' || (p_size % 5) AS c, string_split(p_name, ' ')[1] AS d FROM part)"""

SQL = {
    "added_lines": _ADDED + " SELECT doc_id, count(*) AS lines, sum(pos)::BIGINT AS pos_sum, sum(length(line))::BIGINT AS chars FROM added GROUP BY 1",
    "rule_hits": _HITS + " SELECT doc_id, rule, detail, count(*) AS hits, min(pos)::INTEGER AS first_pos FROM hits GROUP BY 1, 2, 3",
    "rule_hits_excused": _HITS + " SELECT doc_id, detail, count(*) AS hits, min(pos)::INTEGER AS first_pos FROM kept WHERE rule = 2 GROUP BY 1, 2",
    "gate_verdict": _HITS + """, reason AS (SELECT doc_id, rule || '|' || detail || '|' || trim(line) AS r, min((rule, pos, k)) AS o FROM kept GROUP BY 1, 2)
        SELECT d.doc_id, count(r) = 0 AS passed, count(r)::INTEGER AS n_reasons, arg_min(r, o) AS first_reason
        FROM documents d LEFT JOIN reason USING (doc_id) GROUP BY 1""",
    "external_asset_hits": """WITH t AS (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - page_id, url || chr(10) || html FROM pages),
        l AS (SELECT doc_id, unnest(string_split_regex(text, '[\\n\\r]+')) AS l, generate_subscripts(string_split_regex(text, '[\\n\\r]+'), 1) AS pos FROM t),
        m AS (SELECT doc_id, bool_or(regexp_matches(l, '^([+-]|@@|diff )')) AS d FROM l GROUP BY 1),
        a AS (SELECT doc_id, pos, CASE WHEN d THEN substr(l, 2) ELSE l END AS l FROM l JOIN m USING (doc_id) WHERE NOT d OR (starts_with(l, '+') AND NOT starts_with(l, '+++'))),
        c AS (SELECT doc_id, pos, CASE WHEN contains(l, '"') OR contains(l, '''') THEN l ELSE string_split(l, '#')[1] END AS l FROM a)
        SELECT doc_id, count(*) AS hits, arg_min(regexp_extract(l, $p$EXT$p$), pos) AS first_detail FROM c WHERE regexp_matches(l, $p$EXT$p$) GROUP BY 1""".replace("EXT", "(?i)" + G.EXTERNAL[5:]),
    "semantic_changes": _ADDED + f""" SELECT doc_id, coalesce(bool_or(regexp_matches(substr(l, 2), '(?i){_L}(license|erthe|chaux|shan)'))
        FILTER (WHERE (starts_with(l, '+') OR starts_with(l, '-')) AND NOT starts_with(l, '+++') AND NOT starts_with(l, '---')), false) AS semantic
        FROM full_lines GROUP BY 1""",
    "text_hash_dedup": "SELECT sha1(text) AS text_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
    "record_violations": """SELECT conv_id, turn, field, violation FROM (
        SELECT conv_id, turn, '' AS field, 'not an object' AS violation FROM conversations WHERE conv_id % 17 = 8
        UNION ALL SELECT conv_id, turn, f.field, f.violation FROM conversations, (SELECT unnest(['bottleneck', 'evidence', 'confidence', 'confidence', 'component', 'edit_radius', 'uncertainty', 'note']) AS field,
          unnest(['invalid', 'missing', 'missing', 'invalid', 'invalid', 'invalid', 'invalid', 'unknown']) AS violation) f
        WHERE conv_id % 17 <> 8 AND CASE field || violation WHEN 'bottleneckinvalid' THEN trim(text) = '' WHEN 'evidencemissing' THEN conv_id % 5 = 0
          WHEN 'confidencemissing' THEN conv_id % 11 = 3 WHEN 'confidenceinvalid' THEN conv_id % 11 <> 3 AND turn > 3
          WHEN 'componentinvalid' THEN conv_id % 7 = 0 WHEN 'edit_radiusinvalid' THEN turn % 3 = 2
          WHEN 'uncertaintyinvalid' THEN conv_id % 13 = 6 ELSE conv_id % 9 = 0 END)""",
    "cross_field_violations": """WITH c AS (SELECT conv_id, turn, turn % 4 = 0 OR (turn % 4 = 1 AND false) AS has_delta, conv_id % 3 = 0 AS has_tier FROM conversations)
        SELECT conv_id, turn, 'no comparison wording' AS problem FROM c WHERE NOT has_delta
        UNION ALL SELECT conv_id, turn, 'no tier named' FROM c WHERE has_delta AND NOT has_tier
        UNION ALL SELECT conv_id, turn, 'passes with violations' FROM c WHERE turn % 2 = 0 AND conv_id % 2 = 0
        UNION ALL SELECT conv_id, turn, 'fails without violations' FROM c WHERE turn % 2 = 1 AND conv_id % 2 = 1
        UNION ALL SELECT conv_id, turn, 'wrong number of items' FROM c WHERE conv_id % 2 = 1""",
    "reply_json": """SELECT conv_id, turn, CASE WHEN turn % 4 < 3 THEN '{"conv_id":' || conv_id || ',"turn":' || turn || '}' END AS json FROM conversations""",
    "run_log_status": """SELECT event_id AS run_id, CASE WHEN event_id % 23 = 0 THEN 'timeout' WHEN event_type = 'error' THEN 'diverged' WHEN event_id % 10 = 0 THEN 'error'
        WHEN event_type = 'signup' THEN 'error' ELSE 'ok' END AS status,
        CASE event_type WHEN 'click' THEN value WHEN 'view' THEN value WHEN 'purchase' THEN 0.75 END::DOUBLE AS "primary",
        CASE event_type WHEN 'click' THEN 0.5 WHEN 'view' THEN 0.25 END::DOUBLE AS gauc, CASE event_type WHEN 'view' THEN 0.5 END::DOUBLE AS ndcg5 FROM events""",
    "near_duplicate_fingerprints": _FP + """, c AS (SELECT * FROM f WHERE id % 2 = 1), e AS (SELECT * FROM f WHERE id % 2 = 0),
        m AS (SELECT c.id, e.id AS eid, (c.a = e.a)::INT + (c.b = e.b)::INT + (c.c = e.c)::INT + (c.d = e.d)::INT AS same FROM c JOIN e ON true)
        SELECT id, CASE max(same) WHEN 4 THEN 'exact' WHEN 3 THEN 'near' ELSE 'distinct' END AS status,
          coalesce(min(CASE WHEN same = 4 THEN eid END), min(CASE WHEN same = 3 THEN eid END)) AS entry FROM m GROUP BY 1""",
    "exact_duplicates": _FP + " SELECT id FROM f WHERE id % 2 = 1 AND (a, b, c, d) IN (SELECT (a, b, c, d) FROM f WHERE id % 2 = 0)",
    "idea_fingerprints": """SELECT doc_id, CASE WHEN doc_id % 3 = 0 OR doc_id % 4 = 0 THEN CASE WHEN doc_id % 3 = 0 THEN lang ELSE 'pointwise_logloss' END || '/' ||
        CASE WHEN doc_id % 4 = 0 THEN source ELSE 'uniform' END || '/5field_baseline/pure'
        ELSE 'mechanism_hash/' || substr(sha1(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g'))), 1, 16) || '//' END AS fingerprint FROM documents""",
    "proposal_counts": """SELECT conv_id, turn, CASE WHEN (turn > 0 AND turn * 0.15 < 0.5) OR conv_id % 6 = 0
        OR regexp_matches(lower(text || ' ' || role), 'plateau|stagnant|stagnated|no improvement|flat') THEN 3 ELSE 1 END::INTEGER AS proposals FROM conversations""",
}
