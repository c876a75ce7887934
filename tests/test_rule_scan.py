"""A scan of change texts runs each pattern once a line and each marker search once a change."""

from rankspark.operators import rules as G

RULES = G.RuleSet(test_explicit="zzsplit", denied=("zzcol", "zzother"), marker="zzmark", external="zzext", auxiliary=("zzaux",))


def brute(text):
    """(rule, pos, detail) of the lines of a bare text."""
    lines = (text or "").split("\n")
    marks = [i for i, l in enumerate(lines) if "zzmark" in l]
    for i, l in enumerate(lines):
        if "zzsplit" in l:
            yield 1, i, "test split"
        for n in ("zzcol", "zzother"):
            if n in l.split() and all(abs(i - m) > 3 for m in marks):
                yield 2, i, n
        if "zzext" in l:
            yield 3, i, "zzext"


def changes(spark):
    many = "\n".join(["zzcol zzext", "plain", "zzcol zzother", "", "zzsplit", "x", "zzmark", "zzcol", "y", "zzother", "zzcol"] + ["z"] * 9 + ["zzcol"])
    return [(1, many), (2, None), (3, ""), (4, "nothing"), (5, "zzmark"), (6, "zzcol"), (7, "zzmark\nzzcol")]


def test_patterns_stand_once_in_the_plan(spark):
    df = spark.createDataFrame(changes(spark), "id int, text string")
    for excused in (False, True):
        plan = G.rule_hits(df, "id", rules=RULES, excused=excused)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("zzsplit") == plan.count("zzext") == 1
        assert plan.count("zzmark") == int(excused)
        assert ("AS __markers" in plan) == excused  # a column, not an expression inside the function of a hit


def test_hits_are_those_of_plain_loops(spark):
    rows = changes(spark)
    df = spark.createDataFrame(rows, "id int, text string")
    got = sorted((r["id"], r["rule"], r["pos"], r["detail"]) for r in G.rule_hits(df, "id", rules=RULES).collect())
    assert got == sorted((i, *h) for i, t in rows for h in brute(t))
    passed = {r["id"]: r["passed"] for r in G.gate_verdict(df, "id", rules=RULES).collect()}
    assert passed == {1: False, 2: False, 3: False, 4: True, 5: True, 6: False, 7: True}
