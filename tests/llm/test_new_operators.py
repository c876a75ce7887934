"""Periodic runs, host rules and the conversation trie against brute-force versions."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankspark.llm import hostrules, queries, runs, turntrie

SF = "/root/testdata/sf0.001"
CLASHING = ("runs", "best", "collapsed", "start", "length", "period", "n_words", "failed", "host", "host_rejected", "n", "k0", "h", "x", "conv", "pos", "k", "items", "judged", "__at", "r")


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# --- periodic runs

def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            e = j + q
            if e - i >= max(6, 4 * q) and not any(all(w[x] == w[x + p] for x in range(i, e - p)) for p in range(1, q)):
                out.append((i, e - i, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def repetitive(rng):
    out = []
    for _ in range(rng.choice([1, 2, 4])):
        unit = [rng.randrange(rng.choice([2, 3, 40])) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 16, 17, 31, 33]))]
        out += unit * rng.choice([1, 2, 3, 4, 5, 9]) + unit[:rng.randrange(len(unit) + 1)]
        out = out * rng.choice([1, 1, 1, 2, 4])
    return out[:700]


def test_runs_are_those_of_brute_force():
    rng = random.Random(3)
    found = 0
    for _ in range(300):
        w = repetitive(rng)
        want = brute_runs(w)
        assert [(s, e - s, q) for s, e, q in runs.runs_of(np.array(w, np.int64))] == want
        found += len(want)
    assert found > 500


def brute_row(text):
    w = words_of(text)
    found = brute_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return found, best, " ".join(x for i, x in enumerate(w) if i not in drop)


def test_periodic_runs_of_texts(spark):
    rng = random.Random(4)
    texts = [" ".join(f"é{x}" for x in repetitive(rng)) for _ in range(60)]
    texts += [None, "", " \n ", "a", "ha " * 6, "ha " * 5, "Ha ha " * 8, "a\tb\n" * 4, "　x   " * 9, "one two three"] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).select("*", *[F.lit("q").alias(c) for c in CLASHING])
    got = {r["doc_id"]: ([tuple(x) for x in r["runs"]], r["best"] and tuple(r["best"]), r["collapsed"]) for r in runs.periodic_runs(df).collect()}
    assert got == {i: brute_row(t) for i, t in enumerate(texts)}
    assert len(set(runs.periodic_runs(df).columns)) == len(df.columns)
    assert runs.periodic_runs(df.limit(0)).count() == 0


def test_a_text_of_some_megabytes(spark):
    rng = random.Random(6)
    unit = [str(rng.randrange(10**6)) for _ in range(50_000)]
    text = " ".join(["head"] + unit * 4 + ["tail"] + ["la"] * 200_000)
    row = runs.periodic_runs(spark.createDataFrame([(text,)], "text string")).first()
    assert [tuple(x) for x in row["runs"]] == [(1, 200_000, 50_000), (200_002, 200_000, 1)]
    assert row["best"]["period"] == 1 and row["collapsed"] == " ".join(["head", *unit, "tail", "la"])
    m = hostrules.measured(spark.createDataFrame([(text,)], "text string")).first()
    assert m["n_words"] == 400_002 and m["n_repeat_words"] == 400_000


def test_query_of_periodic_runs(spark):
    rows = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SF).collect()}
    docs = [d for d in queries.read(spark, SF, "documents").collect() if len(words_of(d["text"])) < 1500]
    planted = 0
    for d in docs:
        w = words_of(d["text"])
        n, h = len(w), zlib.crc32(str(d["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
            planted += 1
        found, best, kept = brute_row(" ".join(w))
        r = rows[d["doc_id"]]
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(found), *(best or (None,) * 3))
        assert r["exponent_milli"] == (best and 1000 * best[1] // best[2])
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in found).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(kept.encode()).hexdigest()
    assert planted > 5 and len(rows) == queries.read(spark, SF, "documents").count()


# --- host rules

def brute_measures(t):
    t = t or ""
    w = words_of(t)
    lines = [x for x in t.split("\n") if words_of(x)]
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def prose(rng, n, junk=0.0):
    return " ".join("#|" if rng.random() < junk else rng.choice(["stone", "River", "é\U0001f600", "the", "of", "x-1"]) + rng.choice(["", "", "\n", str(rng.randrange(50))]) for _ in range(n))


def host_docs():
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.choice([3, 20, 60, 200])), rng.choice(["a", "b", "c", None])) for i in range(120)]
    rows += [(200 + i, prose(rng, 40, 0.9), "junk") for i in range(40)] + [(300 + i, prose(rng, 40), "junk") for i in range(5)]
    rows += [(400, prose(rng, 40, 0.9), "once"), (401, None, None), (402, "", "a"), (403, "a\n \na\n\na \n a", "a"), (404, "one two three four five " * 3, "b"), (405, "x\r\nx\r\n", "b")]
    return rows + rows[:3]


def brute_rejected(rows, fails, most):
    """Hosts by the same prior, with plain sums."""
    per = collections.defaultdict(lambda: [0, 0])
    for host, m in rows:
        per[host][0] += 1
        per[host][1] += fails(m)
    n, f = np.array([v[0] for v in per.values()], float), np.array([v[1] for v in per.values()], float)
    m, h, a = f.sum() / n.sum(), len(n), n.sum()
    between, within = (n * (f / n - m) ** 2).sum() / (h - 1), (n * (f / n) * (1 - f / n)).sum() / (a - h)
    fair = (a - (n * n).sum() / a) / (h - 1)
    below = between + (fair - 1) * within
    s = 1 / min(hostrules.MOST, max(hostrules.LEAST, (between - within) / below)) - 1 if below > 0 else hostrules.LONE
    return {host for host, (k, x) in per.items() if (x + m * s) / (k + s) > most}


@pytest.mark.parametrize("few", [hostrules.FEW_HOSTS, 0])
def test_host_rules(spark, monkeypatch, few):
    monkeypatch.setattr(hostrules, "FEW_HOSTS", few)
    rows = host_docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).select("*", *[F.lit("q").alias(c) for c in CLASHING])
    out = hostrules.judged(df)
    assert len(set(out.columns)) == len(out.columns)
    each = [(r[2], brute_measures(r[1])) for r in rows]
    tests = {"few_words": lambda m: m[0] < 10, "repeats": lambda m: 100 * m[4] > 20 * m[0], "symbols": lambda m: 10 * m[2] > m[1], "dup_lines": lambda m: 10 * m[3] > m[0]}
    bad = set().union(*[brute_rejected(each, t, 0.5) for t in tests.values()])
    assert "junk" in bad and "a" not in bad
    want = sorted((r[0], *m, tuple(x for x, t in tests.items() if t(m)), r[2] in bad) for r, (_, m) in zip(rows, each, strict=True))
    got = sorted((r["doc_id"], *[r[c] for c in hostrules.MEASURES], tuple(r["failed"]), r["host_rejected"]) for r in out.collect())
    assert got == want
    assert out.where("text is null").count() == 1 and hostrules.judged(df.limit(0)).count() == 0


def test_one_host_is_judged_alone(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, "a b", "x")], "doc_id long, text string, source string")
    assert [r["host_rejected"] for r in hostrules.judged(df).collect()] == [True, True]
    assert [r["host_rejected"] for r in hostrules.judged(df.limit(1)).collect()] == [True]


# --- conversation trie

def brute_trie(convs):
    """convs: id -> list of (turn, bytes)."""
    nodes = collections.defaultdict(list)
    for c, w in convs.items():
        for d in range(len(w) + 1):
            nodes[tuple(w[:d])].append(c)
    kids = collections.Counter(p[:-1] for p in nodes if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, members in nodes.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(members) - 1) * p[-1][1] if p else 0
    ends = collections.defaultdict(list)
    for c, w in convs.items():
        ends[tuple(w)].append(c)
    return sorted((min(m), len(p), min(nodes[p[:-1]]) if p else -1, len(m), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()) for p, m in nodes.items())


def trie_rows(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.mark.parametrize(("limit", "piece"), [(4096, 64), (1, 64), (2, 3), (1, 1), (3, 5), (5, 2)])
def test_turn_trie(spark, limit, piece):
    rng = random.Random(limit * 100 + piece)
    convs = {}
    for c in range(90):
        base = list(convs[rng.choice(list(convs))]) if convs and rng.random() < 0.7 else []
        base = base[:rng.randrange(len(base) + 1)] if rng.random() < 0.8 else base
        convs[c * 7 % 100] = base + [(t := rng.randrange(4), 5 + t) for _ in range(rng.choice([0, 0, 1, 2, 3, 9]))]
    convs[500] = [(1, 6)] * 40
    convs[501] = [(1, 6)] * 37
    convs[502] = [(1, 6)] * 40
    turns = [(c, i + 1, t, t, b) for c, w in convs.items() for i, (t, b) in enumerate(w)]
    made = turntrie.turn_trie(spark.createDataFrame(turns, "conv long, pos long, x long, y long, bytes long"), spark.createDataFrame([(c,) for c in convs], "conv long"), limit, piece)
    assert trie_rows(made) == brute_trie(convs)


def test_turns_are_numbered(spark):
    rows = [(1, 2, "user", "b"), (1, None, "user", "a"), (1, 2, None, "c"), (1, 2, "user", "b"), (None, 0, "user", "lost"), (-3, 7, "user", None), (1, 1, "", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").select("*", *[F.lit("q").alias(c) for c in ("conv", "pos", "x", "y", "bytes")])
    found = turntrie.numbered_turns(df).collect()
    assert sorted((r["conv"], r["pos"], r["bytes"]) for r in found) == [(-3, 1, 0), (1, 1, 1), (1, 2, 2), (1, 3, 1), (1, 4, 1), (1, 5, 1)]
    same = [r["x"] for r in sorted(found, key=lambda r: (r["conv"], r["pos"])) if r["conv"] == 1]
    assert same[3] == same[4] and len(set(same)) == 4
    nothing = turntrie.numbered_turns(df.limit(0))
    assert turntrie.turn_trie(nothing, nothing).count() == 0


def test_a_hot_conversation_is_numbered_by_ranges(spark):
    rows = [(c, t, "user", f"turn {t % 7}") for c, n in ((1, 400), (2, 130), (3, 5), (4, 130)) for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    before = spark.conf.get("spark.rankspark.heavy.rows", None)
    spark.conf.set("spark.rankspark.heavy.rows", "2")
    try:
        turns = turntrie.numbered_turns(df)
        got = trie_rows(turntrie.turn_trie(turns, turns, piece=16))
    finally:
        spark.conf.unset("spark.rankspark.heavy.rows") if before is None else spark.conf.set("spark.rankspark.heavy.rows", before)
    want = {c: [((t % 7), 6) for t in range(n)] for c, n in ((1, 400), (2, 130), (3, 5), (4, 130))}
    assert got == brute_trie(want)
