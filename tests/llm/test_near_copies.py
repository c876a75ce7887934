"""The pipeline's near-duplicate stage beside brute-force Jaccard similarity."""

import itertools
import random
import re

import pytest

import corpus_pipeline
from rankspark.llm import nearcopies
from rankspark.llm.simhash import fingerprint

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def brute_shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Smallest id of each group linked at a Jaccard similarity of 0.8 or more."""
    sets = {i: brute_shingles(t) for i, t in rows}
    label = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
        if 10 * both >= 8 * either and label[a] != label[b]:
            low, high = sorted((label[a], label[b]))
            label = {i: low if x == high else x for i, x in label.items()}
    return sorted(set(label.values()))


def texts():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(3000)]
    out, own = [], 0
    for _ in range(40):
        base = [rng.choice(words) for _ in range(rng.choice([30, 120, 400]))]
        for edits in (0, 0, 1, 2, 3, 5, 9):  # an edit changes five shingles
            w = list(base)
            for at in rng.sample(range(len(w)), edits):
                w[at] = rng.choice(words)
            out.append((own, " ".join(w)))
            own += 1
    chain = [rng.choice(words) for _ in range(200)]
    for _ in range(15):  # neighbours are near, the ends are not
        out.append((own, " ".join(chain)))
        chain = chain[12:] + [rng.choice(words) for _ in range(12)]
        own += 1
    return out + [(own + k, t) for k, t in enumerate([None, "", "  \n", "A b", "a B", "a b c", "a b c d e"])]


def stage(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in rows], DOCS).repartition(5)
    return corpus_pipeline.drop_near_duplicates(spark, docs, "unused")


def test_near_copies_are_those_of_brute_force(spark):
    rows = texts()
    want = brute_kept(rows)
    assert len(want) < len({tuple(sorted(brute_shingles(t))) for _, t in rows})  # not only equal texts
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == want


@pytest.mark.parametrize("rare", [1, 2, 8, 1000])
def test_nodes_that_are_not_the_smallest_of_a_key_are_compared(spark, monkeypatch, rare):
    """With one key for all, only the later steps see pairs without the smallest node; edits come from few words, so that rare shingles are shared."""
    real = nearcopies.signature
    rng = random.Random(rare)
    rows = texts()[:60] + texts()[280:290]
    base = [f"w{rng.randrange(3000)}" for _ in range(150)]
    for k in range(40):
        w = list(base)
        for at in rng.sample(range(150), rng.randrange(6)):
            w[at] = rng.choice(["x", "y"])
        rows.append((1000 + k, " ".join(w)))
    monkeypatch.setattr(nearcopies, "RARE", rare)
    monkeypatch.setattr(nearcopies, "signature", lambda t, size=5: (*real(t, size)[:2], [1]))
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == brute_kept(rows)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    """An id with differing texts loses only near copies, and every group keeps one row."""
    apple, stone = "a pear and an apple lie here", "a stone lies in the blue river"
    rows = [(1, apple), (1, stone), (2, apple), (3, stone), (4, "something else altogether is told")] * 2 + [(None, apple), (None, stone)]
    kept = sorted(((r["doc_id"], r["text"]) for r in stage(spark, rows).collect()), key=str)
    assert kept == sorted([(1, apple), (1, stone), (4, rows[4][1]), (None, apple), (None, stone)], key=str)


def test_stage_of_nothing(spark):
    assert stage(spark, []).count() == 0


def test_fingerprints_propose_pairs_too(spark, monkeypatch):
    """No key is shared: only the fingerprints bring the near copies together, and the exact check keeps what is unlike apart."""
    rng = random.Random(5)
    rows = []
    for block, tail in (("v", 2), ("w", 60)):  # repeats weigh in a fingerprint, not in a set of shingles
        for _ in range(2):
            words = [f"{block}{i}" for i in range(51)] * 20 + [f"t{rng.random()}" for _ in range(tail)]
            rows.append((len(rows), " ".join(words)))
    assert brute_kept(rows) == [0, 2, 3]
    assert all((fingerprint(rows[i][1]) ^ fingerprint(rows[i + 1][1])).bit_count() <= 3 for i in (0, 2))
    real = nearcopies.signature
    monkeypatch.setattr(nearcopies, "signature", lambda t, size=5: (*real(t, size)[:2], []))
    assert sorted(r["doc_id"] for r in stage(spark, rows).collect()) == [0, 2, 3]
