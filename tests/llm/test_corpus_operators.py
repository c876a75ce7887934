"""Every corpus operator against a brute-force version on small tables with nulls, empty and long texts, ties and repeats."""

import collections
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from rankspark.llm import decontam, graph, mixing, queries, quality, sharding, simhash, suffix, tokencounts, topk, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def small_letters(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n):
    return " ".join(rng.choice(["the", "and", "Of", "émile", "stone", "river", "ß", "blue", "12", "x-ray", "cat."]) for _ in range(n))


def documents(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.choice([0, 1, 2, 5, 40, 200])), "en", rng.choice(["a", "b", "é", None, ""]), 0) for i in range(n)]
    passage = prose(rng, 60)
    rows += [(1000 + i, prose(rng, 3) + "\n" + passage + " " + prose(rng, i), "de", "hot", 0) for i in range(30)]
    rows += [(2000 + i, rows[3][1] or "same", "de", "hot", 0) for i in range(20)]
    rows += [(3000, None, None, None, None), (3001, "", "en", "a", 0), (3002, "   \n\t ", "en", "a", 0), (3003, "ha " * 5000, "en", "a", 0),
             (3004, "A" * 3000, "en", "b", 0), (3005, "\x00null\x00 byte", "en", "b", 0), (3006, "\u3000wide\u00a0space \U0001f600", "en", "b", 0)]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    # extra columns bear the names of results and of inner columns
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    return df.select("*", *[F.lit("x").alias(c) for c in ("n_words", "score", "size", "shard", "slot", "id", "doc", "start", "fp", "rule", "k0", "label", "tokens")])


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- decontamination

def brute_hits(text, items):
    w = WORD.findall(small_letters(text))
    hit, named = [False] * len(w), set()
    for item, t in items:
        x = WORD.findall(small_letters(t))
        for g in ([x[i:i + 10] for i in range(max(1, len(x) - 9))] if x else []):
            for p in range(len(w) - len(g) + 1):
                if w[p:p + len(g)] == g:
                    hit[p:p + len(g)] = [True] * len(g)
                    named |= {str(item)} if item is not None else set()
    return len(w), sum(hit), sorted(named)


@pytest.mark.parametrize("block", [100_000, 7])
def test_decontamination(spark, docs, rows, block):
    long = next(r[1] for r in rows if r[0] == 1005)
    items = [(7, long[30:200]), (8, "river"), (9, "Stone the"), (10, None), (11, "..."), (None, long[60:260]), (7, long[30:200]), (12, "not anywhere at all " * 4),
             (13, " ".join(["ha"] * 30))]
    made = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], block_windows=block)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in made.collect()}
    assert got == {r[0]: brute_hits(r[1], items) for r in rows}


def test_decontamination_of_nothing(spark, docs, rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in decontam.decontaminate(docs, none, ["doc_id"]).collect()} == {0}
    assert decontam.decontaminate(empty(spark), none).count() == 0


def test_rarest_shingle_is_the_prefix():
    index = decontam.ShingleIndex([b"a b c d e", b"b c"])
    counts = np.arange(index.total)[::-1].copy()
    for shingle, uses in index.prefixes(counts).items():
        for w, offset in uses:
            assert index.shingles[w][offset] == shingle and counts[shingle] == counts[index.shingles[w]].min()


# --- url filter

def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = small_letters(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if not fits:
        return host, path, None, "allow"
    best = max(fits, key=lambda r: (len(r.text), len(r.path), r.action == "allow", r.text))
    return host, path, best.text, best.action


def test_url_filter(spark):
    rng = random.Random(3)
    hosts = ["Example.COM", "a.example.net", "com", "xcom", "x.com.y", "org", "example.com:80", "", "com/en/7", "ü.org"]
    urls_ = [None, "", "no scheme", "://", "http://", "http://com/en/ x", "http://a.org/x.com/en/", "http://com?/en/", "a://b://com/en/", "http://" + "a." * 5000 + "com/en/7"]
    urls_ += [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/', '/en/7', '/EN/7', '/de/8', '/es/#x'])}{rng.choice(['', '?a=/en/', '#z', '9'])}" for _ in range(300)]
    rules = [*queries.RULES, urls.Rule("com", "", "allow"), urls.Rule("y", "", "block"), urls.Rule("ü.org", "/e", "block"),
             *[urls.Rule(f"host{i}.com", "/a" * 9, "block") for i in range(20)]]
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(urls_)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, rules).collect()}
    assert got == {i: brute_url(u, rules) for i, u in enumerate(urls_)}
    assert urls.filter_urls(df.limit(0), rules).count() == 0


# --- token counts

def test_token_rollup(spark, tmp_path):
    rollup = tokencounts.Rollup(spark, f"file://{tmp_path}/r")
    assert rollup.totals().count() == 0
    schema = "source string, lang string, version string, tokens long, revised long"
    first = spark.createDataFrame([("a", "en", "v1", 5, 7), ("a", "en", "v1", 5, 7), (None, None, "v1", 0, 0), ("b", "de", "v1", None, 4)], schema)
    assert rollup.apply("one", tokencounts.inserts(first)) and not rollup.apply("one", tokencounts.inserts(first))
    assert rollup.apply("two", tokencounts.revisions(first.where("source = 'a'")))
    assert rollup.apply("three", tokencounts.deletes(first.where("source = 'b'")))
    assert rollup.apply("none", tokencounts.inserts(first.limit(0)))
    rollup._write(tokencounts.signed(tokencounts.inserts(first)), "deltas", "broken")  # no commit: as if the job had died
    want = {("a", "en", "v1", 2, 14), (None, None, "v1", 1, 0)}
    assert {tuple(r) for r in rollup.totals().collect()} == want
    folded = rollup.compact("all")
    assert {tuple(r) for r in folded.totals().collect()} == want and not folded.apply("two", tokencounts.inserts(first))


def test_token_query(spark):
    import base64

    import tiktoken
    with open(tokencounts.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pairs = tiktoken.Encoding("t", pat_str=tokencounts.PIECES, mergeable_ranks=ranks, special_tokens={})
    sf = "/root/testdata/sf0.001"
    seen, want = set(), collections.defaultdict(lambda: [0, 0])
    for d in sorted(queries.read(spark, sf, "documents").collect(), key=lambda r: r["doc_id"]):
        if d["text"] in seen:
            continue
        seen.add(d["text"])
        for version, n in (("words", len(WORD.findall(small_letters(d["text"])))), ("byte_bpe_50k", len(pairs.encode_ordinary(d["text"] or "")))):
            want[d["source"], d["lang"], version][0] += 1
            want[d["source"], d["lang"], version][1] += n
    got = {(r[0], r[1], r[2]): [r[3], r[4]] for r in queries.op3_token_counts(spark, sf).collect()}
    assert got == dict(want)


# --- simhash

def brute_fingerprint(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", small_letters(t))
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, x in fps:
            for j, y in fps:
                if (x ^ y).bit_count() <= 3 and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


@pytest.mark.parametrize("block", [2048, 4])
def test_simhash(spark, docs, rows, block):
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(docs, block=block).collect()}
    fps = [(r[0], brute_fingerprint(r[1])) for r in rows]
    label = brute_components(fps)
    assert got == {i: (f, label[i]) for i, f in fps}


@pytest.mark.parametrize("block", [2048, 16])
def test_simhash_links_what_random_flips_link(spark, block):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(12)} | {0, 7, (1 << 64) - 1}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = graph.connected(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), block=block)).collect()
    part = {r["node"] % (1 << 64): r["component"] for r in found}
    label = brute_components([(f, f) for f in fps])
    groups = lambda d: {frozenset(k for k in d if d[k] == v) for v in set(d.values())}
    assert groups({**{f: f"alone {f}" for f in fps}, **part}) == groups(label)


def test_crowded_anchors_without_a_home(spark):
    """Many fingerprints of one half crowd anchors that are nobody's home; these go, and all links stay."""
    rng = np.random.default_rng(4)
    fps = [(7 << 32) | int(x) for x in rng.integers(0, 1 << 20, 400)]
    fps += [f ^ 5 for f in fps[:40]]
    df = spark.createDataFrame([(int(f),) for f in fps], "fp long")
    label = {r["node"]: r["component"] for r in graph.connected(simhash.links(df, block=8)).collect()}
    distinct = sorted(set(fps))
    for i, a in enumerate(distinct):
        for b in distinct[i + 1:]:
            if bin(a ^ b).count("1") <= 3:
                assert label[a] == label[b]


def test_anchors_cover():
    rng = np.random.default_rng(2)
    half = rng.integers(0, 1 << 32, 200, dtype=np.uint64)
    home, near = simhash.anchors(half)
    assert (np.bitwise_count(half ^ home) <= 1).all() and (np.bitwise_count(half[:, None] ^ near) <= 2).all()
    assert not simhash._syndrome(near.ravel()).any()
    for k in range(32):  # whatever lies one bit away has its home among the anchors visited
        other, _ = simhash.anchors(half ^ np.uint64(1 << k))
        assert (near == other[:, None]).any(axis=1).all()


def test_simhash_nulls_and_nothing(spark):
    df = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (None, "q r s t"), (9, None), (8, ""), (8, "")], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(None, 5), (5, 5), (None, None), (9, 8), (8, 8), (8, 8)], key=str)
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_components_of_a_long_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 240)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in graph.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 5 for i in [5, *range(200, 240)]}}


# --- learned scores

def labelled(spark, n=400):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        bad = i % 4 == 0
        w = prose(rng, 60).split()
        if bad:
            w[rng.randrange(60)] = "scoundrel"
            w[rng.randrange(60)] = "you"
        junk = i % 5 == 0
        text = (" ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)) + "."
        docs.append((i, text))
        labels.append((i, 0 if junk else 1, int(bad)))
    docs += [(n, None), (n + 1, ""), (n + 2, "word " * 20000)]
    labels += [(None, 1, 1), (n, None, None), (n + 99, 1, 0)]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


@pytest.mark.parametrize(("module", "label", "cut"), [(toxicity, "toxic", 0.5), (quality, "quality", 0.3)])
def test_scores_hold_on_rows_not_learned_from(spark, module, label, cut):
    docs, labels = labelled(spark)
    scored = module.score(docs, module.fit(docs, labels))
    rows = {r["doc_id"]: r["score"] for r in scored.collect()}
    assert len(rows) == 403 and all(0 <= s <= 1 for s in rows.values())
    held = [r for r in labels.where(toxicity.held_out()).where(f"{label} is not null").collect() if r["doc_id"] in rows]
    right = [(rows[r["doc_id"]] >= cut) == (r[label] == 1) for r in held]
    assert len(held) > 50 and sum(right) / len(right) > 0.95


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_scores_without_labels(spark, module, label):
    docs, labels = labelled(spark, 20)
    for own in (labels.limit(0), labels.where(f"{label} = 1")):
        scores = {r["score"] for r in module.score(docs, module.fit(docs, own)).collect()}
        assert len(scores) == 1 and 0 < scores.pop() < 1
    assert module.score(empty(spark), module.fit(docs, labels)).count() == 0


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = labelled(spark)
    from pyspark.sql import functions as F
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, turned)
    assert a.kept == b.kept and np.allclose(a.weights, b.weights) and np.allclose(a.factors, b.factors)


def brute_terms(text):
    """Every beginning of every word with every count, hashed one by one."""
    w = re.findall("[0-9a-z\\x80-\U0010ffff]+", small_letters(text))
    counts, hashes = collections.Counter(), {}
    for x in w:
        own = toxicity.start_hashes([x])[0][0]
        for start, h in {"=" + x: own[0], **{x[:n]: own[n - 2] for n in range(3, 8) if len(x) >= n}}.items():
            counts[start] += 1
            assert hashes.setdefault(start, h) == h
    assert len(set(hashes.values())) == len(hashes)
    out = {int(toxicity._pieces(toxicity._mixed(np.array([len(w).bit_length() + 1], np.uint64)))[0, 0])}
    for start, n in counts.items():
        out |= set(toxicity._pieces(np.array([hashes[start]], np.uint64))[0, :min(n, 4)].tolist())
    return out


def test_toxicity_scores_are_those_of_a_double_loop_over_terms(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    at = {h: i for i, h in enumerate(model.kept)}
    texts = [r["text"] for r in docs.select("text").collect()] + [None, "", "É é a-b \U0001f600 " * 3000, "x" * 100_000]
    texts += [prose(random.Random(k), 30) for k in range(20)]
    for t, got in zip(texts, model.scorer()(texts)[0], strict=True):
        own = sorted(at[h] for h in brute_terms(t) if h in at)
        x = model.bias + sum(model.weights[i] for i in own)
        x += sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(own) for j in own[:k])
        assert got == pytest.approx(1 / (1 + np.exp(-np.clip(x, -30, 30))), abs=1e-9)
    assert model.kept and toxicity.Terms().of_many(texts)[0].max() == len(texts) - 1


def test_pairs_of_terms_add_to_a_score():
    terms = toxicity.Terms()
    kept = sorted({h for t in ("alpha", "omega") for h in terms.of(t)} - set(terms.of("zz")))
    model = toxicity.Model(kept, -2.0, np.zeros(len(kept)), np.ones((len(kept), 1)) * 0.5)
    both, one = model.scorer()(["alpha omega", "alpha"])[0]
    assert both > one


# --- mixing

def brute_targets(sizes, weights=(5, 2, 1)):
    names = sorted((n for n in sizes if n is not None)) + ([None] if None in sizes else [])
    w = {n: weights[i % 3] for i, n in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = sum(w[n] for n in names if n not in full)
        level = (1.5 * total - sum(2 * sizes[n] for n in full)) / rest if rest else 0
        more = {n for n in names if n not in full and level * w[n] > 2 * sizes[n]}
        if not more:
            return {n: 2 * sizes[n] if n in full else level * w[n] for n in names}
        full |= more


@pytest.mark.parametrize("block", [64, 1, 7])
def test_mixing(spark, docs, rows, block):
    own = {r[0]: (r[3], len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))) for r in rows}
    sizes = collections.Counter()
    for source, n in own.values():
        sizes[source] += n
    mixed = mixing.mix(docs, ["doc_id"], block=block)
    got = mixing.taken_words(mixed, ["doc_id"]).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(own)
    want, taken = brute_targets(sizes), collections.Counter()
    for r in got:
        source, n = own[r["doc_id"]]
        assert r["size"] == n and r["source_size"] == sizes[source] and 0 <= r["taken"] <= 2 * n
        assert r["target"] == pytest.approx(want[source])
        taken[source] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in want)
    again = mixing.taken_words(mixing.mix(docs.repartition(3), ["doc_id"], block=block), ["doc_id"]).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_mixed_texts_hold_the_words_taken(spark, docs, rows):
    how = {"block": 16}
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(mixing.mix(docs, ["doc_id"], **how), ["doc_id"]).collect()}
    own = {r[0]: r[1] for r in rows}
    found = collections.Counter()
    for r in mixing.mixed_documents(docs, ["doc_id", "text"], **how).collect():
        w, source = r["text"].split(), iter(own[r["doc_id"]].split())
        assert r["text"] == own[r["doc_id"]] or all(x in source for x in w)  # a subsequence
        found[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert found == {k: v for k, v in taken.items() if v}


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 1000003])
def test_permutation(spark, n):
    from pyspark.sql import functions as F
    df = spark.range(min(n, 5000)).withColumn("n", F.lit(n).cast("long")).withColumn("name", F.lit("name"))
    got = [r["p"] for r in mixing.permuted(mixing.keys_of_permutation(df, "n", "name", "s"), "id", "p").collect()]
    assert len(set(got)) == len(got) and min(got) >= 0 and max(got) < n


def test_multinomial_draw_spreads_over_shards(spark):
    df = spark.createDataFrame([(i, "w " * 640, "s") for i in range(100)], "doc_id long, text string, source string")
    counts = [r["count"] for r in mixing.mix(df, ["doc_id"], block=64, shards=8).slots.groupBy("shard").count().collect()]
    assert sum(counts) == 1500 and len(counts) == 8
    assert 0.3 < sum((c - 187.5) ** 2 / 187.5 for c in counts) < 24  # a draw, neither even nor lumped


def test_mixing_nothing(spark):
    assert mixing.taken_words(mixing.mix(empty(spark), ["doc_id"]), ["doc_id"]).count() == 0
    blank = spark.createDataFrame([(1, None, None), (1, None, None)], "doc_id long, text string, source string")
    assert [(r["size"], r["taken"], r["target"]) for r in mixing.taken_words(mixing.mix(blank, ["doc_id"]), ["doc_id"]).collect()] == [(0, 0, 0.0)] * 2


# --- sharding

def brute_longest_first(sizes, shards):
    load = [0] * shards
    for s in sorted(sizes, reverse=True):
        load[load.index(min(load))] += s
    return load


@pytest.mark.parametrize("few", [20_000, 0])
def test_sharding(spark, docs, rows, few, monkeypatch):
    monkeypatch.setattr(sharding, "FEW_SIZES", few)
    rng = random.Random(2)
    small = [(10_000 + i, "y" * rng.choice([3, 4, 9]) + str(i), "en", "a", 0) for i in range(3000)]
    both = docs.select("doc_id", "text").unionByName(spark.createDataFrame(small, DOCS).select("doc_id", "text"))
    both = both.withColumns({c: F.lit("x") for c in ("size", "shard", "slot", "row", "id", "k0", "total", "upto")})
    out = sharding.shard_documents(both, 6)
    assert len(set(out.columns)) == len(out.columns)
    got = out.collect()
    text = {r[0]: (r[1] or "").encode() for r in rows + small}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    load, slots, where = collections.Counter(), collections.defaultdict(list), collections.defaultdict(set)
    for r in got:
        t = text[r["doc_id"]]
        assert r["size"] == len(t) + 8 and r["text_crc32"] == zlib.crc32(t)
        load[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[t].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    groups = collections.Counter()
    for t in text.values():
        groups[t] += len(t) + 8
    assert [load[s] for s in range(6)] == brute_longest_first(groups.values(), 6)


def test_longest_first():
    rng = random.Random(9)
    for shards in (1, 3, 24):
        for steps in (0, 3, 64):
            sizes = [(s, rng.choice([1, 2, 5, 70, 300])) for s in rng.sample(range(9, 4000), 25)]
            got = sharding.longest_first(sizes, shards, steps)
            assert all(sum(got[s]) == n for s, n in sizes)
            assert [sum(got[s][k] * s for s, _ in sizes) for k in range(shards)] == brute_longest_first([s for s, n in sizes for _ in range(n)], shards)


def test_sharding_nothing(spark):
    assert sharding.shard_documents(empty(spark), 3).count() == 0
    same = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "doc_id long, text string")
    assert {r["slot"] for r in sharding.shard_documents(same, 1).collect()} == {0, 1, 2}


# --- suffix sort

def brute_repeats(rows, length):
    seen, out = set(), {}
    for d, t in sorted(((r[0], r[1] or "") for r in rows), key=lambda r: r[0]):
        b = t.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            w = b[p:p + length]
            if w in seen:
                gone[p:p + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1]))
        out[d] = (len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g))
    return out


@pytest.mark.parametrize(("length", "run", "part"), [(100, 1 << 20, 1 << 20), (100, 2000, 3000), (30, 1500, 900), (250, 4000, 5000)])
def test_suffix_dedup(spark, docs, rows, length, run, part):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"]))
           for r in suffix.remove_repeats(docs, ["doc_id"], length=length, run_bytes=run, range_bytes=part).collect()}
    want = brute_repeats(rows, length)
    assert got == want and sum(x[1] for x in want.values()) > 1000


def test_suffix_dedup_of_repeated_and_null_ids(spark):
    t = prose(random.Random(1), 60)
    df = spark.createDataFrame([(4, t), (4, t), (None, "zz " + t), (3, None), (2, "short")], "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_removed"] > 0) for r in suffix.remove_repeats(df).collect())
    assert got == {(4, False): 1, (4, True): 1, (None, True): 1, (3, False): 1, (2, False): 1}
    assert suffix.remove_repeats(empty(spark)).count() == 0


def test_windows_of_a_frequent_anchor_spread(spark):
    """One short phrase in many contexts: its windows are dealt to many ranges, and what repeats is found as before."""
    rng = random.Random(8)
    phrase = "this very phrase stands in all of them"
    rows = [(i, prose(rng, 30) + f" {i} " + phrase + f" {i} " + prose(rng, 30)) for i in range(200)]
    rows += [(1000 + i, rows[3 * i][1]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    made = suffix.remove_repeats(df, ["doc_id"], run_bytes=4000, range_bytes=4000, at_once=50)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in made.collect()} == brute_repeats(rows, 100)
    run = suffix._Run()
    for i, t in rows[:200]:
        run.add(i, 0, 0, t.encode())
    h, n = np.unique(suffix.anchors(*suffix._laid(run), 100)[1], return_counts=True)
    assert n.max() >= 100
    dealt = list(suffix._sorted_run(run, 100, 4, h[n > 50]))
    merged = [x for r, b in dealt if r < 4 for x in suffix._read_segment(b, 100)[0].tolist()]
    assert not set(merged) & set(h[n > 50].tolist()) and len({r for r, _ in dealt if r >= 8}) == 4 * suffix.FAN


def test_loser_tree_merges_and_reports_shared_words():
    rng = random.Random(4)
    runs = [sorted(tuple(rng.randrange(3) for _ in range(4)) for _ in range(rng.randrange(9))) for _ in range(7)]
    same = lambda a, b: next((i for i in range(4) if a[i] != b[i]), 4)
    tree = suffix.LoserTree(runs, [[0, *(same(a, b) for a, b in zip(r, r[1:], strict=False))][:len(r)] for r in runs])
    out = list(tree.merged())
    items = [runs[r][i] for r, i, _ in out]
    assert items == sorted(x for r in runs for x in r)
    assert [s for _, _, s in out][1:] == [same(a, b) for a, b in zip(items, items[1:], strict=False)]


def test_segments_round_trip():
    rng = np.random.default_rng(3)
    text = bytes(rng.integers(97, 99, 3000, dtype=np.uint8))
    run = suffix._Run()
    run.add(1, 0, 0, text)
    for r, blob in suffix._sorted_run(run, 60, 4):
        if r < 4:
            h, doc, seq, at, mask, tail, before, common = suffix._read_segment(blob, 60)
            for i in range(len(h)):
                for o in np.flatnonzero(mask[i]).tolist():
                    window = before[i, :o][::-1].tobytes() + tail[i, :60 - o].tobytes()
                    assert window == text[at[i] - o:at[i] - o + 60]


# --- exact top-k

@pytest.mark.parametrize(("block", "part"), [(4096, 512), (17, 5)])
def test_topk(spark, block, part):
    rng = np.random.default_rng(6)
    centre = rng.normal(size=(5, 8))
    v = {i: (centre[i % 5] + rng.normal(size=8) * 0.3).tolist() for i in range(200)}
    v |= {i: v[3] for i in range(200, 260)} | {400: [0.0] * 8, 450: [1e6] * 8}
    bad = [(500, None), (501, []), (502, [1.0, None] * 4), (503, [float("nan")] * 8), (504, [float("inf")] * 8), (None, [1.0] * 8), (550, [1.0] * 3), (551, [2.0] * 3)]
    df = spark.createDataFrame([*v.items(), *bad], "vec_id long, embedding array<double>").repartition(3)
    got = collections.defaultdict(list)
    for r in topk.top_products(df, df.where("vec_id % 50 = 0"), 5, block=block, query_block=part).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(256 * x)) for x in c] for i, c in [*v.items(), (550, [1.0] * 3), (551, [2.0] * 3)]}
    want = {}
    for q in ints:
        if q % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(ints[q], c, strict=True)), i) for i, c in ints.items() if i != q and len(c) == len(ints[q]))[:5]
            want[q] = [(k + 1, i, -s) for k, (s, i) in enumerate(best)]
    assert got == want
    none = df.limit(0)
    assert topk.top_products(none, none).count() == 0 and topk.top_products(df, none).count() == 0
    assert topk.top_products(none, df).count() == 0


def test_topk_in_many_cells(spark):
    """Small cells: floors carried from block to block, ties over blocks, one very common vector, an id asked twice."""
    rng = np.random.default_rng(16)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 5])).tolist()) for i in range(300)] + [(i, [1.0, 0.0, -1.0, 0.5, 0.0, 2.0]) for i in range(1000, 1200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    asked = spark.createDataFrame([*rows[:300:10], rows[300], rows[10]], df.schema)
    got = topk.top_products(df, asked, 5, block=16, query_block=4, held=500, lane=3, shares=True)
    ints = {i: [int(np.floor(256 * x)) for x in v] for i, v in rows}
    want = collections.Counter()
    for q in [*[i for i, _ in rows[:300:10]], 1000, 10]:
        best = sorted((-sum(a * b for a, b in zip(ints[q], c, strict=True)), i) for i, c in ints.items() if i != q)[:5]
        want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(best))
    found = got.collect()
    assert collections.Counter(tuple(r)[:4] for r in found) == want
    assert all(0 <= r["read"] <= 1 for r in found)


def test_lists_are_left_early(spark):
    """Clustered vectors of few components: most queries stop, and far blocks are not read at all."""
    rng = np.random.default_rng(17)
    centre = rng.normal(size=(20, 4))
    v = np.floor(256 * (centre[rng.integers(0, 20, 8192)] + rng.normal(size=(8192, 4)) * 0.05)).astype(np.int64)
    best = topk.Best(np.arange(64), v[:64], 5)
    for at in (0, 4096):
        best.read(topk.SortedLists(v[at:at + 4096]), np.arange(at, at + 4096), v[at:at + 4096])
    assert best.entries.sum() < 0.7 * best.held.sum()
    scores = v[:64] @ v.T
    scores[np.arange(64), np.arange(64)] = -10 ** 15
    for i in range(64):
        order = np.lexsort((np.arange(8192), -scores[i]))[:5]
        assert best.vec[best.query == i].tolist() == order.tolist() and best.score[best.query == i].tolist() == scores[i, order].tolist()


def test_bounds_enclose_scores():
    rng = np.random.default_rng(8)
    vectors, q = rng.integers(-50, 50, (40, 6)), rng.integers(-50, 50, (3, 6)).astype(float)
    lists = topk.SortedLists(vectors)
    for depth in (1, 5, 20, 40):
        low, high = lists.bounds(np.maximum(q, 0), np.minimum(q, 0), depth)
        assert (low <= q @ vectors.T).all() and (high >= q @ vectors.T).all()
    assert (low == high).all()


# --- names, long texts

#: Names of results and of columns inside the operators.
NAMES = ("n_words", "n_hit", "hit_mask", "items", "size", "source_size", "target", "taken", "text_crc32", "shard", "slot", "n_bytes", "n_removed", "n_spans",
         "kept", "row", "pass", "whole", "stretches", "found", "first", "n", "s", "start", "block", "c0", "k0", "id", "doc", "seq", "digest", "window", "item", "part", "place", "__text")


@pytest.mark.parametrize(("make", "results"), [
    (lambda d, spark: decontam.decontaminate(d, spark.createDataFrame([("i", "the the the the the the the the the the")], "item_id string, text string")), decontam.RESULTS),
    (lambda d, spark: mixing.taken_words(mixing.mix(d), d.columns), mixing.RESULTS),
    (lambda d, spark: mixing.mixed_documents(d), ()),
    (lambda d, spark: sharding.shard_documents(d, 3), sharding.RESULTS),
    (lambda d, spark: suffix.remove_repeats(d), suffix.RESULTS)])
def test_extra_columns_of_any_name(spark, rows, make, results):
    """All columns by default: extra ones come through unless a result bears their name, and the results are those without extra columns."""
    plain = spark.createDataFrame(rows[:60], DOCS)
    wide = plain.select("*", *[F.lit("x").alias(c) for c in NAMES])
    got, want = make(wide, spark), make(plain, spark)
    assert sorted(got.columns) == sorted({*wide.columns, *results})
    extra = [c for c in NAMES if c not in results]
    some = got.collect()
    assert some and all(r[c] == "x" for r in some for c in extra)
    same = [c for c in want.columns if c not in extra]
    assert collections.Counter(repr([r[c] for c in same]) for r in some) == collections.Counter(repr([r[c] for c in same]) for r in want.collect())


def test_very_long_text(spark):
    """Some MB in one text: every operator on texts takes it whole."""
    rng = random.Random(9)
    long = " ".join(str(rng.randrange(10 ** 6)) for _ in range(400_000))
    df = spark.createDataFrame([(1, long + " end", "en", "a", 0), (2, "a few words", "en", "b", 0), (3, long[-200:] + " end", "en", "a", 0)], DOCS)
    n = 400_001
    item = spark.createDataFrame([("i", " ".join([*long.split()[-9:], "end"]))], "item_id string, text string")
    assert {r["doc_id"]: (r["n_words"], r["n_hit"]) for r in decontam.decontaminate(df, item).collect()}[1] == (n, 10)
    sizes = {r["doc_id"]: r["size"] for r in mixing.taken_words(mixing.mix(df, ["doc_id"]), ["doc_id"]).collect()}
    assert sizes[1] == n
    assert {r["doc_id"]: r["size"] for r in sharding.shard_documents(df, 2, ["doc_id"]).collect()}[1] == len(long) + 12
    cut = {r["doc_id"]: r for r in suffix.remove_repeats(df, ["doc_id"]).collect()}
    assert cut[1]["n_bytes"] == len(long) + 4 and cut[1]["n_removed"] == 0 and cut[3]["n_removed"] == 204
    assert {r["doc_id"]: r["fp"] for r in simhash.near_duplicates(df).collect()}.keys() == {1, 2, 3}
