"""Near copies by the Jaccard similarity of their word shingles, found by min-hash banding and checked exactly.

Two documents are linked if their sets of ``SHINGLE`` = 5 consecutive words have a Jaccard similarity of at least ``LEAST`` = 0.8.  Documents of
one set are one node before anything is compared.  A node has ``BANDS`` keys, each the hash of ``ROWS`` minima of its shingle hashes; two nodes meet
if a key is equal, which a pair at exactly 0.8 misses with probability (1 - 0.8^6)^32 = 0.00006, a closer one less often.

1. Of each key the smallest node is compared with all others; links make components.
2. In keys that still hold several components, shingles that at most ``RARE`` of their nodes hold are rare.  Of each such key the node with the least
   share of rare shingles is compared with the nodes of other components.
3. What is left is settled without forming the pairs of a key.  Nodes that share a rare shingle meet by it (``RARE`` at most) and are compared.  Two
   nodes x, y that share none, with c common and r rare shingles, have a similarity of at most min(c_x, c_y) / (max(c_x, c_y) + r_x + r_y): only
   pairs of a key and of different components for which this reaches 0.8 are compared, after nodes that reach it with no
   other component of the key have gone.  So no link between two nodes of a key is lost: they are joined by links, compared, or shown to be unlike.

Pairs that another method proposes (``likely``) are compared in the first step.  Comparisons read the words themselves; set sizes that rule 0.8 out are left out before.

Defined cases: a text of fewer words than a shingle is one shingle; texts without words (null, empty) are copies of each other only; repeated rows are copies;
an empty table gives no rows; columns other than row and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.graph import connected
from rankspark.llm.texts import tokens
from rankspark.session import passing, pin

SHINGLE = 5
LEAST = 0.8
BANDS = 32
ROWS = 6
SEED = 42
#: Nodes that hold a rare shingle at most.
RARE = 8
#: Shingles of a text that are hashed at a time.
CHUNK = 4096

_FACTORS = np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    found = tokens(text)
    return {b" ".join(found[i:i + size]) for i in range(max(1, len(found) - size + 1))} if found else set()


def similar(a: set[bytes], b: set[bytes], least: float = LEAST) -> bool:
    """Whether the Jaccard similarity of two sets is at least ``least``; that of two empty sets is 1."""
    both = len(a & b)
    return both >= least * (len(a) + len(b) - both)


def signature(text: str | None, size: int = SHINGLE) -> tuple[int, int, list[int]]:
    """(node, number of shingles, keys): equal sets are one node."""
    digest = xxhash.xxh64_intdigest
    own = shingles(text, size)
    hashes = np.sort(np.fromiter((digest(s, SEED) for s in own), np.uint64, len(own)))
    node = int(np.array([digest(hashes.tobytes(), SEED)], np.uint64).view(np.int64)[0])
    if not len(hashes):
        return node, 0, []
    low = np.full(len(_FACTORS), (1 << 64) - 1, np.uint64)
    for at in range(0, len(hashes), CHUNK):
        np.minimum(low, (hashes[at:at + CHUNK, None] * _FACTORS).min(axis=0), out=low)
    keys = [digest(band.tobytes(), k) for k, band in enumerate(low.reshape(BANDS, ROWS))]
    return node, len(hashes), np.array(keys, np.uint64).view(np.int64).tolist()


def _signed(docs: DataFrame, size: int) -> DataFrame:
    """(row, node, n, keys) of every row of ``docs``: row, text."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [signature(t, size) for t in batch["text"]]
            yield pd.DataFrame({"row": batch["row"], "node": [m[0] for m in made], "n": [m[1] for m in made], "keys": [m[2] for m in made]})
    return docs.mapInPandas(make, "row long, node long, n long, keys array<long>")


def _checked(pairs: DataFrame, texts: DataFrame, size: int, least: float) -> DataFrame:
    """The pairs (a, b) that are similar.  ``texts``: node, text."""
    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, own = None, set()  # a node is often compared with many in turn
        for batch in batches:
            keep = []
            for a, x, y in zip(batch["a"], batch["x"], batch["y"], strict=True):
                if node is None or a != node:
                    node, own = a, shingles(x, size)
                keep.append(similar(own, shingles(y, size), least))
            yield batch.loc[keep, ["a", "b"]]
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("x"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("y"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInPandas(check, "a long, b long")


def _grams(texts: DataFrame, size: int) -> DataFrame:
    """(node, gram) of the hashed shingles of ``texts``: node, text."""
    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                own = shingles(text, size)
                yield pd.DataFrame({"node": node, "gram": np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in own), np.uint64, len(own)).view(np.int64)})
    return texts.mapInPandas(make, "node long, gram long")


def _mixed(shared: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``shared`` (key, node, ...) in keys that hold several components of the links ``found``, with their component."""
    named = shared.join(connected(found), "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return named.join(mixed, "key", "left_semi")


def links(nodes: DataFrame, docs: DataFrame, size: int = SHINGLE, least: float = LEAST, likely: DataFrame | None = None) -> DataFrame:
    """Links (a, b) that join what is similar, directly or by steps.  ``nodes``: node, first (its row whose text is read), n, keys;
    ``likely``: further pairs (a, b) of nodes to compare."""
    dealt = pin(nodes.select("node", "n", F.explode("keys").alias("key")), "keys")
    fits = lambda m, n: F.least(m, n) >= F.greatest(m, n) * (least - 1e-9)
    lead = (dealt.groupBy("key").agg(F.min(F.struct("node", "n")).alias("lead"), F.count("*").alias("size")).where("size > 1")
            .select("key", F.col("lead.node").alias("a"), F.col("lead.n").alias("m")))
    shared = pin(dealt.join(lead, "key"), "shared")
    pairs = shared.where("node <> a").where(fits("m", "n")).select("a", F.col("node").alias("b"))
    many = shared.select("node")
    if likely is not None:
        sizes = lambda node, n: nodes.select(F.col("node").alias(node), F.col("n").alias(n))
        likely = pin(likely.join(sizes("a", "m"), "a").join(sizes("b", "n"), "b").where(fits("m", "n")).select("a", "b").distinct(), "likely")
        pairs = pairs.unionByName(likely)
        many = many.union(likely.select("a")).union(likely.select("b"))
    pairs = pin(pairs.distinct(), "pairs")
    many = many.distinct().join(nodes, "node").select("node", F.col("first").alias("row"))
    texts = pin(docs.join(many, "row").select("node", "text"), "texts")
    found = pin(_checked(pairs, texts, size, least), "found")
    left = pin(_mixed(shared.select("key", "node", "n"), found), "mixed")
    if left.isEmpty():
        return found

    grams = pin(_grams(texts.join(left.select("node").distinct(), "node", "left_semi"), size), "grams")
    rare = pin(grams.join(grams.groupBy("gram").agg(F.count("*").alias("held")).where(F.col("held") <= RARE), "gram"), "rare")
    share = rare.groupBy("node").agg(F.count("*").alias("r"))
    known = pin(left.join(share, "node", "left").withColumn("r", F.coalesce("r", F.lit(0))), "known")
    central = known.groupBy("key").agg(F.min(F.struct((F.col("r") / F.col("n")).alias("share"), "node", "n", "component")).alias("lead"))
    again = known.join(central, "key").where(F.col("component") != F.col("lead.component")).where(fits("n", F.col("lead.n")))
    again = again.select(F.least("node", "lead.node").alias("a"), F.greatest("node", "lead.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more = pin(_checked(pin(again, "central"), texts, size, least), "found")
    found = pin(found.unionByName(more), "found")
    rest = pin(_mixed(known.select("key", "node", "n", "r"), found), "mixed")
    done = pairs.unionByName(again)
    close = _by_rare_shingle(rare, rest, fits).unionByName(_by_bound(rest, least)).distinct().join(done, ["a", "b"], "left_anti")
    return found.unionByName(_checked(pin(close, "close"), texts, size, least))


def _by_rare_shingle(rare: DataFrame, rest: DataFrame, fits) -> DataFrame:
    """Pairs of nodes of different components that share a rare shingle."""
    own = rare.where("held > 1").select("node", "gram").join(rest.select("node", "n", "component").distinct(), "node")
    other = own.select("gram", F.col("node").alias("b"), F.col("n").alias("m"), F.col("component").alias("other"))
    return own.join(other, "gram").where("node < b and component <> other").where(fits("m", "n")).select(F.col("node").alias("a"), "b").distinct()


def _by_bound(rest: DataFrame, least: float) -> DataFrame:
    """Pairs of nodes of one key and different components that could reach ``least`` though they share no rare shingle."""
    c = lambda n, r: F.col(n) - F.col(r)
    # r_x + r_y must stay within (1 / least - 1) min(c_x, c_y): a node stays if the least r of another component leaves it room
    lowest = rest.groupBy("key", "component").agg(F.min("r").alias("r"))
    first = lowest.groupBy("key").agg(F.min(F.struct("r", "component")).alias("one"))
    second = (lowest.join(first, "key").where(F.col("component") != F.col("one.component")).groupBy("key")
              .agg(F.first("one").alias("one"), F.min("r").alias("two")))
    other = F.when(F.col("component") == F.col("one.component"), F.col("two")).otherwise(F.col("one.r"))
    live = pin(rest.join(second, "key").where(c("n", "r") * (1 / least - 1) + 1e-6 >= F.col("r") + other).select("key", "node", "n", "r", "component"), "live")
    right = live.select("key", F.col("node").alias("b"), F.col("n").alias("m"), F.col("r").alias("s"), F.col("component").alias("other"))
    low, high = F.least(c("n", "r"), c("m", "s")), F.greatest(c("n", "r"), c("m", "s"))
    reach = low + 1e-6 >= (high + F.col("r") + F.col("s")) * least
    return live.join(right, "key").where("node < b and component <> other").where(reach).select(F.col("node").alias("a"), "b").distinct()


def near_copies(docs: DataFrame, size: int = SHINGLE, least: float = LEAST, likely: DataFrame | None = None) -> DataFrame:
    """(row, component) of every row of ``docs``: row (unique), text.  ``likely``: pairs (a, b) of rows that are compared besides those that share a key.
    The result is written; all tables on the way to it are removed."""
    with passing() as keep:
        return keep(pin(_components(docs, size, least, likely), "components"))


def _components(docs: DataFrame, size: int, least: float, likely: DataFrame | None) -> DataFrame:
    own = pin(_signed(docs.select("row", "text"), size), "signatures")
    nodes = own.groupBy("node").agg(F.min(F.struct("row", "n", "keys")).alias("s")).select("node", F.col("s.row").alias("first"), "s.n", "s.keys")
    if likely is not None:
        node = lambda row, name: own.select(F.col("row").alias(row), F.col("node").alias(name))
        likely = (likely.join(node("a", "x"), "a").join(node("b", "y"), "b").where("x <> y")
                  .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    found = connected(links(pin(nodes, "nodes"), docs, size, least, likely))
    return own.join(found, "node", "left").select("row", F.coalesce("component", "node").alias("component"))
