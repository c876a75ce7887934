"""SimHash near-duplicates by anchor-point covering.

A fingerprint has one bit per hash bit of the word shingles, set where over half of the shingle hashes have it.
Two fingerprints that differ in at most ``MOST_BITS`` = 3 bits differ in at most one bit in one of their
32-bit halves.  The anchors of a half are the words of the perfect Hamming code [31, 26] with one free bit in front: every half
lies within covering radius 1 of exactly one anchor, its home.  A half is replicated to every anchor within radius plus
threshold, 1 + 1 = 2 (17 or 18 of 2^27), so any pair that may link meets at the home of either, where all
64 bits are compared.  (Anchors over all 64 bits would need radius + 3, some 10,000 replicas; halves need 36.)

Copies fall into one fingerprint before anything is replicated.  At an anchor only as many links come out as connect what
is linked there, never all pairs.  An anchor with many fingerprints is cut into blocks, each pair of blocks its own key.

Defined cases: a text of fewer words than a shingle is one shingle; one without words (null, empty) has
fingerprint 0 and links like any other; repeated rows share a component; a null id takes no part in the
smallest id, and if a component has no other id its number is null; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.graph import connected
from rankspark.llm.texts import add_columns, tokens
from rankspark.session import pin

SHINGLE = 3
SEED = 42
MOST_BITS = 3
#: Fingerprints of one anchor that are compared as one block.
BLOCK = 2048

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    found = tokens(text)
    if not found:
        return 0
    line = b" ".join(found)
    n = max(1, len(found) - size + 1)
    if n == 1:
        hashes = np.array([xxhash.xxh64_intdigest(line, SEED)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
        starts = np.concatenate(([0], ends[:n - 1])).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, (ends[size - 1:] - 1).tolist(), strict=True)), np.uint64, n)
    octets = hashes.view(np.uint8).reshape(n, 8)
    out = 0
    for k in range(8):
        ones = np.bincount(octets[:, k], minlength=256) @ _BITS
        for b in np.flatnonzero(2 * ones > n).tolist():
            out |= 1 << (8 * k + b)
    return out


def with_fingerprint(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """``docs`` with the column fp, the fingerprint's 64 bits as a signed long."""
    def make():
        def hashed(texts: list[str | None]) -> tuple[list[int]]:
            return ([f - (1 << 64) if f >> 63 else f for f in (fingerprint(t, size) for t in texts)],)
        return hashed
    return add_columns(docs, {"fp": "long"}, [text], make)


def _syndrome(half: np.ndarray) -> np.ndarray:
    """XOR of the positions 1 to 31 of the bits set below the free bit: zero for code words."""
    out = np.zeros(len(half), np.uint64)
    for p in range(1, 32):
        out ^= np.where((half >> np.uint64(p - 1)) & np.uint64(1), np.uint64(p), np.uint64(0))
    return out


def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Homes of 32-bit halves, and one row per half of all anchors within distance 2 (the home first, repeats possible).

    A code word at distance d differs from the half in d positions whose XOR is the syndrome s: the single
    position s (d = 1), or pairs (p, p ^ s) (d = 2), where position 0 stands for "no flip" or the free bit.
    """
    s = _syndrome(half)
    flip = np.concatenate(([0], np.uint64(1) << np.arange(31, dtype=np.uint64))).astype(np.uint64)  # flip[p] for position p
    home = half ^ flip[s.astype(np.int64)]
    free = np.uint64(1 << 31)
    all_p = np.arange(32, dtype=np.uint64)
    pairs = half[:, None] ^ flip[None, :] ^ flip[(all_p[None, :] ^ s[:, None]).astype(np.int64)]
    return home, np.concatenate((home[:, None], (home ^ free)[:, None], pairs), axis=1)


def _visits(fps: DataFrame) -> DataFrame:
    """(side, anchor, fp, home): every fingerprint at all anchors of its two halves."""
    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = batch["fp"].to_numpy(np.int64)
            bits = fp.view(np.uint64)
            for side in (0, 1):
                half = (bits >> np.uint64(32 * side)) & np.uint64(0xFFFFFFFF)
                home, near = anchors(half)
                near = np.sort(near, axis=1)
                first = np.concatenate((np.ones((len(near), 1), bool), near[:, 1:] != near[:, :-1]), axis=1)
                row, _ = np.nonzero(first)
                anchor = near[first]
                yield pd.DataFrame({"anchor": anchor.astype(np.int64) * 2 + side, "fp": fp[row], "home": anchor == home[row]})
    return fps.mapInPandas(spread, "anchor long, fp long, home boolean")


def _blocked(visits: DataFrame, block: int) -> DataFrame:
    """Adds the parts (h, v) of the key: (0, 0), but anchors of more than ``block`` rows are cut, homes by hash into h and
    all rows by hash into v, so that every home meets every fingerprint in one pair of parts.  A crowded anchor without a home links nothing and goes."""
    crowded = pin(visits.groupBy("anchor").agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("homes"))
                  .where(F.col("n") > block)
                  .select("anchor", F.ceil(F.col("homes") / block).cast("int").alias("hs"), F.ceil(F.col("n") / block).cast("int").alias("vs")),
                  "crowded")
    if crowded.isEmpty():
        return visits.select("anchor", F.lit(0).alias("h"), F.lit(0).alias("v"), "home", "fp")
    joined = visits.join(crowded, "anchor", "left").where("hs is null or hs > 0").withColumn("hash", F.xxhash64("fp"))
    as_home = F.transform(F.sequence(F.lit(0), F.col("vs") - 1), lambda v: F.struct(
        F.pmod("hash", "hs").cast("int").alias("h"), v.alias("v"), F.lit(True).alias("home")))
    as_visitor = F.transform(F.sequence(F.lit(0), F.col("hs") - 1), lambda h: F.struct(
        h.alias("h"), F.pmod("hash", "vs").cast("int").alias("v"), F.lit(False).alias("home")))
    parts = (F.when(F.col("hs").isNull(), F.array(F.struct(F.lit(0).alias("h"), F.lit(0).alias("v"), F.col("home").alias("home"))))
             .when(F.col("home"), F.concat(as_home, as_visitor)).otherwise(as_visitor))
    return joined.select("anchor", "fp", F.inline(parts)).select("anchor", "h", "v", "home", "fp")


def _linked(rows: np.ndarray, home: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Links that connect what is linked between homes and all fingerprints of one anchor: at most one per fingerprint."""
    fps = np.unique(rows)
    group = np.arange(len(fps))
    left, right = [], []
    for i in np.searchsorted(fps, np.unique(rows[home])).tolist():
        near = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= most) & (group != group[i]))
        if len(near):
            merged, first = np.unique(group[near], return_index=True)
            group[np.isin(group, merged)] = group[i]
            left += [int(fps[i])] * len(merged)
            right += fps[near[first]].tolist()
    return left, right


def links(fps: DataFrame, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between different fingerprints that join exactly what is within ``most`` <= 3 bits, directly or by steps."""
    if not 0 <= most <= MOST_BITS:
        raise ValueError(f"halves and their anchors cover at most {MOST_BITS} differing bits")
    visits = _visits(fps.select("fp").distinct())
    keys = ["anchor", "h", "v"]
    dealt = _blocked(visits, block).repartition(*keys).sortWithinPartitions(*keys)

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last key's rows so far; a key has at most about two blocks
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            last = held.iloc[-1]
            tail = (held["anchor"] == last["anchor"]) & (held["h"] == last["h"]) & (held["v"] == last["v"])
            yield _runs(held[~tail])
            held = held[tail]
        if held is not None:
            yield _runs(held)

    def _runs(rows: pd.DataFrame) -> pd.DataFrame:
        key, fp, home = rows[keys].to_numpy(np.int64), rows["fp"].to_numpy(np.int64), rows["home"].to_numpy(bool)
        left, right = [], []
        if len(key):
            start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1))))
            size = np.diff(np.append(start, len(key)))
            pick = (size > 1) & (np.add.reduceat(home.astype(np.int64), start) > 0)
            for a, n in zip(start[pick].tolist(), size[pick].tolist(), strict=True):
                x, y = _linked(fp[a:a + n], home[a:a + n], most)
                left += x
                right += y
        return pd.DataFrame({"a": np.array(left, np.int64), "b": np.array(right, np.int64)})
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = SHINGLE, most: int = MOST_BITS,
                    block: int = BLOCK) -> DataFrame:
    """doc_id, fp and component_id (the smallest id reachable by links) of every row of ``docs``."""
    own = pin(with_fingerprint(docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("t")), "t", size)
              .select("doc_id", "fp"), "fingerprints")
    groups = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found = connected(links(groups, most, block))  # node -> component, both fingerprints; only nodes with links
    named = groups.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "component").select("fp", "component_id")
    return own.join(classes, "fp").select("doc_id", "fp", "component_id")


def linked_rows(docs: DataFrame, row: str = "row", text: str = "text", size: int = SHINGLE, most: int = MOST_BITS, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of rows of ``docs`` that join what the fingerprints link: every row with the smallest of its fingerprint, and those of linked ones."""
    own = pin(with_fingerprint(docs.select(F.col(f"`{row}`").alias("a"), F.col(f"`{text}`").cast("string").alias("t")), "t", size).select("a", "fp"), "fingerprints")
    lead = pin(own.groupBy("fp").agg(F.min("a").alias("b"), F.count("*").alias("n")), "leads")
    same = own.join(lead.where("n > 1"), "fp").where("a <> b").select("a", "b")
    near = pin(links(lead, most, block).toDF("x", "y"), "near")
    named = lambda fp, name: lead.select(F.col("fp").alias(fp), F.col("b").alias(name))
    return same.unionByName(near.join(named("x", "a"), "x").join(named("y", "b"), "y").select("a", "b"))
