"""Benchmark decontamination as a prefix-filtered set join.

An item is cut into windows of ``WINDOW`` consecutive words (a shorter item is one window).  A window occurs in a
document only if all its shingles do, so its rarest shingle, by counts over all documents, is a prefix that is
both necessary and sufficient to find it: only that one is looked up.  A lookup gives the place at which the window
would have to start; windows that would not fit into the document (positional and length bounds) go, the others
are compared word by word.

Windows are dealt into blocks of at most ``block_windows``; each block is one pass over the documents, and only one
block's index is in memory at a time.  Documents are never shuffled, so neither frequent words nor large groups of
copies load one task.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no window; a null
item id marks words but names no item; repeated items and repeated document rows each count by themselves (item ids
are listed once); without items every document is clean, without documents there are no rows; extra columns pass through when named in ``keep``
(all by default), but one named like a result is replaced by it; extra columns of the items are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.texts import add_columns, words
from rankspark.session import pin

WINDOW = 10
SHINGLE = 3
#: Windows in memory at a time; about 100 bytes each on the driver, 300 with their index in a task.
BLOCK_WINDOWS = 100_000
RESULTS = ("n_words", "hit_mask", "items", "n_hit")


def windows_of(text: str | None, size: int = WINDOW) -> list[bytes]:
    found = words(text)
    if not found:
        return []
    return list({b" ".join(found[i:i + size]): None for i in range(max(1, len(found) - size + 1))})


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """Distinct (item, window) pairs; a window is its words, space-joined."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(i, w) for i, t in zip(batch["item"], batch["text"], strict=True) for w in windows_of(t, size)]
            yield pd.DataFrame(rows, columns=["item", "window"])
    source = items.select(F.col(item_id).cast("string").alias("item"), F.col(text).cast("string").alias("text"))
    return source.mapInPandas(cut, "item string, window binary").distinct()


class ShingleIndex:
    """Shingles of a block of windows, numbered; finds their places in a document's words.

    A shingle is SHINGLE words (all words of a shorter window).  Words are numbered within the block, so a shingle is
    one exact integer per length.
    """

    def __init__(self, windows: list[bytes]):
        self.windows = [w.split(b" ") for w in windows]
        self.vocab: dict[bytes, int] = {}
        for w in self.windows:
            for x in w:
                self.vocab.setdefault(x, len(self.vocab) + 1)
        if len(self.vocab) >= 1 << 21:
            raise ValueError("a block of windows may hold at most 2^21 different words")
        ids = [[self.vocab[x] for x in w] for w in self.windows]
        self.sizes = sorted({min(SHINGLE, len(w)) for w in ids})
        self.keys = {s: np.unique(np.concatenate([self._rolled(np.array(w), s) for w in ids if min(SHINGLE, len(w)) == s]))
                     for s in self.sizes}
        self.base = dict(zip(self.sizes, np.cumsum([0] + [len(self.keys[s]) for s in self.sizes]).tolist(), strict=False))
        self.total = sum(len(k) for k in self.keys.values())
        self.shingles = []
        for w in ids:
            s = min(SHINGLE, len(w))
            self.shingles.append(self.base[s] + np.searchsorted(self.keys[s], self._rolled(np.array(w), s)))

    @staticmethod
    def _rolled(ids: np.ndarray, size: int) -> np.ndarray:
        n = len(ids) - size + 1
        if n <= 0:
            return np.empty(0, np.int64)
        key = ids[:n].astype(np.int64)
        for j in range(1, size):
            key = (key << 21) | ids[j:j + n]
        return key

    def places(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Positions and numbers of this block's shingles among a document's words."""
        get = self.vocab.get
        ids = np.fromiter((get(w, 0) for w in found), np.int64, len(found))
        at, number = [], []
        for s, keys in self.keys.items():
            rolled = self._rolled(ids, s)
            if not len(rolled):
                continue
            known = ids[:len(rolled)] > 0
            for j in range(1, s):
                known &= ids[j:j + len(rolled)] > 0
            where = np.flatnonzero(known)
            slot = np.searchsorted(keys, rolled[where])
            hit = keys[np.minimum(slot, len(keys) - 1)] == rolled[where]
            at.append(where[hit])
            number.append(self.base[s] + slot[hit])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        return np.concatenate(at), np.concatenate(number)

    def prefixes(self, counts: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Of each window its rarest shingle (the first of equals): shingle -> (window, offset) pairs."""
        out: dict[int, list[tuple[int, int]]] = {}
        for i, own in enumerate(self.shingles):
            offset = int(np.argmin(counts[own]))
            out.setdefault(int(own[offset]), []).append((i, offset))
        return out


def _shingle_counts(docs: DataFrame, text: str, windows: list[bytes]) -> np.ndarray:
    """How often each shingle of the block stands in all documents; one row per shingle and batch is shuffled."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = ShingleIndex(windows)
        for batch in batches:
            total = np.zeros(index.total, np.int64)
            for t in batch["text"]:
                total += np.bincount(index.places(words(t))[1], minlength=index.total) if t else 0
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"shingle": seen, "n": total[seen]})
    rows = (docs.select(F.col(text).alias("text")).mapInPandas(count, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).collect())  # at most the block's shingles
    counts = np.zeros(sum(max(1, w.count(b" ") + 1) for w in windows), np.int64)
    for r in rows:
        counts[r["shingle"]] = r["n"]
    return counts


def _mark_block(state: DataFrame, block: list[tuple[bytes, list[str]]], counts: np.ndarray) -> DataFrame:
    windows, owners = [w for w, _ in block], [set(o) for _, o in block]

    def make():
        index = ShingleIndex(windows)
        prefix = index.prefixes(counts)
        is_prefix = np.zeros(index.total, bool)
        is_prefix[list(prefix)] = True

        def mark(text: str | None, mask: bytes, named: list[str]) -> tuple[int, bytes, list[str]]:
            found = words(text)
            n, hit, own = len(found), None, set(named)
            at, number = index.places(found)
            keep = is_prefix[number]
            for p, k in zip(at[keep].tolist(), number[keep].tolist(), strict=True):
                for w, offset in prefix[k]:
                    start, size = p - offset, len(index.windows[w])
                    if start < 0 or start + size > n or found[start:start + size] != index.windows[w]:
                        continue
                    if hit is None:
                        hit = np.unpackbits(np.frombuffer(mask, np.uint8), count=n) if mask else np.zeros(n, np.uint8)
                    hit[start:start + size] = 1
                    own |= owners[w]
            return n, mask if hit is None else np.packbits(hit).tobytes(), sorted(own)
        return lambda *columns: tuple(zip(*map(mark, *columns), strict=True))
    return add_columns(state, {"__n_words": "long", "__mask": "binary", "__items": "array<string>"}, ["__text", "__mask", "__items"], make)


def decontaminate(docs: DataFrame, items: DataFrame, keep: list[str] | None = None, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """``keep`` columns (all by default) of every document with n_words, hit_mask (one bit per word, first word highest),
    n_hit and the sorted ``items`` of which a window occurs."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    wins = pin(item_windows(items, item_id, item_text, window), "windows")
    blocks = max(1, -(-wins.select("window").distinct().count() // block_windows))
    dealt = wins.withColumn("block", F.pmod(F.xxhash64("window"), F.lit(blocks)))
    state = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(text).cast("string").alias("__text"),
                        F.lit(0).cast("long").alias("__n_words"), F.lit(b"").alias("__mask"),
                        F.array().cast("array<string>").alias("__items"))
    source = docs.select(F.col(text).cast("string").alias("text"))
    for b in range(blocks):
        # one block: at most about block_windows windows and their item ids
        rows = dealt.where(F.col("block") == b).groupBy("window").agg(F.collect_set("item").alias("items")).collect()
        block = sorted((bytes(r["window"]), r["items"]) for r in rows)
        counts = _shingle_counts(source, "text", [w for w, _ in block]) if block else np.zeros(0, np.int64)
        state = _mark_block(state, block, counts)
    marked = state.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("__n_words").alias("n_words"),
                          F.col("__mask").alias("hit_mask"), F.col("__items").alias("items"))
    return marked.withColumn("n_hit", _ones(F.hex("hit_mask")))


def _ones(hexed):
    """Set bits of a hex text: each digit adds as many as it has."""
    n = F.lit(0).cast("long")
    for digits, bits in (("1248", 1), ("3569AC", 2), ("7BDE", 3), ("F", 4)):
        n = n + bits * F.length(F.translate(hexed, "".join(d for d in "0123456789ABCDEF" if d not in digits), ""))
    return n


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
