"""Periodic runs of words by string synchronising sets, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q, at least max(``LEAST``, ``TIMES`` q) = max(6, 4 q) words long, that no neighbour extends.

1. Periods below ``SMALL``: words are compared with those q before them; long stretches of equality are the highly periodic regions.
2. For every dyadic scale t = SMALL, 2 SMALL, ...: a place i is in the synchronising set if the least hash among the windows of t words that start in
   [i, i + t] is that of the first or the last; windows within a run of a period of t / 4 at most have no hash (step 1 and the
   smaller scales have found those runs).  Whether i is in the set depends on its context, the 2 t words from i, alone.  So a run of a
   period q in [t, 2 t) has a place of the set among its first t words, and the next place with the same context is q further.
   Such pairs of equal contexts at a distance in [t, 2 t) propose periods.
3. A proposed period is extended to both sides on the words themselves; places within a stretch so found propose it no more.

Texts of similar length are laid end to end, a word of its own between them, so the steps are array operations over many texts.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; letters are compared as they are; repeated rows are
texts of their own; an empty table gives no rows; extra columns pass through, but one named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.texts import add_columns

LEAST = 6
TIMES = 4
#: Periods below this are found by comparing words at a distance; a power of two.
SMALL = 8
#: Words laid end to end at most, unless one text has more.
TOGETHER = 100_000
NO_HASH = np.uint64((1 << 64) - 1)
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

Run = tuple[int, int, int]  # start, end, period


def _mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(31))) * _MIX[0]
    return a ^ (a >> np.uint64(29))


def _stretches(same: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(start, end) of the maximal stretches of at least ``least`` true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    keep = ends - starts >= least
    return list(zip(starts[keep].tolist(), ends[keep].tolist(), strict=True))


def _small_periods(w: np.ndarray) -> list[Run]:
    out, seen = [], set()
    for q in range(1, min(SMALL, len(w))):
        for s, e in _stretches(w[:-q] == w[q:], max(LEAST, TIMES * q) - q):
            if (s, e + q) not in seen:  # a stretch that a divisor of q has made already
                seen.add((s, e + q))
                out.append((s, e + q, q))
    return out


def _least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` + 1 neighbours; width is a power of two."""
    low, k = values, 1
    while k < width:
        low = np.minimum(low[:-k], low[k:])
        k *= 2
    return np.minimum(low[:-1], low[1:]) if len(low) > 1 else low[:0]


def _synchronising(windows: np.ndarray, known: list[Run], t: int) -> np.ndarray:
    """Places of the set at scale t.  ``windows``: hashes of the windows of t words."""
    own = _mixed(windows)
    for s, e, q in known:
        if TIMES * q <= t <= e - s:
            own[s:e - t + 1] = NO_HASH
    least = _least_of(own, t)
    n = len(least)
    return np.flatnonzero((least != NO_HASH) & ((own[:n] == least) | (own[t:t + n] == least)))


def _extent(w: np.ndarray, s: int, q: int) -> tuple[int, int]:
    """The maximal stretch around s that keeps the period q: w[s:s + q] is known to repeat at s + q."""
    low, step = s, 64
    while low > 0:
        a = max(0, low - step)
        differ = np.flatnonzero(w[a:low] != w[a + q:low + q])
        if len(differ):
            low = a + int(differ[-1]) + 1
            break
        low, step = a, step * 2
    high, step = s, 64
    while high + q < len(w):
        b = min(len(w) - q, high + step)
        differ = np.flatnonzero(w[high:b] != w[high + q:b + q])
        if len(differ):
            high += int(differ[0])
            break
        high, step = b, step * 2
    return low, high + q


def runs_of(w: np.ndarray, longest: int | None = None) -> list[Run]:
    """All runs of the numbered words ``w``, by start and period; ``longest`` bounds the length of a run, where known."""
    longest = len(w) if longest is None else longest
    out = _small_periods(w)
    hashes = _mixed(w.astype(np.uint64) + np.uint64(1))
    t = 1
    while TIMES * t <= longest and 3 * t <= len(w):
        doubled = _mixed(hashes[:-t] * _MIX[1] + hashes[t:])  # windows of 2 t words
        if t >= SMALL:
            at = _synchronising(hashes, out, t)
            at = at[at < len(doubled)]
            order = np.lexsort((at, doubled[at]))
            s, following, context = at[order][:-1], at[order][1:], doubled[at][order]
            apart = following - s
            pairs = (context[:-1] == context[1:]) & (apart >= t) & (apart < 2 * t)
            upto, last = 0, 0
            for q, i in sorted(zip(apart[pairs].tolist(), s[pairs].tolist(), strict=True)):
                if q == last and i < upto:
                    continue
                low, high = _extent(w, i, q)
                last, upto = q, high - q
                if high - low >= TIMES * q:
                    out.append((low, high, q))
        hashes, t = doubled, 2 * t
    return sorted(out, key=lambda r: (r[0], r[2]))


def _best(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period, then the smallest start, then the smallest period."""
    best = None
    for r in runs:
        if best is None or (r[1] - r[0]) * best[2] > (best[1] - best[0]) * r[2]:
            best = r
    return best


def _collapsed(words: list[bytes], runs: list[Run]) -> str:
    if runs:
        drop = np.zeros(len(words), bool)
        for s, e, q in runs:
            drop[s + q:e] = True
        words = [words[i] for i in np.flatnonzero(~drop).tolist()]
    return b" ".join(words).decode("utf-8")


def _finder() -> Callable:
    def found(texts: list[str | None]) -> tuple[list, ...]:
        split = [t.encode("utf-8").split() if t else [] for t in texts]
        own: list[list[Run]] = [[]] * len(texts)

        def settle(group: list[int]) -> None:
            numbers: dict[bytes, int] = {}
            parts, starts, at = [], [], 0
            for k, i in enumerate(group):
                parts.append(np.fromiter((numbers.setdefault(x, len(numbers)) for x in split[i]), np.int64, len(split[i])))
                parts.append(np.array([-2 - k], np.int64))  # between texts: found nowhere else
                starts.append(at)
                at += len(split[i]) + 1
                own[i] = []
            places = np.array(starts)
            for s, e, q in runs_of(np.concatenate(parts), max(len(split[i]) for i in group)):
                k = int(np.searchsorted(places, s, "right")) - 1
                own[group[k]].append((s - starts[k], e - starts[k], q))
        group, size = [], 0
        for i in sorted(range(len(texts)), key=lambda i: len(split[i])):
            if len(split[i]) >= LEAST:
                if group and size + len(split[i]) > TOGETHER:
                    settle(group)
                    group, size = [], 0
                group.append(i)
                size += len(split[i])
        if group:
            settle(group)
        best = [_best(r) for r in own]
        return ([[s for s, _, _ in r] for r in own], [[e - s for s, e, _ in r] for r in own], [[q for _, _, q in r] for r in own],
                [b and b[0] for b in best], [b and b[1] - b[0] for b in best], [b and b[2] for b in best],
                [_collapsed(w, r) for w, r in zip(split, own, strict=True)])
    return found


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with runs (start, length and period of each, by start and period), best (the run of the greatest length / period; null
    if there is none) and collapsed (words that no run contains after its first period, joined by a space)."""
    inner = {"__starts": "array<long>", "__lengths": "array<long>", "__periods": "array<long>", "__start": "long", "__length": "long", "__period": "long", "collapsed": "string"}
    found = add_columns(docs.drop("runs", "best") if text not in ("runs", "best") else docs, inner, [text], _finder)
    zipped = F.arrays_zip(F.col("__starts").alias("start"), F.col("__lengths").alias("length"), F.col("__periods").alias("period"))
    best = F.when(F.col("__start").isNotNull(), F.struct(F.col("__start").alias("start"), F.col("__length").alias("length"), F.col("__period").alias("period")))
    return found.withColumns({"runs": zipped, "best": best}).drop(*[c for c in inner if c.startswith("__")])
