"""Repeated byte strings of ``LENGTH`` bytes, found by a distributed merge sort of suffixes that never compares a known prefix twice.

Sorting the suffix at every byte would move a hundred times the input, so suffixes start at anchors only.  A window is any
string of LENGTH bytes within a document.  Its anchor is the place in it whose next ``KEY`` bytes hash lowest (the first of equals); equal windows
have their anchors at the same distance, so they meet at equal suffixes.  An entry is an anchor with the neighbouring windows that chose it:
its suffix (LENGTH bytes from the anchor), the bytes before it, and the distances of those windows.

1. Each task gathers documents into a run and sorts its entries by suffix (hash of the first KEY bytes first).  Windows that repeat within the run are decided
   there, which leaves one entry where a passage stands thousands of times.  The rest is front-coded: an entry carries only what follows its common
   prefix with the one before.
2. Runs are exchanged by ranges of the hash.
3. A task merges the runs of a range with a loser tree.  Nodes keep the common prefix with the last winner; entries are compared only behind
   it, and not at all when the prefixes differ in length.  Entries alone with their hash leave before.
4. In merged order, two windows at distance o are equal if their suffixes share LENGTH - o bytes and the o bytes before agree; both are read off common
   prefix lengths of the two orders.  Of equal windows the earliest (smallest id, then place) stays.

A phrase that is the anchor of very many differing windows would bring all its entries into one task.  Hashes of more than ``AT_ONCE`` entries, counted
first, leave this way: their windows are dealt by a 128-bit hash of the whole window, so equal ones still meet and the others spread.

Defined cases: null texts are empty; documents with a null id come after all others; documents with equal ids are ordered by a
row number given when the table is written once; repeated rows are documents of their own; texts shorter than LENGTH lose nothing; an
empty table gives no rows; extra columns pass through when named in ``keep`` (all by default), but one named like a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.texts import add_columns
from rankspark.session import pin

LENGTH = 100
KEY = 24
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")
#: Bytes of documents that a task sorts as one run; positions within a run need 24 bits.
RUN_BYTES = 6 << 20
#: Bytes of input per range of the exchange.
RANGE_BYTES = 16 << 20
CHUNK = 1 << 18
#: Entries of a range that are merged at a time (more only if they share one hash).
AT_ONCE = 20_000
#: Ranges of windows of frequent hashes for each range of the exchange; a window takes about 40 bytes.
FAN = 4
_PLACE = np.uint64((1 << 24) - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring strings from theirs."""
    x = left * _MIX
    x ^= x >> np.uint64(29)
    x += right
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def key_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the KEY = 16 + 8 bytes at each place."""
    h = data.astype(np.uint64) + np.uint64(1)
    n, eight = 1, None
    while n < 16:
        h = _joined(h[:-n], h[n:])
        n *= 2
        eight = h if n == 8 else eight
    return _joined(h[:len(h) - 8], eight[16:16 + len(h) - 8])


def _spread(h: np.ndarray) -> np.ndarray:
    """Anchors have low hashes; this makes them even over all 64 bits, one to one."""
    h = h * _MIX
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def _hashes_of_rows(rows: np.ndarray) -> np.ndarray:
    """The hash of the first KEY bytes of each row, spread."""
    h = rows[:, :KEY].astype(np.uint64) + np.uint64(1)
    while h.shape[1] > 3:
        h = _joined(h[:, ::2], h[:, 1::2])
    return _spread(_joined(_joined(h[:, 0], h[:, 1]), h[:, 2]))


def _lowest(keys: np.ndarray, width: int) -> np.ndarray:
    n, low = 1, keys
    while 2 * n <= width:
        low = np.minimum(low[:-n], low[n:])
        n *= 2
    return np.minimum(low[:len(keys) - width + 1], low[width - n:]) if n < width else low


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, hash, first window, last window) of each entry of a run; windows never cross a document's end."""
    span = length - KEY + 1
    valid = np.zeros(len(data) + 1, np.int8)
    np.add.at(valid, starts, sizes >= length)
    np.add.at(valid, starts + np.maximum(sizes - length + 1, 0), -(sizes >= length).astype(np.int8))
    valid = np.cumsum(valid[:-1], dtype=np.int8) > 0
    first_of_doc = np.zeros(len(data), bool)
    first_of_doc[starts[sizes > 0]] = True
    parts = []
    padded = np.concatenate((data, np.zeros(length, np.uint8)))
    for at in range(0, len(data), CHUNK):
        windows = np.flatnonzero(valid[at:at + CHUNK])
        if not len(windows):
            continue
        h = key_hashes(padded[at:at + min(CHUNK, len(data) - at) + length - 1])
        low = _lowest((h & ~_PLACE) | (np.arange(len(h), dtype=np.uint64) + np.uint64(at)), span)
        place = (low[windows] & _PLACE).astype(np.int64)
        windows += at
        new = np.concatenate(([True], (place[1:] != place[:-1]) | first_of_doc[windows[1:]]))
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(windows)) - 1
        parts.append((place[begin], _spread(h[place[begin] - at]), windows[begin], windows[last]))
    if not parts:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common prefix of the rows of two byte matrices."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])


def _strings(rows: np.ndarray) -> np.ndarray:
    """The rows of a byte matrix as strings that numpy can sort."""
    return np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel()


def _suffixes(padded: np.ndarray, place: np.ndarray, reach: np.ndarray, length: int) -> np.ndarray:
    """``reach`` bytes from each place, then zeros."""
    out = sliding_window_view(padded, length)[place]
    out[np.arange(length, dtype=np.int16) >= reach.astype(np.int16)[:, None]] = 0
    return out


def _before(padded: np.ndarray, place: np.ndarray, size: int) -> np.ndarray:
    """``size`` bytes in front of each place, nearest first."""
    return np.ascontiguousarray(sliding_window_view(padded, size)[place - size][:, ::-1])


def repeats(common: np.ndarray, before: np.ndarray, mask: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Which windows of entries in suffix order have an equal one of lower rank: bits like ``mask`` (rows x span booleans by distance).

    common: common prefix of each suffix with the one before (0 for the first); before: the bytes in front of the anchors, nearest first.
    """
    n = len(common)
    out = np.zeros_like(mask)
    if n < 2:
        return out
    back = np.argsort(_strings(before), kind="stable")
    shared = np.concatenate(([0], _common(before[back[1:]], before[back[:-1]])))
    for o in np.flatnonzero(mask.any(axis=0)).tolist():
        own = np.flatnonzero(mask[:, o])
        if len(own) < 2:
            continue
        right = np.cumsum(common < length - o)
        left = np.empty(n, np.int64)
        left[back] = np.cumsum(shared < o)
        both = right[own].astype(np.int64) * (n + 1) + (left[own] if o else 0)
        order = np.lexsort((rank[own], both))
        again = both[order][1:] == both[order][:-1]
        out[own[order[1:][again]], o] = True
    return out


class _Run:
    """Documents gathered by a task until they make a run."""

    def __init__(self):
        self.texts: list[bytes] = []
        self.docs: list[tuple[int, int, int]] = []
        self.bytes = 0

    def add(self, doc: int, seq: int, offset: int, text: bytes):
        self.texts.append(text)
        self.docs.append((doc, seq, offset))
        self.bytes += len(text)


def _ordered(doc: np.ndarray, seq: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rank of each (document, place)."""
    rank = np.empty(len(doc), np.int64)
    rank[np.lexsort((at, seq, doc))] = np.arange(len(doc))
    return rank


def _windows(out: np.ndarray, doc: np.ndarray, seq: np.ndarray, at: np.ndarray) -> pd.DataFrame:
    """The windows marked in ``out`` (entries x distances) as (doc, seq, first, last) stretches of window starts."""
    e, o = np.nonzero(out)
    order = np.lexsort((at[e] - o, seq[e], doc[e]))
    d, s, p = doc[e][order], seq[e][order], (at[e] - o)[order]
    new = np.concatenate(([True], (d[1:] != d[:-1]) | (s[1:] != s[:-1]) | (p[1:] > p[:-1] + 1))) if len(p) else np.empty(0, bool)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(p)) - 1
    return pd.DataFrame({"doc": d[begin], "seq": s[begin], "first": p[begin], "last": p[end] if len(p) else p})


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays one behind the other, compressed; their sizes in front."""
    head = np.array([x.nbytes for x in arrays], np.int64).tobytes()
    body = head + b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=6).compress(body, asbytes=True)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    body = pa.decompress(memoryview(blob)[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    sizes = np.frombuffer(body, np.int64, len(types))
    out, at = [], 8 * len(types)
    for n, t in zip(sizes.tolist(), types, strict=True):
        out.append(np.frombuffer(body, t, n // np.dtype(t).itemsize, at))
        at += n
    return out


_SEGMENT = ("i8", "i8", "i4", "u1", "u1", "u1", "u1", "u1", "u1")


def _laid(run: _Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a run, with the starts and sizes of its documents."""
    sizes = np.fromiter(map(len, run.texts), np.int64, len(run.texts))
    return np.frombuffer(b"".join(run.texts), np.uint8), np.concatenate(([0], np.cumsum(sizes)))[:-1], sizes


def _sorted_run(run: _Run, length: int, ranges: int, hot: np.ndarray | None = None) -> Iterator[tuple[int, bytes]]:
    """(range, segment) of one run.  Ranges from ``ranges`` on hold windows that repeat within the run, to be passed on; those from
    2 * ``ranges`` on the windows of the frequent hashes ``hot``."""
    span = length - KEY + 1
    data, starts, sizes = _laid(run)
    place, h, first, last = anchors(data, starts, sizes, length)
    if not len(place):
        return
    order = np.argsort(h, kind="stable")
    place, h, first, last = place[order], h[order], first[order], last[order]
    own = np.searchsorted(starts, place, side="right") - 1
    docs = np.array(run.docs, np.int64)
    doc, seq, at = docs[own, 0], docs[own, 1], place - starts[own] + docs[own, 2]
    near, far = place - last, place - first  # distances
    mask = (np.arange(span) >= near[:, None]) & (np.arange(span) <= far[:, None])
    padded = np.concatenate((np.zeros(span, np.uint8), data, np.zeros(length, np.uint8)))
    same = np.concatenate(([False], h[1:] == h[:-1]))
    twin = np.flatnonzero(same | np.append(same[1:], False))
    if len(twin):
        suffix = _suffixes(padded, place[twin] + span, length - near[twin], length)
        sub = np.lexsort((_strings(suffix), h[twin]))
        moved = twin[sub]
        for x in (place, h, first, last, doc, seq, at, near, far):
            x[twin] = x[moved]
        mask[twin] = mask[moved]
        suffix = suffix[sub]
        common = np.concatenate(([0], np.where(h[twin][1:] == h[twin][:-1], _common(suffix[1:], suffix[:-1]), 0)))
        before = _before(padded, place[twin] + span, span - 1)
        known = repeats(common, before, mask[twin], _ordered(doc[twin], seq[twin], at[twin]), length)
        found = _windows(known, doc[twin], seq[twin], at[twin])
        for part in np.array_split(np.arange(len(found)), -(-len(found) // 50_000)) if len(found) else []:
            rows = found.iloc[part]
            yield ranges + int(rows["doc"].iloc[0]) % ranges, _pack(*(rows[c].to_numpy(np.int64) for c in rows.columns))
        mask[twin] &= ~known
    if hot is not None and len(hot):
        often = np.flatnonzero(np.isin(h, hot))
        yield from _dealt_windows(data, place[often], doc[often], seq[often], at[often], mask[often], length, ranges)
        mask[often] = False
    stay = np.flatnonzero(mask.any(axis=1))
    place, h, doc, seq, at, mask, near, far = (x[stay] for x in (place, h, doc, seq, at, mask, near, far))
    target = ((h >> np.uint64(40)) * np.uint64(ranges)) >> np.uint64(24)
    cuts = np.searchsorted(target, np.arange(ranges + 1).astype(np.uint64))
    for r in range(ranges):
        a, b = int(cuts[r]), int(cuts[r + 1])
        if a < b:
            yield r, _segment(padded, place[a:b], h[a:b], doc[a:b], seq[a:b], at[a:b], mask[a:b], near[a:b], far[a:b], length)


def _dealt_windows(data, place, doc, seq, at, mask, length, ranges) -> Iterator[tuple[int, bytes]]:
    """(range, packed windows) by the hash of each window marked in ``mask``."""
    e, o = np.nonzero(mask)
    if not len(e):
        return
    whole, digest = data.tobytes(), xxhash.xxh3_128_digest
    names = np.frombuffer(b"".join(digest(whole[a:a + length]) for a in (place[e] - o).tolist()), "<u8").reshape(-1, 2)
    target = (names[:, 0] % np.uint64(FAN * ranges)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    cuts = np.flatnonzero(np.diff(target[order], prepend=-1))
    for part in np.split(order, cuts[1:]):
        k = e[part]
        yield 2 * ranges + int(target[part[0]]), _pack(names[part, 0], names[part, 1], doc[k], seq[k], at[k] - o[part])


def _later_windows(blobs: list[bytes]) -> pd.DataFrame:
    """Of equal windows all but the earliest."""
    first, second, doc, seq, at = (np.concatenate(x) for x in zip(*(_unpack(b, "u8", "u8", "i8", "i8", "i8") for b in blobs), strict=True))
    order = np.lexsort((at, seq, doc, second, first))
    again = order[1:][(first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])]
    return _windows(np.ones((len(again), 1), bool), doc[again], seq[again], at[again])


def _segment(padded, place, h, doc, seq, at, mask, near, far, length) -> bytes:
    """Front-coded: of each suffix only what follows the prefix it shares with the one before."""
    span = length - KEY + 1
    size = length - near  # bytes of the suffix that windows reach
    suffix = _suffixes(padded, place + span, size, length)
    before = _before(padded, place + span, span - 1)
    common = np.concatenate(([0], np.where(h[1:] == h[:-1], _common(suffix[1:], suffix[:-1]), 0)))
    kept = np.minimum(common, size)
    column = np.arange(length)
    tail = suffix[(column >= kept[:, None]) & (column < size[:, None])]
    front = before[np.arange(span - 1) < far[:, None]]
    partial = ~(mask == ((np.arange(span) >= near[:, None]) & (np.arange(span) <= far[:, None]))).all(axis=1)
    return _pack(doc, seq, at.astype(np.int32), near.astype(np.uint8), far.astype(np.uint8), kept.astype(np.uint8),
                 np.concatenate((partial.astype(np.uint8), np.packbits(mask[partial], axis=1).ravel())), tail, front)


def _read_segment(blob: bytes, length: int):
    """Inverse of _segment; suffixes padded with zeros."""
    span = length - KEY + 1
    doc, seq, at, near, far, kept, marks, tail, front = _unpack(blob, *_SEGMENT)
    n = len(doc)
    near, far, kept = near.astype(np.int64), far.astype(np.int64), kept.astype(np.int64)
    mask = (np.arange(span) >= near[:, None]) & (np.arange(span) <= far[:, None])
    partial = np.flatnonzero(marks[:n])
    if len(partial):
        mask[partial] = np.unpackbits(marks[n:].reshape(len(partial), -1), axis=1, count=span).astype(bool)
    column = np.arange(length)
    suffix = np.zeros((n, length), np.uint8)
    suffix[(column >= kept[:, None]) & (column < (length - near)[:, None])] = tail
    for i in np.flatnonzero(kept).tolist():
        suffix[i, :kept[i]] = suffix[i - 1, :kept[i]]
    before = np.zeros((n, span - 1), np.uint8)
    before[np.arange(span - 1) < far[:, None]] = front
    h = _hashes_of_rows(suffix)
    common = np.concatenate(([0], np.where(h[1:] == h[:-1], _common(suffix[1:], suffix[:-1]), 0))) if n else np.empty(0, np.int64)
    return h, doc, seq, at.astype(np.int64), mask, suffix, before, common


class LoserTree:
    """Merges sorted runs of word tuples.  A node holds the loser's run and how many words the loser shares with the winner that passed."""

    def __init__(self, runs: list[list[tuple[int, ...]]], shared: list[list[int]]):
        self.runs, self.shared = runs, shared
        self.next = [0] * len(runs)
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.node: list[tuple[int, int]] = [(-1, 0)] * self.leaves
        self.top = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.leaves:
            run = node - self.leaves
            return run if run < len(self.runs) and self.runs[run] else -1
        a, b = self._build(2 * node), self._build(2 * node + 1)
        winner, loser, same = self._play(a, b, 0)
        self.node[node] = (loser, same)
        return winner

    def _play(self, a: int, b: int, known: int) -> tuple[int, int, int]:
        """(winner, loser, words they share); both share ``known`` words with the last winner.  Equal ones go by run."""
        if a < 0 or b < 0:
            return (b, a, 0) if a < 0 else (a, b, 0)
        x, y = self.runs[a][self.next[a]], self.runs[b][self.next[b]]
        n = len(x)
        while known < n and x[known] == y[known]:
            known += 1
        if known == n:
            return (a, b, n) if a < b else (b, a, n)
        return (a, b, known) if x[known] < y[known] else (b, a, known)

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, words shared with the one before) in order."""
        winner, same = self.top, 0
        while winner >= 0:
            yield winner, self.next[winner], same
            run = winner
            self.next[run] += 1
            if self.next[run] < len(self.runs[run]):
                same = self.shared[run][self.next[run]]
            else:
                winner, same = -1, -1
            node = (run + self.leaves) // 2
            while node:
                other, known = self.node[node]
                if other >= 0:
                    if winner < 0 or known > same:  # the other shares more with the last winner, so it comes first
                        self.node[node] = (winner, same)
                        winner, same = other, known
                    elif known == same:
                        first, second, both = self._play(winner, other, same)
                        self.node[node] = (second, both)
                        winner = first
                node //= 2


def _merge(blobs: list[bytes], length: int) -> Iterator[pd.DataFrame]:
    """Windows of one range that stand earlier in another run, some thousand entries at a time."""
    # read twice: first for the hashes alone, then one segment at a time for the entries that stay
    value, n = np.unique(np.concatenate([_read_segment(b, length)[0] for b in blobs]), return_counts=True)
    value, n = value[n > 1], n[n > 1]  # entries alone with their hash leave
    if not len(value):
        return
    kept = []
    for b in blobs:
        p = _read_segment(b, length)
        mine = np.flatnonzero(value[np.minimum(np.searchsorted(value, p[0]), len(value) - 1)] == p[0])
        if len(mine):
            # what an entry shares with the last one kept: the least of all steps between them
            common = np.minimum.reduceat(p[7][:mine[-1] + 1], np.concatenate(([0], mine[:-1] + 1)))
            kept.append((*(x[mine] for x in p[:7]), common))
    cuts = value[np.flatnonzero(np.diff(np.cumsum(n) // AT_ONCE, prepend=-1))]
    for low, high in zip(cuts, [*cuts[1:], None], strict=True):
        runs = []
        for k in kept:
            a, b = np.searchsorted(k[0], low), len(k[0]) if high is None else np.searchsorted(k[0], high)
            if a < b:
                runs.append(tuple(x[a:b] for x in k))
        if runs:
            yield _merge_runs(runs, length)


def _merge_runs(parts: list[tuple], length: int) -> pd.DataFrame:
    runs, shared = [], []
    for h, *_, suffix, _, common in parts:
        wide = np.zeros((len(h), -(-length // 8) * 8), np.uint8)
        wide[:, :length] = suffix
        words = np.concatenate((h[:, None], wide.view(">u8").astype(np.uint64)), axis=1)
        equal = np.concatenate(([False], h[1:] == h[:-1]))
        runs.append(list(map(tuple, words.tolist())))
        shared.append(np.where(equal, 1 + np.where(common >= length, words.shape[1] - 1, common // 8), 0).tolist())
    base = np.concatenate(([0], np.cumsum([len(r) for r in runs])))
    merged = np.array([(base[r] + i, same) for r, i, same in LoserTree(runs, shared).merged()], np.int64)
    del runs, shared
    order = merged[:, 0]
    doc, seq, place, mask, suffix, before = (np.concatenate([k[j] for k in parts])[order] for j in range(1, 7))
    # whole words are known to be shared; the last bytes are counted in the first word that differs
    known = np.maximum(merged[:, 1] - 1, 0) * 8
    common = np.where(merged[:, 1] > 0, np.minimum(known, length), 0)
    for j in range(8):
        c = np.minimum(common, length - 1)
        more = (merged[:, 1] > 0) & (common == known + j) & (common < length)
        more[1:] &= suffix[np.arange(1, len(c)), c[1:]] == suffix[np.arange(len(c) - 1), c[1:]]
        more[:1] = False
        common = common + more
    return _windows(repeats(common, before, mask, _ordered(doc, seq, place), length), doc, seq, place)


def repeated_windows(docs: DataFrame, length: int = LENGTH, run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """(doc, seq, first, last): stretches of window starts at which a window repeats an earlier one.  ``docs``: doc, seq, text."""
    if not KEY < length <= 255 or run_bytes >= 1 << 24:
        raise ValueError(f"a window has {KEY + 1} to 255 bytes, a run less than 2^24")
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    ranges = max(1, -(-total // range_bytes))

    def runs(batches) -> Iterator[_Run]:
        run = _Run()
        for batch in batches:
            for doc, seq, text in zip(batch["doc"], batch["seq"], batch["text"], strict=True):
                data = text.encode("utf-8") if text else b""
                if len(data) < length:
                    continue
                for at in range(0, len(data) - length + 1, run_bytes - length + 1):  # a longer document is cut; every window is in one piece
                    piece = data[at:at + run_bytes]
                    if run.bytes and run.bytes + len(piece) > run_bytes:
                        yield run
                        run = _Run()
                    run.add(doc, seq, at, piece)
        if run.bytes:
            yield run

    def count(batches) -> Iterator[pd.DataFrame]:
        for run in runs(batches):
            h, n = np.unique(anchors(*_laid(run), length)[1], return_counts=True)
            yield pd.DataFrame({"h": h[n > 1].view(np.int64), "n": n[n > 1]})  # those alone in a run are at most one per run

    # at most one in at_once of all entries
    often = docs.mapInPandas(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > at_once).collect()
    hot = np.array([r["h"] for r in often], np.int64).view(np.uint64)

    def sort(batches) -> Iterator[pd.DataFrame]:
        for run in runs(batches):
            rows = list(_sorted_run(run, length, ranges, hot))
            yield pd.DataFrame({"range": [r for r, _ in rows], "segment": [s for _, s in rows]})

    dealt = docs.mapInPandas(sort, "range int, segment binary")
    dealt = dealt.repartition(ranges, "range").sortWithinPartitions("range")

    def settled(number: int, held: list[bytes]) -> Iterator[pd.DataFrame]:
        return _merge(held, length) if number < ranges else iter([_later_windows(held)])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[bytes] = []
        number = None
        for batch in batches:
            for r, segment in zip(batch["range"], batch["segment"], strict=True):
                if ranges <= r < 2 * ranges:
                    yield pd.DataFrame(dict(zip(("doc", "seq", "first", "last"), _unpack(segment, "i8", "i8", "i8", "i8"), strict=True)))
                    continue
                if r != number and held:
                    yield from settled(number, held)
                    held = []
                number = r
                held.append(segment)
        if held:
            yield from settled(number, held)
    return dealt.mapInPandas(merge, "doc long, seq long, first long, last long")


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH,
                   run_bytes: int = RUN_BYTES, range_bytes: int = RANGE_BYTES, at_once: int = AT_ONCE) -> DataFrame:
    """``keep`` columns (all by default) with n_bytes, n_removed, n_spans and kept, the bytes that no earlier string of ``length`` bytes covers."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in RESULTS]
    last = F.lit((1 << 63) - 1)
    own = docs.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)],
                      F.coalesce(F.col(f"`{doc_id}`").cast("long"), last).alias("doc"), F.col(f"`{text}`").cast("string").alias("text"))
    if own.groupBy("doc").count().where("count > 1").isEmpty():
        own = own.withColumn("seq", F.lit(0).cast("long"))
    else:
        own = pin(own.withColumn("seq", F.monotonically_increasing_id()), "numbered")
    found = repeated_windows(own.select("doc", "seq", "text"), length, run_bytes, range_bytes, at_once)
    marks = found.groupBy("doc", "seq").agg(F.collect_list(F.shiftleft("first", 32) + F.col("last")).alias("stretches"))

    def make():
        def cut(texts: list[str | None], stretches: list[list[int] | None]) -> tuple[list, list, list, list]:
            out = []
            for t, marked in zip(texts, stretches, strict=True):
                data = t.encode("utf-8") if t else b""
                if not marked:
                    out.append((len(data), 0, 0, data))
                    continue
                at = np.array(marked, np.int64)
                edge = np.zeros(len(data) + 1, np.int64)
                np.add.at(edge, at >> 32, 1)
                np.add.at(edge, (at & 0xFFFFFFFF) + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                out.append((len(data), int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), np.frombuffer(data, np.uint8)[~gone].tobytes()))
            return tuple(map(list, zip(*out, strict=True)))
        return cut
    joined = own.join(marks, ["doc", "seq"], "left").select(*[f"k{i}" for i in range(len(keep))], "text", "stretches")
    done = add_columns(joined, {"n_bytes": "long", "n_removed": "long", "n_spans": "long", "kept": "binary"}, ["text", "stretches"], make)
    return done.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_bytes", "n_removed", "n_spans", "kept")
