"""Exact top-k inner products by sequential access to sorted lists (no random access until the end).

Vectors are cut into blocks of at most ``BLOCK`` rows.  Within a block every dimension has a list sorted by value; a query reads it from
the top where its own component is positive and from the bottom where it is negative.  All vectors start at the least score the lists
allow, and each entry read adds what its component is worth above the least, so lower bounds only grow and an upper bound is the lower one plus
what the unread lists can still give.  A vector whose upper bound lies below the floor is out; the floor is the k-th best lower bound of
the block or the k-th best score of the blocks read before, whichever is higher, so a block whose best possible score lies below it is
not read at all.  When few vectors are left their scores are resolved exactly.  A query that has settled too few of a block's
vectors after a round (``SLOW``) reads to the ends at once, as many small rounds would cost more than they save.

Blocks and groups of queries meet in cells: a cell holds at most about ``HELD`` bytes of queries and reads its blocks one after the other, the one
with the longest vector first.  Blocks are sent once per group of queries and queries once per lane of blocks.

Components become floor(256 x), integers; scores are exact while they stay within 64 bits (components up to 2^28).  Bounds are doubles and
are widened by their own rounding error, so none cuts a vector that could tie.

Defined cases: a vector that is null, empty, or holds a null or non-finite component takes no part; a query only meets
vectors of its own length; ties go to the smaller id; repeated ids stay separate candidates, but a query's own id is never among its
results; a query id asked twice is answered twice; a null id takes no part; with fewer than k candidates all are returned; extra columns are
ignored; an empty table, of vectors or of queries, gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.session import pin

BLOCK = 4096
QUERIES = 512
SCALE = 256
#: Numbers in a block at most, so that long vectors make shorter blocks.
NUMBERS = 1 << 20
#: Bytes of queries that a cell holds, and blocks that it reads; both are averages.
HELD = 32 << 20
LANE = 64
#: Share of a block's vectors per query that is left to resolve at most, if reading further can help.
LEFT = 1 / 64
#: Share of each list that the first round reads.
FIRST = 1 / 4
#: A query with more than this share of a block's vectors left after a round reads to the ends.
SLOW = 0.5


def integer_vectors(df: DataFrame, vec_id: str, vector: str, scale: int = SCALE) -> DataFrame:
    v = F.col(f"`{vector}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (df.select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.alias("v")).where(F.col("id").isNotNull() & (F.size("v") > 0) & fine)
            .select("id", F.size("v").alias("dim"), F.transform("v", lambda x: F.floor(x * scale)).alias("v")))


def _packed(rows: DataFrame, size: int, name: str) -> DataFrame:
    """One row per block of at most ``size`` vectors: (number, dim, longest, ids, vectors), the numbers as little-endian 64-bit integers."""
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for dim, part in batch.groupby("dim"):
                v = np.stack(part["v"].to_list()).astype(np.int64)
                norm, ids = np.linalg.norm(v.astype(np.float64), axis=1), part["id"].to_numpy(np.int64)
                order = np.argsort(-norm, kind="stable")
                step = max(1, min(size, NUMBERS // int(dim)))
                for at in range(0, len(order), step):
                    piece = order[at:at + step]
                    out.append((dim, norm[piece[0]], ids[piece].tobytes(), v[piece].tobytes()))
            yield pd.DataFrame(out, columns=["dim", "longest", "ids", "vectors"])
    blocks = rows.mapInPandas(pack, "dim int, longest double, ids binary, vectors binary")
    return pin(blocks.withColumn("number", F.monotonically_increasing_id()), name)


class SortedLists:
    """The sorted lists of one block: what reading on is worth, and what is still unread."""

    def __init__(self, vectors: np.ndarray):
        self.v = vectors.astype(np.float64)
        self.n = len(vectors)
        order = np.argsort(self.v, axis=0, kind="stable")
        self.sorted = np.take_along_axis(self.v, order, axis=0)
        self.low, self.high = self.sorted[0], self.sorted[-1]
        self.rank = np.empty_like(order)
        np.put_along_axis(self.rank, order, np.arange(self.n)[:, None], axis=0)
        self._gains: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        self._unread: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def least(self, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        return pos @ self.low + neg @ self.high

    def most(self, pos: np.ndarray, neg: np.ndarray) -> np.ndarray:
        return pos @ self.high + neg @ self.low

    def gained(self, pos: np.ndarray, neg: np.ndarray, read: int, to: int) -> np.ndarray:
        """What the entries after ``read`` up to ``to`` of each list add to the lower bounds of each query (row) and vector."""
        if (read, to) not in self._gains:
            top = (self.rank >= self.n - to) & (self.rank < self.n - read)
            bottom = (self.rank < to) & (self.rank >= read)
            self._gains[read, to] = np.where(top, self.v - self.low, 0).T, np.where(bottom, self.v - self.high, 0).T
        above, below = self._gains[read, to]
        return pos @ above + neg @ below

    def open_gain(self, pos: np.ndarray, neg: np.ndarray, to: int) -> np.ndarray:
        """The most that the entries after ``to`` can add to each vector's lower bound."""
        if to not in self._unread:
            self._unread[to] = (self.rank < self.n - to).astype(np.float64).T, (self.rank >= to).astype(np.float64).T
        top, bottom = self._unread[to]
        return (pos * (self.sorted[self.n - to] - self.low)) @ top + (neg * (self.sorted[to - 1] - self.high)) @ bottom

    def bounds(self, pos: np.ndarray, neg: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) of every query (row) and vector after ``depth`` entries of each list; pos and neg: the queries' components by sign."""
        lower = self.least(pos, neg)[:, None] + self.gained(pos, neg, 0, depth)
        return lower, lower + self.open_gain(pos, neg, depth)


class Best:
    """The k best (score, id) so far of each query of one part, and the entries its queries have read."""

    def __init__(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.q, self.k = query_ids, queries, k
        self.query = self.vec = self.score = np.empty(0, np.int64)
        self.floor = np.full(len(queries), -np.inf)
        self.entries, self.held = np.zeros(len(queries), np.int64), np.zeros(len(queries), np.int64)

    def add(self, query: np.ndarray, vec: np.ndarray, score: np.ndarray) -> None:
        query, vec, score = (np.concatenate(x) for x in ((self.query, query), (self.vec, vec), (self.score, score)))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < self.k
        self.query, self.vec, self.score = query[keep], vec[keep], score[keep]
        last = place == self.k - 1
        self.floor[query[last]] = score[last]

    def read(self, lists: SortedLists, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Read one block's lists as far as its vectors can still be among the best."""
        q = self.q.astype(np.float64)
        pos, neg, used = np.maximum(q, 0), np.minimum(q, 0), (self.q != 0).sum(axis=1)
        slack = np.abs(q) @ np.maximum(np.abs(lists.low), np.abs(lists.high)) * 4e-12
        self.held += used * lists.n
        open_ = np.flatnonzero(lists.most(pos, neg) >= self.floor - slack)
        need, rest_of = min(self.k, lists.n), []
        work = [(open_, np.repeat(lists.least(pos[open_], neg[open_])[:, None], lists.n, axis=1), 0, max(1, int(lists.n * FIRST)))]
        while work:
            open_, lower, read, to = work.pop()
            if not len(open_):
                continue
            own = self.ids[open_][:, None] == ids
            lower += lists.gained(pos[open_], neg[open_], read, to)
            self.entries[open_] += used[open_] * (to - read)
            lower[own] = -np.inf
            floor = np.maximum(np.partition(lower, lists.n - need, axis=1)[:, lists.n - need], self.floor[open_])
            upper = lower if to == lists.n else lower + lists.open_gain(pos[open_], neg[open_], to)
            stays = (upper >= (floor - 2 * slack[open_])[:, None]) & ~own
            left = stays.sum(axis=1)
            done = (left <= max(4 * self.k, LEFT * lists.n)) | (to == lists.n)
            rest_of += [(int(open_[i]), np.flatnonzero(stays[i])) for i in np.flatnonzero(done).tolist()]
            slow = ~done & (left > SLOW * lists.n)
            work += [(open_[slow], lower[slow], to, lists.n), (open_[~done & ~slow], lower[~done & ~slow], to, min(lists.n, to + max(1, to // 2)))]
        if rest_of:
            scores = [vectors[rest] @ self.q[i] for i, rest in rest_of]  # the final scores, in integers
            self.add(np.repeat([i for i, _ in rest_of], [len(r) for _, r in rest_of]).astype(np.int64),
                     ids[np.concatenate([r for _, r in rest_of])], np.concatenate(scores))


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def top_products(vectors: DataFrame, queries: DataFrame, k: int = 5, vec_id: str = "vec_id", vector: str = "embedding",
                 block: int = BLOCK, query_block: int = QUERIES, held: int = HELD, lane: int = LANE, shares: bool = False) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` best vectors of each query, itself left out; with ``shares`` also ``read``,
    the share of the entries of its lists that the query read."""
    candidates = _packed(integer_vectors(vectors, vec_id, vector), block, "block")
    asked = _packed(integer_vectors(queries, vec_id, vector).repartition(max(1, -(-queries.count() // query_block))), query_block, "part")
    blocks = candidates.count()
    groups = max(1, -(-(asked.agg(F.sum(F.length("vectors"))).first()[0] or 0) // held))
    lanes = max(1, min(blocks, max(vectors.sparkSession.sparkContext.defaultParallelism, -(-blocks // lane))))
    turn = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = (asked.withColumn("group", turn(groups)).withColumn("lane", every(lanes)).withColumn("kind", F.lit(0))
             .unionByName(candidates.withColumn("group", every(groups)).withColumn("lane", turn(lanes)).withColumn("kind", F.lit(1)))
             .repartition(groups * lanes, "group", "lane").sortWithinPartitions("group", "lane", "kind", F.desc("longest"), "number"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cell, parts = None, {}
        for batch in batches:
            for row in batch.itertuples(index=False):
                if (row.group, row.lane) != cell:
                    yield from results(parts)
                    cell, parts = (row.group, row.lane), {}
                numbers = _ints(row.vectors).reshape(-1, row.dim)
                if row.kind == 0:
                    parts[row.number] = Best(_ints(row.ids), numbers, k)
                    continue
                meets = [p for p in parts.values() if p.q.shape[1] == row.dim]
                lists = SortedLists(numbers) if meets else None
                for p in meets:
                    p.read(lists, _ints(row.ids), numbers)
        yield from results(parts)

    def results(parts: dict[int, Best]) -> Iterator[pd.DataFrame]:
        for number, p in parts.items():
            first = np.concatenate(([True], p.query[1:] != p.query[:-1]))[:len(p.query)]  # a query's counts are given once
            yield pd.DataFrame({"part": number, "query": p.query, "query_id": p.ids[p.query], "vec_id": p.vec, "score": p.score,
                                "entries": np.where(first, p.entries[p.query], 0), "held": np.where(first, p.held[p.query], 0)})
    found = cells.mapInPandas(read, "part long, query long, query_id long, vec_id long, score long, entries long, held long")
    asker = Window.partitionBy("part", "query")
    out = found.withColumn("rank", F.row_number().over(asker.orderBy(F.desc("score"), "vec_id")).cast("int"))
    if shares:
        out = out.withColumn("read", F.sum("entries").over(asker) / F.sum("held").over(asker))
    return out.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", *["read"] * shares)
