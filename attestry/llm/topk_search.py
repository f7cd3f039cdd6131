"""Exact search for the highest inner products with an impact-ordered, score-at-a-time index."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions.exprs import join_dimension
from attestry.llm.common import hash_pair, stored

#: Vectors of one index, and queries put to it in one task.
BLOCK, CHUNK = 8192, 1024
#: Impact levels of a dimension at most; with fewer distinct values every value is its own level.
LEVELS = 256
#: Shares of the largest contribution down to which postings are processed; a next round follows if too many rows remain possible.
ROUNDS = (0.12, 0.05, 0.0)
#: Tasks at most; with more blocks and chunks than that a task takes several, one after another.
TASKS = 10_000
#: Integers up to this size are exact in every bound; beyond it all vectors of the block are rescored.
EXACT = 1 << 53
#: A lookup of more bytes than this is joined by a shuffle.
LOOKUP_BYTES = 8 << 20


class ImpactIndex:
    """Postings of a block of integer vectors: for each dimension, vectors by descending impact level.

    The impact of a vector on a dimension is how far its value lies above the
    dimension's least, or below its greatest where a query's weight is negative,
    so impacts are never negative. A level's impact is that of its best value.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.doubles = self.vectors.astype(np.float64)
        self.least, self.most = self.vectors.min(axis=0), self.vectors.max(axis=0)
        # the width of a level, and levels from 0
        self.spread = [int(b) - int(a) for a, b in zip(self.least, self.most, strict=True)]
        self.exact = max(self.spread, default=0) < EXACT
        self.largest = max((max(abs(int(a)), abs(int(b))) for a, b in zip(self.least, self.most, strict=True)), default=0)
        if not self.exact:
            return
        spread = np.array(self.spread, np.int64)
        width = np.maximum(1, -(-(spread + 1) // LEVELS))
        level = (self.vectors - self.least) // width
        order = np.argsort(level, axis=0, kind="stable").T
        held = np.take_along_axis(level, order.T, axis=0).T
        self.width, self.wide = width, spread
        # vectors below each level, for where a run of postings ends
        self.below = np.array([np.searchsorted(row, np.arange(LEVELS + 1)) for row in held])
        # postings and their impacts in processing order, for weights above and below zero
        self.postings = np.ascontiguousarray(order[:, ::-1]), np.ascontiguousarray(order)
        self.impacts = (np.minimum((held[:, ::-1] + 1) * width[:, None] - 1, spread[:, None]).astype(np.float64),
                        (spread[:, None] - held * width[:, None]).astype(np.float64))

        # room for the postings of one round
        self.rows, self.above = np.empty(self.vectors.size, np.int64), np.empty(self.vectors.size)

    def ends(self, positive: np.ndarray, least: np.ndarray) -> np.ndarray:
        """How many postings of each dimension have an impact above ``least``."""
        dims = np.arange(len(least))
        up = len(self.ids) - self.below[dims, np.minimum((least + 1) // self.width, LEVELS)]
        down = self.below[dims, np.clip(-((least - self.wide) // self.width), 0, LEVELS)]
        return np.where(least >= self.wide, 0, np.where(positive, up, down))

    def scores(self, query: list[int], rows: np.ndarray | slice) -> np.ndarray:
        """Inner products with some of the vectors, without overflow."""
        if sum(map(abs, query)) * self.largest < EXACT:
            # every partial sum is an integer that a double holds
            return (self.doubles[rows] @ np.array(query, np.float64)).astype(np.int64)
        if sum(map(abs, query)) * self.largest < 1 << 62:
            return self.vectors[rows] @ np.array(query, np.int64)
        return self.vectors[rows].astype(object) @ np.array(query, object)

    def possible(self, query: list[int], k: int) -> np.ndarray | slice:
        """Rows that can be among the best ``k`` (ties included): proven by bounds, whenever the rounds stop.

        A round takes the postings with a contribution above t, dimension by
        dimension from the highest impact down; t falls from round to round. A
        vector's score is at most the sum of what its postings have above t, plus
        t (or the most the dimension can give, if less) for each dimension. It is
        out if that is below the k-th best of some exact scores.
        """
        n = len(self.ids)
        reach = [abs(w) * s for w, s in zip(query, self.spread, strict=True)]
        if n <= 4 * k or not self.exact or sum(reach) >= EXACT:
            return slice(None)
        # what a vector with no impact at all would score
        floor = sum(w * (int(a) if w > 0 else int(b)) for w, a, b in zip(query, self.least, self.most, strict=True))
        limits, weights = np.array(reach, np.int64), np.abs(np.array(query, np.int64))
        positive = np.array(query, np.int64) > 0
        tried, best, kept = np.zeros(n, bool), np.zeros(0, np.int64), np.arange(n)
        for share in ROUNDS:
            t = int(share * limits.max(initial=0))
            # a contribution above t is an impact above t / weight
            ends = np.where(limits > t, self.ends(positive, t // np.maximum(weights, 1)), 0)
            bound = np.full(n, int(np.minimum(limits, t).sum()) + floor)
            runs = [(0 if positive[d] else 1, d, ends[d], weights[d]) for d in np.flatnonzero(ends)]
            if runs:
                size, first = int(ends.sum()), 0
                rows, above = self.rows[:size], self.above[:size]
                np.concatenate([self.postings[i][d, :end] for i, d, end, _ in runs], out=rows)
                for i, d, end, weight in runs:
                    np.multiply(self.impacts[i][d, :end], weight, out=above[first : first + end])
                    first += end
                above -= t
                bound += np.bincount(rows, above, n).astype(np.int64)
            likely = np.argpartition(bound, n - 2 * k)[n - 2 * k :]
            likely = likely[~tried[likely]]
            if len(likely):
                tried[likely] = True
                best = np.sort(np.concatenate([best, self.scores(query, likely).astype(np.int64)]))[-k:]
            if len(best) == k:
                kept = np.flatnonzero(bound >= best[0])
                if len(kept) <= max(16 * k, n // 2):
                    break
        return kept

    def search(self, query: list[int], k: int) -> tuple[np.ndarray, list[int]]:
        """The best ``k``: (ids, scores), ties to smaller ids."""
        rows = self.possible(query, k)
        scores, ids = self.scores(query, rows), self.ids[rows]
        # rows are in order of their ids, so a stable sort leaves ties that way
        order = np.argsort(-scores, kind="stable")[:k]
        return ids[order], [int(s) for s in scores[order]]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int):
    """Rows sorted by (dimensions, block, chunk), vectors before queries: (query, id, score), the best ``k`` of a block for each query."""

    def run(batches):
        key, ids, vectors, index = None, [], [], None
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(3)]
            asks = batch.column(3).to_numpy(zero_copy_only=False)
            change = np.any([x[1:] != x[:-1] for x in [*keys, asks]], axis=0)
            bounds = np.concatenate([[0], np.flatnonzero(change) + 1, [batch.num_rows]]) if batch.num_rows else [0]
            for start, end in zip(bounds[:-1], bounds[1:], strict=True):
                own = tuple(int(x[start]) for x in keys)
                if own != key:
                    key, ids, vectors, index = own, [], [], None
                part = batch.slice(start, end - start)
                if not asks[start]:
                    ids.append(part.column(4).to_numpy())
                    vectors.append(_matrix(part.column(5)))
                    continue
                if not ids and index is None:
                    continue
                if index is None:
                    index = ImpactIndex(np.concatenate(ids), np.concatenate(vectors))
                    ids, vectors = [], []
                for first in range(0, part.num_rows, 512):
                    some = part.slice(first, 512)
                    out = [[], [], []]
                    for name, query in zip(some.column(4).to_pylist(), _matrix(some.column(5)).tolist(), strict=True):
                        found, scores = index.search(query, k)
                        out[0] += [name] * len(found)
                        out[1] += found.tolist()
                        out[2] += [min(max(s, -(1 << 63)), (1 << 63) - 1) for s in scores]
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query", "id", "score"])

    return run


def topk_search(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, every: int = 50, scale: int = 256) -> DataFrame:
    """For each vector whose id is divisible by ``every``, the ``k`` others with the highest inner products.

    Components become floor(scale * x), scores are exact integers, ties go to the
    smaller id. Returns query_id, rank (from 1), vec_id and score.

    Vectors that are NULL or empty or hold NULL or non-finite components and rows
    with a NULL id take no part; vectors of different lengths do not meet; rows
    that repeat an id count once (with the least of their vectors, component by
    component, if they differ). Numbers beyond 64 bits are held at their limit. Other columns are not read.

    Scale: vectors are dealt by the hash of their id into blocks of BLOCK with an
    index each, queries into chunks, and every chunk meets every block, one task
    each. Of equal vectors only the k + 1 smallest ids can be in any result, so no
    more are indexed; equal queries are asked once. A block returns k + 1 rows for a query.
    """
    ids = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").alias("v")).where(
        F.col("id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    whole = stored(ids.select("id", F.transform("v", lambda x: F.floor(x.cast("double") * scale)).alias("v")).groupBy("id").agg(F.min("v").alias("v")), "vectors")
    # a bounded number of ids for each distinct vector
    twins = Window.partitionBy("v").orderBy("id")
    rows = stored(whole.withColumn("place", F.row_number().over(twins)).where(F.col("place") <= k + 1).drop("place"), "rows")
    h = hash_pair(F.col("v"))
    asked = whole.where(F.col("id") % every == 0).select("id", "v", h[0].alias("h0"), h[1].alias("h1"))
    queries = stored(asked.groupBy("h0", "h1").agg(F.min(F.struct("id", "v")).alias("first")).select("h0", "h1", F.col("first.id").alias("query"), F.col("first.v").alias("v")), "queries")
    blocks, chunks = max(1, -(-rows.count() // BLOCK)), max(1, -(-queries.count() // CHUNK))

    def numbers(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    def dealt(name: str, count: int) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(count)).cast("int")

    indexed = rows.select(F.size("v").alias("size"), dealt("id", blocks).alias("block"), numbers(chunks).alias("chunk"), F.lit(False).alias("asks"), "id", "v")
    asking = queries.select(F.size("v").alias("size"), numbers(blocks).alias("block"), dealt("query", chunks).alias("chunk"), F.lit(True).alias("asks"), F.col("query").alias("id"), "v")
    group = ["size", "block", "chunk"]
    found = indexed.union(asking).repartition(min(blocks * chunks, TASKS), *group).sortWithinPartitions(*group, "asks").mapInArrow(_search(k + 1), "query long, id long, score long")
    top = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= k + 1)
    lists = best.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "id", "score"))).alias("found"))

    named = join_dimension(asked.select("id", "h0", "h1"), queries.select("h0", "h1", "query"), ["h0", "h1"], "inner", LOOKUP_BYTES)
    out = named.select("id", "query").join(lists, "query")
    others = F.slice(F.filter("found", lambda x: x["id"] != F.col("id")), 1, k)
    return out.select("id", F.posexplode(others).alias("place", "hit")).select(
        F.col("id").alias("query_id"), (F.col("place") + 1).alias("rank"), F.col("hit.id").alias("vec_id"), F.col("hit.score").alias("score"))
