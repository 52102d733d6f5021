"""Approximate nearest neighbours by collision-counting hashing.

Rows are dealt into blocks of equal size. In a block every vector gets a
coordinate that makes all norms equal (so that the largest inner product is
the nearest), and m orthogonal projections are each kept as one sorted array, cut into
GRID base buckets of equal counts. A query opens a window around its own projection in every
array; virtual rehashing widens it, by whole base buckets, along a ladder of widths. What a
window holds is a bitmap (that of the places below its end without that of the places below its
start), and a carry-save adder counts the collisions of 64 vectors at once. Vectors that
collide in at least ALPHA * m windows are verified by their exact inner
product in double precision; the width is the first of the ladder that gives BETA * n + SPARE * k
of them, found by galloping from the width of the queries before.

Every row is indexed; queries and rows meet block by block. The best k of each
block meet per query in a ranked window.

Defined results: rows with a null key, and vectors that are null, empty, zero or
hold null or non-finite components take no part; vectors meet those of their own dimension;
a query skips rows with its own key; repeated keys and equal rows count as rows each, and are
dealt over all blocks; queries of one key are asked together, equal ones once; ties go to
the smaller key; with fewer candidates than k all are given; columns beside key
and vector are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import for_workers

BLOCK, QUERY_BLOCK = 32_768, 16_384
PROJECTIONS, ALPHA, BETA, SPARE, GRID = 128, 0.88, 0.03, 8, 64
#: Widths of windows: the first in standard deviations of a projection, the factor of each widening, and how many; the last one covers all.
START, STEP, LEVELS = 0.02, 1.02, 288
#: Queries that are counted together, so that their bitmaps stay in cache.
TOGETHER = 16


def projections(dim: int, m: int, seed: int = 5) -> np.ndarray:
    """dim x m, in orthonormal groups of at most dim columns."""
    r, out = np.random.default_rng(seed + dim), []
    while sum(x.shape[1] for x in out) < m:
        out.append(np.linalg.qr(r.normal(size=(dim, dim)))[0])
    return np.concatenate(out, 1)[:, :m]


def added(masks) -> list[np.ndarray]:
    """Bit planes, lowest first, of how many of some bitmaps hold each bit: a carry-save adder tree."""
    planes: list[list[np.ndarray]] = [[]]

    def carry(level: int, bits: np.ndarray) -> None:
        if level == len(planes):
            planes.append([])
        planes[level].append(bits)

    def full(level: int) -> None:
        a, b, c = planes[level]
        s = a ^ b
        planes[level] = [s ^ c]
        carry(level + 1, (a & b) | (s & c))

    for x in masks:
        carry(0, x)
        level = 0
        while len(planes[level]) == 3:
            full(level)
            level += 1
    level = 0
    while level < len(planes):
        if len(planes[level]) == 3:
            full(level)
        elif len(planes[level]) == 2:
            a, b = planes[level]
            planes[level] = [a ^ b]
            carry(level + 1, a & b)
        level += 1
    return [p[0] for p in planes]


def at_least(planes: list[np.ndarray], least: int) -> np.ndarray:
    """Bitmap of the bits whose count is least or more."""
    if least >> len(planes):
        return np.zeros_like(planes[0])
    more, equal = np.zeros_like(planes[0]), ~np.zeros_like(planes[0])
    for k in range(len(planes) - 1, -1, -1):
        if least >> k & 1:
            equal &= planes[k]
        else:
            more |= equal & planes[k]
            equal &= ~planes[k]
    return more | equal


class Block:
    def __init__(self, ids: np.ndarray, x: np.ndarray, m: int = PROJECTIONS):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        norms, n = np.sqrt((self.x**2).sum(1)), len(ids)
        self.top = float(norms.max()) or 1.0
        unit = np.concatenate([self.x, np.sqrt(np.maximum(0, self.top**2 - norms**2))[:, None]], 1) / self.top
        self.a = projections(unit.shape[1], m)
        p = np.ascontiguousarray((unit @ self.a).T)
        self.width = START * float(np.median(p.std(1))) or 1e-9
        order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, order, 1)
        # for each array and bucket bound, the bitmap of the vectors whose place is below it
        self.bounds = np.unique(np.linspace(0, n, GRID + 1).astype(np.int64))
        self.below = np.zeros((m, len(self.bounds), -(-n // 64)), np.uint64)
        place = np.empty(n, np.int64)
        for j in range(m):
            place[order[j]] = np.arange(n)
            for g, bound in enumerate(self.bounds):
                bits = np.packbits(place < bound, bitorder="little")
                self.below[j, g].view(np.uint8)[: len(bits)] = bits
        self.all = self.below[0, -1]

    def hits(self, at: np.ndarray, level: np.ndarray, least: int) -> np.ndarray:
        """For each query (its projections a column of at) the bitmap of the vectors that collide with it in `least` windows of a level."""
        w = self.width * STEP**level

        def masks():
            for j, s in enumerate(self.sorted):
                lo = np.searchsorted(self.bounds, s.searchsorted(at[j] - w), "right") - 1
                hi = np.searchsorted(self.bounds, s.searchsorted(at[j] + w, "right"), "left")
                yield self.below[j, hi] ^ self.below[j, lo]

        out = at_least(added(masks()), least)
        out[level >= LEVELS - 1] = self.all
        return out & self.all

    def search(self, own: np.ndarray, q: np.ndarray, k: int, alpha: float = ALPHA, beta: float = BETA) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (its key and vector) the keys and products of the best k of the block."""
        n, m = len(self.ids), len(self.sorted)
        need, least = min(n, int(beta * n) + SPARE * k), int(np.ceil(alpha * m))
        norms = np.sqrt((q**2).sum(1))[:, None]
        at = np.ascontiguousarray((np.concatenate([q, np.zeros((len(q), 1))], 1) / np.where(norms > 0, norms, 1) @ self.a).T)
        out, guess, self.verified = [], LEVELS // 2, 0
        for first in range(0, len(q), TOGETHER):
            part = np.arange(first, min(len(q), first + TOGETHER))
            # low is too narrow, high is wide enough
            low, high, step = np.full(len(part), -1), np.full(len(part), LEVELS - 1), np.ones(len(part), np.int64)
            found = np.broadcast_to(self.all, (len(part), len(self.all))).copy()
            probe, open_ = np.full(len(part), guess), np.arange(len(part))
            while len(open_):
                got = self.hits(at[:, part[open_]], probe[open_], least)
                enough = np.bitwise_count(got).sum(1) >= need
                yes, no = open_[enough], open_[~enough]
                high[yes], low[no], found[yes] = probe[yes], probe[no], got[enough]
                up, down = (high == LEVELS - 1), (low == -1)
                probe = np.where(up, np.minimum(low + step, high - 1), np.where(down, np.maximum(high - step, 0), (low + high) // 2))
                step *= 2
                open_ = open_[(high - low > 1)[open_]]
            guess = int(np.median(high))
            for i, bits in zip(part, found, strict=True):
                hit = np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=n, bitorder="little"))
                hit = hit[self.ids[hit] != own[i]]
                self.verified += len(hit)
                score = self.x[hit] @ q[i]
                if len(hit) > 4 * k:  # the k-th score and its ties
                    cut = np.partition(score, len(score) - k)[len(score) - k]
                    hit = hit[score >= cut - 1e-9 * max(1.0, abs(cut))]
                score = np.einsum("ij,j->i", self.x[hit], q[i])  # rounds alike for equal rows
                best = np.lexsort((self.ids[hit], -score))[:k]
                out.append((self.ids[hit][best], score[best]))
        return out


def _matrix(t: pa.Table, col: str) -> np.ndarray:
    values = t.column(col).combine_chunks()
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(t.num_rows, -1)


def nearest(df: DataFrame, is_query: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found for each row for which is_query holds."""
    spark = df.sparkSession
    for_workers(spark)
    v = F.col(vector).cast("array<double>")
    usable = F.col("k").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = df.select(F.col(key).cast("long").alias("k"), v.alias("v"), is_query.alias("q")).where(usable).withColumn("dim", F.size("v"))
    counted = rows.agg(F.count("*").alias("n"), F.count_if("q").alias("q")).first()
    blocks, parts = max(1, -(-counted["n"] // BLOCK)), max(1, -(-counted["q"] // QUERY_BLOCK))
    # a row's number deals equal rows over all blocks, too
    data = rows.select("k", "v", "dim", F.pmod(F.xxhash64("k", F.monotonically_increasing_id()), F.lit(blocks)).alias("b"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p"))
    ask = rows.where("q").select("k", "v", "dim").dropDuplicates(["k", "v"]).select("k", "v", "dim", F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("b"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            block = Block(left.column("k").to_numpy(), _matrix(left, "v"))
            asked = right.column("k").to_numpy()
            for own, (ids, score) in zip(asked, block.search(asked, _matrix(right, "v"), k), strict=True):
                out[0].append(np.full(len(ids), own))
                out[1].append(ids)
                out[2].append(score)
        cols = [np.concatenate(c) if c else np.array([]) for c in out]
        return pa.table({"query_id": pa.array(cols[0].astype(np.int64)), "vec_id": pa.array(cols[1].astype(np.int64)), "score": pa.array(cols[2].astype(np.float64))})

    keys = ["dim", "p", "b"]
    found = data.groupBy(*keys).cogroup(ask.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
