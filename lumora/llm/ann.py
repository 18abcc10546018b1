"""Approximate nearest neighbours by collision counting on query-aware hashing.

Each of ``n_proj`` random projections of a block of vectors is kept as a sorted array. A query opens a window
around its own projection in each array; virtual rehashing widens the windows by a factor until enough
neighbours are certain. The first windows hold most of an array, so the vectors outside of them are counted, and then
those that a wider window takes in: both give the number of windows that a vector is in. A vector in the windows of at
least ``threshold`` of the projections is verified by its exact inner product. Vectors are
compared by inner product; one more coordinate makes that order the order of distances.

Vectors and queries are dealt to blocks by a hash of their id, and each pair of a query block and a vector
block is one task of bounded size; its best ``k`` are merged by query. A block's index is built once in a task, for up
to ``query_rows`` queries, and there are no more query blocks than that number or the cores ask for. Every vector is
indexed; nothing is capped: a window that reaches over the whole block verifies all of it.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no part,
as candidates or queries. A query never finds rows of its own id. Repeated rows are candidates of their own;
a repeated query is asked once. Ties go to the smaller id. With fewer than ``k`` candidates all are returned. An empty table, or
one without queries, gives an empty result. Only the two named columns are read; others may have any name.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUT = "query_id bigint, vec_id bigint, score double"


def valid_vectors(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Rows that take part: _id and _v (array<double>)."""
    v = F.col(vec_col)
    some = vectors.where(F.col(id_col).isNotNull() & v.isNotNull()).select(F.col(id_col).cast("bigint").alias("_id"), v.cast("array<double>").alias("_v"))
    fine = F.forall("_v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("_v", lambda x: x != 0)
    some = some.where(fine)
    size = some.groupBy(F.size("_v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return some.where(F.size("_v") == F.lit(size["d"] if size else 0))


class BlockIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, x: np.ndarray, norm: float, n_proj: int, seed: int) -> None:
        self.x, self.quick, self.norm = x, x.astype(np.float32), max(norm, float(np.sqrt((x * x).sum(1).max())))
        self.directions = np.random.default_rng(seed).standard_normal((n_proj, x.shape[1] + 1))
        extra = np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0.0))
        p = (x @ self.directions[:, :-1].T + extra[:, None] * self.directions[:, -1]).T
        self.order = np.argsort(p, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(p, self.order, axis=1)
        self.verified = 0  # vectors verified so far, over all queries

    def search(self, q: np.ndarray, k: int, own: np.ndarray, ids: np.ndarray, *, width: float, threshold: int, start: float, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and inner products of the best ``k``; ``own``: rows that are left out."""
        n, length = len(self.x), float(np.sqrt(q @ q))
        center = self.directions[:, :-1] @ q * (self.norm / length)
        outside = np.zeros(n, np.int16)  # windows that a vector is not in
        lo, hi = np.zeros(len(center), np.int64), np.full(len(center), n)
        done = np.zeros(n, bool)
        done[own] = True
        rows, dots = np.empty(0, np.int64), np.empty(0)
        q32 = q.astype(np.float32)  # candidates are first compared in single precision, with a wide margin
        want, radius, first = min(k, n - int(done.sum())), start * self.norm, True
        while want:
            half = width * radius / 2
            a = np.array([np.searchsorted(s, c - half, "left") for s, c in zip(self.sorted, center, strict=True)])
            b = np.array([np.searchsorted(s, c + half, "right") for s, c in zip(self.sorted, center, strict=True)])
            if first:  # what the first windows leave out
                parts = [o[:x] for o, x in zip(self.order, a, strict=True)] + [o[y:] for o, y in zip(self.order, b, strict=True)]
                outside += np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            else:  # what the wider ones take in
                parts = [o[x:y] for o, x, y in zip(self.order, a, lo, strict=True)] + [o[x:y] for o, x, y in zip(self.order, hi, b, strict=True)]
                outside -= np.bincount(np.concatenate(parts), minlength=n).astype(np.int16)
            lo, hi, first = a, b, False
            new = np.flatnonzero((outside <= len(center) - threshold) & ~done)
            if len(new):
                done[new] = True
                self.verified += len(new)
                rows, dots = np.concatenate([rows, new]), np.concatenate([dots, (self.quick[new] @ q32).astype(float)])
                if len(rows) > 8 * k:
                    rows, dots = self._near_best(rows, dots, 4 * k)
            # inner product of a vector at this distance from the scaled query
            near = (2 * self.norm**2 - radius**2) / 2 * (length / self.norm)
            if int((dots >= near).sum()) >= want or done.all():
                break
            radius *= factor
        dots = self.x[rows] @ q  # exactly, in double precision
        best = np.lexsort((ids[rows], -dots))[:k]
        return rows[best], dots[best]

    def _near_best(self, rows: np.ndarray, dots: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that are among the best ``n``, or too near the last of them to tell in single precision."""
        least = np.partition(dots, -n)[-n] - 1e-5 * self.norm * max(1.0, float(np.abs(dots).max()))
        some = dots >= least
        return rows[some], dots[some]


def _matrix(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = t["_id"].to_numpy()
    flat = t["_v"].combine_chunks()
    flat = (flat.flatten() if isinstance(flat, pa.ListArray) else pa.concat_arrays([c.flatten() for c in flat.chunks])).to_numpy()
    return ids, flat.reshape(len(ids), -1)


def search(vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 20, n_proj: int = 96, width: float = 3.6, threshold: float = 0.9, start: float = 0.7, factor: float = 1.05, block_rows: int = 65_536, query_rows: int = 4096, seed: int = 7) -> DataFrame:
    """The ``k`` nearest found of each query row: query_id, rank (from 1), vec_id, score."""
    rows = valid_vectors(vectors, id_col, vec_col)
    queries = rows.where(is_query)
    n, m, norm = rows.agg(F.count("*"), F.count(F.when(is_query, 1)), F.max(F.sqrt(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    n_blocks = max(1, math.ceil(n / block_rows))
    # blocks of queries: of at most query_rows, and of fewer while there are fewer tasks than twice the cores, but of at least 256
    wanted = math.ceil(2 * vectors.sparkSession.sparkContext.defaultParallelism / n_blocks)
    n_queries = max(1, math.ceil(m / query_rows), min(math.ceil(m / 256), wanted))
    least = max(1, round(threshold * n_proj))
    norm = float(norm or 1.0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left) or not len(right):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        ids, x = _matrix(left)
        q_ids, q = _matrix(right)
        index = BlockIndex(x, norm, n_proj, seed)
        order = np.argsort(ids, kind="stable")
        sorted_ids = ids[order]
        got: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for qi, v in zip(q_ids, q, strict=True):
            own = order[np.searchsorted(sorted_ids, qi, "left") : np.searchsorted(sorted_ids, qi, "right")]
            r, s = index.search(v, k, own, ids, width=width, threshold=least, start=start, factor=factor)
            got.append((np.full(len(r), qi), ids[r], s))
        cols = [np.concatenate(c) for c in zip(*got, strict=True)]
        return pa.table({"query_id": pa.array(cols[0], pa.int64()), "vec_id": pa.array(cols[1], pa.int64()), "score": pa.array(cols[2], pa.float64())})

    data = rows.withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(n_blocks)).cast("int")).withColumn("_qb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))))
    asked = queries.dropDuplicates(["_id"]).withColumn("_qb", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(n_queries)).cast("int")).withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    found = data.groupBy("_b", "_qb").cogroup(asked.groupBy("_b", "_qb")).applyInArrow(run, OUT)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
