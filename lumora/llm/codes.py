"""Codes of vectors by product quantisation, whose codebooks come from Lloyd rounds that filter entries through kd-trees.

Vectors become integers (``floor(scale * x)``) and are cut into equal parts. Each task builds, for chunks of its rows and for
each part position, a balanced kd-tree over the parts, whose nodes hold the bounding box and the sum of their parts (their
number follows from their place). The trees are written once; each round walks them from the root with all entries of the codebook as
candidates. In a box, an entry goes if another one is nearer at the corner of the box that favours it most; where one entry
is left, the sum and count of the whole subtree are added to it at once; only in leaves with several entries left are parts
compared with them. Sums and counts are added up by Spark; the driver gets one row per part position, entry and component.
All arithmetic is on integers, so results don't depend on how rows are dealt out.

Rows whose vector is null, empty or holds null or non-finite components are dropped, and so are those that can't be coded: a
length that isn't a multiple of the number of parts or differs from that of the smallest id's vector, or a component so large
that the squared distances of vectors wouldn't fit a long. Of rows that share one of the smallest ids the least vector is the
entry; a null id is never an entry, but is coded. Fewer ids than entries give a shorter codebook. Equally near entries: the
lower index. Rows that repeat are coded and counted each. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import BROADCAST_IDS, batch_rows, cut, release_after

#: Vectors of one chunk, for which a task builds its trees; a chunk is one row of some 6 MB for 64 components.
CHUNK = 1 << 14
LEAF = 24
#: Entries that a leaf has left are compared in groups of leaves with at most so many.
_GROUPS = (2, 4, 8, 16, 32, 64, 1 << 30)
_CODE_SALTS = 16


def _bounds(n: int, level: int) -> np.ndarray:
    """Where the nodes of a level begin, and the end: a complete binary tree over n rows."""
    return (np.arange((1 << level) + 1, dtype=np.int64) * n) >> level


def _depth(n: int) -> int:
    return max(0, math.ceil(math.log2(n / LEAF))) if n > LEAF else 0


class Tree:
    """A kd-tree over integer points: ``order`` of the rows, ``points`` in that order, boxes and sums of nodes level by level."""

    def __init__(self, order: np.ndarray, points: np.ndarray, low: np.ndarray, high: np.ndarray, sums: np.ndarray) -> None:
        self.order, self.points, self.low, self.high, self.sums = order, points, low, high, sums

    @classmethod
    def build(cls, points: np.ndarray) -> Tree:
        n, order, levels = len(points), np.arange(len(points)), []
        for level in range(_depth(n) + 1):
            at = _bounds(n, level)
            sorted_points = points[order]
            low, high = np.minimum.reduceat(sorted_points, at[:-1]), np.maximum.reduceat(sorted_points, at[:-1])
            levels.append((low, high, np.add.reduceat(sorted_points, at[:-1])))
            if level < _depth(n):
                node = np.repeat(np.arange(1 << level), np.diff(at))
                widest = np.argmax(high - low, axis=1)
                order = order[np.lexsort((sorted_points[np.arange(n), widest[node]], node))]
        return cls(order, points[order], *(np.concatenate(x) for x in zip(*levels, strict=True)))

    def pack(self) -> list[bytes]:
        return [self.order.astype(np.int32).tobytes(), *(x.astype(np.int32).tobytes() for x in (self.points, self.low, self.high)), self.sums.tobytes()]

    @classmethod
    def unpack(cls, packed: list[bytes], width: int) -> Tree:
        order, *boxes = (np.frombuffer(x, np.int32).astype(np.int64) for x in packed[:4])
        return cls(order, *(x.reshape(-1, width) for x in boxes), np.frombuffer(packed[4], np.int64).reshape(-1, width))

    def filter(self, book: np.ndarray, *, assign: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """Count and sum of the points nearest to each entry of ``book``, and with ``assign`` each row's entry."""
        n, k, width = len(self.points), *book.shape
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width), np.int64)
        nearest = np.zeros(n, np.int64) if assign else None
        nodes, left = np.zeros(1, np.int64), np.ones((1, k), bool)
        for level in range(_depth(n) + 1):
            at, base = _bounds(n, level), (1 << level) - 1
            low, high = self.low[base + nodes], self.high[base + nodes]
            twice = ((2 * book - (low + high)[:, None]) ** 2).sum(-1)
            twice[~left] = np.iinfo(np.int64).max
            best = twice.argmin(1)
            corner = np.where(book > book[best][:, None], high[:, None], low[:, None])
            gain = ((book - corner) ** 2).sum(-1) - ((book[best][:, None] - corner) ** 2).sum(-1)
            entry = np.arange(k)
            left &= (gain < 0) | ((gain == 0) & (entry <= best[:, None]))
            one = left.sum(1) == 1
            whole, entry = nodes[one], left[one].argmax(1)
            np.add.at(counts, entry, at[whole + 1] - at[whole])
            np.add.at(sums, entry, self.sums[base + whole])
            if assign:
                rows = _ranges(at[whole], at[whole + 1])
                nearest[rows] = np.repeat(entry, at[whole + 1] - at[whole])
            nodes, left = nodes[~one], left[~one]
            if not len(nodes):
                break
            if level == _depth(n):
                self._leaves(book, nodes, left, at, counts, sums, nearest)
            else:
                nodes, left = np.stack([2 * nodes, 2 * nodes + 1], 1).ravel(), np.repeat(left, 2, axis=0)
        if not assign:
            return counts, sums, None
        out = np.empty(n, np.int64)
        out[self.order] = nearest
        return counts, sums, out

    def _leaves(self, book: np.ndarray, nodes: np.ndarray, left: np.ndarray, at: np.ndarray, counts: np.ndarray, sums: np.ndarray, nearest: np.ndarray | None) -> None:
        many, below = left.sum(1), 0
        for most in _GROUPS:
            some = (many > below) & (many <= most)
            below = most
            if not some.any():
                continue
            held, mine = left[some], nodes[some]
            first = np.argsort(~held, axis=1, kind="stable")[:, : held.sum(1).max()]
            first = np.where(np.take_along_axis(held, first, 1), first, first[:, :1])
            sizes = at[mine + 1] - at[mine]
            rows = _ranges(at[mine], at[mine + 1])
            entries, points = np.repeat(first, sizes, axis=0), self.points[rows]
            pick = np.take_along_axis(entries, ((points[:, None] - book[entries]) ** 2).sum(-1).argmin(1)[:, None], 1)[:, 0]
            counts += np.bincount(pick, minlength=len(book))
            np.add.at(sums, pick, points)
            if nearest is not None:
                nearest[rows] = pick


def _ranges(begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    sizes = end - begin
    return np.arange(sizes.sum()) + np.repeat(begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) if len(begin) else np.empty(0, np.int64)


def _kept(vector: Column, parts: int, scale: int) -> Column:
    """Whether a vector of doubles can be coded, its length aside."""
    most = F.sqrt(F.lit(float(1 << 62)) / F.greatest(F.size(vector), F.lit(1))) / (2 * scale)
    return vector.isNotNull() & (F.size(vector) > 0) & (F.size(vector) % parts == 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most))


def _forest(rows: DataFrame, parts: int, width: int, chunk: int) -> DataFrame:
    """A row per chunk: ids, labels and the packed trees of each part position. ``rows``: id, label, v (longs)."""
    schema = rows.limit(0).toArrow().schema
    kinds = [schema.field(c).type for c in ("id", "label")]
    out = pa.schema([("ids", pa.list_(kinds[0])), ("labels", pa.list_(kinds[1])), ("trees", pa.list_(pa.binary()))])

    def packed(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        points = t["v"].combine_chunks().flatten().to_numpy().reshape(len(t), parts, width)
        trees = [x for p in range(parts) for x in Tree.build(points[:, p]).pack()]
        whole = [pa.ListArray.from_arrays(pa.array([0, len(t)], pa.int32()), t[c].combine_chunks().cast(kind)) for c, kind in zip(("id", "label"), kinds, strict=True)]
        return pa.record_batch([*whole, pa.array([trees], pa.list_(pa.binary()))], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while n + len(b) >= chunk:
                held.append(b.slice(0, chunk - n))
                b = b.slice(chunk - n)
                yield packed(held)
                held, n = [], 0
            if len(b):
                held.append(b)
                n += len(b)
        if held:
            yield packed(held)

    names = {c: rows.schema[c].dataType.simpleString() for c in ("id", "label")}
    return rows.mapInArrow(release_after(run), f"ids array<{names['id']}>, labels array<{names['label']}>, trees array<binary>")


def _trees(batches: Iterator[pa.RecordBatch], parts: int, width: int) -> Iterator[tuple[pa.RecordBatch, int, list[Tree]]]:
    for b in batches:
        for i in range(len(b)):
            packed = b.column("trees")[i].as_py()
            yield b, i, [Tree.unpack(packed[5 * p : 5 * p + 5], width) for p in range(parts)]


def _round(forest: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: each entry the floor of the mean of its parts; unused ones as they were."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, k, width + 1), np.int64)
        for _, _, trees in _trees(batches, parts, width):
            for p, tree in enumerate(trees):
                counts, sums, _ = tree.filter(books[p], assign=False)
                total[p] += np.concatenate([sums, counts[:, None]], 1)
        at = np.flatnonzero(total.any(-1).ravel().repeat(width + 1))
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array(total.ravel()[at], pa.int64())], names=["at", "v"])

    got = forest.mapInArrow(release_after(run), "at bigint, v bigint").groupBy("at").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v")).collect()
    total = np.zeros(parts * k * (width + 1), object)
    for r in got:
        total[r["at"]] = int(r["v"])
    out = books.copy()
    for p, e, c in zip(*np.nonzero(total.reshape(parts, k, -1)[:, :, -1:]), strict=True):
        s = total.reshape(parts, k, -1)[p, e]
        out[p, e] = [x // s[-1] for x in s[:-1]]
    return out


def _coded(forest: DataFrame, books: np.ndarray) -> DataFrame:
    """id, label, code and error of every vector."""
    parts, _, width = books.shape
    kinds = [forest.schema[c].dataType.elementType.simpleString() for c in ("ids", "labels")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, i, trees in _trees(batches, parts, width):
            ids, labels = (b.column(c)[i].values for c in ("ids", "labels"))
            codes, error = np.empty((len(ids), parts), np.uint8), np.zeros(len(ids), np.int64)
            for p, tree in enumerate(trees):
                nearest = tree.filter(books[p], assign=True)[2]
                codes[:, p] = nearest
                error[tree.order] += ((tree.points - books[p][nearest[tree.order]]) ** 2).sum(1)
            text = codes.tobytes().hex()
            yield pa.record_batch([ids, labels, pa.array([text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]), pa.array(error)], names=["id", "label", "code", "error"])

    return forest.mapInArrow(release_after(run), f"id {kinds[0]}, label {kinds[1]}, code string, error bigint")


def compress(rows: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, chunk: int = CHUNK) -> tuple[DataFrame, np.ndarray]:
    """(id, label, code, error) of every vector that can be coded, and the codebooks [part, entry, component].

    ``entries`` at most 256: an index is two hexadecimal digits of the code. Runs its jobs when called.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    given = rows.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    ints = given.where(_kept(F.col("v"), parts, scale)).withColumn("v", F.transform("v", lambda x: F.floor(x * scale)))
    first = ints.where("id is not null").select("id", F.size("v").alias("n"), "v").groupBy("id").agg(F.min(F.struct("n", "v")).alias("n")).select("id", "n.n")
    smallest = first.orderBy("id").limit(1).collect()
    size = smallest[0]["n"] if smallest else 0
    ints = ints.where(F.size("v") == size)
    ids = ints.where("id is not null").select("id").distinct().orderBy("id").limit(entries)
    seeds = ints.join(F.broadcast(ids), "id", "left_semi").groupBy("id").agg(F.min("v").alias("v")).orderBy("id").collect()
    books = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), parts, -1).transpose(1, 0, 2) if seeds else np.zeros((parts, 0, 1), np.int64)
    with batch_rows(rows.sparkSession, 4096):
        forest = cut(_forest(ints, parts, max(1, size // parts), chunk), "trees")
    with batch_rows(rows.sparkSession, 8):  # a row is a chunk
        for _ in range(rounds if seeds else 0):
            books = _round(forest, books)
        coded = cut(_coded(forest, books), "codes")
    return coded, books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over equal labels, nulls together."""
    sums = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "label-errors")
    same = F.col("label").eqNullSafe(F.col("of"))
    if sums.count() <= BROADCAST_IDS:
        return coded.join(F.broadcast(sums), same).drop("of")
    salted = sums.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_CODE_SALTS - 1))))
    return coded.withColumn("_salt", F.pmod(F.xxhash64("id", "code"), F.lit(_CODE_SALTS))).join(salted, same & (F.col("_salt") == F.col("salt"))).drop("of", "salt", "_salt")


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and position, in decimal, with commas between."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def oracle(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """DuckDB SQL of ``op12_codes`` for vectors of one length: every part is compared with every entry."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""
near{r} AS MATERIALIZED (
  SELECT vec_id, label, p, v, min({{'d': d, 'e': e}}) AS best FROM (
    SELECT s.vec_id, s.label, s.p, s.v, b.e, CAST(list_sum(list_transform(range(1, len(s.v) + 1), lambda j: (s.v[j] - b.c[j]) * (s.v[j] - b.c[j]))) AS BIGINT) AS d
    FROM slices s JOIN book{r} b ON b.p = s.p) GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""
sums{r} AS (SELECT p, best.e AS e, j, CAST(floor(CAST(sum(v[j]) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM (SELECT p, best, v, unnest(range(1, len(v) + 1)) AS j FROM near{r}) GROUP BY ALL),
means{r} AS (SELECT p, e, list(x ORDER BY j) AS c FROM sums{r} GROUP BY ALL),
book{r + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
slices AS MATERIALIZED (SELECT vec_id, label, p, v[p * (len(v) // {parts}) + 1 : (p + 1) * (len(v) // {parts})] AS v FROM (SELECT *, unnest(range({parts})) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM slices QUALIFY e < {entries}),{','.join(steps)},
coded AS (SELECT vec_id, label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM near{rounds} GROUP BY ALL),
hashed AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS h FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, hashed"""
