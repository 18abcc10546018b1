"""Ordered computations on few large groups, done in ranges: running sums, places and exact percentiles; hashes of sorted ids as a stream."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.operators.shared import cut


def running_sums(rows: DataFrame, *, by: list[str], order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """The rows with the sum of each of ``sums`` over the rows of their group (``by``, null keys are one) up to and with their own, in an order.

    The rows are sorted in ranges of (group, order), which may cut a group anywhere, and written once. Each range is summed up on its
    own; the totals of a group's ranges, one row for each range it is in, are summed up in their order and added. So a group of
    any size is spread over as many tasks as it has ranges. ``order`` has to tell the rows of a group apart. A null adds nothing.
    """
    held = rows.withColumns({f"_x{i}": F.coalesce(c, F.lit(0)) for i, c in enumerate(sums.values())})
    keys = [F.col(b) for b in by]
    ranged = held.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    ranged = cut(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()), "ranges")  # a second sampling may choose other ranges
    inside = Window.partitionBy("_p", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, 0)
    names = [f"_s{i}" for i in range(len(sums))]
    totals = ranged.groupBy("_p", *by).agg(*[F.sum(f"_x{i}").alias(n) for i, n in enumerate(names)])
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("_p").alias("_q"), *[F.col(b).alias(f"_k{i}") for i, b in enumerate(by)], *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names])
    same = F.col("_p") == F.col("_q")
    for i, b in enumerate(by):
        same = same & F.col(b).eqNullSafe(F.col(f"_k{i}"))
    out = ranged.withColumns({f"_y{i}": F.sum(f"_x{i}").over(inside) for i in range(len(sums))}).join(totals, same)
    return out.select(*rows.columns, *[(F.col(f"_y{i}") + F.col(f"_s{i}")).alias(name) for i, name in enumerate(sums)])


def percentiles(rows: DataFrame, *, by: str, value: str, shares: dict[str, float], splitters: int = 1000) -> DataFrame:
    """Exact percentiles of each group, with the linear interpolation of ``percentile``: by, n and a column for each of ``shares``. Null
    values don't count; a group without any has none.

    A distributed selection: splitters (approximate quantiles of each group, of bounded size) cut a group's values into ranges;
    the ranges are counted; the two values next to each place are looked up in the ranges that hold them alone, by their place
    there. A range has about a ``splitters``-th of a group's distinct values, so no task holds a group.
    """
    x = rows.select(F.col(by).alias("_k"), F.col(value).cast("double").alias("_x")).where(F.col("_x").isNotNull())
    # equal values are counted first, so a value that a third of the rows share is one row
    x = cut(x.groupBy("_k", "_x").agg(F.count("*").alias("_c")), "values")
    grid = F.array(*[F.lit(i / splitters) for i in range(1, splitters)])
    cuts = x.groupBy("_k").agg(F.percentile_approx("_x", grid, F.lit(10 * splitters)).alias("_at"), F.sum("_c").alias("n"))
    cuts = cut(cuts.select("_k", F.array_sort(F.array_distinct("_at")).alias("_at"), "n"), "splitters")
    at = F.col("_at")
    bucket = F.aggregate(F.sequence(F.lit(0), F.lit(max(1, splitters.bit_length()))), F.struct(F.lit(0).alias("lo"), F.size(at).alias("hi")), lambda s, _: F.when(s["lo"] >= s["hi"], s).when(F.get(at, F.floor((s["lo"] + s["hi"]) / 2).cast("int")) < F.col("_x"), F.struct((F.floor((s["lo"] + s["hi"]) / 2).cast("int") + 1).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), F.floor((s["lo"] + s["hi"]) / 2).cast("int").alias("hi"))), lambda s: s["lo"])
    few = F.broadcast if cuts.count() <= 10_000 else (lambda df: df)
    dealt = x.join(few(cuts.select(F.col("_k").alias("_j"), "_at")), F.col("_k").eqNullSafe(F.col("_j"))).select("_k", "_x", "_c", bucket.alias("_b"))
    dealt = cut(dealt, "ranges")
    sizes = dealt.groupBy("_k", "_b").agg(F.sum("_c").alias("_n"))
    ranges = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    places = cuts.select(F.col("_k").alias("_j"), "n", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(s)).alias("share")) for name, s in shares.items()])).alias("_s"))
    exact = F.col("_s.share") * (F.col("n") - 1)
    places = places.select("_j", "n", "_s.name", exact.alias("exact"), F.explode(F.array(F.floor(exact), F.ceil(exact))).alias("place")).distinct()
    held = ranges.join(places, F.col("_k").eqNullSafe(F.col("_j")) & (F.col("place") >= F.col("_before")) & (F.col("place") < F.col("_before") + F.col("_n"))).select("_j", F.col("_b").alias("_r"), "_before", "n", "name", "exact", "place")
    wanted = held.select(F.col("_j").alias("_i"), F.col("_r").alias("_o"), F.col("_before").alias("_first")).distinct()
    inside = dealt.join(wanted, F.col("_k").eqNullSafe(F.col("_i")) & (F.col("_b") == F.col("_o")))
    upto = F.sum("_c").over(Window.partitionBy("_k", "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_first")
    inside = inside.select("_k", "_b", "_x", (upto - F.col("_c")).alias("_from"), upto.alias("_to"))
    found = held.join(inside, F.col("_j").eqNullSafe(F.col("_k")) & (F.col("_r") == F.col("_b")) & (F.col("place") >= F.col("_from")) & (F.col("place") < F.col("_to")))
    part = F.col("exact") - F.floor("exact")
    both = found.groupBy(F.col("_j").alias("_k"), "n", "name").agg(F.min("_x").alias("lo"), F.max("_x").alias("hi"), F.first(part).alias("part"))
    one = both.withColumn("v", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part"))
    return one.groupBy(F.col("_k").alias(by), "n").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in shares])


def group_hashes(rows: DataFrame, *, by: str, id_col: str, start: str = "", between: str = "") -> DataFrame:
    """The SHA-256 of ``start`` and each group's ids as sorted texts with ``between`` between them, and its number of rows: by,
    digest (64 hexadecimal digits), size. Null ids are rows without a text; null keys are one group.

    A hash of one text is one sequence, so a group's ids pass through one task. Spark sorts them, on disk if need be, and the
    task holds an Arrow batch of them and the hash, however large the group is."""
    ids = rows.select(F.col(by), F.col(id_col).cast("string").alias("_id")).repartition(by).sortWithinPartitions(by, "_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, h, size, begun, of = None, None, 0, False, pa.null()
        for b in batches:
            texts, at, done, of = b.column(1).to_pylist(), 0, [], b.schema.field(0).type
            for k, same in groupby(b.column(0).to_pylist()):
                if h is None or k != key:
                    if h is not None:
                        done.append((key, h.hexdigest(), size))
                    key, h, size, begun = k, hashlib.sha256(start.encode()), 0, False
                n = sum(1 for _ in same)
                more = [x for x in texts[at : at + n] if x is not None]
                if more:
                    h.update(((between if begun else "") + between.join(more)).encode())
                at, size, begun = at + n, size + n, begun or bool(more)
            if done:
                yield _columns(done, of)
        if h is not None:
            yield _columns([(key, h.hexdigest(), size)], of)

    def _columns(done: list[tuple], of: pa.DataType) -> pa.RecordBatch:
        keys, digests, sizes = zip(*done, strict=True)
        return pa.record_batch([pa.array(keys, of), pa.array(digests, pa.string()), pa.array(sizes, pa.int64())], names=[by, "digest", "size"])

    return ids.mapInArrow(run, ids.select(by, F.lit("").alias("digest"), F.lit(0).cast("bigint").alias("size")).schema)
