"""Perceptual fingerprints of grids, and joins of fingerprints that differ in few bits."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.arrays import once
from lumora.operators.shared import cut

#: Keys of one fingerprint in an index, at most.
MOST_KEYS = 256
#: What a candidate costs, in keys; keys that a task makes and candidates that a task compares, some; rows of a key beyond which it is dealt to several tasks.
CANDIDATE_COST, TASK_KEYS, TASK_CANDIDATES, HOT_ROWS = 0.2, 200_000, 2_000_000, 2_000


def bits_hex(bits: Column) -> Column:
    """64 booleans as 16 hexadecimal digits, the first one the highest bit."""
    nibble = lambda b, n: sum((F.when(F.get(b, n * 4 + k), 8 >> k).otherwise(0) for k in range(4)), F.lit(0))
    return once(bits, lambda b: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda n: F.lower(F.hex(nibble(b, n).cast("bigint")))), ""))


def dhash(grid: Column) -> Column:
    """The difference hash of 8 rows of 9 brightnesses, row by row: which of two neighbours in a row is the brighter one."""
    at = lambda i: i + F.floor(i / 8).cast("int")
    return bits_hex(once(grid, lambda g: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.get(g, at(i)) > F.get(g, at(i) + 1))))


def hash_bits(digits: Column) -> Column:
    """16 hexadecimal digits as the 64 bits of a long."""
    half = lambda at: F.conv(F.substring(digits, at, 8), 16, 10).cast("bigint")
    return F.shiftleft(half(1), 32).bitwiseOR(half(9))


def _cosines() -> np.ndarray:
    x = np.arange(32)
    out = np.cos(np.pi * (2 * x[None, :] + 1) * x[:8, None] / 64)
    out[0] /= np.sqrt(2)
    return out


def add_phash(rows: DataFrame, grid_col: str, out_col: str = "phash") -> DataFrame:
    """The rows with the perceptual hash (16 hexadecimal digits) of ``grid_col``, 32 x 32 brightnesses row by row: which of the 8 x 8 lowest
    frequencies of the cosine transform exceed the median of the 63 other than the first. A grid that is null, of another length or
    holds a null has none. The transform is separable and done for a batch at once: 8 x 32 x 32, then 8 x 8 x 32 products a grid."""
    if out_col in rows.columns:
        raise ValueError(f"there is a column {out_col}")
    at = rows.columns.index(grid_col)
    fine = (F.size(grid_col) == 1024) & ~F.exists(grid_col, lambda x: x.isNull())
    given = rows.withColumn(grid_col, F.when(fine, F.col(grid_col).cast("array<double>")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cosine = _cosines()
        for b in batches:
            col = b.column(at)
            known = np.flatnonzero(np.asarray(col.is_valid()))
            grids = np.asarray(col.drop_null().flatten()).reshape(-1, 32, 32)
            low = (cosine @ grids @ cosine.T).reshape(-1, 64)
            bits = np.packbits(low > np.median(low[:, 1:], axis=1, keepdims=True), axis=1) if len(low) else low
            out = [None] * len(b)
            for i, x in zip(known.tolist(), bits, strict=True):
                out[i] = x.tobytes().hex()
            yield pa.record_batch([*b.columns, pa.array(out, pa.string())], names=[*b.schema.names, out_col])

    return given.mapInArrow(run, given.withColumn(out_col, F.lit(None).cast("string")).schema)


def blocks_kept(n: int, distance: int, width: int) -> int:
    """How many equal blocks of bits a key of the index holds: the number with which keys and candidates of ``n`` random fingerprints cost
    least, as long as a fingerprint has no more than ``MOST_KEYS`` keys."""
    may = [k for k in range(1, width - distance + 1) if k == 1 or comb(distance + k, k) <= MOST_KEYS]
    return min(may, key=lambda k: comb(distance + k, k) * (1 + CANDIDATE_COST * n / 2 ** (width * k // (distance + k))))


def near_pairs(rows: DataFrame, *, bits_col: str, id_col: str, distance: int, width: int = 64, n: int | None = None, kept: int | None = None) -> DataFrame:
    """Pairs of rows, as structs ``a`` and ``b`` (a's id the smaller one) whose bits differ in at most ``distance`` places: each pair once.

    The bits that vary are cut into ``distance + kept`` blocks. Of two such rows at least ``kept`` blocks are equal, so a join on every
    combination of ``kept`` blocks finds them; it is taken from the first combination of equal blocks alone, so nothing is
    made distinct. Keys of several blocks keep buckets small when ``n`` (the number of rows, counted if not given) grows.
    The join is shuffled, since a small table of rows makes many candidates, into as many tasks as these ask for: they grow faster
    than the bytes by which Spark would cut it. A key of over ``HOT_ROWS`` rows is dealt to several tasks. Reads the rows and
    counts the keys when called.
    """
    if not 0 <= distance < width:
        raise ValueError("the distance must be less than the number of bits")
    seen = rows.agg(F.count("*").alias("n"), F.coalesce(F.expr(f"bit_or({bits_col})").bitwiseXOR(F.expr(f"bit_and({bits_col})")), F.lit(0)).alias("vary")).first()
    n = seen["n"] if n is None else n
    # bits that are the same in all rows would make blocks that tell nothing apart: they come last, and only where the others don't suffice
    places = [p for p in range(64) if seen["vary"] >> p & 1]
    kept = blocks_kept(n, distance, max(len(places), distance + 1)) if kept is None else kept
    blocks = distance + kept
    places += [p for p in range(64) if not seen["vary"] >> p & 1][: max(0, blocks - len(places))]
    ends = [len(places) * i // blocks for i in range(blocks + 1)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    mask_of = [sum(1 << p for p in places[b:e]) for b, e in zip(ends, ends[1:], strict=False)]
    choices = list(combinations(range(blocks), kept))
    # A pair is taken from its first choice: of the blocks that a choice leaves out before its last one, none may be equal. They are
    # plain columns, 0 where there are fewer: one expression over all blocks would make a join that the JVM doesn't compile.
    out = [f"out{i}" for i in range(distance)]
    left = lambda c: ([signed(mask_of[i]) for i in range(c[-1]) if i not in c] + [0] * distance)[:distance]
    keys = F.array(*[
        F.struct(F.lit(at).alias("choice"), *[F.lit(m).cast("bigint").alias(o) for o, m in zip(out, left(c), strict=True)], F.col(bits_col).bitwiseAND(F.lit(signed(sum(mask_of[i] for i in c)))).alias("key"))
        for at, c in enumerate(choices)
    ])
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, n * len(choices) // TASK_KEYS)
    index = rows.where(F.col(bits_col).isNotNull()).repartition(parts).select(F.struct(*rows.columns).alias("r"), F.explode(keys).alias("k")).select("r", "k.*")
    pairs = F.sum(F.col("count").cast("double") * F.col("count")).alias("pairs")
    sizes = cut(index.groupBy("choice", "key").count().groupBy(F.when(F.col("count") > HOT_ROWS, F.struct("choice", "key")).alias("k"), F.when(F.col("count") > HOT_ROWS, F.ceil(F.col("count") / HOT_ROWS).cast("int")).alias("shares")).agg(pairs), "sizes")
    tasks = max(parts, int((sizes.agg(F.sum("pairs")).first()[0] or 0) / TASK_CANDIDATES))
    hot = sizes.where("k IS NOT NULL").select("k.*", "shares")
    dealt = index.join(F.broadcast(hot), ["choice", "key"], "left") if hot.head(1) else index.withColumn("shares", F.lit(1))
    dealt = dealt.withColumn("shares", F.coalesce("shares", F.lit(1)))
    a = dealt.select(F.col("r").alias("a"), "choice", *out, "key", F.pmod(F.xxhash64(f"r.{id_col}"), F.col("shares")).cast("int").alias("share"))
    b = dealt.select(F.col("r").alias("b"), "choice", "key", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    x = F.col(f"a.{bits_col}").bitwiseXOR(F.col(f"b.{bits_col}"))
    near = (F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & (F.bit_count(x) <= distance)
    for o in out:
        near = near & ((F.col(o) == 0) | (x.bitwiseAND(F.col(o)) != 0))
    by = ["choice", "key", "share"]
    return a.repartition(tasks, *by).join(b.repartition(tasks, *by).hint("merge"), by).where(near).select("a", "b")


def hamming_links(rows: DataFrame, *, id_col: str, bits_col: str, distance: int, width: int = 64) -> DataFrame:
    """Links (u < v) of ids whose fingerprints differ in at most ``distance`` bits: those between the smallest ids of different
    fingerprints, and each copy's to the smallest id of its own (distance 0). Counts the fingerprints when called."""
    one = cut(rows.where(F.col(bits_col).isNotNull()).groupBy(F.col(bits_col).alias("bits")).agg(F.min(id_col).alias("id")))
    same = rows.select(F.col(id_col).alias("v"), F.col(bits_col).alias("bits")).join(one, "bits").where("id != v").select(F.col("id").alias("u"), "v", F.lit(0).alias("distance"))
    near = near_pairs(one, bits_col="bits", id_col="id", distance=distance, width=width)
    return near.select(F.col("a.id").alias("u"), F.col("b.id").alias("v"), F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits"))).cast("int").alias("distance")).unionByName(same)


def near_links(rows: DataFrame, *, id_col: str, dhash_col: str, phash_col: str, width_col: str, height_col: str, rgb_col: str, dhash_distance: int = 4, phash_distance: int = 6, aspect: float = 0.05, mae: float = 12.0) -> DataFrame:
    """Near-duplicate links (u < v) and the first rule that gives each: 'dhash' as ``hamming_links`` gives them; 'phash_mae' for rows
    that fail it with pHashes of at most ``phash_distance`` bits apart, aspects of at most ``aspect`` apart (the later id's over the
    earlier one's) and a mean absolute difference of the RGB arrays of at most ``mae``; a null in one of them fails it.

    Rows that agree in all four are one class, its smallest id stands for it: links of the second rule are between classes, and
    from a class to its copies where the first rule, lacking a dHash, doesn't link them. A link of two classes stands if any two
    of their rows, in the order of their ids, meet the rule. Counts fingerprints when called."""
    first = hamming_links(rows, id_col=id_col, bits_col=dhash_col, distance=dhash_distance).select("u", "v", F.lit("dhash").alias("reason"))
    full = rows.select(F.col(id_col).alias("id"), F.col(dhash_col).alias("dh"), F.col(phash_col).alias("ph"), (F.col(width_col) / F.col(height_col)).alias("ratio"), F.col(rgb_col).cast("array<double>").alias("rgb"))
    full = full.where("ph IS NOT NULL AND ratio IS NOT NULL AND size(rgb) > 0").where(~F.exists("rgb", lambda x: x.isNull())).withColumn("colour", F.xxhash64("rgb"))
    by = ["dh", "ph", "ratio", "colour"]
    classes = cut(full.groupBy(*by, "rgb").agg(F.min("id").alias("lo"), F.max("id").alias("hi")))
    copies = full.where("dh IS NULL").alias("r").join(classes.where("dh IS NULL").alias("c"), [F.col(f"r.{k}") == F.col(f"c.{k}") for k in ("ph", "ratio", "rgb")]).where("r.id != c.lo").select(F.col("c.lo").alias("u"), F.col("r.id").alias("v"))
    near = near_pairs(classes.select("lo", "hi", "dh", "ph", "ratio"), bits_col="ph", id_col="lo", distance=phash_distance)
    close = lambda early, late: (F.col(f"{early}.lo") < F.col(f"{late}.hi")) & (F.abs(F.col(f"{late}.ratio") / F.col(f"{early}.ratio") - 1) <= aspect)
    unlike = F.coalesce(F.bit_count(F.col("a.dh").bitwiseXOR(F.col("b.dh"))) > dhash_distance, F.lit(True))
    near = cut(near.where(unlike & (close("a", "b") | close("b", "a"))).select(F.col("a.lo").alias("u"), F.col("b.lo").alias("v")))
    colours = classes.select("lo", "rgb")
    both = near.join(colours.select(F.col("lo").alias("u"), F.col("rgb").alias("_p")), "u").join(colours.select(F.col("lo").alias("v"), F.col("rgb").alias("_q")), "v")
    apart = F.aggregate(F.zip_with("_p", "_q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)
    second = both.where((F.size("_p") == F.size("_q")) & (apart / F.size("_p") <= mae)).select("u", "v").unionByName(copies)
    return first.unionByName(second.withColumn("reason", F.lit("phash_mae")))
