"""Tile codes, notation and predicates as column expressions.

Tiles are ints: 0-8 man, 9-17 pin, 18-26 sou, 27-30 winds, 31-33 dragons, 34-41 flowers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUITS = "mpszf"


def tile_code(t: Column) -> Column:
    """``5m`` and so on; null outside 0..41."""
    def code(letter: str, base: int) -> Column:
        return F.concat((t - base + 1).cast("string"), F.lit(letter))

    return F.when(t.between(0, 8), code("m", 0)).when(t.between(9, 17), code("p", 9)).when(t.between(18, 26), code("s", 18)).when(t.between(27, 33), code("z", 27)).when(t.between(34, 41), code("f", 34))


def parse_tiles(text: Column) -> Column:
    """Tiles of a notation like ``123m55z``; null unless the whole text, without white space, is such groups."""
    clean = F.regexp_replace(text, r"\s+", "")
    good = clean.rlike(r"^([1-9]+[mps]|[1-7]+z|[1-8]+f)*$")
    parts = F.regexp_extract_all(clean, F.lit(r"([1-9]+[mpszf])"), 1)
    base = F.create_map(*[x for c, b in zip(SUITS, (0, 9, 18, 27, 34), strict=True) for x in (F.lit(c), F.lit(b))])
    tiles = F.flatten(F.transform(parts, lambda p: F.transform(F.filter(F.split(F.substring(p, F.lit(1), F.length(p) - 1), ""), lambda d: d != ""), lambda d: d.cast("int") - 1 + F.element_at(base, F.substring(p, F.length(p), F.lit(1))))))
    return F.when(good, tiles)


def is_honor(t: Column) -> Column:
    return (t >= 27) & (t < 34)


def is_terminal(t: Column) -> Column:
    return (t < 27) & (t % 9).isin(0, 8)


def count_of(tiles: Column, t: Column | int) -> Column:
    return F.size(F.filter(tiles, lambda x: x == t))


def tile_counts(tiles: Column) -> Column:
    """How often each of the 34 ordinary tiles occurs."""
    return F.transform(F.sequence(F.lit(0), F.lit(33)), lambda t: F.size(F.filter(tiles, lambda x: x == t)))


def is_thirteen_orphans(tiles: Column) -> Column:
    """14 tiles, all terminals or honors, all 13 kinds."""
    return (F.size(tiles) == 14) & F.forall(tiles, lambda t: (t >= 0) & (t < 34) & (is_honor(t) | is_terminal(t))) & (F.size(F.array_distinct(tiles)) == 13)


def seat_wind(winner: Column, dealer: Column) -> Column:
    return F.pmod(winner - dealer + 4, F.lit(4))


def dim_tile(spark: SparkSession) -> DataFrame:
    """The 42 tiles: tile, code, suit, rank, is_honor, is_terminal."""
    t = F.col("tile")
    return spark.range(42).select(F.col("id").cast("int").alias("tile")).select("tile", tile_code(t).alias("code"), F.substring(tile_code(t), 2, 1).alias("suit"), F.substring(tile_code(t), 1, 1).cast("int").alias("rank"), is_honor(t).alias("is_honor"), is_terminal(t).alias("is_terminal"))
