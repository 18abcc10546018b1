"""All ways to take a hand apart into a pair and groups, by lookups of suits.

Suits don't mix in a group, so each suit's nine counts decompose on their own. All count vectors that do are
listed once (a bounded table of the game, some 60,000 rows); four equi-joins on the counts, read as digits of
base 5, and a filter on the numbers of pairs and groups give each decomposition once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.arrays import once
from lumora.operators.shared import cut

PART = "key int, has_pair int, n_groups int, pair int, groups array<struct<kind:string,tile:int>>"


def _group_sets(ranks: int, chows: bool, most: int) -> Iterator[tuple[tuple[int, ...], list[tuple[str, int]]]]:
    """Counts and groups of every multiset of up to ``most`` groups in one suit, no count above 4."""
    kinds = [("pung", r, [3 if k == r else 0 for k in range(ranks)]) for r in range(ranks)]
    if chows:
        kinds += [("chow", r, [1 if r <= k < r + 3 else 0 for k in range(ranks)]) for r in range(ranks - 2)]

    def grow(at: int, counts: list[int], groups: list[tuple[str, int]]) -> Iterator:
        yield tuple(counts), list(groups)
        if len(groups) == most:
            return
        for j in range(at, len(kinds)):
            kind, r, add = kinds[j]
            new = [a + b for a, b in zip(counts, add, strict=True)]
            if max(new) <= 4:
                yield from grow(j, new, [*groups, (kind, r)])

    yield from grow(0, [0] * ranks, [])


@lru_cache(4)
def suit_parts(ranks: int, chows: bool, most: int = 5) -> list[tuple]:
    """Rows of PART with tiles counted from the suit's first."""
    out = []
    for counts, groups in _group_sets(ranks, chows, most):
        key = sum(c * 5**i for i, c in enumerate(counts))
        out.append((key, 0, len(groups), None, groups))
        out += [(key + 2 * 5**p, 1, len(groups), p, groups) for p in range(ranks) if counts[p] + 2 <= 4]
    return out


_FRAMES: dict[tuple, DataFrame] = {}


def _part_table(spark: SparkSession, honors: bool) -> DataFrame:
    key = (spark.sparkContext.applicationId, honors)
    if key not in _FRAMES:
        _FRAMES[key] = cut(spark.createDataFrame(suit_parts(7, False) if honors else suit_parts(9, True), PART).coalesce(1), "parts")
    return _FRAMES[key]


def _suit_keys(t: Column, most: int) -> Column:
    """The four suits' counts of sorted tiles as digits of base 5; null for over ``most`` tiles, for one that is none and for five of a kind."""
    power = F.array(*[F.lit(5**i) for i in range(9)])
    none = F.array(*[F.lit(0)] * 4)
    five = F.size(F.filter(F.slice(t, 5, most), lambda x, i: x == F.get(t, i))) > 0
    added = lambda a, x: F.transform(a, lambda k, s: k + F.when(F.floor(x / 9) == s, F.element_at(power, (x % 9 + 1).cast("int"))).otherwise(0))
    return F.when((F.size(t) <= most) & F.forall(t, lambda x: x.between(0, 33)) & ~five, F.aggregate(t, none, added))


def decompose(hands: DataFrame, *, id_col: str = "hand_id", tiles_col: str = "concealed", groups_col: str = "n_groups") -> DataFrame:
    """Every (pair, groups) of each hand: the id, pair, groups (kind, first tile) in tile order.

    Hands with a tile outside 0..33, more than four of a kind or a wrong number of tiles have none.
    """
    rows = hands.where(F.size(tiles_col) == F.col(groups_col).cast("int") * 3 + 2)
    rows = rows.select(F.col(id_col), F.col(groups_col).cast("int").alias("_g"), once(F.sort_array(tiles_col), lambda t: _suit_keys(t, 17)).alias("_keys"))

    def moved(groups: Column, suit: int) -> Column:
        return F.transform(groups, lambda g: F.struct(g["kind"].alias("kind"), (g["tile"] + 9 * suit).alias("tile")))

    # -1 is no key; of a key that may be null the optimizer would ask, once a suit and with all of its expression, whether it is
    rows = rows.select(id_col, "_g", *[F.coalesce(F.get("_keys", s), F.lit(-1)).alias(f"_k{s}") for s in range(4)])
    spark = hands.sparkSession
    for s in range(4):
        part = _part_table(spark, s == 3)
        shifted = part.select(F.col("key").alias(f"_k{s}"), F.col("has_pair").alias(f"_h{s}"), F.col("n_groups").alias(f"_n{s}"), (F.col("pair") + 9 * s).alias(f"_p{s}"), moved(F.col("groups"), s).alias(f"_q{s}"))
        rows = rows.join(F.broadcast(shifted), f"_k{s}")
    total = lambda c: sum((F.col(f"{c}{s}") for s in range(1, 4)), F.col(f"{c}0"))
    rows = rows.where((total("_h") == 1) & (total("_n") == F.col("_g")))
    by_tile = lambda a, b: F.when(a["tile"] != b["tile"], a["tile"] - b["tile"]).when(a["kind"] == b["kind"], 0).when(a["kind"] < b["kind"], -1).otherwise(1)
    return rows.select(id_col, F.coalesce(*[F.col(f"_p{s}") for s in range(4)]).alias("pair"), F.array_sort(F.concat(*[F.col(f"_q{s}") for s in range(4)]), by_tile).alias("groups"))


@lru_cache(2)
def short_parts(ranks: int, chows: bool) -> pa.Table:
    """Of every count vector of a suit: ``pairs`` if it is whole (0 or 1), and the tiles (from the suit's first) that make it whole if one
    is missing, with the pairs it then has. How many tiles there are tells the pairs, and with them the groups."""
    whole = {key: pair for key, pair, *_ in suit_parts(ranks, chows)}
    short: dict[int, list[int]] = {}
    pairs: dict[int, int] = {}
    for key, pair in whole.items():
        for r in range(ranks):
            if key // 5**r % 5:
                short.setdefault(key - 5**r, []).append(r)
                pairs[key - 5**r] = pair
    keys = sorted(whole.keys() | short.keys())
    return pa.table({"key": pa.array(keys, pa.int32()), "pairs": pa.array([whole.get(k) for k in keys], pa.int32()), "short": pa.array([sorted(short.get(k, [])) for k in keys], pa.list_(pa.int32())), "short_pairs": pa.array([pairs.get(k) for k in keys], pa.int32())})


def _short_table(spark: SparkSession, honors: bool) -> DataFrame:
    key = (spark.sparkContext.applicationId, honors, "short")
    if key not in _FRAMES:
        _FRAMES[key] = cut(spark.createDataFrame(short_parts(7, False) if honors else short_parts(9, True)).coalesce(1), "suits")
    return _FRAMES[key]


def waits(hands: DataFrame, *, id_col: str = "hand_id", tiles_col: str = "before", melds_col: str = "meld_tiles", groups_col: str = "n_groups") -> DataFrame:
    """Tiles that complete each hand of one tile too few: the id and wait. Four of a kind, melds counted, can't be waited for.

    Each of the four suits is looked up once in a table (bounded by the game) of count vectors that are whole or one tile short:
    a tile is waited for where its suit is short of it, the others are whole and there is one pair in all.
    """
    rows = hands.where(F.size(tiles_col) == F.col(groups_col).cast("int") * 3 + 1)
    rows = rows.select(F.col(id_col), F.concat(tiles_col, F.coalesce(F.col(melds_col), F.array().cast("array<int>"))).alias("_all"), once(F.sort_array(tiles_col), lambda t: _suit_keys(t, 16)).alias("_keys"))
    rows = rows.select(id_col, "_all", *[F.get("_keys", s).alias(f"_k{s}") for s in range(4)])
    for s in range(4):
        part = _short_table(hands.sparkSession, s == 3)
        rows = rows.join(F.broadcast(part.select(F.col("key").alias(f"_k{s}"), F.col("pairs").alias(f"_h{s}"), F.col("short").alias(f"_w{s}"), F.col("short_pairs").alias(f"_p{s}"))), f"_k{s}")

    def waited(s: int) -> Column:
        pairs = F.col(f"_p{s}")
        for o in range(4):
            pairs = pairs if o == s else pairs + F.col(f"_h{o}")
        return F.when(pairs == 1, F.transform(f"_w{s}", lambda r: r + 9 * s)).otherwise(F.array().cast("array<int>"))

    lists = [waited(s) for s in range(4)]
    rows = rows.select(id_col, "_all", F.explode(F.concat(*lists)).alias("wait"))
    return rows.where(F.size(F.filter("_all", lambda x: x == F.col("wait"))) < 4).select(id_col, "wait")
