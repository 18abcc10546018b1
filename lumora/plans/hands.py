"""Queries on hands: notation, decomposition, scoring, settlement and history."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.tiles import dim_tile, is_thirteen_orphans, parse_tiles, tile_code, tile_counts
from lumora.operators.decompose import decompose, waits
from lumora.operators.history import balances_by_rules, delete_and_undo, parse_history, rule_key
from lumora.operators.scoring import LIMITS, hand_violations, rule_violations, score_hands
from lumora.operators.settlement import explode_transfers, settle
from lumora.plans.base import WIN, derive, derive_sql, register, table

QUERIES: dict = {}

_SETTLE_SQL = f"""
h AS ({derive_sql('orders', WIN)}),
g AS (SELECT *, CASE score WHEN 3 THEN 32 WHEN 4 THEN 64 WHEN 5 THEN 96 WHEN 6 THEN 128 WHEN 7 THEN 192 WHEN 8 THEN 256 WHEN 9 THEN 384 WHEN 10 THEN 512 END * CAST(unit AS BIGINT) AS v
      FROM h WHERE score BETWEEN minimum AND cap),
p AS (SELECT g.*, CAST(r.range AS INT) AS p, (r.range - winner + 4) % 4 AS place FROM g, range(4) r WHERE r.range <> winner),
a AS (SELECT *, CASE payment WHEN 'fullEach' THEN v WHEN 'preset' THEN v // 2 ELSE v // 3 + CASE WHEN place <= v % 3 THEN 1 ELSE 0 END END AS drawn,
             CASE payment WHEN 'fullEach' THEN 3 * v WHEN 'preset' THEN 3 * (v // 2) ELSE v END AS all_drawn,
             base + least(score + CASE WHEN winner = dealer OR p = dealer THEN 1 + 2 * continuations ELSE 0 END, cap) * unit AS tai,
             base + least(score + CASE WHEN winner = dealer THEN 1 + 2 * continuations ELSE 0 END, cap) * unit AS fixed FROM p),
x AS (SELECT *, CASE
        WHEN family = 'taiwanese' AND source = 'selfDraw' AND payment = 'splitTotal' THEN fixed // 3 + CASE WHEN place <= fixed % 3 THEN 1 ELSE 0 END
        WHEN family = 'taiwanese' AND source = 'selfDraw' THEN tai
        WHEN family = 'taiwanese' THEN CASE WHEN p = discarder THEN tai END
        WHEN source = 'robKong' THEN CASE WHEN p = discarder THEN all_drawn END
        WHEN source = 'discard' THEN CASE WHEN p = discarder THEN v END
        WHEN liable_player IS NOT NULL AND replacement <> 'kong' THEN CASE WHEN p = liable_player THEN all_drawn END
        ELSE drawn END AS amount,
      CASE WHEN source = 'robKong' THEN 'robbed_kong' WHEN family = 'hongKong' AND source = 'selfDraw' AND replacement <> 'kong' AND liable_player = p THEN 'liability'
           WHEN source = 'selfDraw' THEN 'self_draw' ELSE 'discard' END AS reason FROM a),
tr AS (SELECT hand_id, p AS payer, winner AS payee, CAST(amount AS BIGINT) AS amount, reason, family FROM x WHERE amount IS NOT NULL)"""


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    settled = settle(derive(table(spark, d, "orders"), WIN))
    return explode_transfers(settled, "hand_id", "family").withColumnsRenamed({"from": "payer", "to": "payee"})


@register(QUERIES, f"WITH {_SETTLE_SQL} SELECT hand_id, payer, payee, amount, reason FROM tr")
def settlement_transfers(spark, d):
    return _transfers(spark, d).select("hand_id", "payer", "payee", "amount", "reason")


@register(QUERIES, f"WITH {_SETTLE_SQL}, m AS (SELECT payer AS player, -amount AS x FROM tr UNION ALL SELECT payee, amount FROM tr) SELECT player, CAST(sum(x) AS BIGINT) AS balance FROM m GROUP BY player")
def settlement_balances(spark, d):
    moves = F.explode(F.array(F.struct(F.col("payer").alias("player"), (-F.col("amount")).alias("x")), F.struct(F.col("payee").alias("player"), F.col("amount").alias("x"))))
    return _transfers(spark, d).select(moves.alias("m")).groupBy("m.player").agg(F.sum("m.x").alias("balance"))


def _by_reason(name: str, where: str):
    def run(spark, d):
        return _transfers(spark, d).where(where).groupBy("reason").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("amount").alias("largest"))

    QUERIES[name] = (run, f"WITH {_SETTLE_SQL} SELECT reason, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total, max(amount) AS largest FROM tr WHERE {where} GROUP BY reason")


_by_reason("settlement_tw_dealer", "family = 'taiwanese'")
_by_reason("settlement_liability", "reason = 'liability'")
_by_reason("settlement_robbed", "reason = 'robbed_kong'")


@register(QUERIES, """
WITH t AS (SELECT CAST(range AS INT) AS tile FROM range(42))
SELECT p_partkey, CAST(p_partkey % 42 AS INT) AS tile,
  CASE WHEN p_partkey % 42 < 9 THEN (p_partkey % 42 + 1) || 'm' WHEN p_partkey % 42 < 18 THEN (p_partkey % 42 - 8) || 'p' WHEN p_partkey % 42 < 27 THEN (p_partkey % 42 - 17) || 's'
       WHEN p_partkey % 42 < 34 THEN (p_partkey % 42 - 26) || 'z' ELSE (p_partkey % 42 - 33) || 'f' END AS code,
  p_partkey % 42 BETWEEN 27 AND 33 AS is_honor, p_partkey % 42 IN (0, 8, 9, 17, 18, 26) AS is_terminal FROM part""")
def tile_codes(spark, d):
    parts = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 42).cast("int").alias("tile"))
    return parts.join(F.broadcast(dim_tile(spark)), "tile").select("p_partkey", "tile", "code", "is_honor", "is_terminal")


# A notation: man, pin and honor digits of an order's keys; some are broken.
_TEXT = {"hand_id": "o_orderkey", "notation": "concat(CAST(o_orderkey % 9 + 1 AS VARCHAR(9)), CAST(o_custkey % 9 + 1 AS VARCHAR(9)), 'm ', CAST(o_custkey % 9 + 1 AS VARCHAR(9)), CASE WHEN o_orderkey % 11 = 0 THEN 'q' ELSE 'p' END, CAST(o_orderkey % 8 + 1 AS VARCHAR(9)), 'z')"}


@register(QUERIES, f"""
WITH h AS ({derive_sql('orders', _TEXT)}), c AS (SELECT hand_id, notation, replace(notation, ' ', '') AS t FROM h),
v AS (SELECT hand_id, notation, CASE WHEN substr(t, 5, 1) = 'p' AND substr(t, 6, 1) <> '8' THEN
  concat(CAST(substr(t, 1, 1) AS INT) - 1, ',', CAST(substr(t, 2, 1) AS INT) - 1, ',', CAST(substr(t, 4, 1) AS INT) + 8, ',', CAST(substr(t, 6, 1) AS INT) + 26) END AS tiles FROM c)
SELECT hand_id, notation, tiles, CASE WHEN tiles IS NOT NULL THEN substr(notation, 1, 1) || 'm' END AS first_code FROM v""")
def parse_notation(spark, d):
    rows = derive(table(spark, d, "orders"), _TEXT).withColumn("t", parse_tiles(F.col("notation")))
    return rows.select("hand_id", "notation", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("tiles"), tile_code(F.col("t")[0]).alias("first_code"))


def _hand_exprs(key: str, c: str, groups: int = 4) -> dict[str, str]:
    """Scalars of a hand from two keys: the pair p, and k (0 pung, 1 chow) and first tile g of each group."""
    out = {"hand_id": key, "p": f"CAST(CASE WHEN {key} % 3 = 0 THEN ({key} % 3 * 9 + {c} % 9) ELSE ({key} * 7 + {c}) % 34 END AS INT)"}
    for i in range(groups):
        x = f"({key} * {3 + 2 * i} + {c} * {5 + i} + {11 * i})"
        out[f"k{i}"] = f"CAST(CASE WHEN {x} % 5 < 2 THEN 0 ELSE 1 END AS INT)"
        suit = f"(CASE WHEN {key} % 3 = 0 THEN 0 ELSE {x} % 3 END)"
        out[f"g{i}"] = f"CAST(CASE WHEN {x} % 5 < 2 THEN (CASE WHEN {key} % 3 = 0 THEN {x} % 9 ELSE {x} % 34 END) ELSE {suit} * 9 + {x} % 7 END AS INT)"
    return out


HAND = _hand_exprs("c_custkey", "(c_nationkey * 13 + 1)")
TILES_SQL = "flatten([[p, p]" + "".join(f", [g{i}, g{i} + k{i}, g{i} + 2 * k{i}]" for i in range(4)) + "])"


def _tiles() -> Column:
    groups = [F.array(F.col(f"g{i}"), F.col(f"g{i}") + F.col(f"k{i}"), F.col(f"g{i}") + 2 * F.col(f"k{i}")) for i in range(4)]
    return F.concat(F.array("p", "p"), *groups)


def _hands(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "customer"), HAND).select("hand_id", _tiles().alias("concealed"))


@register(QUERIES, f"""
WITH h AS ({derive_sql('customer', HAND)}), t AS (SELECT hand_id, unnest({TILES_SQL}) AS tile FROM h), n AS (SELECT hand_id, tile, count(*) AS c FROM t GROUP BY ALL)
SELECT hand_id, CAST(max(c) AS INT) AS most, CAST(count(*) AS INT) AS kinds, CAST(sum(c * c) AS INT) AS squares, max(c) <= 4 AS possible FROM n GROUP BY hand_id""")
def hand_tile_counts(spark, d):
    c = tile_counts(F.col("concealed"))
    rows = _hands(spark, d).withColumn("c", c)
    return rows.select("hand_id", F.array_max("c").alias("most"), F.size(F.filter("c", lambda x: x > 0)).alias("kinds"), F.aggregate("c", F.lit(0), lambda s, x: s + x * x).alias("squares"), (F.array_max("c") <= 4).alias("possible"))


# Thirteen orphans with one more tile; every fourth lacks one.
_ORPHANS = (0, 8, 9, 17, 18, 26, 27, 28, 29, 30, 31, 32, 33)


@register(QUERIES, f"""
WITH h AS (SELECT o_orderkey AS hand_id, list_concat({list(_ORPHANS)}, [CAST(o_custkey % 34 AS INT)]) AS a FROM orders),
t AS (SELECT hand_id, CASE WHEN hand_id % 4 = 0 THEN list_concat(a[2:], [a[2]]) ELSE a END AS a FROM h)
SELECT hand_id, len(a) = 14 AND len(list_distinct(a)) = 13 AND len(list_filter(a, lambda x: NOT list_contains({list(_ORPHANS)}, x))) = 0 AS orphans FROM t""")
def orphans_check(spark, d):
    a = F.concat(F.array(*map(F.lit, _ORPHANS)), F.array((F.col("o_custkey") % 34).cast("int")))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("hand_id"), a.alias("a")).withColumn("a", F.when(F.col("hand_id") % 4 == 0, F.concat(F.slice("a", 2, 13), F.array(F.col("a")[1]))).otherwise(F.col("a")))
    return rows.select("hand_id", is_thirteen_orphans(F.col("a")).alias("orphans"))


# Recursive decomposition in SQL: take a pair out, then always the lowest tile's pung or chow.
def _decompose_sql(hands: str, n_groups: str) -> str:
    return f"""
hs AS ({hands}),
cnt AS (SELECT hand_id, list_transform(range(34), lambda x: len(list_filter(tiles, lambda y: y = x))) AS c, len(tiles) AS n, {n_groups} AS g FROM hs),
ok AS (SELECT * FROM cnt WHERE list_max(c) <= 4 AND n = 3 * g + 2),
rec AS (
  SELECT hand_id, CAST(r.range AS INT) AS pair, list_transform(c, lambda x, i: CASE WHEN i = r.range + 1 THEN x - 2 ELSE x END) AS c, '' AS groups FROM ok, range(34) r WHERE c[r.range + 1] >= 2
  UNION ALL
  SELECT hand_id, pair, list_transform(c, lambda x, i: x - CASE WHEN k.kind = 'pung' AND i = low THEN 3 WHEN k.kind = 'chow' AND i BETWEEN low AND low + 2 THEN 1 ELSE 0 END), groups || k.kind || (low - 1) || ';'
  FROM (SELECT *, list_position(list_transform(c, lambda x: x > 0), true) AS low FROM rec) s, (VALUES ('pung'), ('chow')) k(kind)
  WHERE low > 0 AND ((k.kind = 'pung' AND c[low] >= 3) OR (k.kind = 'chow' AND low <= 27 AND (low - 1) % 9 <= 6 AND c[low + 1] >= 1 AND c[low + 2] >= 1)))"""


_HANDS_SQL = f"SELECT hand_id, {TILES_SQL} AS tiles FROM ({derive_sql('customer', HAND)})"


@register(QUERIES, f"""WITH RECURSIVE {_decompose_sql(_HANDS_SQL, '4')}
SELECT DISTINCT hand_id, pair, list_sort(string_split(rtrim(groups, ';'), ';'))::VARCHAR AS groups FROM rec WHERE list_max(c) = 0""")
def hand_decompositions(spark, d):
    parts = decompose(_hands(spark, d).withColumn("n_groups", F.lit(4)))
    text = F.array_sort(F.transform("groups", lambda g: F.concat(g["kind"], g["tile"].cast("string"))))
    return parts.select("hand_id", "pair", F.concat(F.lit("["), F.array_join(text, ", "), F.lit("]")).alias("groups"))


_BEFORE_SQL = f"SELECT hand_id, list_concat(tiles[1:13], [CAST(w.range AS INT)]) AS tiles, hand_id * 100 + w.range AS k FROM ({_HANDS_SQL}), range(34) w WHERE len(list_filter(tiles[1:13], lambda y: y = w.range)) < 4"


@register(QUERIES, f"""WITH RECURSIVE {_decompose_sql(f"SELECT k AS hand_id, tiles FROM ({_BEFORE_SQL})", '4')}
SELECT DISTINCT hand_id // 100 AS hand_id, CAST(hand_id % 100 AS INT) AS wait FROM rec WHERE list_max(c) = 0""")
def hand_waits(spark, d):
    rows = _hands(spark, d).select("hand_id", F.slice("concealed", 1, 13).alias("before"), F.array().cast("array<int>").alias("meld_tiles"), F.lit(4).alias("n_groups"))
    return waits(rows)


def _customer_hands(spark: SparkSession, d: str) -> DataFrame:
    """Whole hands with rules: half of one family with four concealed groups, half of the other with one pung melded."""
    rows = derive(table(spark, d, "customer"), HAND | {"m": "CAST(c_custkey * 3 % 34 AS INT)", "w": "CAST(c_custkey % 14 AS INT)", "s": "CAST(c_custkey % 4 AS INT)", "q": "CAST(c_nationkey AS INT)"})
    tw = F.col("hand_id") % 2 == 1
    meld = F.array(F.struct(F.lit("pung").alias("kind"), F.array("m", "m", "m").alias("tiles")))
    self_draw = F.col("s") < 2
    return rows.select(
        F.col("hand_id").cast("bigint"), _tiles().alias("concealed"), F.when(tw, meld).otherwise(F.array().cast("array<struct<kind:string,tiles:array<int>>>")).alias("melds"), F.when(F.col("q") % 3 == 0, F.array((F.col("q") % 8 + 34).cast("int"))).otherwise(F.array().cast("array<int>")).alias("flowers"),
        _tiles()[F.col("w")].alias("winning_tile"), F.when(self_draw, "selfDraw").when(F.col("s") == 2, "discard").otherwise(F.lit(None).cast("string")).alias("source"), (F.col("q") % 4).alias("winner"), ((F.col("q") + 1) % 4).alias("discarder"), (F.col("hand_id") % 4).cast("int").alias("dealer"),
        ((F.col("hand_id") + F.col("q")) % 4).cast("int").alias("round_wind"), (F.col("hand_id") % 3).cast("int").alias("continuations"), F.when(self_draw & (F.col("hand_id") % 9 == 0), "draw").otherwise("none").alias("last_tile"), F.lit("none").alias("replacement"), F.lit(0).alias("kong_chain"), F.lit(None).cast("int").alias("liable_player"),
        F.lit(False).alias("heavenly"), F.lit(False).alias("earthly"), F.lit(True).alias("confirmed"), F.when(tw, "taiwanese").otherwise("hongKong").alias("family"), F.when(tw, 1).otherwise(3).alias("minimum"), F.when(tw, 40).otherwise(10).alias("cap"), F.lit(True).alias("use_flowers"),
        F.lit(1).alias("base"), F.lit(2).alias("unit"), F.when(F.col("q") % 3 == 0, "preset").when(F.col("q") % 3 == 1, "fullEach").otherwise("splitTotal").alias("payment"), F.when(F.col("q") == 5, F.create_map(F.lit("chows"), F.lit(6))).otherwise(F.create_map().cast("map<string,int>")).alias("overrides"),
    )


# Hands in which every pattern and status occurs: family, concealed groups and melds (kind and tiles), and what differs from the defaults.
def _planted() -> list[dict]:
    pung, chow = lambda t: [t] * 3, lambda t: [t, t + 1, t + 2]
    meld = lambda kind, t: {"kind": kind, "tiles": chow(t) if kind == "chow" else [t] * (3 if kind == "pung" else 4)}
    chows = [*chow(0), *chow(3), *chow(9), *chow(12), 20, 20]
    first = [
        {"concealed": chows, "win": 0}, {"concealed": [*pung(27), *chow(0), *chow(3), 8, 8], "melds": [meld("pung", 31)], "win": 0, "source": "discard"}, {"concealed": [*pung(8), *pung(9), *pung(27), 31, 31], "melds": [meld("pung", 0)], "win": 31, "source": "discard"},
        {"concealed": chows, "win": 0, "source": "robKong"}, {"concealed": [*chow(0), *chow(3), *pung(9), 20, 20], "melds": [meld("closedKong", 31)], "win": 9, "replacement": "kong", "kong_chain": 1}, {"concealed": chows, "win": 0, "last_tile": "draw"},
        {"concealed": [33, 33, *chow(0), *chow(9)], "melds": [meld("pung", 31), meld("pung", 32)], "win": 0, "source": "discard"}, {"concealed": [*pung(33), *chow(0), 9, 9], "melds": [meld("pung", 31), meld("pung", 32)], "win": 0, "source": "discard"},
        {"concealed": [*pung(3), *chow(5), *pung(8), 4, 4], "melds": [meld("chow", 0)], "win": 5, "source": "discard"}, {"concealed": chows, "win": 0, "use_flowers": False, "minimum": 3}, {"concealed": chows, "win": 0, "flowers": [34, 35, 36, 37]},
        {"concealed": [*pung(31), *pung(32), 33, 33], "melds": [meld("pung", 27), meld("pung", 28)], "win": 33, "source": "discard"}, {"concealed": [*pung(30), 0, 0], "melds": [meld("pung", k) for k in (27, 28, 29)], "win": 0, "source": "discard"},
        {"concealed": [*chow(0), 30, 30], "melds": [meld("pung", k) for k in (27, 28, 29)], "win": 0, "source": "discard"}, {"concealed": [*pung(0), *pung(10), *pung(20), *pung(28), 5, 5], "win": 5},
        {"concealed": [5, 5], "melds": [meld("openKong", 0), meld("closedKong", 10), meld("addedKong", 20), meld("openKong", 28)], "win": 5, "source": "discard"}, {"concealed": [*pung(9), *pung(17), 18, 18], "melds": [meld("pung", 0), meld("pung", 8)], "win": 18, "source": "discard"},
        {"concealed": chows, "win": 0, "heavenly": True}, {"concealed": chows, "win": 0, "winner": 1, "discarder": 0, "source": "discard", "earthly": True}, {"concealed": [*chow(18), *chow(21), 5, 5], "melds": [meld("closedKong", 0), meld("closedKong", 10)], "win": 18, "replacement": "kong", "kong_chain": 2},
        {"concealed": [0, 0, 0, 1, 2, 3, 4, 4, 5, 6, 7, 8, 8, 8], "win": 4, "source": "discard"}, {"concealed": [*_ORPHANS, 33], "win": 0, "source": "robConcealedKong"}, {"concealed": chows, "win": 0, "source": "robConcealedKong"},
        {"concealed": [0, 1, 3, 4, 9, 10, 12, 13, 18, 20, 22, 24, 27, 28], "win": 0}, {"concealed": chows[:13], "win": 0}, {"concealed": chows, "win": 0, "flowers": [34, 35, 36, 37, 38, 39, 40]}, {"concealed": chows, "win": 0, "confirmed": False}, {"concealed": [*chows, 25], "win": 0},
        {"concealed": [*chow(0), *chow(3), *pung(9), 20, 20], "melds": [meld("pung", 31)], "flowers": [34], "win": 0, "replacement": "flower"},
    ]
    second = [
        {"concealed": [*chow(0), *chow(3), *chow(9), *chow(12), *chow(18), 24, 24], "win": 0, "source": "discard"}, {"concealed": [*pung(0), *pung(10), *pung(20), *chow(3), *chow(12), 28, 28], "win": 3}, {"concealed": [*pung(0), *chow(10), *chow(20), *chow(3), *chow(13), 28, 28], "win": 3, "source": "discard"},
        {"concealed": [*pung(0), *pung(10), *pung(20), *pung(28), *chow(3), 8, 8], "win": 3}, {"concealed": [*pung(0), *pung(10), *pung(20), *pung(28), *pung(31), 8, 8], "win": 8}, {"concealed": [*pung(0), *pung(10), *chow(3), *chow(13), 28, 28], "melds": [meld("chow", 18)], "win": 28, "source": "discard"},
        {"concealed": [8, 8], "melds": [meld("pung", 0), meld("chow", 3), meld("pung", 10), meld("chow", 13), meld("pung", 28)], "win": 8, "source": "discard"}, {"concealed": [*pung(31), *pung(32), 33, 33], "melds": [meld("pung", k) for k in (27, 28, 29)], "win": 33, "source": "discard"},
        {"concealed": [*pung(0), 5, 5], "melds": [meld("pung", k) for k in (27, 28, 29, 30)], "win": 5}, {"concealed": [*chow(0), *chow(10), 30, 30], "melds": [meld("pung", k) for k in (27, 28, 29)], "win": 0, "source": "discard"},
        {"concealed": [*chow(0), *chow(10), 5, 5], "melds": [meld("pung", k) for k in (31, 32, 33)], "win": 0, "source": "discard"}, {"concealed": [*chow(0), *chow(10), *chow(20), 33, 33], "melds": [meld("pung", 31), meld("pung", 32)], "win": 0, "source": "discard"},
        {"concealed": [*chow(0), *chow(10), *chow(20), 5, 5], "melds": [meld("pung", 31), meld("pung", 27)], "win": 0}, {"concealed": [*chow(0), *chow(3), *chow(9), *chow(12), *chow(18), 24, 24], "win": 9, "source": "robKong"},
        {"concealed": [*chow(0), *chow(3), *chow(9), *chow(12), *chow(18), 24, 24], "win": 0, "replacement": "flower", "flowers": [34]}, {"concealed": [*chow(0), *chow(3), *chow(9), *chow(12), 24, 24], "melds": [meld("chow", 18)], "win": 0, "last_tile": "draw"},
        {"concealed": [*chow(0), *chow(3), *pung(6), *pung(27), *pung(28), 8, 8], "win": 0, "source": "discard"}, {"concealed": [*chow(0), *chow(1), *chow(3), *pung(6), *pung(7), 8, 8], "win": 0}, {"concealed": [*chow(0), *chow(3), *chow(9), *chow(12), *chow(18), 24, 24], "win": 0, "flowers": [38, 39, 40, 41]},
        {"concealed": [*pung(0), *pung(10), *chow(3), *chow(13), 28, 28], "melds": [meld("closedKong", 20)], "win": 3, "replacement": "kong", "kong_chain": 1},
    ]
    base = {"melds": [], "flowers": [], "source": "selfDraw", "winner": 0, "discarder": 1, "dealer": 0, "round_wind": 0, "last_tile": "none", "replacement": "none", "kong_chain": 0, "heavenly": False, "earthly": False, "confirmed": True, "use_flowers": True}
    rows = [base | {"family": "hongKong", "minimum": 3, "cap": 10} | x for x in first] + [base | {"family": "taiwanese", "minimum": 1, "cap": 40} | x for x in second]
    return [x | {"k": k, "winning_tile": x["win"]} for k, x in enumerate(rows)]


_PLANTED = _planted()
_PLANTED_DDL = "k int, concealed array<int>, melds array<struct<kind:string,tiles:array<int>>>, flowers array<int>, winning_tile int, source string, winner int, discarder int, dealer int, round_wind int, last_tile string, replacement string, kong_chain int, heavenly boolean, earthly boolean, confirmed boolean, family string, minimum int, cap int, use_flowers boolean"
_PLANTED_NAMES = [x.split()[0] for x in _PLANTED_DDL.split(", ")]


def _full_hands(spark: SparkSession, d: str) -> DataFrame:
    """The hands of customers, and one of the planted ones for each supplier."""
    fixed = spark.createDataFrame([tuple(x[n] for n in _PLANTED_NAMES) for x in _PLANTED], _PLANTED_DDL)
    s = table(spark, d, "supplier").select((F.col("s_suppkey") + 1_000_000_000).cast("bigint").alias("hand_id"), (F.col("s_suppkey") % len(_PLANTED)).cast("int").alias("k"))
    rows = s.join(F.broadcast(fixed), "k").drop("k").withColumns({"continuations": F.lit(0), "liable_player": F.lit(None).cast("int"), "base": F.lit(1), "unit": F.lit(2), "payment": F.lit("preset"), "overrides": F.create_map().cast("map<string,int>")})
    return _customer_hands(spark, d).unionByName(rows)


_MELD_TYPE = "STRUCT(kind VARCHAR, tiles INTEGER[])[]"


def _literal(v: object) -> str:
    if isinstance(v, list) and v and isinstance(v[0], dict):
        return f"CAST([{', '.join(f'{{{chr(39)}kind{chr(39)}: {chr(39)}{m["kind"]}{chr(39)}, {chr(39)}tiles{chr(39)}: {m["tiles"]}}}' for m in v)}] AS {_MELD_TYPE})"
    return str(v) if isinstance(v, bool | int) else f"CAST({v} AS INTEGER[])" if isinstance(v, list) else f"'{v}'"


def _full_sql() -> str:
    """The same hands in DuckDB's SQL, under the name full."""
    rows = ", ".join("(" + ", ".join(f"CAST([] AS {_MELD_TYPE})" if n == "melds" and not x[n] else _literal(x[n]) for n in _PLANTED_NAMES) + ")" for x in _PLANTED)
    exprs = HAND | {"m": "CAST(c_custkey * 3 % 34 AS INT)", "w": "CAST(c_custkey % 14 AS INT)", "s": "CAST(c_custkey % 4 AS INT)", "q": "CAST(c_nationkey AS INT)"}
    return f"""base AS ({derive_sql('customer', exprs)}), tiled AS (SELECT *, {TILES_SQL} AS tiles, hand_id % 2 = 1 AS tw FROM base), planted AS (SELECT * FROM (VALUES {rows}) v({', '.join(_PLANTED_NAMES)})),
full_hands AS (
  SELECT CAST(hand_id AS BIGINT) AS hand_id, CAST(tiles AS INTEGER[]) AS concealed, CASE WHEN tw THEN CAST([{{'kind': 'pung', 'tiles': [m, m, m]}}] AS {_MELD_TYPE}) ELSE CAST([] AS {_MELD_TYPE}) END AS melds, CASE WHEN q % 3 = 0 THEN CAST([q % 8 + 34] AS INTEGER[]) ELSE CAST([] AS INTEGER[]) END AS flowers,
    CAST(tiles[w + 1] AS INTEGER) AS winning_tile, CASE WHEN s < 2 THEN 'selfDraw' WHEN s = 2 THEN 'discard' END AS source, q % 4 AS winner, (q + 1) % 4 AS discarder, CAST(hand_id % 4 AS INT) AS dealer, CAST((hand_id + q) % 4 AS INT) AS round_wind, CAST(hand_id % 3 AS INT) AS continuations,
    CASE WHEN s < 2 AND hand_id % 9 = 0 THEN 'draw' ELSE 'none' END AS last_tile, 'none' AS replacement, 0 AS kong_chain, false AS heavenly, false AS earthly, true AS confirmed, CASE WHEN tw THEN 'taiwanese' ELSE 'hongKong' END AS family, CASE WHEN tw THEN 1 ELSE 3 END AS minimum, CASE WHEN tw THEN 40 ELSE 10 END AS cap,
    true AS use_flowers, CASE q % 3 WHEN 0 THEN 'preset' WHEN 1 THEN 'fullEach' ELSE 'splitTotal' END AS payment, CASE WHEN q = 5 THEN 'chows' END AS override_id FROM tiled
  UNION ALL BY NAME SELECT s_suppkey + 1000000000 AS hand_id, 0 AS continuations, 'preset' AS payment, CAST(NULL AS VARCHAR) AS override_id, p.* EXCLUDE (k) FROM supplier JOIN planted p ON p.k = s_suppkey % {len(_PLANTED)})"""


def _score_sql() -> str:
    """Scores of the hands in full_hands, rule by rule, under the name scored: every decomposition and place of the winning tile is a row."""
    melded = "list_transform(list_filter(melds, lambda m: m.kind <> 'chow'), lambda m: m.tiles[1])"
    every = "list_concat(concealed, coalesce(flatten(list_transform(melds, lambda m: m.tiles)), []))"
    count = lambda xs, cond: f"len(list_filter({xs}, lambda x: {cond}))"
    honor, terminal = "x >= 27", "x IN (0, 8, 9, 17, 18, 26)"
    kongs = count("melds", "x.kind IN ('openKong', 'closedKong', 'addedKong')")
    plain = lambda less: f"len(list_filter(range(9), lambda r: len(list_filter(allt, lambda x: x % 9 = r)) - {less} < CASE WHEN r IN (0, 8) THEN 3 ELSE 1 END)) = 0"
    nine = f"len(melds) = 0 AND len(suits) = 1 AND NOT honors AND {plain('0')} AND (selfdrawn OR {plain('CASE WHEN r = winning_tile % 9 THEN 1 ELSE 0 END')})"
    limits = {
        "allHonors": "len(suits) = 0", "bigWinds": "winds = 4", "smallWinds": "winds = 3 AND pair BETWEEN 27 AND 30", "fourHidden": "hidden = 4 AND kongs = 0", "fourKongs": "kongs = 4", "allTerminals": f"{count('allt', f'NOT ({terminal})')} = 0",
        "heavenly": "heavenly", "earthly": "earthly", "doubleKongWin": "kong_chain >= 2", "nineGates": nine,
    }
    both = "(dragons = 3 OR (dragons = 2 AND pair >= 31))"
    exposed = "(len(melds) = 5 AND openmelds = 5 AND NOT selfdrawn)"
    adds = [
        ("halfFlush", 3, 4, "len(suits) = 1 AND honors", "1"), ("fullFlush", 7, 8, "len(suits) = 1 AND NOT honors", "1"), ("allHonors", 0, 16, "NOT hk AND len(suits) = 0", "1"), ("allPungs", 3, 4, "len(triplets) = CASE WHEN hk THEN 4 ELSE 5 END", "1"),
        ("bigDragons", 5, 8, "dragons = 3", "1"), ("smallDragons", 3, 4, "dragons = 2 AND pair >= 31", "1"), ("dragon", 1, 1, f"hk OR NOT {both}", "dragons"), ("seatWind", 1, 1, "list_contains(kinds, 27 + seat)", "1"), ("roundWind", 1, 1, "list_contains(kinds, 27 + round_wind)", "1"),
        ("mixedTerminals", 1, 0, f"hk AND {count('allt', f'NOT ({terminal} OR {honor})')} = 0", "1"), ("chows", 1, 2, "len(triplets) = 0 AND (hk OR (NOT honors AND len(flowers) = 0 AND NOT selfdrawn AND n_waits > 1 AND role = 'chow'))", "1"),
        ("selfDraw", 1, 1, "selfdrawn AND (hk OR NOT unopened)", "1"), ("closed", 1, 1, "CASE WHEN hk THEN NOT use_flowers AND len(melds) = 0 ELSE unopened AND NOT selfdrawn END", "1"), ("closedSelfDraw", 0, 3, "NOT hk AND unopened AND selfdrawn", "1"),
        ("threeConcealed", 0, 2, "NOT hk AND hidden = 3", "1"), ("fourConcealed", 0, 5, "NOT hk AND hidden = 4", "1"), ("fiveConcealed", 0, 8, "NOT hk AND hidden = 5", "1"), ("allExposed", 0, 2, f"NOT hk AND {exposed}", "1"), ("singleWait", 0, 1, f"NOT hk AND NOT {exposed} AND n_waits = 1", "1"),
        ("bigWinds", 0, 16, "NOT hk AND winds = 4", "1"), ("smallWinds", 0, 8, "NOT hk AND winds = 3 AND pair BETWEEN 27 AND 30", "1"), ("noFlowers", 1, 0, "hk AND use_flowers AND len(flowers) = 0", "1"),
        ("seatFlower", 1, 1, "use_flowers", "len(list_filter(flowers, lambda x: (x - 34) % 4 = seat))"), ("flowerSet", 1, 2, "use_flowers", "CAST(list_has_all(flowers, [34, 35, 36, 37]) AS INT) + CAST(list_has_all(flowers, [38, 39, 40, 41]) AS INT)"),
        ("robKong", 1, 1, "source IN ('robKong', 'robConcealedKong')", "1"), ("kongWin", 1, 1, "replacement = 'kong' OR (NOT hk AND replacement = 'flower')", "1"), ("lastDraw", 1, 1, "last_tile = 'draw'", "1"),
    ]

    def added(name: str, hk: int, tw: int, cond: str, times: str) -> str:
        value = f"CASE WHEN override_id = '{name}' THEN 6 WHEN hk THEN {hk} ELSE {tw} END"
        return f"CASE WHEN ({cond}) AND {value} > 0 THEN list_transform(range({times}), lambda i: {{'id': '{name}', 'value': CAST({value} AS INT)}}) ELSE [] END"

    limit = "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in limits.items()) + " END"
    before = "list_concat(concealed[1:list_position(concealed, winning_tile) - 1], concealed[list_position(concealed, winning_tile) + 1:])"
    wait_hands = f"SELECT hand_id * 100 + w.range AS hand_id, list_concat({before}, [CAST(w.range AS INT)]) AS tiles, left_groups FROM fit, range(34) w WHERE NOT hk AND len(list_filter(list_concat({before}, coalesce(flatten(list_transform(melds, lambda m: m.tiles)), [])), lambda y: y = w.range)) < 4"
    waits_sql = _decompose_sql(wait_hands, "left_groups")
    for name in ("hs", "cnt", "ok", "rec"):
        waits_sql = re.sub(rf"\b{name}\b", f"wait_{name}", waits_sql)
    group = lambda x: f"list_transform(list_filter(string_split(rtrim(groups, ';'), ';'), lambda x: x LIKE '{x}%'), lambda x: CAST(substr(x, 5) AS INT))"
    has_chow = "len(list_filter(chows, lambda x: winning_tile BETWEEN x AND x + 2)) > 0"
    settled = _SETTLE_SQL[_SETTLE_SQL.index("g AS (") :]
    return f"""{_full_sql()},
judged AS (SELECT *, family = 'hongKong' AS hk, CAST(CASE WHEN family = 'hongKong' THEN 4 ELSE 5 END - len(melds) AS INT) AS left_groups, {every} AS allt, coalesce(source = 'selfDraw', false) AS selfdrawn, (winner - dealer + 4) % 4 AS seat FROM full_hands),
checked AS (SELECT *, len(list_filter(range(34), lambda k: len(list_filter(allt, lambda x: x = k)) > 4)) > 0 AS bad, left_groups * 3 + 2 AS expected,
  hk AND len(melds) = 0 AND len(concealed) = 14 AND len(list_distinct(concealed)) = 13 AND len(list_filter(concealed, lambda x: NOT list_contains({list(_ORPHANS)}, x))) = 0 AS orphans FROM judged),
fit AS (SELECT * FROM checked WHERE NOT bad AND len(flowers) < 7 AND len(concealed) = expected AND source IS NOT NULL AND confirmed),
{_decompose_sql("SELECT hand_id, concealed AS tiles, left_groups FROM fit", "left_groups")},
{waits_sql},
waiting AS (SELECT hand_id // 100 AS hand_id, count(DISTINCT hand_id) AS n_waits FROM wait_rec WHERE list_max(c) = 0 GROUP BY 1),
parts AS (SELECT DISTINCT hand_id, pair, {group('pung')} AS pungs, {group('chow')} AS chows FROM rec WHERE list_max(c) = 0),
roles AS (SELECT f.*, p.pair, p.pungs, p.chows, coalesce(w.n_waits, 0) AS n_waits, unnest(CASE WHEN selfdrawn THEN ['selfDraw'] ELSE list_filter([CASE WHEN pair = winning_tile THEN 'pair' END, CASE WHEN {has_chow} THEN 'chow' END, CASE WHEN list_contains(pungs, winning_tile) THEN 'pung' END], lambda x: x IS NOT NULL) END) AS role
  FROM fit f JOIN parts p USING (hand_id) LEFT JOIN waiting w USING (hand_id)),
facts AS (SELECT *, list_concat({melded}, pungs) AS triplets, list_distinct(list_concat({melded}, pungs)) AS kinds, list_distinct(list_transform(list_filter(allt, lambda x: x < 27), lambda x: x // 9)) AS suits, {count('allt', honor)} > 0 AS honors,
  {count('melds', "x.kind <> 'closedKong'")} AS openmelds, {kongs} AS kongs, len(pungs) + {count('melds', "x.kind = 'closedKong'")} - CASE WHEN role = 'pung' THEN 1 ELSE 0 END AS hidden FROM roles),
counted AS (SELECT *, openmelds = 0 AS unopened, {count('kinds', 'x >= 31')} AS dragons, {count('kinds', 'x BETWEEN 27 AND 30')} AS winds FROM facts),
limited AS (SELECT *, CASE WHEN hk THEN {limit} END AS best_limit FROM counted),
variants AS (SELECT hand_id, pair, role, list_sort(list_concat(list_transform(pungs, lambda x: x * 2 + 1), list_transform(chows, lambda x: x * 2))) AS placed,
    CASE WHEN best_limit IS NOT NULL THEN [{{'id': best_limit, 'value': CAST(10 AS INT)}}] ELSE flatten([{', '.join(added(*x) for x in adds)}]) END AS patterns FROM limited
  UNION ALL SELECT hand_id, -1, '', [], [{{'id': 'orphans', 'value': CAST(10 AS INT)}}] FROM fit WHERE orphans),
named AS (SELECT *, coalesce(list_sum(list_transform(patterns, lambda x: x.value)), 0) AS raw, '[' || array_to_string(list_transform(placed, lambda x: '{{"kind":"' || CASE WHEN x % 2 = 1 THEN 'pung' ELSE 'chow' END || '","tile":' || (x // 2) || '}}'), ',') || ']' AS g FROM variants),
best AS (SELECT hand_id, patterns, raw FROM named QUALIFY row_number() OVER (PARTITION BY hand_id ORDER BY raw DESC, pair, g, role) = 1),
totals AS (SELECT c.*, b.patterns, coalesce(b.raw, 0) AS raw, least(coalesce(b.raw, 0), cap) AS capped, b.hand_id IS NOT NULL AS found FROM checked c LEFT JOIN best b USING (hand_id)),
named_status AS (SELECT *, CASE WHEN bad THEN 'invalid' WHEN len(flowers) >= 7 THEN 'needsContext' WHEN len(concealed) < expected THEN 'incomplete' WHEN len(concealed) > expected THEN 'invalid' WHEN source IS NULL OR NOT confirmed THEN 'needsContext'
  WHEN source = 'robConcealedKong' AND NOT orphans THEN 'invalid' WHEN NOT found THEN 'invalid' WHEN capped < minimum THEN 'belowMinimum' ELSE 'valid' END AS status FROM totals),
scored AS (SELECT *, CASE WHEN status IN ('valid', 'belowMinimum') THEN patterns ELSE [] END AS shown, CAST(CASE WHEN status IN ('valid', 'belowMinimum') THEN raw ELSE 0 END AS INT) AS raw_score, CAST(CASE WHEN status IN ('valid', 'belowMinimum') THEN capped ELSE 0 END AS INT) AS score,
  CASE WHEN bad THEN 'more_than_four' WHEN len(flowers) >= 7 THEN 'flower_win' WHEN len(concealed) <> expected THEN 'tile_count' WHEN source IS NULL OR NOT confirmed THEN concat_ws(',', CASE WHEN source IS NULL THEN 'source_missing' END, CASE WHEN NOT confirmed THEN 'not_confirmed' END)
    WHEN source = 'robConcealedKong' AND NOT orphans THEN 'only_orphans_rob_concealed' WHEN NOT found THEN 'no_decomposition' WHEN status = 'belowMinimum' THEN 'below_minimum' WHEN raw > capped THEN 'capped' ELSE '' END AS messages FROM named_status),
h AS (SELECT hand_id, winner, discarder, dealer, continuations, CASE WHEN source = 'robConcealedKong' THEN 'robKong' ELSE source END AS source, replacement, family, CAST(NULL AS INT) AS liable_player, minimum, cap, 1 AS base, 2 AS unit, payment, score FROM scored WHERE status = 'valid'),
{settled},
paid AS (SELECT hand_id, CAST(sum(amount) AS BIGINT) AS total FROM tr GROUP BY hand_id)"""


_HAS = lambda *names: f"len(list_filter(shown, lambda x: x.id IN ({', '.join(repr(n) for n in names)}))) > 0"


@register(QUERIES, f"""WITH RECURSIVE {_score_sql()}
SELECT s.hand_id, status, messages, raw_score, score, array_to_string(list_sort(list_transform(shown, lambda x: x.id || ':' || x.value)), ',') AS patterns, CASE WHEN status = 'valid' THEN coalesce(total, 0) END AS total,
  CASE WHEN status <> 'valid' THEN '' ELSE concat_ws(',', CASE WHEN {_HAS('closedSelfDraw')} THEN 'closed_self_draw_includes_both' END, CASE WHEN NOT hk AND {_HAS('bigDragons', 'smallDragons')} THEN 'dragons_include_single_ones' END,
    CASE WHEN hk AND {_HAS(*LIMITS, 'orphans')} THEN 'limit_hand_stands_alone' END, CASE WHEN hk AND replacement = 'flower' THEN 'flower_replacement_scores_nothing' END) END AS notes FROM scored s LEFT JOIN paid USING (hand_id)""")
def hand_scores(spark, d):
    """Status, messages, patterns, score, payments and notes of each hand."""
    return score_hands(_full_hands(spark, d)).select("hand_id", "status", F.array_join("messages", ",").alias("messages"), "raw_score", "score", F.array_join(F.array_sort(F.transform("patterns", lambda p: F.concat_ws(":", p["id"], p["value"].cast("string")))), ",").alias("patterns"), F.aggregate("transfers", F.lit(0).cast("bigint"), lambda s, t: s + t["amount"]).alias("total"), F.array_join("notes", ",").alias("notes"))


@register(QUERIES, f"WITH RECURSIVE {_score_sql()} SELECT x.id, x.value, count(*) AS n FROM (SELECT unnest(shown) AS x FROM scored) GROUP BY ALL")
def hand_patterns(spark, d):
    return score_hands(_full_hands(spark, d)).select(F.explode("patterns").alias("p")).groupBy("p.id", "p.value").agg(F.count("*").alias("n"))


@register(QUERIES, f"WITH RECURSIVE {_score_sql()} SELECT status, count(*) AS n FROM scored GROUP BY status")
def hand_status(spark, d):
    return score_hands(_full_hands(spark, d)).groupBy("status").agg(F.count("*").alias("n"))


# Hands without melds whose other fields are partly out of their domains.
_ODD = {
    "hand_id": "o_orderkey", "winner": "CAST(o_orderkey % 5 AS INT)", "discarder": "CAST(o_custkey % 4 AS INT)", "dealer": "CAST(o_orderkey % 4 AS INT)", "round_wind": "CAST(o_custkey % 4 AS INT)", "continuations": "CAST(o_orderkey % 103 AS INT)",
    "source": "CASE o_custkey % 4 WHEN 0 THEN 'selfDraw' WHEN 1 THEN 'discard' WHEN 2 THEN 'robKong' END", "last_tile": "CASE o_orderkey % 7 WHEN 0 THEN 'draw' WHEN 1 THEN 'discard' ELSE 'none' END", "replacement": "CASE o_orderkey % 6 WHEN 0 THEN 'flower' WHEN 1 THEN 'kong' ELSE 'none' END",
    "kong_chain": "CAST(o_orderkey % 13 % 2 AS INT)", "heavenly": "(o_orderkey % 17 = 0)", "earthly": "(o_orderkey % 19 = 0)", "family": "CASE WHEN o_orderkey % 2 = 0 THEN 'hongKong' ELSE 'taiwanese' END",
    "tile": "CAST(o_custkey % 36 AS INT)", "winning_tile": "CAST(o_orderkey % 36 AS INT)", "minimum": "CAST(o_orderkey % 6 AS INT)", "cap": "CAST(o_custkey % 12 AS INT)", "unit": "CAST(o_orderkey % 3 AS INT)", "use_flowers": "(o_orderkey % 3 = 0)", "override_value": "CAST(o_custkey % 130 AS INT)",
}


def _odd(spark: SparkSession, d: str) -> DataFrame:
    return derive(table(spark, d, "orders"), _ODD).select("*", F.array_repeat("tile", 5).alias("concealed"), F.array().cast("array<struct<kind:string,tiles:array<int>>>").alias("melds"), F.array().cast("array<int>").alias("flowers"), F.lit(None).cast("int").alias("liable_player"), F.lit(0).alias("base"), F.create_map(F.lit("dragon"), F.col("override_value")).alias("overrides"))


@register(QUERIES, f"""
WITH h AS ({derive_sql('orders', _ODD)})
SELECT hand_id, concat_ws(',', CASE WHEN winner > 3 THEN 'seat_range' END, CASE WHEN continuations > 100 THEN 'continuations_range' END,
  CASE WHEN source IS NOT NULL AND source <> 'selfDraw' AND discarder = winner THEN 'discarder_is_winner' END, CASE WHEN tile > 33 THEN 'tile_range' END, CASE WHEN tile <= 33 THEN 'more_than_four' END,
  CASE WHEN source = 'robKong' AND winning_tile <= 33 AND winning_tile = tile THEN 'robbed_tile_held' END, CASE WHEN winning_tile <> tile THEN 'winning_tile_not_held' END,
  CASE WHEN last_tile = 'draw' AND coalesce(source, '') <> 'selfDraw' THEN 'last_draw_needs_self_draw' END, CASE WHEN last_tile = 'discard' AND coalesce(source, '') <> 'discard' THEN 'last_discard_needs_discard' END,
  CASE WHEN replacement <> 'none' AND coalesce(source, '') <> 'selfDraw' THEN 'replacement_needs_self_draw' END, CASE WHEN replacement = 'flower' THEN 'replacement_needs_flower' END,
  CASE WHEN kong_chain > 0 THEN 'kong_chain_over_kongs' END, CASE WHEN kong_chain > 0 THEN 'kong_chain_fed_twice' END, CASE WHEN replacement = 'kong' AND kong_chain < 1 THEN 'replacement_needs_kong' END,
  CASE WHEN replacement <> 'kong' AND kong_chain <> 0 THEN 'kong_chain_broken' END,
  CASE WHEN heavenly AND (winner <> dealer OR coalesce(source, '') <> 'selfDraw' OR replacement = 'kong') THEN 'heavenly' END,
  CASE WHEN earthly AND (winner = dealer OR coalesce(source, '') <> 'discard' OR discarder <> dealer) THEN 'earthly' END, CASE WHEN heavenly AND earthly THEN 'heavenly_and_earthly' END,
  CASE WHEN (heavenly OR earthly) AND last_tile <> 'none' THEN 'first_and_last' END, CASE WHEN family = 'taiwanese' AND (heavenly OR earthly) THEN 'family_without_first_wins' END) AS violations FROM h""")
def hand_violation_list(spark, d):
    return _odd(spark, d).select("hand_id", F.array_join(hand_violations(), ",").alias("violations"))


@register(QUERIES, f"""
WITH h AS ({derive_sql('orders', _ODD)})
SELECT hand_id, concat_ws(',', CASE WHEN minimum > cap THEN 'minimum_over_cap' END, CASE WHEN family = 'hongKong' AND (minimum < 3 OR cap > 10 OR cap < 3) THEN 'score_range' END,
  CASE WHEN family = 'taiwanese' AND cap < 1 THEN 'cap_range' END, CASE WHEN unit < 1 THEN 'base_or_unit_range' END, CASE WHEN override_value > 100 THEN 'override' END) AS violations FROM h""")
def rule_violation_list(spark, d):
    return _odd(spark, d).select("hand_id", F.array_join(rule_violations(), ",").alias("violations"))


# Saved hands as JSON lines: of 31 in a row, some are fine and each of the others is broken in one way.
def _doc() -> str:
    """The text of a saved hand as an expression that both engines read; w is the winner, a what each other player pays, m the way it is broken."""
    w, a, m = "CAST(event_id % 4 AS INT)", "(1 + user_id % 5)", "event_id % 31"
    text = lambda e: f"CAST({e} AS VARCHAR(20))"
    case = lambda *ways, other: "CASE " + " ".join(f"WHEN {m} = {k} THEN {v}" for k, v in ways) + f" ELSE {other} END"
    other = lambda k: text(f"(event_id + {k}) % 4")
    transfer = lambda k: f"""concat('{{"from":', {other(k)}, ',"to":', {text(w)}, ',"amount":', {text(a)}, ',"reason":"win"}}')"""
    odd = lambda source, to, amount: f"""concat('{{"from":{source},"to":', {to}, ',"amount":{amount},"reason":"odd"}}')"""
    balance = lambda i: f"CASE WHEN {w} = {i} THEN {text(f'3 * {a}')} ELSE {text(f'0 - {a}')} END"
    parts = [
        "'{\"id\":\"'", case((2, "''"), other=f"concat('h', {text('event_id')})"), "'\",\"date\":\"'", case((3, "'2024-05-01'"), (4, "'yesterday at noon'"), other="'2024-05-01T10:30:00.000'"),
        "'\",\"hand\":{\"concealed\":[0,0,0,9,9,9,18,18,18,27,27,27,'", case((7, "'40'"), (30, "'null'"), other="'31'"), "',31],\"melds\":['", case((25, "'{\"kind\":\"pong\",\"tiles\":[1,1,1]}'"), other="''"),
        "'],\"flowers\":[],\"winningTile\":31,\"source\":'", case((8, "'null'"), other="'\"selfDraw\"'"), "',\"winner\":'", case((6, "'7'"), other=text(w)),
        "',\"discarder\":0,\"dealer\":1,\"roundWind\":2,\"continuations\":0,\"lastTile\":\"none\",\"replacement\":\"none\",\"kongChain\":0,\"liablePlayer\":null,\"heavenly\":false,\"earthly\":false,\"circumstancesConfirmed\":'",
        case((9, "'false'"), other="'true'"), "'},\"rules\":{\"family\":\"'", case((23, "'sichuan'"), other="'hongKong'"), "'\",\"minimum\":'", case((5, "'11'"), other="'3'"), "',\"cap\":'", text("user_id % 3 + 8"),
        "',\"flowers\":true,\"base\":'", text("user_id % 2"), "',\"unit\":1,\"payment\":\"'", case((24, "'later'"), other="'preset'"), "'\"'", case((27, "''"), other="',\"overrides\":{\"dragon\":2}'"),
        "'},\"result\":{\"score\":'", case((11, "'-1'"), (12, "'9'"), other="'8'"), "',\"rawScore\":8,\"total\":'", case((19, "'1'"), (15, text(f"3 * {a} - 5")), other=text(f"3 * {a}")), "',\"engineVersion\":\"'", case((10, "''"), other="'1'"),
        "'\",\"balances\":['", balance(0), "','", balance(1), "','", balance(2), case((13, "''"), (14, "',\"x\"'"), (20, "',77'"), other=f"concat(',', {balance(3)})"),
        "'],\"patterns\":[{\"label\":\"p\",\"value\":'", case((21, "'-1'"), other="'8'"), case((22, "''"), other="',\"reason\":\"r\"'"), "'}]'",
        case((26, "''"), other="concat(',\"transfers\":[', " + ", ',', ".join(transfer(k) for k in (1, 2, 3)) + ", " + case((15, f"concat(',', {odd('0', text(w), -5)})"), (16, f"concat(',', {odd(0, text(f'({w} + 1) % 4'), 0)})"), (17, f"""concat(',{{"from":', {text(w)}, ',"to":', {text(w)}, ',"amount":0,"reason":"odd"}}')"""), (18, f"concat(',', {odd(4, text(w), 0)})"), (29, f"""concat(',{{"from":', {other(1)}, ',"to":', {text(w)}, ',"amount":0}}')"""), other="''") + ", ']')"),
        "'}}'",
    ]
    whole = f"concat({', '.join(parts)})"
    return f"CASE WHEN {m} = 1 THEN concat('{{\"id\":', {text('event_id')}) WHEN {m} = 28 THEN NULL ELSE {whole} END"


_SAVED = {"id": "event_id", "doc": _doc()}
_J = "json_extract(doc, '$.{}')"


def _is(path: str, *kinds: str) -> str:
    return f"coalesce(json_type(doc, '$.{path}') IN ({', '.join(repr(k) for k in kinds)}), false)"


_INT, _STR, _LIST = ("BIGINT", "UBIGINT"), ("VARCHAR",), ("ARRAY",)
_READABLE = " AND ".join(
    [*[_is(f"result.{k}", *_INT) for k in ("score", "rawScore", "total")], *[_is(f"result.{k}", *_LIST) for k in ("balances", "patterns", "transfers")], _is("id", *_STR), _is("hand.melds", *_LIST),
     "len(list_filter(list_transform(CAST(json_extract(doc, '$.result.balances') AS JSON[]), lambda x: coalesce(json_type(x), 'NULL')), lambda k: k NOT IN ('BIGINT', 'UBIGINT'))) = 0",
     "len(list_filter(CAST(json_extract(doc, '$.hand.concealed') AS JSON[]), lambda x: coalesce(json_type(x), 'NULL') NOT IN ('BIGINT', 'UBIGINT'))) = 0",
     "len(list_filter(CAST(json_extract(doc, '$.result.transfers') AS JSON[]), lambda t: json_extract(t, '$.from') IS NULL OR json_extract(t, '$.to') IS NULL OR json_extract(t, '$.amount') IS NULL OR json_extract(t, '$.reason') IS NULL)) = 0",
     "len(list_filter(CAST(json_extract(doc, '$.result.patterns') AS JSON[]), lambda t: json_extract(t, '$.label') IS NULL OR json_extract(t, '$.value') IS NULL OR json_extract(t, '$.reason') IS NULL)) = 0"])
_N = lambda path: f"CAST(json_extract(doc, '$.{path}') AS BIGINT)"
_S = lambda path: f"json_extract_string(doc, '$.{path}')"
_STATES = f"""s AS ({derive_sql('events', _SAVED)}), k AS (SELECT id, CASE WHEN coalesce(json_valid(doc), false) THEN doc ELSE '{{}}' END AS doc FROM s), r AS (SELECT *, coalesce({_READABLE}, false) AS readable FROM k),
moves AS (SELECT id, doc, unnest(CAST(json_extract(doc, '$.result.transfers') AS JSON[])) AS t FROM r WHERE readable),
moved AS (SELECT id, CAST(json_extract(t, '$.from') AS BIGINT) AS src, CAST(json_extract(t, '$.to') AS BIGINT) AS dst, CAST(json_extract(t, '$.amount') AS BIGINT) AS x, {_N('hand.winner')} AS w FROM moves),
booked AS (SELECT id, bool_or(src NOT BETWEEN 0 AND 3 OR dst <> w OR src = dst OR x < 0) AS bad, CAST(sum(x) AS BIGINT) AS total,
  [{', '.join(f"CAST(sum(CASE WHEN dst = {p} THEN x ELSE 0 END - CASE WHEN src = {p} THEN x ELSE 0 END) AS BIGINT)" for p in range(4))}] AS held FROM moved GROUP BY id),
states AS (SELECT r.id, r.doc, CASE WHEN NOT readable THEN 'unreadable'
  WHEN {_S('rules.family')} NOT IN ('hongKong', 'taiwanese') OR {_S('rules.payment')} NOT IN ('preset', 'fullEach', 'splitTotal') OR {_S('hand.melds[0].kind')} NOT IN ('chow', 'pung', 'openKong', 'closedKong', 'addedKong') THEN 'unknown_word'
  WHEN {_S('id')} = '' OR length({_S('date')}) < 16 OR NOT regexp_matches({_S('date')}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') THEN 'id_or_date' WHEN {_N('rules.minimum')} > {_N('rules.cap')} THEN 'rules'
  WHEN {_N('hand.winner')} > 3 OR list_max(CAST(json_extract(doc, '$.hand.concealed') AS BIGINT[])) > 33 THEN 'hand' WHEN {_S('hand.source')} IS NULL OR {_S('hand.circumstancesConfirmed')} = 'false' THEN 'incomplete'
  WHEN {_S('result.engineVersion')} = '' THEN 'engine_version' WHEN {_N('result.score')} < 0 OR {_N('result.total')} < 0 OR {_N('result.score')} > {_N('result.rawScore')} THEN 'score_range'
  WHEN json_array_length(doc, '$.result.balances') <> 4 THEN 'balances' WHEN b.bad THEN 'transfer' WHEN b.total <> {_N('result.total')} THEN 'total' WHEN b.held <> CAST(json_extract(doc, '$.result.balances') AS BIGINT[]) THEN 'not_settled'
  WHEN {_N('result.patterns[0].value')} < 0 THEN 'pattern' ELSE 'ok' END AS state FROM r LEFT JOIN booked b USING (id))"""


@register(QUERIES, f"WITH {_STATES} SELECT id, state FROM states")
def history_valid(spark, d):
    """Each saved hand and the first reason why it can't be taken."""
    return parse_history(derive(table(spark, d, "events"), _SAVED)).select("id", "state")


@register(QUERIES, f"""WITH {_STATES}, p AS (SELECT {_S('rules.base')} AS base, {_S('rules.cap')} AS cap, CAST(i AS INT) AS player, CAST(json_extract(doc, '$.result.balances[' || i || ']') AS BIGINT) AS x FROM states, range(4) t(i) WHERE state = 'ok')
SELECT '{{"base":' || base || ',"cap":' || cap || '}}' AS rule_key, player, CAST(sum(x) AS BIGINT) AS balance FROM p GROUP BY ALL""")
def history_balances_by_rules(spark, d):
    return balances_by_rules(parse_history(derive(table(spark, d, "events"), _SAVED)))


@register(QUERIES, "WITH x AS (SELECT event_id, ts FROM events WHERE event_id % 5 <> 0 UNION ALL SELECT event_id, ts FROM events WHERE event_id % 10 = 0) SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place FROM x")
def history_delete_undo(spark, d):
    events = table(spark, d, "events").select("event_id", "ts")
    return delete_and_undo(events, F.col("event_id") % 5 == 0, F.col("event_id") % 10 == 0, id_col="event_id", at_col="ts").select("event_id", "place")


@register(QUERIES, """SELECT event_type, sha256('{"base":' || (user_id % 3) || ',"overrides":{"chows":' || (user_id % 2) || ',"dragon":1},"payment":"' || event_type || '"}') AS key, count(*) AS n FROM events GROUP BY ALL""")
def rule_snapshot_keys(spark, d):
    rows = table(spark, d, "events").select("event_type", F.create_map(F.lit("dragon"), F.lit(1).cast("bigint"), F.lit("chows"), F.col("user_id") % 2).alias("overrides"), (F.col("user_id") % 3).alias("base"))
    return rows.select("event_type", F.sha2(rule_key(base=F.col("base"), payment=F.col("event_type"), overrides=F.col("overrides")), 256).alias("key")).groupBy("event_type", "key").agg(F.count("*").alias("n"))
