"""Hand validation, pattern rules and best-variant scoring.

A hand is one row: hand_id, concealed array<int>, melds array<struct<kind,tiles>>, flowers array<int>,
winning_tile, source, winner, discarder, dealer, round_wind, continuations, last_tile, replacement, kong_chain,
liable_player, heavenly, earthly, confirmed, and its rules: family, minimum, cap, use_flowers, base, unit,
payment, overrides map<string,int>. Every rule is a column expression; decompositions come from joins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.functions.tiles import is_honor, is_terminal, is_thirteen_orphans, seat_wind
from lumora.operators.decompose import decompose, waits
from lumora.operators.shared import cut
from lumora.operators.settlement import HONG_KONG, TAIWANESE, settle

HAND = (
    "hand_id bigint, concealed array<int>, melds array<struct<kind:string,tiles:array<int>>>, flowers array<int>, winning_tile int, source string, winner int, discarder int, dealer int, "
    "round_wind int, continuations int, last_tile string, replacement string, kong_chain int, liable_player int, heavenly boolean, earthly boolean, confirmed boolean, "
    "family string, minimum int, cap int, use_flowers boolean, base int, unit int, payment string, overrides map<string,int>"
)
KONGS = ("openKong", "closedKong", "addedKong")
OPEN = ("chow", "pung", "openKong", "addedKong")

# What each pattern scores, by rule family. Those in FLOWERS_ONLY need rules with flowers,
# those in NO_FLOWERS_ONLY rules without.
VALUES = {
    HONG_KONG: {"chows": 1, "selfDraw": 1, "dragon": 1, "seatWind": 1, "roundWind": 1, "mixedTerminals": 1, "robKong": 1, "kongWin": 1, "lastDraw": 1, "halfFlush": 3, "allPungs": 3, "smallDragons": 3, "bigDragons": 5, "fullFlush": 7, "closed": 1, "noFlowers": 1, "seatFlower": 1, "flowerSet": 1},
    TAIWANESE: {"chows": 2, "selfDraw": 1, "closed": 1, "closedSelfDraw": 3, "dragon": 1, "seatWind": 1, "roundWind": 1, "robKong": 1, "kongWin": 1, "lastDraw": 1, "halfFlush": 4, "allPungs": 4, "smallDragons": 4, "bigDragons": 8, "fullFlush": 8, "threeConcealed": 2, "fourConcealed": 5, "fiveConcealed": 8, "singleWait": 1, "allExposed": 2, "allHonors": 16, "bigWinds": 16, "smallWinds": 8, "seatFlower": 1, "flowerSet": 2},
}
FLOWERS_ONLY = ("noFlowers", "seatFlower", "flowerSet")
NO_FLOWERS_ONLY = {HONG_KONG: ("closed",), TAIWANESE: ()}
# The limit hands of the first family, in the order in which the first that holds wins, 10 each.
LIMITS = ("allHonors", "bigWinds", "smallWinds", "fourHidden", "fourKongs", "allTerminals", "heavenly", "earthly", "doubleKongWin", "nineGates")

c = F.col


def in_hong_kong() -> Column:
    return c("family") == HONG_KONG


def self_drawn() -> Column:
    return c("source") == "selfDraw"


def robbed() -> Column:
    return c("source").isin("robKong", "robConcealedKong")


def group_count() -> Column:
    return F.when(in_hong_kong(), 4).otherwise(5)


def kong(m: Column) -> Column:
    return m["kind"].isin(*KONGS)


def open_meld(m: Column) -> Column:
    return m["kind"] != "closedKong"


def all_tiles() -> Column:
    """Concealed and melded tiles."""
    return F.concat("concealed", F.flatten(F.transform("melds", lambda m: m["tiles"])))


def _messages(rules: list[tuple[str, Column]]) -> Column:
    return F.filter(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules]), lambda x: x.isNotNull())


def rule_violations() -> Column:
    """Names of the rules' own constraints that a row breaks."""
    def allowed(family: str) -> Column:
        names = F.array(*[F.lit(n) for n in VALUES[family]])
        off = F.when(c("use_flowers"), F.array(*[F.lit(n) for n in NO_FLOWERS_ONLY[family]]).cast("array<string>")).otherwise(F.array(*[F.lit(n) for n in FLOWERS_ONLY]))
        return F.array_except(names, off)

    names = F.when(in_hong_kong(), allowed(HONG_KONG)).otherwise(allowed(TAIWANESE))
    return _messages([
        ("minimum_over_cap", (c("minimum") < 0) | (c("minimum") > c("cap"))),
        ("score_range", in_hong_kong() & ((c("minimum") < 3) | (c("cap") > 10) | (c("cap") < 3))),
        ("cap_range", ~in_hong_kong() & ~c("cap").between(1, 1000)),
        ("base_or_unit_range", ~c("unit").between(1, 1000000) | ~c("base").between(0, 1000000)),
        ("override", F.exists(F.map_entries("overrides"), lambda e: ~F.array_contains(names, e["key"]) | ~e["value"].between(0, 100))),
    ])


def hand_violations() -> Column:
    """Names of the constraints that a hand breaks, each once, in a fixed order."""
    n_kongs = F.size(F.filter("melds", kong))
    declared = F.size(F.filter("melds", lambda m: m["kind"].isin("closedKong", "addedKong")))
    fed = F.exists("melds", lambda m: m["kind"] == "openKong")
    tiles = all_tiles()
    same = lambda t: F.size(F.filter(tiles, lambda x: x == t))
    sized = lambda m: F.forall(m["tiles"], lambda t: t.between(0, 33)) & (F.size(m["tiles"]) == F.when(kong(m), 4).otherwise(3))

    def bad_chow(m: Column) -> Column:
        s = F.array_sort(m["tiles"])
        return (s[0] >= 27) | (F.floor(s[0] / 9) != F.floor(s[2] / 9)) | (s[1] != s[0] + 1) | (s[2] != s[1] + 1)

    dragon = lambda m: (m["kind"] != "chow") & (F.size(m["tiles"]) > 0) & F.get(m["tiles"], F.lit(0)).between(31, 33)
    dragons = F.filter("melds", dragon)
    twelve = (F.size("melds") == 4) & F.exists("melds", open_meld)
    exposed = (F.size(F.array_distinct(F.transform(dragons, lambda m: m["tiles"][0]))) == 3) & F.exists(dragons, open_meld)
    no_melds = F.size("melds") == 0
    return _messages([
        ("seat_range", ~(c("winner").between(0, 3) & c("discarder").between(0, 3) & c("dealer").between(0, 3) & c("round_wind").between(0, 3))),
        ("continuations_range", ~c("continuations").between(0, 100)),
        ("liable_player", c("liable_player").isNotNull() & (~c("liable_player").between(0, 3) | (c("liable_player") == c("winner")))),
        ("discarder_is_winner", c("source").isNotNull() & ~self_drawn() & (c("discarder") == c("winner"))),
        ("too_many_melds", F.size("melds") > group_count()),
        ("meld_tiles", F.exists("melds", lambda m: ~sized(m))),
        ("chow_shape", F.exists("melds", lambda m: F.when(sized(m) & (m["kind"] == "chow"), bad_chow(m)).otherwise(False))),
        ("pung_or_kong_shape", F.exists("melds", lambda m: sized(m) & (m["kind"] != "chow") & (F.size(F.array_distinct(m["tiles"])) != 1))),
        ("tile_range", F.exists(tiles, lambda t: ~t.between(0, 33))),
        ("more_than_four", F.exists(F.filter(tiles, lambda t: t.between(0, 33)), lambda t: same(t) > 4)),
        ("robbed_tile_held", robbed() & c("winning_tile").between(0, 33) & (same(c("winning_tile")) > 1)),
        ("flowers", F.exists("flowers", lambda t: ~t.between(34, 41)) | (F.size(F.array_distinct("flowers")) != F.size("flowers"))),
        ("flowers_not_used", ~c("use_flowers") & (F.size("flowers") > 0)),
        ("winning_tile_not_held", c("winning_tile").isNotNull() & ~F.exists("concealed", lambda t: t == c("winning_tile"))),
        ("last_draw_needs_self_draw", (c("last_tile") == "draw") & ~F.coalesce(self_drawn(), F.lit(False))),
        ("last_discard_needs_discard", (c("last_tile") == "discard") & (F.coalesce("source", F.lit("")) != "discard")),
        ("replacement_needs_self_draw", (c("replacement") != "none") & ~F.coalesce(self_drawn(), F.lit(False))),
        ("replacement_needs_flower", (c("replacement") == "flower") & (F.size("flowers") == 0)),
        ("kong_chain_over_kongs", (c("kong_chain") < 0) | (c("kong_chain") > n_kongs)),
        ("kong_chain_fed_twice", c("kong_chain") > declared + fed.cast("int")),
        ("replacement_needs_kong", (c("replacement") == "kong") & (c("kong_chain") < 1)),
        ("kong_chain_broken", (c("replacement") != "kong") & (c("kong_chain") != 0)),
        ("heavenly", c("heavenly") & ((c("winner") != c("dealer")) | ~F.coalesce(self_drawn(), F.lit(False)) | ~no_melds | (c("replacement") == "kong"))),
        ("earthly", c("earthly") & ((c("winner") == c("dealer")) | (F.coalesce("source", F.lit("")) != "discard") | (c("discarder") != c("dealer")) | ~no_melds)),
        ("heavenly_and_earthly", c("heavenly") & c("earthly")),
        ("first_and_last", (c("heavenly") | c("earthly")) & (c("last_tile") != "none")),
        ("family_without_first_wins", ~in_hong_kong() & (c("heavenly") | c("earthly"))),
        ("family_without_liability", ~in_hong_kong() & c("liable_player").isNotNull()),
        ("liability_needs_melds", in_hong_kong() & F.coalesce(self_drawn(), F.lit(False)) & c("liable_player").isNotNull() & ~twelve & ~exposed),
    ])


def _with_patterns(rows: DataFrame) -> DataFrame:
    """Adds ``patterns`` (id, value) to rows that also have pair, groups (kind, tile), role and n_waits.

    Facts that many rules share become columns first, so that plans stay small.
    """
    melds, groups = c("melds"), c("groups")
    rows = rows.withColumns({"_every": all_tiles(), "_triplets": F.concat(F.transform(F.filter(melds, lambda m: m["kind"] != "chow"), lambda m: m["tiles"][0]), F.transform(F.filter(groups, lambda g: g["kind"] == "pung"), lambda g: g["tile"])), "_hk": in_hong_kong(), "_sd": F.coalesce(self_drawn(), F.lit(False)), "_rob": F.coalesce(robbed(), F.lit(False))})
    every, triplets, hk, sd = c("_every"), c("_triplets"), c("_hk"), c("_sd")
    rows = rows.withColumns({"_kinds": F.array_distinct(triplets), "_suits": F.array_distinct(F.transform(F.filter(every, lambda t: t < 27), lambda t: F.floor(t / 9)))})
    kinds, suits = c("_kinds"), c("_suits")
    honors = F.exists(every, is_honor)
    closed = F.forall(melds, lambda m: ~open_meld(m))
    n_dragons = F.size(F.filter(kinds, lambda t: t >= 31))
    n_winds = F.size(F.filter(kinds, lambda t: t.between(27, 30)))
    wind_pair, dragon_pair = c("pair").between(27, 30), c("pair") >= 31
    hidden = F.size(F.filter(groups, lambda g: g["kind"] == "pung")) + F.size(F.filter(melds, lambda m: m["kind"] == "closedKong")) - (c("role") == "pung").cast("int")
    n_kongs, no_melds = F.size(F.filter(melds, kong)), F.size(melds) == 0
    flush = F.size(suits) == 1
    seat = 27 + seat_wind(c("winner"), c("dealer"))
    facts = {"_honors": honors, "_closed": closed, "_nd": n_dragons, "_nw": n_winds, "_hidden": hidden, "_nk": n_kongs, "_seat": seat}
    rows = rows.withColumns(facts)
    honors, closed, n_dragons, n_winds, hidden, n_kongs, seat = (c(x) for x in facts)
    rank_count = lambda r: F.size(F.filter(every, lambda t: t % 9 == r))
    win_rank = c("winning_tile") % 9
    gates = lambda less: F.forall(F.sequence(F.lit(0), F.lit(8)), lambda r: rank_count(r) - less(r) >= F.when(r.isin(0, 8), 3).otherwise(1))
    nine = no_melds & flush & ~honors & gates(lambda r: F.lit(0)) & (sd | gates(lambda r: (r == win_rank).cast("int")))
    limit = {
        "allHonors": F.size(suits) == 0, "bigWinds": n_winds == 4, "smallWinds": (n_winds == 3) & wind_pair, "fourHidden": (hidden == 4) & (n_kongs == 0), "fourKongs": n_kongs == 4,
        "allTerminals": F.forall(every, is_terminal), "heavenly": c("heavenly"), "earthly": c("earthly"), "doubleKongWin": c("kong_chain") >= 2, "nineGates": nine,
    }
    rows = rows.withColumn("_limit", F.coalesce(*[F.when(limit[x], F.lit(x)) for x in LIMITS]))
    first_limit = c("_limit")

    def add(name: str, cond: Column, times: Column | None = None) -> Column:
        default = F.when(hk, VALUES[HONG_KONG].get(name, 0)).otherwise(VALUES[TAIWANESE].get(name, 0))
        value = F.coalesce(F.element_at("overrides", F.lit(name)), default)
        n = F.when(cond & (value > 0), F.lit(1) if times is None else times).otherwise(0)
        return F.array_repeat(F.struct(F.lit(name).alias("id"), value.alias("value")), n)

    three_dragons, two_dragons = n_dragons == 3, (n_dragons == 2) & dragon_pair
    exposed = (F.size(melds) == 5) & F.forall(melds, open_meld) & ~sd
    tw_chows = ~honors & (F.size("flowers") == 0) & ~sd & (c("n_waits") > 1) & (c("role") == "chow")
    flower_sets = sum((F.forall(F.array(*[F.lit(s + i) for i in range(4)]), lambda f: F.array_contains("flowers", f)).cast("int") for s in (34, 38)), F.lit(0))
    closed_draw = ~hk & closed & sd
    ordinary = F.concat(
        add("halfFlush", flush & honors), add("fullFlush", flush & ~honors), add("allHonors", ~hk & (F.size(suits) == 0)), add("allPungs", F.size(triplets) == group_count()),
        add("bigDragons", three_dragons), add("smallDragons", two_dragons), add("dragon", hk | ~(three_dragons | two_dragons), n_dragons),
        add("seatWind", F.exists(kinds, lambda t: t == seat)), add("roundWind", F.exists(kinds, lambda t: t == 27 + c("round_wind"))),
        add("mixedTerminals", hk & F.forall(every, lambda t: is_terminal(t) | is_honor(t))), add("chows", (F.size(triplets) == 0) & (hk | tw_chows)),
        add("closedSelfDraw", closed_draw), add("closed", F.when(hk, ~c("use_flowers") & no_melds).otherwise(closed & ~closed_draw)), add("selfDraw", sd & ~closed_draw),
        *[add(x, ~hk & (hidden == n)) for x, n in (("threeConcealed", 3), ("fourConcealed", 4), ("fiveConcealed", 5))],
        add("allExposed", ~hk & exposed), add("singleWait", ~hk & ~exposed & (c("n_waits") == 1)), add("bigWinds", ~hk & (n_winds == 4)), add("smallWinds", ~hk & (n_winds == 3) & wind_pair),
        add("noFlowers", hk & c("use_flowers") & (F.size("flowers") == 0)),
        add("seatFlower", c("use_flowers"), F.size(F.filter("flowers", lambda f: (f - 34) % 4 == seat - 27))), add("flowerSet", c("use_flowers"), flower_sets),
        add("robKong", c("_rob")), add("kongWin", (c("replacement") == "kong") | (~hk & (c("replacement") == "flower"))), add("lastDraw", c("last_tile") == "draw"),
    )
    patterns = F.when(hk & first_limit.isNotNull(), F.array(F.struct(first_limit.alias("id"), F.lit(10).alias("value")))).otherwise(ordinary)
    return rows.withColumn("patterns", patterns)


def _roles() -> Column:
    """The places a winning tile can have in a decomposition."""
    held = lambda kind: F.exists("groups", lambda g: (g["kind"] == kind) & F.when(g["kind"] == "pung", g["tile"] == c("winning_tile")).otherwise(c("winning_tile").between(g["tile"], g["tile"] + 2)))
    others = F.filter(F.array(F.when(c("pair") == c("winning_tile"), F.lit("pair")), F.when(held("chow"), F.lit("chow")), F.when(held("pung"), F.lit("pung"))), lambda x: x.isNotNull())
    return F.when(self_drawn(), F.array(F.lit("selfDraw"))).otherwise(others)


def score_hands(hands: DataFrame) -> DataFrame:
    """hand_id, status, messages, patterns (id, value), raw_score, score, transfers and notes of each hand.

    Of all decompositions and places of the winning tile the best total counts; ties go to the first in order of
    pair, groups and place. Hands are joined by their id, which must be unique.
    """
    checked = hands.withColumn("_bad", F.concat(rule_violations(), hand_violations())).withColumn("_left", group_count() - F.size("melds"))
    expected = c("_left") * 3 + 2
    orphans = in_hong_kong() & (F.size("melds") == 0) & is_thirteen_orphans(c("concealed"))
    complete = (F.size("_bad") == 0) & (F.size("flowers") < 7) & (F.size("concealed") == expected) & c("source").isNotNull() & c("winning_tile").isNotNull() & c("confirmed")
    checked = checked.withColumn("_orphans", F.coalesce(orphans, F.lit(False))).withColumn("_complete", F.coalesce(complete, F.lit(False)))
    checked = cut(checked, "hands")  # the checks are long expressions: evaluate and plan them once
    fit = checked.where("_complete")
    parts = decompose(fit.withColumn("n_groups", c("_left")))
    at = F.expr("array_position(concealed, winning_tile)").cast("int")
    before = F.concat(F.slice("concealed", F.lit(1), at - 1), F.slice("concealed", at + 1, F.size("concealed")))
    tw = fit.where(~in_hong_kong()).select("hand_id", before.alias("before"), F.flatten(F.transform("melds", lambda m: m["tiles"])).alias("meld_tiles"), c("_left").alias("n_groups"))
    n_waits = waits(tw).groupBy("hand_id").agg(F.count("*").cast("int").alias("n_waits"))
    variants = fit.join(parts, "hand_id").join(n_waits, "hand_id", "left").withColumn("n_waits", F.coalesce("n_waits", F.lit(0))).withColumn("role", F.explode(_roles()))
    variants = _with_patterns(variants).select("hand_id", F.struct("pair", F.to_json("groups").alias("g"), "role").alias("_ord"), "patterns")
    special = fit.where("_orphans").select("hand_id", F.struct(F.lit(-1).alias("pair"), F.lit("").alias("g"), F.lit("").alias("role")).alias("_ord"), F.array(F.struct(F.lit("orphans").alias("id"), F.lit(10).alias("value"))).alias("patterns"))
    total = F.aggregate("patterns", F.lit(0), lambda s, p: s + p["value"])
    best = variants.unionByName(special).withColumn("raw", total).groupBy("hand_id").agg(F.min_by(F.struct("patterns", "raw"), F.struct((-c("raw")).alias("r"), "_ord")).alias("_best"))
    got = checked.join(best, "hand_id", "left").withColumn("raw_score", F.coalesce("_best.raw", F.lit(0))).withColumn("score", F.least("raw_score", "cap"))
    concealed_only = c("source") == "robConcealedKong"
    status = (
        F.when(F.size("_bad") > 0, "invalid").when(F.size("flowers") >= 7, "needsContext").when(F.size("concealed") < expected, "incomplete").when(F.size("concealed") > expected, "invalid")
        .when(~c("_complete"), "needsContext").when(concealed_only & ~c("_orphans"), "invalid").when(c("_best").isNull(), "invalid").when(c("score") < c("minimum"), "belowMinimum").otherwise("valid")
    )
    got = got.withColumn("status", status)
    scored = c("status").isin("valid", "belowMinimum")
    got = got.withColumn("patterns", F.when(scored, c("_best.patterns")).otherwise(F.array().cast("array<struct<id:string,value:int>>")))
    for x in ("raw_score", "score"):
        got = got.withColumn(x, F.when(scored, c(x)).otherwise(0))
    has = lambda *names: F.exists("patterns", lambda p: p["id"].isin(*names))
    valid = c("status") == "valid"
    notes = _messages([
        ("closed_self_draw_includes_both", valid & has("closedSelfDraw")), ("dragons_include_single_ones", valid & ~in_hong_kong() & has("bigDragons", "smallDragons")),
        ("limit_hand_stands_alone", valid & in_hong_kong() & has(*LIMITS, "orphans")), ("flower_replacement_scores_nothing", valid & in_hong_kong() & (c("replacement") == "flower")),
    ])
    messages = (
        F.when(F.size("_bad") > 0, c("_bad")).when(F.size("flowers") >= 7, F.array(F.lit("flower_win"))).when(F.size("concealed") != expected, F.array(F.lit("tile_count")))
        .when(~c("_complete"), _messages([("source_missing", c("source").isNull()), ("not_confirmed", ~F.coalesce("confirmed", F.lit(False))), ("winning_tile_missing", c("winning_tile").isNull())]))
        .when(concealed_only & ~c("_orphans"), F.array(F.lit("only_orphans_rob_concealed"))).when(c("_best").isNull(), F.array(F.lit("no_decomposition")))
        .when(c("status") == "belowMinimum", F.array(F.lit("below_minimum"))).when(c("raw_score") > c("score"), F.array(F.lit("capped"))).otherwise(F.array().cast("array<string>"))
    )
    got = settle(got).withColumn("transfers", F.when(valid, c("transfers")))
    return got.select("hand_id", "status", messages.alias("messages"), "patterns", "raw_score", "score", "transfers", notes.alias("notes"))

