"""Saved hands: tolerant reading, checks, deletion with undo, and balances by rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumora.operators.ordered import running_sums
from lumora.operators.scoring import hand_violations, rule_violations
from lumora.operators.settlement import HONG_KONG, TAIWANESE
from lumora.operators.shared import cut

# The fields of a saved hand by their names in JSON, and the words of its enumerations.
MELD = "struct<kind:string,tiles:array<int>>"
HAND = (
    f"struct<concealed:array<int>,melds:array<{MELD}>,flowers:array<int>,winningTile:int,source:string,winner:int,discarder:int,dealer:int,roundWind:int,continuations:int,"
    "lastTile:string,replacement:string,kongChain:int,liablePlayer:int,heavenly:boolean,earthly:boolean,circumstancesConfirmed:boolean>"
)
RULES = "struct<family:string,minimum:int,cap:int,flowers:boolean,base:int,unit:int,payment:string,overrides:map<string,int>,version:string>"
PATTERN, TRANSFER = "struct<label:string,value:bigint,reason:string>", "struct<from:int,to:int,amount:bigint,reason:string>"
RESULT = f"struct<score:bigint,rawScore:bigint,total:bigint,engineVersion:string,balances:array<bigint>,patterns:array<{PATTERN}>,transfers:array<{TRANSFER}>>"
SAVED = f"struct<id:string,date:string,hand:{HAND},rules:{RULES},result:{RESULT}>"
WORDS = {
    "rules.family": (HONG_KONG, TAIWANESE), "rules.payment": ("preset", "fullEach", "splitTotal"), "hand.source": ("selfDraw", "discard", "robAddedKong", "robConcealedKong"),
    "hand.lastTile": ("none", "draw", "discard"), "hand.replacement": ("none", "flower", "kong"),
}
KINDS = ("chow", "pung", "openKong", "closedKong", "addedKong")
#: Fields that may be null or absent.
NULLABLE = frozenset({"hand.winningTile", "hand.source", "hand.liablePlayer", "rules.overrides", "rules.version"})
#: A date that may be read, out of range values included.
DATE = r"\A[+-]?\d{4,6}-?\d\d-?\d\d([ T]\d\d(:?\d\d(:?\d\d([.,]\d+)?)?)?( ?[zZ]| ?[-+]\d\d(:?\d\d)?)?)?\z"
#: Reasons for which a saved hand isn't taken, in the order in which they are looked for.
REASONS = (
    "unreadable", "unknown_word", "id_or_date", "rules", "hand", "incomplete", "engine_version", "score_range", "balances", "transfer", "total", "not_settled", "pattern",
)


def rule_key(**values: Column) -> Column:
    """JSON of named values with keys in order, maps with sorted keys: a text to group equal rules by."""
    sorted_map = lambda m: F.map_from_entries(F.array_sort(F.map_entries(m)))
    return F.to_json(F.struct(*[(sorted_map(values[k]) if k == "overrides" else values[k]).alias(k) for k in sorted(values)]))


def encode_saved(hand: Column, rules: Column, result: Column, *, id: Column, date: Column) -> Column:  # noqa: A002
    """JSON of a saved hand from structs of ``HAND``, ``RULES`` and ``RESULT``; nulls are written."""
    return F.to_json(F.struct(id.alias("id"), date.alias("date"), hand.cast(HAND).alias("hand"), rules.cast(RULES).alias("rules"), result.cast(RESULT).alias("result")), {"ignoreNullFields": "false"})


def _fields(saved: Column) -> Column:
    """Whether all fields are there that have to be."""
    there = saved["id"].isNotNull() & saved["date"].isNotNull()
    for part, kind in (("hand", HAND), ("rules", RULES), ("result", RESULT)):
        for f in T.StructType.fromDDL(f"x {kind}")["x"].dataType.fields:
            if f"{part}.{f.name}" in NULLABLE:
                continue
            there = there & saved[part][f.name].isNotNull()
            if isinstance(f.dataType, T.ArrayType):
                there = there & ~F.exists(saved[part][f.name], lambda x: x.isNull())
    whole = lambda of, kind: F.forall(of, lambda x: F.greatest(*[x[f.name].isNull() for f in T.StructType.fromDDL(f"x {kind}")["x"].dataType.fields]) == F.lit(False))
    tiles = F.forall(saved["hand"]["melds"], lambda m: m["kind"].isNotNull() & m["tiles"].isNotNull() & F.forall(m["tiles"], lambda t: t.isNotNull()))
    return F.coalesce(there & tiles & whole(saved["result"]["transfers"], TRANSFER) & whole(saved["result"]["patterns"], PATTERN), F.lit(False))


def ledger(transfers: Column) -> Column:
    """What each of four players has after transfers."""
    moved = lambda p: F.aggregate(transfers, F.lit(0).cast("bigint"), lambda s, x: s + F.when(x["to"] == p, x["amount"]).otherwise(0) - F.when(x["from"] == p, x["amount"]).otherwise(0))
    return F.array(*[moved(p) for p in range(4)])


def parse_history(rows: DataFrame, doc_col: str = "doc") -> DataFrame:
    """Adds ``saved`` (a struct of ``SAVED``, null where unreadable) and ``state``: 'ok' or the first of ``REASONS``. Nothing is dropped, so
    a later write can keep what can't be read. A score is not worked out again: it keeps the version of its engine."""
    if {"saved", "state", "_read", *_VALIDATED} & set(rows.columns):
        raise ValueError("the columns saved, state, _read and those of hands are added for a time: rename them")
    schema = f"{SAVED[7:-1].replace('id:string,date:string', 'id string, date string', 1)}, _corrupt string".replace(",hand:", ", hand ").replace(",rules:", ", rules ").replace(",result:", ", result ")
    read = F.from_json(F.col(doc_col), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    parsed = rows.withColumn("_read", read)
    s = F.col("_read")
    parsed = parsed.withColumns({name: at(s) for name, at in _VALIDATED.items()})
    hand, rules, result = s["hand"], s["rules"], s["result"]
    words = F.forall(hand["melds"], lambda m: m["kind"].isin(*KINDS))
    for path, allowed in WORDS.items():
        part, name = path.split(".")
        words = words & F.coalesce(s[part][name].isin(*allowed), F.lit(True))
    of = result["transfers"]
    bad = F.exists(of, lambda t: ~t["from"].between(0, 3) | (t["to"] != hand["winner"]) | (t["from"] == t["to"]) | (t["amount"] < 0))
    total = F.aggregate(of, F.lit(0).cast("bigint"), lambda a, t: a + t["amount"])
    fails = dict(zip(REASONS, (
        s.isNull() | s["_corrupt"].isNotNull() | ~_fields(s), ~words, (s["id"] == "") | (F.length(s["date"]) < 16) | ~s["date"].rlike(DATE), F.size(rule_violations()) > 0, F.size(hand_violations()) > 0,
        hand["source"].isNull() | hand["winningTile"].isNull() | ~hand["circumstancesConfirmed"], result["engineVersion"] == "",
        (F.least(result["score"], result["rawScore"], result["total"]) < 0) | (result["score"] > result["rawScore"]), F.size(result["balances"]) != 4, bad, total != result["total"],
        ledger(of) != result["balances"], F.exists(result["patterns"], lambda p: p["value"] < 0),
    ), strict=True))
    state = F.lit("ok")
    for reason in reversed(REASONS):
        state = F.when(F.coalesce(fails[reason], F.lit(False)), reason).otherwise(state)
    readable = F.when(s["_corrupt"].isNull() & _fields(s), F.struct(s["id"].alias("id"), s["date"].alias("date"), hand.alias("hand"), rules.alias("rules"), result.alias("result")))
    return parsed.withColumns({"state": state, "saved": readable}).select(*rows.columns, "saved", "state")


#: Columns that the validators of hands and rules read, from a parsed hand.
_VALIDATED = {
    "concealed": lambda s: s["hand"]["concealed"], "melds": lambda s: s["hand"]["melds"], "flowers": lambda s: s["hand"]["flowers"], "winning_tile": lambda s: s["hand"]["winningTile"],
    "source": lambda s: F.when(s["hand"]["source"] == "robAddedKong", "robKong").otherwise(s["hand"]["source"]), "winner": lambda s: s["hand"]["winner"], "discarder": lambda s: s["hand"]["discarder"], "dealer": lambda s: s["hand"]["dealer"],
    "round_wind": lambda s: s["hand"]["roundWind"], "continuations": lambda s: s["hand"]["continuations"], "last_tile": lambda s: s["hand"]["lastTile"], "replacement": lambda s: s["hand"]["replacement"],
    "kong_chain": lambda s: s["hand"]["kongChain"], "liable_player": lambda s: s["hand"]["liablePlayer"], "heavenly": lambda s: s["hand"]["heavenly"], "earthly": lambda s: s["hand"]["earthly"],
    "family": lambda s: s["rules"]["family"], "minimum": lambda s: s["rules"]["minimum"], "cap": lambda s: s["rules"]["cap"], "use_flowers": lambda s: s["rules"]["flowers"], "base": lambda s: s["rules"]["base"],
    "unit": lambda s: s["rules"]["unit"], "payment": lambda s: s["rules"]["payment"], "overrides": lambda s: F.coalesce(s["rules"]["overrides"], F.create_map().cast("map<string,int>")),
}


def balances_by_rules(history: DataFrame) -> DataFrame:
    """Summed balances of each player under each set of rules, of readable hands: rule_key, player, balance."""
    # written first: a filter on the state would go below the reading and read each text once for every rule
    held = cut(history.select("state", rule_key(base=F.col("saved.rules.base"), cap=F.col("saved.rules.cap")).alias("rule_key"), F.col("saved.result.balances").alias("x")), "history")
    rows = held.where("state = 'ok'").select("rule_key", F.posexplode("x").alias("player", "x"))
    return rows.groupBy("rule_key", "player").agg(F.sum("x").alias("balance"))


def delete_and_undo(history: DataFrame, delete: Column, undo: Column, *, id_col: str, at_col: str) -> DataFrame:
    """Delete rows, put some back, and number the rest from the newest: adds ``place``. The numbering is a running count over ranges of
    time, so that no single task sorts the whole table."""
    kept = history.where(~delete).unionByName(history.where(delete & undo))
    return running_sums(kept, by=[], order=[F.desc(at_col), F.desc(id_col)], sums={"place": F.lit(1)})
