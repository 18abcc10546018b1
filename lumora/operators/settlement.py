"""Payments of a scored hand, from columns of the hand and its rules to transfers and balances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Discard totals of scores 3 to 10 under the first rule family.
DISCARD_TABLE = {3: 32, 4: 64, 5: 96, 6: 128, 7: 192, 8: 256, 9: 384, 10: 512}
HONG_KONG, TAIWANESE = "hongKong", "taiwanese"


def settle(hands: DataFrame, *, score: str = "score") -> DataFrame:
    """Add ``transfers`` (from, to, amount, reason) to hands with winner, discarder, dealer, continuations, source,
    replacement, liable_player, family, minimum, cap, base, unit, payment and a score.

    Null where the input is invalid: a score outside the rules' range, no source, a player outside 0..3, a
    discarder who is the winner, or a liable player under rules without liability.
    """
    c = F.col
    hk = c("family") == HONG_KONG
    self_draw, robbed = c("source") == "selfDraw", c("source").isin("robKong", "robConcealedKong")
    players = F.sequence(F.lit(0), F.lit(3))
    table = F.create_map(*[x for k, v in DISCARD_TABLE.items() for x in (F.lit(k), F.lit(v))])
    value = F.element_at(table, c(score).cast("int")).cast("bigint") * c("unit")
    extra = 1 + 2 * c("continuations")

    def place(p: Column) -> Column:  # how far clockwise from the winner
        return F.pmod(p - c("winner"), F.lit(4))

    def split(total: Column, p: Column) -> Column:
        return F.floor(total / 3).cast("bigint") + F.when(place(p) <= total % 3, 1).otherwise(0)

    each = F.when(c("payment") == "fullEach", value).otherwise(F.floor(value / 2).cast("bigint"))
    drawn = F.when(c("payment") == "splitTotal", value).otherwise(3 * each)

    def hong_kong(p: Column) -> Column:
        of_draw = F.when(c("payment") == "splitTotal", split(value, p)).otherwise(each)
        liable = c("liable_player").isNotNull() & (c("replacement") != "kong")
        return (
            F.when(robbed, F.when(p == c("discarder"), drawn))
            .when(self_draw & liable, F.when(p == c("liable_player"), drawn))
            .when(self_draw, of_draw)
            .otherwise(F.when(p == c("discarder"), value))
        )

    def taiwanese(p: Column) -> Column:
        def amount(dealer: Column) -> Column:
            return c("base") + F.least(c(score) + F.when(dealer, extra).otherwise(0), c("cap")).cast("bigint") * c("unit")

        pays = amount((c("winner") == c("dealer")) | (p == c("dealer")))
        return F.when(self_draw, F.when(c("payment") == "splitTotal", split(amount(c("winner") == c("dealer")), p)).otherwise(pays)).when(p == c("discarder"), pays)

    reason = lambda p: F.when(robbed, "robbed_kong").when(hk & self_draw & (c("replacement") != "kong") & (c("liable_player") == p), "liability").when(self_draw, "self_draw").otherwise("discard")
    seats = [c(x).between(0, 3) for x in ("winner", "discarder", "dealer")]
    valid = c("source").isNotNull() & c(score).between(c("minimum"), c("cap")) & seats[0] & seats[1] & seats[2] & (self_draw | (c("winner") != c("discarder"))) & c("continuations").between(0, 100)
    valid = valid & (c("liable_player").isNull() | (hk & c("liable_player").between(0, 3) & (c("liable_player") != c("winner")))) & (~hk | c(score).between(3, 10))
    rows = F.transform(players, lambda p: F.struct(p.alias("from"), c("winner").alias("to"), F.when(p != c("winner"), F.when(hk, hong_kong(p)).otherwise(taiwanese(p))).alias("amount"), reason(p).alias("reason")))
    return hands.withColumn("transfers", F.when(valid, F.filter(rows, lambda t: t["amount"].isNotNull())))


def balances(transfers: Column) -> Column:
    """What each of the four players gains: money in less money out."""
    def gain(p: Column) -> Column:
        return F.aggregate(transfers, F.lit(0).cast("bigint"), lambda s, t: s + F.when(t["to"] == p, t["amount"]).otherwise(F.lit(0)) - F.when(t["from"] == p, t["amount"]).otherwise(F.lit(0)))

    return F.transform(F.sequence(F.lit(0), F.lit(3)), gain)


def explode_transfers(settled: DataFrame, *keep: str) -> DataFrame:
    return settled.select(*keep, F.inline("transfers"))
