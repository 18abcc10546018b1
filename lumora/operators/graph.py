"""Connected components and cycles of a graph of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumora.operators.shared import cut


#: A node with more edges than this is a hub, whose edges aren't shuffled to one task; so many hubs at most are broadcast.
HUB_EDGES, MOST_HUBS = 100_000, 500_000


def _lowest(edges: DataFrame, low: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m of their u, from ``low`` (u, m, n: how many edges). Hubs' values are looked up where the edges are."""
    low = cut(low, "low")
    hubs = low.where(F.col("n") > HUB_EDGES).select("u", "m")
    if not 0 < hubs.count() <= MOST_HUBS:
        return edges.join(low.select("u", "m"), "u")
    rest = edges.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(low.where(F.col("n") <= HUB_EDGES).select("u", "m"), "u")
    return edges.join(F.broadcast(hubs), "u").unionByName(rest)


def components(links: DataFrame) -> DataFrame:
    """The smallest id that each id reaches over links (u, v): u, root; ids that are their own root are left out.

    Alternates two steps until nothing changes: every node passes the least of its neighbours to its larger ones,
    then to its smaller ones. The rounds grow with the logarithm of the longest chain. Minima are partial before the shuffle.
    """
    edges = cut(links.select("u", "v").where("u != v").distinct())
    before = None
    while True:
        sign = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if sign == before or not sign[0]:
            return edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("root"))
        before = sign
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
        up = _lowest(both, low).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = cut(up.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        edges = cut(_lowest(down, low).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())


def cycle_nodes(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """Nodes on a cycle of directed edges (src, dst), or on a path between cycles: node.

    Each round rakes and compresses: edges of a node without an edge in or without one out go, and of the nodes with one of
    each, every one whose hash of node and round is less than those of both neighbours gives way to an edge between them. A
    chain or a tree of n nodes is gone after some log(n) rounds, a cycle is a loop; only where paths part and meet again and again does
    a round take one layer. At last the edges that are left are spelled out again. ``rounds``, if given, gets the edges left after each round.
    """
    edges = cut(edges.select("src", "dst").distinct(), "edges")
    taken: list[DataFrame] = []
    while True:
        ends = edges.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(None).cast(edges.schema["src"].dataType).alias("pred"), F.col("dst").alias("succ"))
        ends = ends.unionByName(edges.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("src").alias("pred"), F.lit(None).cast(edges.schema["dst"].dataType).alias("succ")))
        seen = cut(ends.groupBy("node").agg(F.sum("i").alias("i"), F.sum("o").alias("o"), F.min("pred").alias("pred"), F.min("succ").alias("succ")).where("i = 0 OR o = 0 OR (i = 1 AND o = 1 AND pred != node)"), "ends")
        h = lambda c: F.xxhash64(F.col(c), F.lit(len(taken)))
        middle = F.expr("i = 1 AND o = 1")
        low = middle & (h("node") < h("pred")) & ((h("node") < h("succ")) | (F.col("pred") == F.col("succ")))
        out = seen.where(~middle | low).select("node", "pred", "succ", middle.alias("middle"))
        if not seen.head(1):
            break
        left = edges.join(out.select(F.col("node").alias("src")), "src", "left_anti").join(out.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst")
        way = out.where("middle").select("node", "pred", "succ")
        taken.append(cut(way, "taken"))
        edges = cut(left.unionByName(taken[-1].select(F.col("pred").alias("src"), F.col("succ").alias("dst"))).distinct(), "edges")
        if rounds is not None:
            rounds.append(edges.count())
    if edges.head(1):
        for way in reversed(taken):
            on = way.join(edges.select(F.col("src").alias("pred"), F.col("dst").alias("succ")), ["pred", "succ"], "left_semi")
            more = on.select(F.col("pred").alias("src"), F.col("node").alias("dst")).unionByName(on.select(F.col("node").alias("src"), F.col("succ").alias("dst")))
            edges = cut(edges.unionByName(more).distinct(), "edges")
    return edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
