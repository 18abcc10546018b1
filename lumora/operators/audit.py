"""Audits of data sets: duplicates, conflicts, leakage, groups, splits and their hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.operators.graph import components
from lumora.operators.ordered import group_hashes


def conflicts(rows: DataFrame, key: str, *values: str) -> DataFrame:
    """Keys with more than one combination of values: key, n. Keys are compared by a digest, so only those that conflict are shuffled whole."""
    digest = F.sha2(F.col(key).cast("string"), 256)
    bad = rows.groupBy(digest.alias("_d")).agg(F.count_distinct(F.struct(*values)).alias("n")).where("n > 1")
    whole = rows.select(digest.alias("_d"), key).join(bad, "_d")
    return whole.groupBy("_d", "n").agg(F.first(key).alias(key)).select(key, "n")


def keep_first(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key in an order: not any row, as dropDuplicates would give. All columns go through the shuffle: give long texts as digests."""
    return rows.groupBy(F.col(key).alias("_k")).agg(F.min_by(F.struct(*rows.columns), F.col(order)).alias("_r")).select("_r.*")


def exact_duplicates(rows: DataFrame, content: str) -> DataFrame:
    """Content hashes that occur more than once: sha, n."""
    return rows.groupBy(F.sha2(F.col(content), 256).alias("sha")).agg(F.count("*").alias("n")).where("n > 1")


def shared_key_links(rows: DataFrame, id_col: str, *keys: str) -> DataFrame:
    """Links (u, v) of each row to the smallest id that shares one of its keys; a null key links nothing."""
    melted = rows.select(F.col(id_col).alias("v"), F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(k).cast("string").alias("x")) for k in keys])).alias("e")).select("v", "e.k", "e.x").where("x is not null")
    first = melted.groupBy("k", "x").agg(F.min("v").alias("u"))
    return melted.join(first, ["k", "x"]).where("u != v").select("u", "v").distinct()


def grouped(rows: DataFrame, links: DataFrame, id_col: str) -> DataFrame:
    """Rows with ``root``: the smallest id of their component."""
    roots = components(links)
    return rows.join(roots.withColumnRenamed("u", id_col), id_col, "left").withColumn("root", F.coalesce("root", F.col(id_col)))


def group_ids(rows: DataFrame, id_col: str, root: str = "root") -> DataFrame:
    """A name for each group: the first 20 hex digits of the hash of its sorted ids, a line each. root, group_id, size."""
    return group_hashes(rows, by=root, id_col=id_col, between="\n").select(root, F.substring("digest", 1, 20).alias("group_id"), "size")


def leaking_groups(rows: DataFrame, root: str, split: str) -> DataFrame:
    """Groups with rows in more than one split: root, splits."""
    return rows.where(F.col(split).isNotNull()).groupBy(root).agg(F.count_distinct(split).alias("splits")).where("splits > 1")


def promote(rows: DataFrame, root: str, split: str) -> DataFrame:
    """One split for each group: train if any row is, else valid becomes dev, else internal_test. Adds ``to_split``."""
    by = rows.groupBy(root).agg(F.bool_or(F.col(split) == "train").alias("_t"), F.bool_or(F.col(split) == "valid").alias("_v"))
    return rows.join(by, root).withColumn("to_split", F.when(F.col("_t"), "train").when(F.col("_v"), "dev").otherwise("internal_test")).drop("_t", "_v")


def unit_value(*parts: Column) -> Column:
    """A value in [0, 1) from a hash of texts: its first 52 bits."""
    h = F.sha2(F.concat_ws("|", *parts), 256)
    return F.conv(F.substring(h, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def assign_split(value: Column, ratios: dict[str, float]) -> Column:
    """The split whose share of the cumulated weights holds a unit value; splits in order of their names."""
    total, at, out = sum(ratios.values()), 0.0, None
    for name in sorted(ratios):
        at += ratios[name]
        out = F.when(value * total < at, name) if out is None else out.when(value * total < at, name)
    return out.otherwise(sorted(ratios)[-1])


def weights_by_rarity(counts: DataFrame, n: str = "n") -> DataFrame:
    """Adds weight: 1 / sqrt(n) over its mean."""
    return counts.withColumn("weight", (1 / F.sqrt(F.col(n))) / F.avg(1 / F.sqrt(F.col(n))).over(Window.partitionBy()))
