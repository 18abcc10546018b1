"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed character n-grams. Each is scaled by the log ratio of its
smoothed share among toxic and other texts, and a logistic regression is fitted on the scaled
features. The fit takes a bounded sample of labelled rows, written to a table; the shares are counted
there by Spark, and the driver gets one bit of each row for each n-gram that tells the classes apart, of at most
``2 ** bits``. Scoring is one pass over the texts without a shuffle.

Nulls and odd rows: a null or empty text has no n-grams and gets the score of the bias alone; very long texts
are read in parts, with the same result; rows whose label is null, or whose id is null, are not learned from; a
document labelled more than once counts once, as its largest label; where rows share an id, one of their texts
is learned from (the first by a hash of the text), and each of the rows is scored; with labels of one class
only, or none, every score is that class's share (0 without labels). Rows with a null id are scored. An empty
table gives an empty result. Other columns of the input are ignored; a kept column with the name of the score
is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import cut, give_back, out_schema, release_after, small_batches
from lumora.llm.grams import Grams
from lumora.llm.linear import Rows, fit_sparse_logistic, sigmoid

#: Partitions of the table of labelled texts.
_FIT_TASKS = 16


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    orders: tuple[int, ...]
    bits: int
    info: dict = field(default_factory=dict)


def sample_labels(labels: DataFrame, id_col: str, label_col: str, per_class: int) -> DataFrame:
    """At most ``per_class`` ids of each class (0 and 1), the first in the order of a hash of the id."""
    one = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label_col).cast("int").alias("_y"))
    parts = [one.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(per_class) for y in (0, 1)]
    return parts[0].unionByName(parts[1])


def labelled_texts(docs: DataFrame, picked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table of one text and label of each picked id: _id, _y, _text. ``picked`` has a bounded number of rows, so it is broadcast."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(picked), "_id")
    one = rows.groupBy("_id", "_y").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    return cut(one.repartition(_FIT_TASKS, "_id"), "labelled")


def class_counts(texts: DataFrame, orders: tuple[int, ...], bits: int) -> DataFrame:
    """In how many texts of each class a bucket occurs: bucket, c0, c1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, count = Grams(orders, bits), np.zeros((2, 1 << bits), np.int32)
        for b in batches:
            for y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                count[y, grams.ids(t)] += 1  # distinct in a text
        on = np.flatnonzero(count.any(0))
        yield pa.record_batch([pa.array(on.astype(np.int32)), pa.array(count[0, on]), pa.array(count[1, on])], names=["bucket", "c0", "c1"])

    rows = texts.select("_y", "_text").mapInArrow(release_after(run), "bucket int, c0 int, c1 int")
    return rows.groupBy("bucket").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def log_count_ratio(c0: Column, c1: Column, n0: int, n1: int, alpha: float) -> Column:
    return F.log((c1 + alpha) / (n1 + 2 * alpha)) - F.log((c0 + alpha) / (n0 + 2 * alpha))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", keep: Column | None = None, per_class: int = 2000, orders: tuple[int, ...] = (3, 4, 5, 6), bits: int = 20, alpha: float = 1.0, least_df: int = 4, least_ratio: float = 0.25, least_surety: float = 2.0, l2: float = 3e-3) -> ToxicityModel:
    """Fit on at most ``2 * per_class`` labelled documents. N-grams that occur in at least ``least_df`` of them are learned from if their
    log-count ratio is at least ``least_ratio`` and ``least_surety`` times its standard error. ``keep``: a condition on the labels' rows to learn from."""
    spark = docs.sparkSession
    small_batches(spark)
    picked = sample_labels(labels if keep is None else labels.where(keep), id_col, label_col, per_class)
    texts = labelled_texts(docs, picked, id_col, text_col)
    n = {r["_y"]: r["n"] for r in texts.groupBy("_y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = n.get(0, 0), n.get(1, 0)
    if not n0 or not n1:
        share = n1 / max(1, n0 + n1)
        return ToxicityModel(np.zeros(1 << bits, np.float32), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))), orders, bits, {"rows": n0 + n1})
    told = class_counts(texts, orders, bits).withColumn("r", log_count_ratio(F.col("c0"), F.col("c1"), n0, n1, alpha))
    # others are too rare to tell, as common in both classes, or may differ by chance
    surety = F.abs("r") / F.sqrt(1 / (F.col("c0") + alpha) + 1 / (F.col("c1") + alpha))
    told = told.where((F.col("c0") + F.col("c1") >= least_df) & (F.abs("r") >= least_ratio) & (surety >= least_surety))
    got = told.select("bucket", "r").orderBy("bucket").toArrow()
    active, ratio = got["bucket"].to_numpy(), got["r"].to_numpy()
    place = np.full(1 << bits, -1, np.int32)
    place[active] = np.arange(len(active), dtype=np.int32)
    held = spark.sparkContext.broadcast(place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Grams(orders, bits)
        for b in batches:
            at = [held.value[grams.ids(t)] for t in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array([Rows.pack(np.sort(x[x >= 0]), len(active)) for x in at], pa.binary())], names=["_id", "_y", "row"])

    got = texts.select("_id", "_y", "_text").mapInArrow(release_after(run), f"_id {dict(texts.dtypes)['_id']}, _y int, row binary").toArrow().sort_by("_id")
    y = got["_y"].to_numpy().astype(float)
    rows = Rows(got["row"].to_pylist(), len(active))
    del got
    w = np.zeros(1 << bits, np.float32)
    fitted, bias = fit_sparse_logistic(rows, ratio, y, np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y), l2)
    w[active] = fitted * ratio
    del rows
    held.unpersist()
    give_back()
    return ToxicityModel(w, bias, orders, bits, {"rows": n0 + n1, "positives": n1, "features": len(active)})


def score_toxicity(docs: DataFrame, model: ToxicityModel, *, text_col: str = "text", score_col: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and a score from 0 to 1 of each whole text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias, model.orders, model.bits))
    rows = docs.select(*keep, F.col(text_col).alias("_score_text"))
    schema = out_schema(docs, keep, {score_col: F.lit(0.0).cast("double")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias, orders, bits = held.value
        grams = Grams(orders, bits)
        for b in batches:
            z = np.array([bias + weights[grams.ids(t)].sum(dtype=float) for t in b.column(b.num_columns - 1).to_pylist()], float)
            yield pa.record_batch([*b.columns[:-1], pa.array(sigmoid(z))], names=[*b.schema.names[:-1], score_col])

    return rows.mapInArrow(release_after(run), schema)
