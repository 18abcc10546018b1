"""Queries on rates, bounds, percentiles, sweeps and confusion."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.functions.metrics import Z95, fitness, ratio, selective, wilson, zero_failure_bound
from lumora.operators.audit import weights_by_rarity
from lumora.operators.ordered import percentiles
from lumora.plans.base import register, table

QUERIES: dict = {}

# A predictor of quality by length, with a confidence; both from documents.
_PRED = "p AS (SELECT d.doc_id, d.lang, l.quality AS actual, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS pred, CAST(d.n_chars % 100 AS DOUBLE) / 100 AS conf FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _pred(spark, d):
    docs, labels = table(spark, d, "documents").select("doc_id", "lang", "n_chars"), table(spark, d, "labels").select("doc_id", F.col("quality").alias("actual"))
    return docs.join(labels, "doc_id").select("doc_id", "lang", "actual", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("pred"), ((F.col("n_chars") % 100).cast("double") / 100).alias("conf"))


@register(QUERIES, f"WITH {_PRED} SELECT actual, pred, count(*) AS n FROM p GROUP BY ALL")
def confusion(spark, d):
    return _pred(spark, d).groupBy("actual", "pred").agg(F.count("*").alias("n"))


@register(QUERIES, f"""WITH {_PRED}, c AS (SELECT k.range AS cls, count(CASE WHEN actual = k.range AND pred = k.range THEN 1 END) AS tp, count(CASE WHEN actual <> k.range AND pred = k.range THEN 1 END) AS fp, count(CASE WHEN actual = k.range AND pred <> k.range THEN 1 END) AS fn FROM range(3) k CROSS JOIN p GROUP BY 1)
SELECT CAST(cls AS INT) AS cls, tp, fp, fn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END, 6) AS prec, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END, 6) AS recall FROM c""")
def per_class_counts(spark, d):
    """Every class of the domain, also those without rows: counts of 0 and null rates."""
    p = _pred(spark, d)
    rows = p.select(F.explode(F.array_distinct(F.array("actual", "pred"))).alias("cls"), "actual", "pred")
    c = rows.groupBy("cls").agg(F.count(F.when((F.col("actual") == F.col("cls")) & (F.col("pred") == F.col("cls")), 1)).alias("tp"), F.count(F.when((F.col("actual") != F.col("cls")) & (F.col("pred") == F.col("cls")), 1)).alias("fp"), F.count(F.when((F.col("actual") == F.col("cls")) & (F.col("pred") != F.col("cls")), 1)).alias("fn"))
    dim = spark.range(3).select(F.col("id").cast("int").alias("cls"))
    full = dim.join(c, "cls", "left").fillna(0, ["tp", "fp", "fn"])
    return full.select("cls", "tp", "fp", "fn", F.round(ratio(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("prec"), F.round(ratio(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))


@register(QUERIES, f"WITH {_PRED}, r AS (SELECT actual, avg(CASE WHEN actual = pred THEN 1.0::DOUBLE ELSE 0 END) AS recall, count(*) AS n, count(CASE WHEN actual = pred THEN 1 END) AS hit FROM p GROUP BY actual) SELECT round(avg(recall), 6) AS macro_recall, round(sum(hit) / greatest(1, sum(n)), 6) AS accuracy FROM r")
def macro_recall(spark, d):
    hit = F.count(F.when(F.col("actual") == F.col("pred"), 1))
    by = _pred(spark, d).groupBy("actual").agg(F.count("*").alias("n"), hit.alias("hit"))
    return by.agg(F.round(F.avg(F.col("hit") / F.col("n")), 6).alias("macro_recall"), F.round(F.sum("hit") / F.greatest(F.lit(1), F.sum("n")), 6).alias("accuracy"))


@register(QUERIES, f"""WITH {_PRED}, t AS (SELECT CAST(range AS DOUBLE) / 10 AS threshold FROM range(11))
SELECT threshold, count(CASE WHEN conf >= threshold THEN 1 END) AS accepted, count(CASE WHEN conf >= threshold AND actual <> pred THEN 1 END) AS wrong, round(count(CASE WHEN conf >= threshold THEN 1 END) / count(*), 6) AS coverage,
round(CASE WHEN count(CASE WHEN conf >= threshold THEN 1 END) > 0 THEN 1 - count(CASE WHEN conf >= threshold AND actual <> pred THEN 1 END) / count(CASE WHEN conf >= threshold THEN 1 END) END, 6) AS accuracy FROM t CROSS JOIN p GROUP BY threshold""")
def threshold_sweep(spark, d):
    """One pass: each row adds to the eleven thresholds that it reaches."""
    cuts = F.array(*[F.lit(i / 10) for i in range(11)])
    rows = _pred(spark, d).select("conf", "actual", "pred", F.explode(cuts).alias("threshold"))
    on = F.col("conf") >= F.col("threshold")
    g = rows.groupBy("threshold").agg(F.count(F.when(on, 1)).alias("accepted"), F.count(F.when(on & (F.col("actual") != F.col("pred")), 1)).alias("wrong"), F.count("*").alias("n"))
    return g.select("threshold", "accepted", "wrong", F.round(F.col("accepted") / F.col("n"), 6).alias("coverage"), F.round(1 - ratio(F.col("wrong"), F.col("accepted")), 6).alias("accuracy"))


_W = "(s / n + {z}::DOUBLE * {z}::DOUBLE / (2 * n)) / (1 + {z}::DOUBLE * {z}::DOUBLE / n)"
_HALF = "{z}::DOUBLE * sqrt(s / n * (1 - s / n) / n + {z}::DOUBLE * {z}::DOUBLE / (4 * n * n)) / (1 + {z}::DOUBLE * {z}::DOUBLE / n)"


def _wilson_sql(z: str) -> str:
    return f"round(greatest(0.0, {_W.format(z=z)} - {_HALF.format(z=z)}), 6), round(least(1.0, {_W.format(z=z)} + {_HALF.format(z=z)}), 6)"


_LOW, _HIGH = _wilson_sql(str(Z95)).split("), round(")


@register(QUERIES, f"""WITH {_PRED}, g AS (SELECT lang, count(*) AS n, CAST(count(CASE WHEN actual = pred THEN 1 END) AS DOUBLE) AS s FROM p GROUP BY lang)
SELECT lang, n, CAST(s AS BIGINT) AS correct, {_LOW}) AS low, round({_HIGH} AS high, {_wilson_sql('1.96').split('), round(')[0]}) AS low_196 FROM g""")
def wilson_rates(spark, d):
    g = _pred(spark, d).groupBy("lang").agg(F.count("*").alias("n"), F.count(F.when(F.col("actual") == F.col("pred"), 1)).alias("correct"))
    w = g.withColumn("w", wilson(F.col("correct"), F.col("n"))).withColumn("v", wilson(F.col("correct"), F.col("n"), 1.96))
    return w.select("lang", "n", "correct", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"), F.round("v.low", 6).alias("low_196"))


@register(QUERIES, "SELECT source, count(*) AS n, round(1 - pow(1 - 0.95::DOUBLE, 1.0 / count(*)), 6) AS bound FROM documents GROUP BY source")
def zero_failure_bounds(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n")).withColumn("bound", F.round(zero_failure_bound(F.col("n")), 6))


@register(QUERIES, f"""WITH {_PRED}, g AS (SELECT lang, count(*) AS attempts, count(CASE WHEN conf >= 0.5 THEN 1 END) AS accepted, count(CASE WHEN conf >= 0.5 AND actual <> pred THEN 1 END) AS wrong FROM p GROUP BY lang)
SELECT lang, round(accepted / attempts, 6) AS coverage, round(CASE WHEN accepted > 0 THEN wrong / accepted END, 6) AS wrong_among_accepted, round(wrong / attempts, 6) AS wrong_per_attempt, round((accepted - wrong) / attempts, 6) AS yield FROM g""")
def selective_metrics(spark, d):
    on = F.col("conf") >= 0.5
    g = _pred(spark, d).groupBy("lang").agg(F.count("*").alias("attempts"), F.count(F.when(on, 1)).alias("accepted"), F.count(F.when(on & (F.col("actual") != F.col("pred")), 1)).alias("wrong"))
    r = lambda a, b: F.round(ratio(a, b), 6)
    c = F.col
    return g.select("lang", r(c("accepted"), c("attempts")).alias("coverage"), r(c("wrong"), c("accepted")).alias("wrong_among_accepted"), r(c("wrong"), c("attempts")).alias("wrong_per_attempt"), r(c("accepted") - c("wrong"), c("attempts")).alias("yield"))


@register(QUERIES, "SELECT event_type, count(*) AS n, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    got = percentiles(table(spark, d, "events"), by="event_type", value="value", shares={"median": 0.5, "p95": 0.95})
    return got.select("event_type", "n", F.round("median", 6).alias("median"), F.round("p95", 6).alias("p95"))


@register(QUERIES, "WITH u AS (SELECT user_id, event_type, quantile_cont(value, 0.5) AS m FROM events GROUP BY ALL) SELECT event_type, round(quantile_cont(m, 0.5), 6) AS median_of_medians, round(quantile_cont(m, 0.95), 6) AS p95_of_medians FROM u GROUP BY event_type")
def latency_two_level(spark, d):
    u = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.expr("percentile(value, 0.5D)").alias("m"))
    got = percentiles(u, by="event_type", value="m", shares={"median": 0.5, "p95": 0.95})
    return got.select("event_type", F.round("median", 6).alias("median_of_medians"), F.round("p95", 6).alias("p95_of_medians"))


@register(QUERIES, "WITH c AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label) SELECT label, n, round((1 / sqrt(n)) / avg(1 / sqrt(n)) OVER (), 6) AS weight FROM c")
def class_weights(spark, d):
    return weights_by_rarity(table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))).select("label", "n", F.round("weight", 6).alias("weight"))


@register(QUERIES, "SELECT CAST(range AS INT) AS label FROM range(64) WHERE range NOT IN (SELECT label FROM embeddings)")
def missing_classes(spark, d):
    return spark.range(64).select(F.col("id").cast("int").alias("label")).join(table(spark, d, "embeddings").select("label").distinct(), "label", "left_anti")


# Epochs of training runs, from events: user = run, event = epoch.
_RUN = "e AS (SELECT user_id AS run, event_id AS epoch, round(0.1 * value + 0.9 * (value * 7 % 13), 6) AS fit FROM events)"


@register(QUERIES, f"WITH {_RUN} SELECT run, arg_max(epoch, (fit, epoch)) AS epoch, max(fit) AS fit FROM e GROUP BY run")
def checkpoint_selection(spark, d):
    e = _epochs(spark, d)
    return e.groupBy("run").agg(F.max_by("epoch", F.struct("fit", "epoch")).alias("epoch"), F.max("fit").alias("fit"))


def _epochs(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.round(fitness(F.col("value"), F.col("value") * 7 % 13), 6).alias("fit"))


@register(QUERIES, f"WITH {_RUN}, b AS (SELECT *, max(fit) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e) SELECT run, epoch, fit FROM b WHERE best IS NULL OR fit > best")
def running_best(spark, d):
    before = Window.partitionBy("run").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    return _epochs(spark, d).withColumn("best", F.max("fit").over(before)).where("best is null or fit > best").select("run", "epoch", "fit")


@register(QUERIES, f"WITH {_RUN}, k AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY fit DESC, epoch) AS rank FROM e) SELECT run, epoch, fit, CAST(rank AS INT) AS rank FROM k WHERE rank <= 3")
def elite_topk(spark, d):
    w = Window.partitionBy("run").orderBy(F.desc("fit"), "epoch")
    return _epochs(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3")


@register(QUERIES, f"WITH {_RUN} SELECT run, arg_max(epoch, (fit, -epoch)) AS winner FROM e WHERE epoch % 4 = run % 4 GROUP BY run")
def tournament(spark, d):
    e = _epochs(spark, d).where(F.col("epoch") % 4 == F.col("run") % 4)
    return e.groupBy("run").agg(F.max_by("epoch", F.struct("fit", (-F.col("epoch")).alias("e"))).alias("winner"))


@register(QUERIES, "SELECT user_id, event_id, CAST(epoch_us(ts) - coalesce(lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY event_id), epoch_us(ts)) AS BIGINT) AS elapsed_us FROM events")
def progress_delta(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").withColumn("us", us).select("user_id", "event_id", (F.col("us") - F.coalesce(F.lag("us").over(w), F.col("us"))).alias("elapsed_us"))


@register(QUERIES, "WITH x AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS rn, embedding FROM embeddings), d AS (SELECT label, max(abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE)) AS m, count(CASE WHEN abs(embedding[1]::DOUBLE - embedding[2]::DOUBLE) <= 0.05::DOUBLE + 0.1::DOUBLE * abs(embedding[2]::DOUBLE) THEN 1 END) AS close FROM embeddings GROUP BY label) SELECT label, round(m, 6) AS max_error, close FROM d")
def parity_errors(spark, d):
    a, b = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, d, "embeddings").groupBy("label").agg(F.round(F.max(F.abs(a - b)), 6).alias("max_error"), F.count(F.when(F.abs(a - b) <= 0.05 + 0.1 * F.abs(b), 1)).alias("close"))


_SELECTIVE = """g AS (SELECT o_custkey % 40 AS capture, count(*) AS attempts, count(*) FILTER (o_orderkey % 3 > 0) AS accepted, count(*) FILTER (o_orderkey % 3 > 0 AND (o_custkey % 40 % 4 = 1 AND o_orderkey % 11 = 0)) AS wrong,
  count(*) FILTER (o_orderkey % 7 > 0 OR o_orderkey % 3 > 0) AS in_scope, count(*) FILTER (o_orderkey % 3 > 0 AND NOT (o_custkey % 40 % 4 = 1 AND o_orderkey % 11 = 0)) + CASE WHEN o_custkey % 40 = 39 THEN 1 ELSE 0 END AS correct FROM orders GROUP BY o_custkey % 40)"""
_WILSON = "(({p} / {n}) + 3.841458820694124 / (2 * {n})) / (1 + 3.841458820694124 / {n}) - 1.959963984540054 * sqrt(({p} / {n}) * (1 - {p} / {n}) / {n} + 3.841458820694124 / (4 * {n} * {n})) / (1 + 3.841458820694124 / {n})"


@register(QUERIES, f"""WITH {_SELECTIVE}, f AS (SELECT *, correct = accepted - wrong AND correct <= in_scope AS fits FROM g)
SELECT capture, fits, CASE WHEN fits THEN round(accepted / attempts, 9) END AS coverage, CASE WHEN fits THEN round(greatest(0.0, {_WILSON.format(p='accepted', n='attempts')}), 9) END AS coverage_low, CASE WHEN fits AND accepted > 0 THEN round(wrong / accepted, 9) END AS wrong_among_accepted,
  CASE WHEN fits AND in_scope > 0 THEN round(correct / in_scope, 9) END AS correct_lock_yield, CASE WHEN fits AND wrong = 0 AND accepted > 0 THEN round(1 - pow(0.05, 1.0 / accepted), 9) END AS zero_wrong_upper FROM f""")
def selective_bounds(spark, d):
    """Rates of accepted attempts with their totals and bounds; counts that don't fit together have none."""
    k, c = F.col("o_orderkey"), F.col("capture")
    rows = table(spark, d, "orders").select(k, (F.col("o_custkey") % 40).alias("capture"))
    taken, wrong = k % 3 > 0, (k % 3 > 0) & (c % 4 == 1) & (k % 11 == 0)
    g = rows.groupBy("capture").agg(F.count("*").alias("attempts"), F.count_if(taken).alias("accepted"), F.count_if(wrong).alias("wrong"), F.count_if((k % 7 > 0) | taken).alias("in_scope"), (F.count_if(taken & ~wrong) + F.max(F.when(c == 39, 1).otherwise(0))).alias("correct"))
    s = g.select("capture", selective(*[F.col(x) for x in ("attempts", "accepted", "wrong", "in_scope", "correct")]).alias("s"))
    r = lambda x, y: F.round(x, 9).alias(y)
    return s.select("capture", F.col("s").isNotNull().alias("fits"), r("s.coverage.rate", "coverage"), r("s.coverage.low", "coverage_low"), r("s.wrong_among_accepted.rate", "wrong_among_accepted"), r("s.correct_lock_yield.rate", "correct_lock_yield"), r("s.zero_wrong_accepts_upper_95", "zero_wrong_upper"))


@register(QUERIES, "SELECT event_id, user_id FROM events WHERE event_id IN (SELECT o_orderkey // 3 FROM orders WHERE o_orderkey % 3 = 0)")
def reviewed_frames(spark, d):
    """Frames whose index was selected for review, in another table."""
    reviewed = table(spark, d, "orders").where("o_orderkey % 3 = 0").selectExpr("o_orderkey DIV 3 AS event_id")
    return table(spark, d, "events").select("event_id", "user_id").join(reviewed, "event_id", "left_semi")


@register(QUERIES, """WITH g AS (SELECT l_orderkey AS image_id, count(*) AS n_true FROM lineitem GROUP BY 1), p AS (SELECT l_orderkey AS image_id, count(*) AS n_found, min(CASE WHEN l_partkey % 50 = 0 THEN 0.7 ELSE 0.9 END) AS least FROM lineitem WHERE l_suppkey % 20 > 0 GROUP BY 1)
SELECT n_true, count(*) AS images, count(*) FILTER (n_true IN (2, 5, 8, 11, 14, 17) AND n_found = n_true AND least >= 0.8) AS eligible FROM g LEFT JOIN p USING (image_id) GROUP BY n_true""")
def eligibility_histogram(spark, d):
    """Images by their number of tiles, and how many of them count: a number that can be a hand, all found, each with at least 0.8."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("image_id"), "l_suppkey", "l_partkey")
    found = F.col("l_suppkey") % 20 > 0
    by = rows.groupBy("image_id").agg(F.count("*").alias("n_true"), F.count_if(found).alias("n_found"), F.min(F.when(found, F.when(F.col("l_partkey") % 50 == 0, 0.7).otherwise(0.9))).alias("least"))
    fits = F.col("n_true").isin(2, 5, 8, 11, 14, 17) & (F.col("n_found") == F.col("n_true")) & (F.col("least") >= 0.8)
    return by.groupBy("n_true").agg(F.count("*").alias("images"), F.count_if(fits).alias("eligible"))


@register(QUERIES, "SELECT o.o_orderkey AS frame, abs((l.us - o.o_orderkey * 33367) - 1500) <= 2000 AS within FROM orders o JOIN (SELECT l_orderkey, min(l_orderkey * 33367 + l_partkey % 5000) AS us FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey")
def decoded_times(spark, d):
    """Decoded times of frames against pinned ones of another table, less a constant offset, within 2 ms."""
    decoded = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("frame")).agg(F.min(F.col("l_orderkey") * 33367 + F.col("l_partkey") % 5000).alias("us"))
    pinned = table(spark, d, "orders").select(F.col("o_orderkey").alias("frame"), (F.col("o_orderkey") * 33367).alias("pinned"))
    return pinned.join(decoded, "frame").select("frame", (F.abs(F.col("us") - F.col("pinned") - 1500) <= 2000).alias("within"))
