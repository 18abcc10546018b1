"""Queries on completeness, eligibility and agreement between tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.operators.session import stop_after
from lumora.plans.base import BOX, derive, derive_sql, register, table

QUERIES: dict = {}

_BOXES = f"boxes AS (SELECT DISTINCT * FROM ({derive_sql('lineitem', BOX)}))"


def _boxes(spark, d):
    return derive(table(spark, d, "lineitem"), BOX).distinct()


@register(QUERIES, "SELECT d.source, bool_and((d.n_chars > 400) = (l.quality = 1)) AS all_correct, count(*) AS n FROM documents d JOIN labels l USING (doc_id) GROUP BY d.source")
def all_correct_by_source(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return rows.groupBy("source").agg(F.bool_and((F.col("n_chars") > 400) == (F.col("quality") == 1)).alias("all_correct"), F.count("*").alias("n"))


@register(QUERIES, "WITH s AS (SELECT source, CASE WHEN count(*) % 2 = 0 THEN 'train' ELSE 'dev' END AS split FROM documents GROUP BY source) SELECT doc_id, coalesce(CASE WHEN doc_id % 9 = 0 THEN 'internal_test' END, s.split) AS split FROM documents LEFT JOIN s USING (source)")
def split_override(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source")
    by = docs.groupBy("source").agg(F.when(F.count("*") % 2 == 0, "train").otherwise("dev").alias("split"))
    return docs.join(by, "source", "left").select("doc_id", F.coalesce(F.when(F.col("doc_id") % 9 == 0, "internal_test"), "split").alias("split"))


@register(QUERIES, f"""WITH {_BOXES}, i AS (SELECT image_id, count(*) AS n, min(conf) AS least, max(cls) < 34 AND max(c) <= 4 AS physical FROM (SELECT *, count(*) OVER (PARTITION BY image_id, cls) AS c FROM boxes) GROUP BY image_id)
SELECT image_id, n, n IN (2, 5, 8, 11, 14, 17) AND least >= 0.2 AS eligible, physical FROM i""")
def count_eligibility(spark, d):
    """Images whose number of tiles can be a hand, whose least confidence suffices, and with no more than four of a kind."""
    by_class = _boxes(spark, d).groupBy("image_id", "cls").agg(F.count("*").alias("c"), F.min("conf").alias("least"))
    i = by_class.groupBy("image_id").agg(F.sum("c").alias("n"), F.min("least").alias("least"), ((F.max("cls") < 34) & (F.max("c") <= 4)).alias("physical"))
    return i.select("image_id", "n", (F.col("n").isin(2, 5, 8, 11, 14, 17) & (F.col("least") >= 0.2)).alias("eligible"), "physical")


@register(QUERIES, "WITH e AS (SELECT event_id, epoch_us(ts) AS us FROM events), p AS (SELECT event_id, us + CASE WHEN event_id % 31 = 0 THEN 2500 ELSE 900 END AS pinned FROM e) SELECT e.event_id, abs(pinned - us) <= 2000 AS within FROM e JOIN p USING (event_id)")
def pinned_times(spark, d):
    e = table(spark, d, "events").select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("us"))
    pinned = e.select("event_id", (F.col("us") + F.when(F.col("event_id") % 31 == 0, 2500).otherwise(900)).alias("pinned"))
    return e.join(pinned, "event_id").select("event_id", (F.abs(F.col("pinned") - F.col("us")) <= 2000).alias("within"))


@register(QUERIES, "SELECT coalesce(c.c_nationkey, s.s_nationkey) AS nation, c.n AS customers, s.n AS suppliers, c.n IS NOT NULL AND s.n IS NOT NULL AS both_sides FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_nationkey % 4 > 0 GROUP BY 1) c FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_nationkey % 3 > 0 GROUP BY 1) s ON c.c_nationkey = s.s_nationkey")
def key_set_comparison(spark, d):
    c = table(spark, d, "customer").where("c_nationkey % 4 > 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = table(spark, d, "supplier").where("s_nationkey % 3 > 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", "customers", "suppliers", (F.col("customers").isNotNull() & F.col("suppliers").isNotNull()).alias("both_sides"))


@register(QUERIES, "WITH s AS (SELECT conv_id, turn, regexp_extract(text, '^(\\w)', 1) AS first FROM conversations) SELECT conv_id, array_to_string(list_sort(list(DISTINCT turn)), ',') AS turns, count(DISTINCT turn) AS n FROM s GROUP BY conv_id")
def sorted_turns(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_set("turn")).alias("t"))
    return c.select("conv_id", F.array_join(F.transform("t", lambda x: x.cast("string")), ",").alias("turns"), F.size("t").cast("bigint").alias("n"))


@register(QUERIES, f"WITH {_BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY l + r, anchor, l) AS n FROM boxes) SELECT image_id, string_agg(CAST(cls AS VARCHAR), '' ORDER BY n) AS row_text, count(*) AS n FROM o GROUP BY image_id")
def physical_order(spark, d):
    """Classes of each image from left to right."""
    rows = _boxes(spark, d).groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct((F.col("l") + F.col("r")).alias("c"), "anchor", "l", "cls"))).alias("a"))
    return rows.select("image_id", F.array_join(F.transform("a", lambda x: x["cls"].cast("string")), "").alias("row_text"), F.size("a").cast("bigint").alias("n"))


@register(QUERIES, f"""WITH {_BOXES}, o AS (SELECT *, (t + b) / 2 AS cy, b - t AS h, row_number() OVER (PARTITION BY image_id ORDER BY b - t) AS hn, count(*) OVER (PARTITION BY image_id) AS n FROM boxes),
m AS (SELECT image_id, max(CASE WHEN hn = n // 2 + 1 THEN h END) AS median, max(cy) - min(cy) AS spread FROM o GROUP BY image_id) SELECT image_id, spread <= median * 0.5 AS in_row, round(median, 6) AS upper_median FROM m""")
def row_spread(spark, d):
    """Whether the centres of an image's boxes lie within half of the upper median of their heights."""
    rows = _boxes(spark, d).withColumn("h", F.col("b") - F.col("t")).withColumn("cy", (F.col("t") + F.col("b")) / 2)
    g = rows.groupBy("image_id").agg(F.array_sort(F.collect_list("h")).alias("hs"), (F.max("cy") - F.min("cy")).alias("spread"))
    median = F.get("hs", F.floor(F.size("hs") / 2).cast("int"))
    return g.select("image_id", (F.col("spread") <= median * 0.5).alias("in_row"), F.round(median, 6).alias("upper_median"))


@register(QUERIES, "SELECT doc_id, substr(sha256(CAST(doc_id AS VARCHAR) || '|' || lang), 1, 24) AS crop_key, substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24) AS stem FROM documents")
def derived_keys(spark, d):
    i = F.col("doc_id").cast("string")
    return table(spark, d, "documents").select("doc_id", F.substring(F.sha2(F.concat(i, F.lit("|"), F.col("lang")), 256), 1, 24).alias("crop_key"), F.substring(F.sha2(i, 256), 1, 24).alias("stem"))


@register(QUERIES, "SELECT event_id, replace(substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 16), 'T', ' ') AS shown FROM events")
def pretty_dates(spark, d):
    return table(spark, d, "events").select("event_id", F.replace(F.substring(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), 1, 16), F.lit("T"), F.lit(" ")).alias("shown"))


@register(QUERIES, "WITH g AS (SELECT user_id, event_id, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_type FROM events), r AS (SELECT user_id, event_id, count(CASE WHEN event_type = 'error' THEN 1 END) OVER (PARTITION BY user_id, k ORDER BY event_id) AS failures FROM g) SELECT user_id, min(event_id) AS stopped_at FROM r WHERE failures >= 3 GROUP BY user_id")
def circuit_breaker(spark, d):
    """The third failure in a row of each user; a success starts the count anew."""
    return stop_after(table(spark, d, "events"), key="user_id", order="event_id", failed=F.col("event_type") == "error")
