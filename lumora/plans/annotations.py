"""Queries on annotated images: joins, checks, class names, confusion, roll-ups, selection locks and drafts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumora.operators.annotations import annotated, annotations_per_image, audit_rollup, canonical, cascade, confusion, confusion_totals, inventory_violations, selection_violations
from lumora.operators.manifest import manifest_components, record_links
from lumora.plans.base import register, table
from lumora.plans.records import _RELATED_SQL, _related

QUERIES: dict = {}

# Images are orders, annotations lines of orders of some quantity, some of them of an image that isn't there.
_IMAGES = "SELECT o_orderkey AS id, CAST(200 + o_custkey % 300 AS INT) AS width, CAST(150 + o_custkey * 7 % 250 AS INT) AS height FROM orders"
_ANNOTATIONS = """SELECT l_orderkey * 8 + l_linenumber AS id, CASE WHEN l_partkey % 97 = 0 THEN 0 - l_orderkey ELSE l_orderkey END AS image_id, CAST(l_suppkey % 8 AS INT) AS category_id,
CASE WHEN l_partkey % 53 = 0 THEN 0 - 1 ELSE CAST(l_partkey % 150 AS DOUBLE) END AS x, CAST(l_suppkey % 100 AS DOUBLE) AS y, CASE WHEN l_partkey % 59 = 0 THEN CAST('NaN' AS DOUBLE) WHEN l_partkey % 61 = 0 THEN CAST(0 AS DOUBLE) ELSE CAST(l_quantity AS DOUBLE) * 1.5 END AS w,
CAST(4 + l_linenumber * 9 AS DOUBLE) AS h, CASE WHEN l_linenumber = 6 THEN 1 END AS iscrowd FROM lineitem WHERE l_quantity > 12"""
_LABELS = ("1m", "2m", "1p", "2p", "1s", "1z", "7z")
_JOINED = f"""i AS ({_IMAGES}), a AS ({_ANNOTATIONS}), c(category_id, label) AS (VALUES {', '.join(f"({k}, '{n}')" for k, n in enumerate(_LABELS))}),
j AS (SELECT coalesce(i.id, a.image_id) AS image_id, a.id AS annotation_id, label, i.id AS found, width, height, x, y, w, h, iscrowd, c.category_id AS known,
  greatest(0, least(width, floor(x - w * 0.06::DOUBLE))) AS l, greatest(0, least(height, floor(y - h * 0.06::DOUBLE))) AS t, greatest(0, least(width, ceil(x + w + w * 0.06::DOUBLE))) AS r, greatest(0, least(height, ceil(y + h + h * 0.06::DOUBLE))) AS b
  FROM i FULL JOIN a ON i.id = a.image_id LEFT JOIN c ON a.category_id = c.category_id),
s AS (SELECT *, CASE WHEN annotation_id IS NULL THEN 'none' WHEN found IS NULL THEN 'no_image' WHEN known IS NULL THEN 'unknown_category' WHEN NOT isfinite(w) OR w <= 0 OR h <= 0 OR x < 0 OR y < 0 OR x + w > width + 0.01::DOUBLE OR y + h > height + 0.01::DOUBLE THEN 'invalid'
  WHEN coalesce(iscrowd, 0) <> 0 THEN 'crowd' WHEN least(r - l, b - t) < 8 THEN 'too_small' ELSE 'kept' END AS state FROM j)"""


def _annotated(spark, d):
    images = spark.sql(_IMAGES.replace("FROM orders", "FROM {t}"), t=table(spark, d, "orders"))
    rows = spark.sql(_ANNOTATIONS.replace("FROM lineitem", "FROM {t}"), t=table(spark, d, "lineitem")).select("id", "image_id", "category_id", F.array("x", "y", "w", "h").alias("bbox"), "iscrowd")
    return annotated(images, rows, spark.createDataFrame(list(enumerate(_LABELS)), "id int, name string"))


@register(QUERIES, f"WITH {_JOINED} SELECT image_id, annotation_id, label, state, CASE WHEN state = 'kept' THEN concat_ws(',', CAST(l AS INT), CAST(t AS INT), CAST(r AS INT), CAST(b AS INT)) END AS box FROM s")
def annotation_states(spark, d):
    """Each image with its annotations, and why one is skipped."""
    box = F.when(F.col("box").isNotNull(), F.concat_ws(",", *[F.col(f"box.{k}").cast("string") for k in "ltrb"]))
    return _annotated(spark, d).withColumn("box", box)


@register(QUERIES, f"WITH {_JOINED}, n AS (SELECT image_id, count(annotation_id) AS n_annotations FROM s WHERE state <> 'no_image' GROUP BY image_id) SELECT n_annotations, count(*) AS n_images FROM n GROUP BY n_annotations")
def annotation_histogram(spark, d):
    """How many images have how many annotations."""
    return annotations_per_image(_annotated(spark, d))


_CLASSES = 9
_CONFUSED = f"""p AS (SELECT l_partkey % 5 AS target, (l_partkey + CASE WHEN l_quantity > 40 THEN l_suppkey % 3 ELSE 0 END) % 7 AS predicted FROM lineitem), n AS (SELECT target, predicted, count(*) AS n FROM p GROUP BY ALL),
m AS (SELECT CAST(a.range AS INT) AS target, CAST(b.range AS INT) AS predicted, coalesce(n.n, 0) AS n, CAST(sum(coalesce(n.n, 0)) OVER (PARTITION BY a.range) AS BIGINT) AS support, sum(CASE WHEN a.range = b.range THEN coalesce(n.n, 0) ELSE 0 END) OVER (PARTITION BY a.range) AS hits
  FROM range({_CLASSES}) a CROSS JOIN range({_CLASSES}) b LEFT JOIN n ON n.target = a.range AND n.predicted = b.range), f AS (SELECT target, predicted, n, support, CASE WHEN support > 0 THEN hits / support ELSE 0.0 END AS recall FROM m)"""


def _matrix(spark, d):
    p = F.col("l_partkey")
    rows = table(spark, d, "lineitem").select((p % 5).alias("target"), ((p + F.when(F.col("l_quantity") > 40, F.col("l_suppkey") % 3).otherwise(0)) % 7).alias("predicted"))
    return confusion(rows, target="target", predicted="predicted", classes=_CLASSES)


@register(QUERIES, f"WITH {_CONFUSED} SELECT target, predicted, n, support, round(recall, 9) AS recall FROM f")
def confusion_matrix(spark, d):
    """All cells of a confusion matrix, with the support and recall of their class."""
    return _matrix(spark, d).withColumn("recall", F.round("recall", 9))


@register(QUERIES, f"WITH {_CONFUSED} SELECT CAST(sum(support) AS BIGINT) AS count, round(sum(n) / sum(support), 9) AS accuracy, round(avg(CASE WHEN support > 0 THEN recall END), 9) AS macro_recall_present_classes FROM f WHERE target = predicted")
def confusion_summary(spark, d):
    got = confusion_totals(_matrix(spark, d))
    return got.select("count", F.round("accuracy", 9).alias("accuracy"), F.round("macro_recall_present_classes", 9).alias("macro_recall_present_classes"))


_VOCABS = ("title", "dashed", "letters", "short", "romaji", "mixed", "red_fives")
_NAMED = """SELECT p_partkey, CAST(p_partkey % 7 AS INT) AS v, CAST(p_size % 9 + 1 AS INT) AS n, CAST(p_partkey // 7 % 5 AS INT) AS kind FROM part"""
_RAW = {  # by vocabulary: names of the three suits, of the honors, and one it doesn't have
    "title": ("Character {n}", "Circle {n}", "Bamboo {n}", ("East", "South", "West", "North", "White", "Green", "Red")), "dashed": ("characters-{n}", "dots-{n}", "bamboo-{n}", ("honors-east", "honors-south", "honors-west", "honors-north", "honors-white", "honors-green", "honors-red")),
    "letters": ("{n}C", "{n}D", "{n}B", ("EW", "SW", "WW", "NW", "WD", "GD", "RD")), "short": ("{n}m", "{n}p", "{n}s", ("1z", "2z", "3z", "4z", "5z", "6z", "7z")), "romaji": ("{n}m", "{n}p", "{n}s", ("tou", "nan", "sha", "pe", "haku", "hatsu", "chun")),
    "mixed": ("{n}m", "{n}p", "{n}s", ("East", "South", "West", "North", "Haku", "Hatsu", "Chun")), "red_fives": ("{n}m", "5pr", "{n}s", ("1z", "2z", "3z", "4z", "5z", "6z", "7z")),
}


def _raw_sql() -> str:
    ways = []
    for k, v in enumerate(_VOCABS):
        *suits, honors = _RAW[v]
        name = " ".join(f"WHEN kind = {i} THEN replace('{s}', '{{n}}', CAST(n AS VARCHAR(9)))" for i, s in enumerate(suits))
        honor = " ".join(f"WHEN n = {i} THEN '{h}'" for i, h in enumerate(honors, 1))
        ways.append(f"WHEN v = {k} THEN CASE {name} WHEN kind = 3 AND n <= 7 THEN CASE {honor} END ELSE concat('other', CAST(n AS VARCHAR(9))) END")
    return f"CASE {' '.join(ways)} END"


def _raw_spark() -> str:
    named = _NAMED.replace("//", "DIV").replace("FROM part", "FROM {t}")
    return f"SELECT *, {_raw_sql().replace('{n}', '{{n}}')} AS raw FROM ({named})"


@register(QUERIES, f"""WITH n AS ({_NAMED}), r AS (SELECT *, {_raw_sql()} AS raw FROM n)
SELECT p_partkey, raw, CASE WHEN kind = 4 OR (kind = 3 AND n > 7) THEN NULL WHEN kind = 3 THEN n || 'z' WHEN v = 6 AND kind = 1 THEN '5p' ELSE n || CASE kind WHEN 0 THEN 'm' WHEN 1 THEN 'p' ELSE 's' END END AS code FROM r""")
def class_codes(spark, d):
    """Class names of seven vocabularies as codes; names that a vocabulary doesn't have have none."""
    rows = spark.sql(_raw_spark(), t=table(spark, d, "part"))
    named = rows.withColumn("vocab", F.element_at(F.array(*map(F.lit, _VOCABS)), F.col("v") + 1))
    return canonical(named, vocab_col="vocab", name_col="raw").select("p_partkey", "raw", "code")


_UP = "CASE WHEN doc_id % 3 = 0 THEN 'train' WHEN doc_id % 3 = 1 THEN 'valid' ELSE 'test' END"


@register(QUERIES, f"""WITH RECURSIVE {_RELATED_SQL}, e AS (SELECT u, v FROM l UNION SELECT v, u FROM l), reach(a, b) AS (SELECT id, id FROM r UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u), g AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a),
s AS (SELECT r.id, root, {_UP} AS split FROM r JOIN g USING (id)), q AS (SELECT root, count(*) AS n, count(DISTINCT split) AS splits, CASE WHEN bool_or(split = 'train') THEN 'train' WHEN bool_or(split = 'valid') THEN 'dev' ELSE 'internal_test' END AS to_split FROM s GROUP BY root),
m AS (SELECT s.*, to_split, to_split <> CASE split WHEN 'valid' THEN 'dev' WHEN 'test' THEN 'internal_test' ELSE split END AS moved FROM s JOIN q USING (root))
SELECT 'images' AS metric, '' AS key, count(*) AS n FROM m UNION ALL SELECT 'groups', '', count(*) FROM q UNION ALL SELECT 'multi_image_groups', '', count(*) FILTER (n > 1) FROM q UNION ALL SELECT 'largest_group', '', max(n) FROM q
UNION ALL SELECT 'cross_split_groups', '', count(*) FILTER (splits > 1) FROM q UNION ALL SELECT 'promoted_images', '', count(*) FILTER (moved) FROM m UNION ALL SELECT 'edges', reason, count(*) FROM l GROUP BY reason
UNION ALL SELECT 'upstream_images', split, count(*) FROM m GROUP BY split UNION ALL SELECT 'grouped_images', to_split, count(*) FROM m GROUP BY to_split""")
def dataset_rollup(spark, d):
    """Counts of an audit: groups, edges by reason, groups of several splits, and what their promotion changes."""
    records = _related(spark, d)
    k = F.substring("id", 2, 20).cast("bigint") % 3
    grouped = manifest_components(records).select("id", "root", F.when(k == 0, "train").when(k == 1, "valid").otherwise("test").alias("split"))
    return audit_rollup(grouped, record_links(records))


_INVENTORY = """locked AS (SELECT concat('img/', CAST(p_partkey AS VARCHAR(20))) AS path, CASE WHEN p_partkey % 3 = 0 THEN 'train' ELSE 'dev' END AS split, concat('h', CAST(p_partkey AS VARCHAR(20))) AS sha256, p_partkey AS k FROM part),
enriched AS (SELECT CASE WHEN k % 41 = 0 THEN concat(path, 'x') ELSE path END AS path, CASE WHEN k % 43 = 0 THEN 'test' ELSE split END AS split, CASE WHEN k % 47 = 0 THEN 'other' ELSE sha256 END AS sha256, concat('s', CAST(k AS VARCHAR(20))) AS source_id, CAST(k % 100 AS VARCHAR(20)) AS group_id FROM locked UNION ALL
  SELECT path, split, sha256, concat('s', CAST(k AS VARCHAR(20))), CAST(k % 100 AS VARCHAR(20)) FROM locked WHERE k % 59 = 0 AND k % 41 > 0 AND k % 43 > 0 AND k % 47 > 0),
crops AS (SELECT CASE WHEN k % 31 = 0 THEN concat(path, 'gone') ELSE path END AS source_path, CASE WHEN k % 37 = 0 THEN 'other' ELSE sha256 END AS source_sha256, split, concat('s', CAST(CASE WHEN k % 29 = 0 THEN k + 1 ELSE k END AS VARCHAR(20))) AS source_id, CAST(k % 100 AS VARCHAR(20)) AS group_id FROM locked WHERE k % 2 = 0)"""


@register(QUERIES, f"""WITH {_INVENTORY}, once AS (SELECT DISTINCT ON (path) * FROM enriched)
SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'not_enriched' WHEN a.path IS NULL THEN 'not_locked' ELSE 'split_or_hash_differs' END AS rule FROM locked a FULL JOIN enriched b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.split <> b.split OR a.sha256 <> b.sha256
UNION ALL SELECT path, 'enriched_twice' FROM enriched GROUP BY path HAVING count(*) > 1
UNION ALL SELECT source_path, rule FROM (SELECT source_path, CASE WHEN a.path IS NULL THEN 'crop_not_locked' WHEN c.source_sha256 <> a.sha256 OR c.split <> a.split THEN 'crop_split_or_hash_differs' WHEN b.path IS NULL OR c.source_id <> b.source_id OR c.group_id <> b.group_id THEN 'crop_identity_differs' END AS rule
  FROM crops c LEFT JOIN locked a ON c.source_path = a.path LEFT JOIN once b ON c.source_path = b.path) WHERE rule IS NOT NULL""")
def selection_inventory(spark, d):
    """What in the inventories speaks against a selection lock."""
    frames = [spark.sql(f"WITH {_INVENTORY.replace('FROM part', 'FROM {t}')} SELECT * FROM {name}", t=table(spark, d, "part")) for name in ("locked", "enriched", "crops")]
    return inventory_violations(*frames)


@register(QUERIES, """SELECT s_suppkey AS id, unnest(list_filter([CASE WHEN s_suppkey % 11 = 0 THEN 'schema_version' END, CASE WHEN s_suppkey % 7 = 0 THEN 'selected_at' END, CASE WHEN s_suppkey % 13 = 0 THEN 'checkpoint' END, CASE WHEN s_suppkey % 5 = 0 THEN 'manifest' END,
CASE WHEN s_suppkey % 3 = 0 OR s_suppkey % 17 = 0 THEN 'thresholds' END, CASE WHEN s_suppkey % 4 = 0 THEN 'operating_threshold' END], lambda x: x IS NOT NULL)) AS rule FROM supplier""")
def selection_locks(spark, d):
    """Rules that selection locks break."""
    k = F.col("s_suppkey")
    t = F.when(k % 3 == 0, F.array(F.lit(0.5), F.lit(0.25))).when(k % 17 == 0, F.array(F.lit(0.25), F.lit(0.5), F.lit(1.5))).otherwise(F.array(F.lit(0.25), F.lit(0.5)))
    return selection_violations(table(spark, d, "supplier").select(
        k.alias("id"), F.when(k % 11 == 0, 2).otherwise(1).alias("schema_version"), F.when(k % 7 == 0, "2024-05-01T10:00:00").otherwise("2024-05-01T10:00:00+08:00").alias("selected_at"), t.alias("thresholds"), F.when(k % 4 == 0, 0.3).otherwise(0.5).alias("operating_threshold"),
        F.lit("c").alias("checkpoint"), F.when(k % 13 == 0, "x").otherwise("c").alias("checkpoint_found"), F.lit("m").alias("manifest"), F.when(k % 5 == 0, "x").otherwise("m").alias("manifest_found"),
    ))


@register(QUERIES, """WITH d AS (SELECT o_orderkey, o_orderkey % 2 = 0 AS other, o_custkey % 3 > 0 AS flowers_on FROM orders)
SELECT o_orderkey, false AS confirmed, CASE WHEN other THEN false ELSE o_orderkey % 5 = 0 END AS heavenly, CASE WHEN other THEN false ELSE o_orderkey % 7 = 0 END AS earthly, CASE WHEN NOT other THEN CAST(o_orderkey % 4 AS INT) END AS liable_player, CASE WHEN other THEN 0 ELSE CAST(o_orderkey % 6 AS INT) END AS continuations,
  CASE WHEN other AND o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 0 OR o_orderkey % 8 = 3 THEN 'robConcealedKong' ELSE 'discard' END AS source, CASE WHEN flowers_on THEN 2 ELSE 0 END AS n_flowers, CASE WHEN NOT flowers_on THEN CASE WHEN o_orderkey % 9 = 1 THEN 'kong' ELSE 'none' END WHEN o_orderkey % 9 = 0 THEN 'flower' WHEN o_orderkey % 9 = 1 THEN 'kong' ELSE 'none' END AS replacement
FROM d""")
def rule_change_cascade(spark, d):
    """What a change of rules clears in a draft."""
    k = F.col("o_orderkey")
    hand = F.struct(
        F.lit(True).alias("confirmed"), (k % 5 == 0).alias("heavenly"), (k % 7 == 0).alias("earthly"), (k % 4).cast("int").alias("liable_player"), (k % 6).cast("int").alias("continuations"),
        F.when((k % 8 == 0) | (k % 8 == 3), "robConcealedKong").otherwise("discard").alias("source"), F.array(F.lit(34), F.lit(35)).alias("flowers"), F.when(k % 9 == 0, "flower").when(k % 9 == 1, "kong").otherwise("none").alias("replacement"),
    )
    before, after = F.struct(F.lit("hongKong").alias("family")), F.struct(F.when(k % 2 == 0, "taiwanese").otherwise("hongKong").alias("family"), (F.col("o_custkey") % 3 > 0).alias("flowers"))
    rows = table(spark, d, "orders").select("o_orderkey", cascade(hand, before, after).alias("h"))
    return rows.select("o_orderkey", *[F.col(f"h.{x}").alias(x) for x in ("confirmed", "heavenly", "earthly", "liable_player", "continuations", "source")], F.size("h.flowers").alias("n_flowers"), "h.replacement")
