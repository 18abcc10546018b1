"""Queries that write tables in the formats of the readers and sinks, and read them back. The files are in the shared folder
and go when the application ends."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.operators.audit import assign_split, unit_value
from lumora.operators.history import parse_history
from lumora.operators.manifest import make_lock, manifest_digest
from lumora.operators.shared import cut, forget, shared_dir
from lumora.plans.base import derive, derive_sql, register, table
from lumora.plans.hands import _SAVED, _STATES
from lumora.sources.readers import list_names, read_coco, read_digests, read_frame_times, read_labels, read_lines, read_numbers, read_regions, read_yolo_labels
from lumora.sources.writers import replace_history, write_by_split, write_lists, write_once, write_report

QUERIES: dict = {}


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    forget(spark, path)
    return path


@register(QUERIES, "SELECT 'img' || p_partkey || '.jpg' AS name, CAST(p_partkey % 34 + 1 AS INT) AS label, p_brand AS label_name FROM part")
def label_csv(spark, d):
    """A label CSV with header."""
    path, k = _folder(spark, "labels"), F.col("p_partkey")
    rows = table(spark, d, "part").select(F.concat(F.lit("img"), k.cast("string"), F.lit(".jpg")).alias("image-name"), (k % 34 + 1).alias("label"), F.col("p_brand").alias("label-name"))
    rows.write.option("header", True).csv(path)
    return read_labels(spark, path).select(F.col("image-name").alias("name"), "label", F.col("label-name").alias("label_name"))


@register(QUERIES, "SELECT CAST(o_orderkey AS DOUBLE) AS epoch, CAST(o_custkey AS DOUBLE) / 8 AS loss FROM orders")
def number_csv(spark, d):
    """A CSV of numbers whose header names have blanks around them."""
    path = _folder(spark, "numbers")
    table(spark, d, "orders").select(F.col("o_orderkey").alias("  epoch"), (F.col("o_custkey") / 8).alias(" loss ")).write.option("header", True).csv(path)
    return read_numbers(spark, path, ["  epoch", " loss "])


@register(QUERIES, "SELECT CAST(event_id % 2 AS INT) AS key, CAST(event_id AS DOUBLE) / 4 AS pts, CAST(event_id AS DOUBLE) / 2 AS pts2 FROM events")
def frame_time_csv(spark, d):
    """A CSV without header of key-frame flags and times."""
    path, k = _folder(spark, "times"), F.col("event_id")
    table(spark, d, "events").select((k % 2).alias("a"), (k / 4).alias("b"), (k / 2).alias("c")).write.csv(path)
    return read_frame_times(spark, path)


@register(QUERIES, """SELECT 'r' || n_nationkey || '-' || i AS id, CAST(j AS INT) AS gt_idx, CAST(n_nationkey % 9 + 1 AS VARCHAR(9)) || 'm' AS tile, concat_ws(',', n_nationkey, i, n_nationkey + 10, j + 20) AS box FROM nation, range(3) a(i), range(2) b(j)""")
def region_annotations(spark, d):
    """Nested region documents, one a file, and their annotations in order."""
    path, k = _folder(spark, "regions"), F.col("n_nationkey").cast("int")
    each = lambda i, j: F.struct(F.concat((k % 9 + 1).cast("string"), F.lit("m")).alias("tile"), F.array(k, i, k + 10, j + 20).alias("box"))
    region = lambda i: F.struct(F.concat(F.lit("r"), k.cast("string"), F.lit("-"), i.cast("string")).alias("id"), F.lit("s").alias("source_id"), F.array(F.lit(0), F.lit(0), k, k).alias("roi"), F.lit("row").alias("kind"), F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: each(i, j)).alias("annotations"))
    table(spark, d, "nation").select(k.alias("k"), F.transform(F.sequence(F.lit(0), F.lit(2)), region).alias("regions")).write.partitionBy("k").json(path)
    return read_regions(spark, path)[1].select("id", "gt_idx", "tile", F.array_join("box", ",").alias("box"))


@register(QUERIES, """WITH i AS (SELECT CASE r_regionkey % 2 WHEN 0 THEN 'train' ELSE 'valid' END AS split, n_nationkey AS image_id, n_name AS file_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey < 2)
SELECT split, file_name, CAST(image_id * 10 + k AS BIGINT) AS annotation_id, CASE k WHEN 0 THEN 'East' ELSE 'Red' END AS category, CAST(image_id + 20 AS DOUBLE) AS w FROM i, range(2) t(k)""")
def coco_documents(spark, d):
    """A file of images, annotations and categories for each split, joined again."""
    image = F.struct(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("file_name"), F.lit(640).alias("width"), F.lit(480).alias("height"))
    note = lambda k: F.struct((F.col("n_nationkey") * 10 + k).cast("bigint").alias("id"), F.col("n_nationkey").cast("bigint").alias("image_id"), F.lit(k).alias("category_id"), F.array(F.lit(1.0), F.lit(2.0), F.col("n_nationkey") + 20.0, F.lit(9.0)).alias("bbox"), F.lit(0).alias("iscrowd"))
    names = F.array(*[F.struct(F.lit(k).alias("id"), F.lit(n).alias("name"), F.lit("tile").alias("supercategory")) for k, n in enumerate(("East", "Red"))])
    paths = {}
    for key, split in enumerate(("train", "valid")):
        paths[split] = _folder(spark, f"coco-{split}")
        rows = table(spark, d, "nation").where(F.col("n_regionkey") == key)  # a region has five nations
        rows.agg(F.collect_list(image).alias("images"), F.flatten(F.collect_list(F.array(note(0), note(1)))).alias("annotations")).withColumn("categories", names).coalesce(1).write.json(paths[split])
    images, annotations, categories = read_coco(spark, paths)
    i, a, c = images.select("split", F.col("id").alias("image_id"), "file_name"), annotations.select("split", "image_id", F.col("id").alias("annotation_id"), "category_id", F.get("bbox", 2).alias("w")), F.broadcast(categories.select(F.col("id").alias("category_id"), F.col("name").alias("category")))
    return i.join(a, ["split", "image_id"]).join(c, "category_id").select("split", "file_name", "annotation_id", "category", "w")


def _texts(spark: SparkSession, d: str) -> str:
    """A text file for each benchmark item."""
    path = _folder(spark, "texts")
    table(spark, d, "benchmark").where("item_id IS NOT NULL").select("item_id", F.coalesce("text", F.lit("")).alias("value")).write.partitionBy("item_id").text(path)
    return path


def _item() -> Column:
    return F.regexp_extract("path", r"item_id=(\d+)", 1).cast("bigint")


@register(QUERIES, "WITH l AS (SELECT item_id, regexp_split_to_array(coalesce(text, ''), '\\r|\\n') AS x FROM benchmark WHERE item_id IS NOT NULL) SELECT item_id, unnest(range(len(x))) AS line_no, sha256(unnest(x)) AS sha FROM l")
def text_lines(spark, d):
    """Lines of files with their numbers."""
    return read_lines(spark, _texts(spark, d)).select(_item().alias("item_id"), "line_no", F.sha2("line", 256).alias("sha"))


@register(QUERIES, "SELECT item_id, strlen(coalesce(text, '')) + 1 AS length, sha256(coalesce(text, '') || chr(10)) AS sha256 FROM benchmark WHERE item_id IS NOT NULL")
def file_digests(spark, d):
    """Sizes and digests of files."""
    return read_digests(spark, _texts(spark, d), "*.txt").select(_item().alias("item_id"), "length", "sha256")


@register(QUERIES, "SELECT CAST(count(*) AS BIGINT) AS files FROM benchmark WHERE item_id IS NOT NULL")
def file_names(spark, d):
    """Names of files, contents not read."""
    return list_names(spark, f"{_texts(spark, d)}/*", "part-*.txt").agg(F.count("*").alias("files"))


@register(QUERIES, "SELECT CAST(l_partkey % 34 AS INT) AS cls, CAST(l_partkey % 64 AS DOUBLE) / 64 AS cx, CAST(l_suppkey % 32 AS DOUBLE) / 32 AS cy, 0.25::DOUBLE AS w, 0.5::DOUBLE AS h, count(*) AS n FROM lineitem GROUP BY ALL")
def yolo_label_files(spark, d):
    """Label files of lines ``class cx cy w h``."""
    path = _folder(spark, "yolo")
    table(spark, d, "lineitem").select(F.concat_ws(" ", (F.col("l_partkey") % 34).cast("string"), (F.col("l_partkey") % 64 / 64).cast("string"), (F.col("l_suppkey") % 32 / 32).cast("string"), F.lit("0.25"), F.lit("0.5")).alias("value")).write.text(path)
    return read_yolo_labels(spark, path).groupBy("cls", "cx", "cy", "w", "h").agg(F.count("*").alias("n"))


@register(QUERIES, "SELECT 'list' AS sink, CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END AS split, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'table', CASE WHEN doc_id % 3 = 0 THEN 'dev' ELSE 'train' END, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'report', '', count(*) FROM documents UNION ALL SELECT 'once', '', count(*) FROM documents")
def written_splits(spark, d):
    """What each sink wrote: lists and tables by split, a report, a table that is written once."""
    rows = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, "dev").otherwise("train").alias("split"))
    paths = {k: _folder(spark, k) for k in ("lists", "tables", "report", "once")}
    write_lists(rows, paths["lists"], "split", "doc_id")
    write_by_split(rows, paths["tables"])
    write_report(rows, paths["report"])
    write_once(rows, paths["once"])
    count = lambda df, sink, *by: df.groupBy(*by).agg(F.count("*").alias("n")).select(F.lit(sink).alias("sink"), *(by or [F.lit("").alias("split")]), "n")
    out = count(spark.read.text(paths["lists"]), "list", "split").unionByName(count(spark.read.parquet(paths["tables"]), "table", "split"))
    return out.unionByName(count(spark.read.schema("doc_id bigint, split string").json(paths["report"]), "report")).unionByName(count(spark.read.parquet(paths["once"]), "once"))


@register(QUERIES, f"WITH {_STATES} SELECT CASE WHEN state = 'unreadable' THEN 'quarantine' ELSE state END AS kind, count(*) AS n FROM states GROUP BY 1")
def history_replaced(spark, d):
    """A history that is replaced twice: what can't be read is set aside, the rest is the table."""
    h = cut(parse_history(derive(table(spark, d, "events"), _SAVED)).select("id", "doc", "state"), "history")  # filtered several times
    path, aside = _folder(spark, "history"), _folder(spark, "aside")
    replace_history(h.where("id < 0"), path, _folder(spark, "none"))
    replace_history(h, path, aside)
    kept = spark.read.parquet(path).groupBy(F.col("state").alias("kind")).agg(F.count("*").alias("n"))
    return kept.unionByName(spark.read.schema("id bigint, doc string").json(aside).agg(F.count("*").alias("n")).select(F.lit("quarantine").alias("kind"), "n"))


@register(QUERIES, """WITH u AS (SELECT doc_id, CAST(CAST('0x' || substr(sha256('seed|' || doc_id), 1, 13) AS UBIGINT) AS DOUBLE) / pow(2, 52) AS u FROM documents WHERE doc_id IS NOT NULL)
SELECT doc_id, CASE WHEN u * 4 < 1 THEN 'dev' WHEN u * 4 < 2 THEN 'internal_test' ELSE 'train' END AS split FROM u""")
def hashed_splits(spark, d):
    """A split for each row by a hash of its id, in fixed shares."""
    rows = table(spark, d, "documents").where("doc_id IS NOT NULL")
    return rows.select("doc_id", assign_split(unit_value(F.lit("seed"), F.col("doc_id").cast("string")), {"train": 2.0, "dev": 1.0, "internal_test": 1.0}).alias("split"))


_LOCKED = {"id": "concat('p', CAST(p_partkey AS VARCHAR(20)))", "path": "p_name"}


@register(QUERIES, f"""WITH r AS ({derive_sql('part', _LOCKED)}), j AS (SELECT substr(sha256(id), 1, 4) AS bucket, sha256('{{"id":"' || id || '","path":"' || path || '"}}') AS h FROM r), b AS (SELECT bucket, sha256(string_agg(h, '' ORDER BY h)) AS h FROM j GROUP BY bucket),
m AS (SELECT sha256('m' || string_agg(chr(10) || bucket || ':' || h, '' ORDER BY bucket)) AS hash FROM b)
SELECT hash AS manifest_sha256, (SELECT count(*) FROM r) AS records, sha256('{{"manifest_sha256":"' || hash || '","report":{{"records":' || (SELECT count(*) FROM r) || '}}}}') AS lock_sha256 FROM m""")
def manifest_lock(spark, d) -> DataFrame:
    """A lock over a manifest's digest and its report."""
    rows = derive(table(spark, d, "part"), _LOCKED)
    lock = make_lock(manifest_digest(rows, "m"), {"records": rows.count()})
    return spark.createDataFrame([(lock["manifest_sha256"], lock["report"]["records"], lock["lock_sha256"])], "manifest_sha256 string, records bigint, lock_sha256 string")
