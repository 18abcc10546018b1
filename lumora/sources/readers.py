"""Readers of the formats that audits and evaluations start from. Every schema is declared; nothing is inferred."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.window import Window

from lumora.operators.shared import cut

LABELS = "`image-name` string, label int, `label-name` string"
FRAME_TIMES = "key int, pts double, pts2 double"
COCO = (
    "images array<struct<id:bigint,file_name:string,width:int,height:int>>, annotations array<struct<id:bigint,image_id:bigint,category_id:int,bbox:array<double>,iscrowd:int>>, "
    "categories array<struct<id:int,name:string,supercategory:string>>"
)
REGIONS = "regions array<struct<id:string,source_id:string,roi:array<int>,kind:string,note:string,annotations:array<struct<tile:string,box:array<int>>>>>"


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """A label CSV with header; rows keep their file order in ``row``."""
    return spark.read.schema(LABELS).option("header", True).csv(path).withColumn("row", F.monotonically_increasing_id())


def read_numbers(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV of numbers whose header names have blanks around them: stripped names, all doubles."""
    return spark.read.schema(", ".join(f"`{c.strip()}` double" for c in columns)).option("header", True).option("enforceSchema", True).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def read_frame_times(spark: SparkSession, path: str) -> DataFrame:
    """A CSV without header: key-frame flag and two times."""
    return spark.read.schema(FRAME_TIMES).csv(path)


def read_regions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Regions of a nested JSON document, and their annotations: (id, gt_idx, tile, box)."""
    regions = spark.read.schema(REGIONS).option("multiLine", True).json(path).select(F.inline("regions"))
    return regions, regions.select("id", F.posexplode("annotations").alias("gt_idx", "a")).select("id", "gt_idx", "a.tile", "a.box")


def read_coco(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Images, annotations and categories of a file for each split. Their categories must be the same in all splits."""
    parts = [spark.read.schema(COCO).option("multiLine", True).json(p).withColumn("split", F.lit(s)) for s, p in sorted(paths.items())]
    doc = parts[0]
    for p in parts[1:]:
        doc = doc.unionByName(p)
    sets = doc.select(F.array_sort(F.transform("categories", lambda c: F.struct(c["id"].alias("id"), c["name"].alias("name")))).alias("c")).distinct().count()
    if sets > 1:
        raise ValueError("splits have different categories")
    images = doc.select("split", F.inline("images"))
    annotations = doc.select("split", F.inline("annotations"))
    return images, annotations, parts[0].select(F.inline("categories"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with their numbers from 0: path, line_no, line. Line feeds and carriage returns each end a line; one at a
    file's end, or both, begin no other.

    Files are cut at line feeds into splits as large as Spark makes them, and what a split holds is cut at carriage returns. Lines are
    numbered within their split and offset by the lines of the splits before, so no task holds a file. Bytes that are no
    UTF-8 stay what Spark's reader makes of them.
    """
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("_block"), meta["file_size"].alias("_bytes"), F.monotonically_increasing_id().alias("_m"), "value")
    rows = cut(rows, "lines")
    one = Window.partitionBy("path", "_block").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
    parts = F.regexp_count("value", F.lit("\r")) + 1
    held = rows.withColumns({"_n": parts, "_before": F.coalesce(F.sum(parts).over(one), F.lit(0))})
    splits = held.groupBy("path", "_block").agg(F.sum("_n").alias("_lines"), F.max("_bytes").alias("_bytes"), F.sum(F.octet_length("value") + 1).alias("_read"), F.max(F.struct("_m", F.col("value").endswith("\r").alias("cr"), F.col("value").eqNullSafe("").alias("empty"))).alias("_last"), F.max("_m").alias("_m"))
    order = Window.partitionBy("path").orderBy("_block")
    whole = Window.partitionBy("path")
    splits = splits.select(
        F.col("path").alias("_p"), F.col("_block").alias("_b"), F.coalesce(F.sum("_lines").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"),
        F.when((F.col("_block") == F.max("_block").over(whole)) & (F.sum("_read").over(whole) == F.col("_bytes")) & F.col("_last.cr"), F.col("_m")).alias("_ends"),
    )
    # a carriage return before the last line feed of a file is part of its end
    value = F.when(F.col("_m") == F.col("_ends"), F.regexp_replace("value", "\r\\z", "")).otherwise(F.col("value"))
    found = held.join(splits, (F.col("path") == F.col("_p")) & (F.col("_block") == F.col("_b"))).select("path", (F.col("_offset") + F.col("_before")).alias("_at"), F.posexplode(F.split(value, "\r")).alias("_i", "line"))
    return found.select("path", (F.col("_at") + F.col("_i")).alias("line_no"), "line")


def read_yolo_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label files of lines ``class cx cy w h``: path, cls, cx, cy, w, h."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.input_file_name().alias("path"), parts.alias("p"))
    return rows.select("path", F.col("p")[0].cast("int").alias("cls"), *[F.col("p")[i + 1].cast("double").alias(x) for i, x in enumerate(("cx", "cy", "w", "h"))])


def read_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files of a folder with their size and sha-256."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def list_names(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names of a folder's files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))


@udtf(returnType="name string, kind string, size bigint, content binary")
class TarMembers:
    """Members of one tar file."""

    def eval(self, content: bytes) -> Iterator[tuple]:
        import io
        import tarfile

        with tarfile.open(fileobj=io.BytesIO(content), mode="r:") as tar:
            for m in tar:
                kind = "file" if m.isreg() else "directory" if m.isdir() else "other"
                yield m.name, kind, m.size, tar.extractfile(m).read() if m.isreg() else None


def read_tar(spark: SparkSession, path: str, *, suffixes: tuple[str, ...], budget: int) -> DataFrame:
    """Members of tar files with the first reason to refuse each: unsafe_path, kind, duplicate, suffix, over_budget, or null."""
    spark.udtf.register("lumora_tar_members", TarMembers)
    spark.read.format("binaryFile").load(path).createOrReplaceTempView("_lumora_tars")
    rows = spark.sql("SELECT t.path, m.* FROM _lumora_tars t, LATERAL lumora_tar_members(t.content) m").withColumn("_n", F.monotonically_increasing_id())
    by_name, by_tar = Window.partitionBy("path", "name").orderBy("_n"), Window.partitionBy("path").orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    unsafe = F.col("name").rlike(r"^/|(^|/)\.\.(/|$)|\\")
    rows = rows.withColumn("_dup", F.row_number().over(by_name) > 1).withColumn("_sum", F.sum("size").over(by_tar))
    suffix = F.lower(F.regexp_extract("name", r"(\.[^./]+)$", 1))
    why = F.when(unsafe, "unsafe_path").when(F.col("kind") == "other", "kind").when(F.col("_dup"), "duplicate").when((F.col("kind") == "file") & ~suffix.isin(*suffixes), "suffix").when(F.col("_sum") > budget, "over_budget")
    return rows.select("path", "name", "kind", "size", "content", why.alias("refused"))
