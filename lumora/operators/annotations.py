"""Annotations of images: joined, checked and cut out, class names, the confusion of classes, and roll-ups of an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.functions.geometry import finite, pixel_box
from lumora.operators.audit import promote

#: What a box may stick out of its image by, in pixels, and the least side of a crop.
SLACK, LEAST_SIDE = 0.01, 8
# The names that each vocabulary has for suits and honors, in the order of codes.
_SUITS = {"title": ("Character {}", "Circle {}", "Bamboo {}"), "dashed": ("characters-{}", "dots-{}", "bamboo-{}"), "letters": ("{}C", "{}D", "{}B"), "short": ("{}m", "{}p", "{}s")}
_HONORS = {
    "title": ("East", "South", "West", "North", "White", "Green", "Red"), "dashed": tuple(f"honors-{x}" for x in ("east", "south", "west", "north", "white", "green", "red")), "letters": ("EW", "SW", "WW", "NW", "WD", "GD", "RD"),
    "short": ("1z", "2z", "3z", "4z", "5z", "6z", "7z"), "romaji": ("tou", "nan", "sha", "pe", "haku", "hatsu", "chun"), "mixed": ("East", "South", "West", "North", "Haku", "Hatsu", "Chun"),
}


def class_names() -> list[tuple[str, str, str]]:
    """(vocabulary, its name of a class, code) of seven vocabularies; red fives count as fives."""
    out = []
    for vocab, honors in _HONORS.items():
        out += [(vocab, name, f"{i}z") for i, name in enumerate(honors, 1)]
        out += [(vocab, form.format(n), f"{n}{s}") for s, form in zip("mps", _SUITS.get(vocab, _SUITS["short"]), strict=True) for n in range(1, 10)]
    out += [("dashed", f"0{s}", f"5{s}") for s in "mps"] + [("dashed", f"{n}{s}", f"{n}{s}") for s in "mps" for n in range(1, 10)]
    out += [("red_fives", code, code) for v, _, code in out if v == "short"] + [("red_fives", f"5{s}r", f"5{s}") for s in "mps"]
    return out


def canonical(rows: DataFrame, *, vocab_col: str, name_col: str, out_col: str = "code", spark: SparkSession | None = None) -> DataFrame:
    """The rows with the code of a class by its name in a vocabulary; null where the vocabulary doesn't have the name. A broadcast of a fixed table."""
    dim = (spark or rows.sparkSession).createDataFrame(class_names(), "_vocab string, _name string, _code string")
    return rows.join(F.broadcast(dim), (F.col(vocab_col) == F.col("_vocab")) & (F.col(name_col) == F.col("_name")), "left").drop("_vocab", "_name").withColumnRenamed("_code", out_col)


def annotated(images: DataFrame, annotations: DataFrame, categories: DataFrame, *, margin: float = 0.06) -> DataFrame:
    """Every image with each of its annotations, and annotations without an image: image_id, annotation_id, label, state, box.

    ``images``: id, width, height; ``annotations``: id, image_id, category_id, bbox [x, y, w, h], iscrowd; ``categories``: id, name. States:
    ``none`` (an image without annotations), ``no_image``, ``unknown_category``, ``invalid`` (not finite, without a size, or outside),
    ``crowd``, ``too_small`` (a side under 8 pixels) or ``kept``, with the pixels of the crop.
    """
    a = annotations.select(F.col("id").alias("annotation_id"), F.col("image_id").alias("_image"), "category_id", "bbox", "iscrowd")
    i = images.select(F.col("id").alias("image_id"), "width", "height")
    c = categories.select(F.col("id").alias("_category"), F.col("name").alias("label"))
    rows = i.join(a, F.col("image_id") == F.col("_image"), "full").join(F.broadcast(c), F.col("category_id") == F.col("_category"), "left")
    x, y, w, h = (F.get("bbox", k) for k in range(4))
    fine = (F.size("bbox") == 4) & F.forall("bbox", lambda v: v.isNotNull() & finite(v)) & (F.least(w, h) > 0) & (F.least(x, y) >= 0) & (x + w <= F.col("width") + SLACK) & (y + h <= F.col("height") + SLACK)
    box = pixel_box(x, y, w, h, F.col("width"), F.col("height"), margin)
    small = F.least(box["r"] - box["l"], box["b"] - box["t"]) < LEAST_SIDE
    state = F.when(F.col("annotation_id").isNull(), "none").when(F.col("image_id").isNull(), "no_image").when(F.col("_category").isNull(), "unknown_category").when(~F.coalesce(fine, F.lit(False)), "invalid")
    state = state.when(F.coalesce(F.col("iscrowd"), F.lit(0)) != 0, "crowd").when(small, "too_small").otherwise("kept")
    return rows.select(F.coalesce("image_id", "_image").alias("image_id"), "annotation_id", "label", state.alias("state"), F.when(state == "kept", box).alias("box"))


def annotations_per_image(rows: DataFrame) -> DataFrame:
    """How many images have how many annotations, from ``annotated``; those without any too: n_annotations, n_images."""
    by = rows.where("state != 'no_image'").groupBy("image_id").agg(F.count("annotation_id").alias("n_annotations"))
    return by.groupBy("n_annotations").agg(F.count("*").alias("n_images"))


def confusion(rows: DataFrame, *, target: str, predicted: str, classes: int) -> DataFrame:
    """The whole confusion matrix of classes 0 to ``classes - 1``, cells without rows too: target, predicted, n, support, recall (0 without
    support). Two counts and a table of fixed size."""
    n = rows.groupBy(F.col(target).cast("int").alias("target"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    spark = rows.sparkSession
    each = F.sequence(F.lit(0), F.lit(classes - 1))
    cells = spark.range(1).select(F.explode(each).alias("target")).select("target", F.explode(each).alias("predicted"))
    full = cells.join(n, ["target", "predicted"], "left").select("target", "predicted", F.coalesce("n", F.lit(0)).alias("n"))
    by = full.groupBy("target").agg(F.sum("n").alias("support"), F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n"))).alias("_right"))
    return full.join(F.broadcast(by), "target").select("target", "predicted", "n", "support", F.when(F.col("support") > 0, F.col("_right") / F.col("support")).otherwise(F.lit(0.0)).alias("recall"))


def confusion_totals(matrix: DataFrame) -> DataFrame:
    """count, accuracy, and the mean recall of the classes that have rows."""
    own = matrix.where("target = predicted")
    return own.agg(F.sum("support").alias("count"), (F.sum("n") / F.greatest(F.sum("support"), F.lit(1))).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("macro_recall_present_classes"))


def audit_rollup(records: DataFrame, links: DataFrame, *, split: str = "split") -> DataFrame:
    """Counts of an audit over grouped records (with ``root``) and the links between them: metric, key, n. Groups of several splits
    are promoted whole; a record whose split changes by that counts as promoted."""
    moved = promote(records, "root", split)
    changed = F.col("to_split") != F.when(F.col(split) == "valid", "dev").when(F.col(split) == "test", "internal_test").otherwise(F.col(split))
    groups = moved.groupBy("root").agg(F.count("*").alias("n"), F.count_distinct(split).alias("splits"))
    one = lambda df, metric, n: df.agg(n.cast("bigint").alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("key"), "n")
    parts = [
        one(groups, "images", F.coalesce(F.sum("n"), F.lit(0))), one(groups, "groups", F.count("*")), one(groups, "multi_image_groups", F.count_if(F.col("n") > 1)), one(groups, "largest_group", F.max("n")), one(groups, "cross_split_groups", F.count_if(F.col("splits") > 1)),
        one(moved, "promoted_images", F.count_if(changed)), links.groupBy(F.col("reason").alias("key")).agg(F.count("*").alias("n")).select(F.lit("edges").alias("metric"), "key", "n"),
        moved.groupBy(F.col(split).alias("key")).agg(F.count("*").alias("n")).select(F.lit("upstream_images").alias("metric"), "key", "n"), moved.groupBy(F.col("to_split").alias("key")).agg(F.count("*").alias("n")).select(F.lit("grouped_images").alias("metric"), "key", "n"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def inventory_violations(locked: DataFrame, enriched: DataFrame, crops: DataFrame) -> DataFrame:
    """What speaks against a selection lock: path, rule. ``locked``: path, split, sha256; ``enriched`` also has source_id and group_id; ``crops``:
    source_path, source_sha256, split, source_id, group_id. The enriched inventory must hold the locked paths and no others, each
    once, with their splits and hashes; a crop must come from one of them and agree with it."""
    a, b = locked.alias("a"), enriched.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    differs = lambda x, y: ~x.eqNullSafe(y)
    rule = F.when(F.col("b.path").isNull(), "not_enriched").when(F.col("a.path").isNull(), "not_locked").when(differs(F.col("a.split"), F.col("b.split")) | differs(F.col("a.sha256"), F.col("b.sha256")), "split_or_hash_differs")
    first = both.select(F.coalesce("a.path", "b.path").alias("path"), rule.alias("rule"))
    twice = enriched.groupBy("path").count().where("count > 1").select("path", F.lit("enriched_twice").alias("rule"))
    c = crops.alias("c").join(a, F.col("c.source_path") == F.col("a.path"), "left").join(enriched.dropDuplicates(["path"]).alias("b"), F.col("c.source_path") == F.col("b.path"), "left")
    why = F.when(F.col("a.path").isNull(), "crop_not_locked").when(differs(F.col("c.source_sha256"), F.col("a.sha256")) | differs(F.col("c.split"), F.col("a.split")), "crop_split_or_hash_differs")
    why = why.when(differs(F.col("c.source_id"), F.col("b.source_id")) | differs(F.col("c.group_id"), F.col("b.group_id")), "crop_identity_differs")
    third = c.select(F.col("c.source_path").alias("path"), why.alias("rule"))
    return first.unionByName(twice).unionByName(third).where("rule IS NOT NULL")


def selection_violations(lock: DataFrame) -> DataFrame:
    """Rules that a selection lock itself breaks: id, rule. ``lock``: id, schema_version, selected_at, thresholds, operating_threshold, and the
    pinned and found hashes checkpoint, checkpoint_found, manifest, manifest_found."""
    t = F.col("thresholds")
    fine = (F.size(t) > 0) & F.forall(t, lambda x: x.isNotNull() & finite(x) & (x > 0) & (x <= 1)) & (F.array_sort(F.array_distinct(t)) == t)
    fails = lambda x: ~F.coalesce(x, F.lit(False))
    rules = [
        ("schema_version", fails(F.col("schema_version") == 1)), ("selected_at", fails(F.col("selected_at").rlike(r"\A\d{4}-\d\d-\d\d[T ]\d\d:\d\d(:\d\d(\.\d+)?)?(Z|[-+]\d\d:?\d\d)\z"))), ("checkpoint", fails(F.col("checkpoint") == F.col("checkpoint_found"))),
        ("manifest", fails(F.col("manifest") == F.col("manifest_found"))), ("thresholds", fails(fine)), ("operating_threshold", fails(F.array_contains(t, F.col("operating_threshold")))),
    ]
    return lock.select("id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))).alias("rule"))


def cascade(hand: Column, before: Column, after: Column) -> Column:
    """A draft of a hand when its rules change from ``before`` to ``after`` (structs with family and flowers): what it says of
    circumstances has to be confirmed anew; another family clears what the first one alone knows, rules without flowers
    clear the flowers."""
    other = before["family"] != after["family"]
    none = lambda kind: F.lit(None).cast(kind)
    out = hand.withField("confirmed", F.lit(False))
    for name, value in (("heavenly", F.lit(False)), ("earthly", F.lit(False)), ("liable_player", none("int")), ("continuations", F.lit(0))):
        out = out.withField(name, F.when(other, value).otherwise(hand[name]))
    out = out.withField("source", F.when(other & (hand["source"] == "robConcealedKong"), none("string")).otherwise(hand["source"]))
    out = out.withField("flowers", F.when(~after["flowers"], F.array().cast("array<int>")).otherwise(hand["flowers"]))
    return out.withField("replacement", F.when(~after["flowers"] & (hand["replacement"] == "flower"), "none").otherwise(hand["replacement"]))
