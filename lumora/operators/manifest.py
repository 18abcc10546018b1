"""Records of a data-set manifest: closed checks, eligibility, splits of whole groups, canonical hash, lock and register."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.operators.fingerprints import hamming_links, hash_bits
from lumora.operators.graph import components, cycle_nodes
from lumora.operators.ordered import group_hashes

# The fields of a record and the words that some of them may hold.
REQUIRED = (
    "id", "path", "source_image", "parent_capture", "session_id", "physical_tile_set", "dataset_version", "sha256", "source_sha256", "split", "exposure",
    "upstream_training_status", "parent_ids", "near_duplicate_clusters",
)
OPTIONAL = ("dhash64", "annotation_path", "annotation_sha256", "notes", "upstream_evidence")
SPLITS = ("dev", "holdout", "internal_test", "quarantine", "train", "unassigned")
PROTECTED = ("internal_test", "holdout")
EXPOSURES = ("unexposed", "development", "training")
UPSTREAM = ("unknown", "known_in_training", "verified_disjoint")
NOT_KNOWN = ("unknown", "none", "n/a", "null")


def _fails(x: Column) -> Column:
    """Where a condition is false or null."""
    return ~F.coalesce(x, F.lit(False))


#: White space that a text may not begin or end with, as a class of a regular expression.
BLANK = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The fields by whose equal values records belong together, each in a name space of its own; both hashes are in one.
GROUP_FIELDS, HASH_FIELDS = ("source_image", "parent_capture", "session_id", "physical_tile_set"), ("sha256", "source_sha256")


def stripped(value: Column) -> Column:
    """Whether a text is not empty and has no white space at its ends."""
    return (F.length(value) > 0) & ~value.rlike(rf"\A{BLANK}|{BLANK}\z")


def _text(name: str) -> Column:
    return stripped(F.col(name))


def _hex(name: str, digits: int) -> Column:
    return F.col(name).rlike(rf"\A[0-9a-f]{{{digits}}}\z")


def safe_path(path: Column) -> Column:
    """Relative, with no ``..`` part and no backslash; empty and ``.`` parts of a longer path don't count."""
    return stripped(path) & ~path.contains("\\") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..") & (path != ".")


def _distinct_texts(name: str) -> Column:
    return F.forall(name, lambda v: F.coalesce(stripped(v), F.lit(False))) & (F.size(F.array_distinct(name)) == F.size(name))


def record_rules(columns: list[str]) -> dict[str, Column]:
    """Name and violation of every rule on a single record. Optional fields that are no columns are absent."""
    has = lambda c: F.col(c).isNotNull() if c in columns else F.lit(False)
    rules = {f"invalid_{k}": _fails(_text(k)) for k in ("id", "source_image", "dataset_version")}
    rules |= {f"unknown_{k}_not_null": F.col(k).isNotNull() & (_fails(_text(k)) | F.lower(k).isin(*NOT_KNOWN)) for k in ("parent_capture", "session_id", "physical_tile_set")}
    rules |= {"unsafe_path": _fails(safe_path(F.col("path")))} | {f"invalid_{k}": _fails(_hex(k, 64)) for k in ("sha256", "source_sha256")}
    rules |= {f"invalid_{k}": _fails(F.col(k).isin(*words)) for k, words in (("split", SPLITS), ("exposure", EXPOSURES), ("upstream_training_status", UPSTREAM))}
    rules["evidence_required"] = (F.col("upstream_training_status") == "verified_disjoint") & (_fails(_text("upstream_evidence")) if "upstream_evidence" in columns else F.lit(True))
    rules |= {f"invalid_{k}": _fails(_distinct_texts(k)) for k in ("parent_ids", "near_duplicate_clusters")}
    rules["self_parent"] = F.coalesce(F.array_contains("parent_ids", F.col("id")), F.lit(False))
    rules |= {f"invalid_{k}": has(k) & _fails(check) for k, check in (("dhash64", _hex("dhash64", 16)), ("notes", _text("notes")), ("upstream_evidence", _text("upstream_evidence"))) if k in columns}
    pair = ("annotation_path", "annotation_sha256")
    if set(pair) & set(columns):
        fine = safe_path(F.col(pair[0])) & _hex(pair[1], 64) if set(pair) <= set(columns) else F.lit(False)
        rules["invalid_annotation_pair"] = (has(pair[0]) | has(pair[1])) & _fails(fine)
    return rules


def record_violations(records: DataFrame) -> DataFrame:
    """id and rule of each violation: those of single records, ids that repeat, parents that are not there, and records on a cycle of
    parents (or between two cycles). Runs jobs when called, for the cycles."""
    rules = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in record_rules(records.columns).items()]))
    single = records.select("id", F.explode(rules).alias("rule"))
    twice = records.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("rule"))
    parents = records.select("id", F.explode("parent_ids").alias("parent"))
    gone = parents.join(records.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", F.lit("dangling_parent").alias("rule")).distinct()
    edges = parents.where("id IS NOT NULL AND parent IS NOT NULL AND id != parent").select(F.col("parent").alias("src"), F.col("id").alias("dst"))
    loops = cycle_nodes(edges).select(F.col("node").alias("id"), F.lit("cyclic_parents").alias("rule"))
    return single.unionByName(twice).unionByName(gone).unionByName(loops)


def header_violations(header: DataFrame) -> DataFrame:
    """Rules that the header of a manifest breaks: manifest_id, rule. ``header``: keys array<string>, schema_version, manifest_id, n_records."""
    keys = F.array(*map(F.lit, ("manifest_id", "records", "schema_version")))
    rules = [("header_keys", _fails(F.array_sort("keys") == keys)), ("schema_version", _fails(F.col("schema_version") == 1)), ("manifest_id", _fails(_text("manifest_id"))), ("no_records", _fails(F.col("n_records") > 0))]
    return header.select("manifest_id", F.explode(F.array_compact(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]))).alias("rule"))


def record_links(records: DataFrame, *, near_distance: int = 4) -> DataFrame:
    """Links (u, v, reason) between records by all their relations: equal values of one of ``GROUP_FIELDS``, any two of ``HASH_FIELDS`` equal,
    a shared near-duplicate cluster, a parent, dHashes of at most ``near_distance`` bits apart. Nulls link nothing.

    A value is a node of its own: it links each of its records to the smallest one, so a value that many records share gives as
    many links and not their pairs. The minimum is partial before its shuffle; beyond that a value's records are looked up by a join
    that Spark may split."""
    if not 0 <= near_distance < 64:
        raise ValueError("the distance must be in 0..63")
    spaces = [(k, F.array(k)) for k in GROUP_FIELDS] + [("hash", F.array(*HASH_FIELDS)), ("near_cluster", F.col("near_duplicate_clusters"))]
    keys = F.flatten(F.array(*[_spaced(name, values) for name, values in spaces]))
    keyed = records.select(F.col("id").alias("v"), F.explode(F.array_distinct(keys)).alias("k")).where("k.value IS NOT NULL").select("v", "k.space", "k.value")
    first = keyed.groupBy("space", "value").agg(F.min("v").alias("u"))
    shared = keyed.join(first, ["space", "value"]).where("u != v").select("u", "v", F.col("space").alias("reason"))
    parents = records.select(F.explode("parent_ids").alias("p"), "id").where("p IS NOT NULL AND p != id").select(F.least("p", "id").alias("u"), F.greatest("p", "id").alias("v"), F.lit("parent").alias("reason"))
    out = shared.unionByName(parents)
    if "dhash64" in records.columns:
        near = hamming_links(records.select("id", hash_bits(F.col("dhash64")).alias("bits")), id_col="id", bits_col="bits", distance=near_distance)
        out = out.unionByName(near.select("u", "v", F.lit("near_hash").alias("reason")))
    return out.distinct()


def _spaced(name: str, values: Column) -> Column:
    return F.transform(values, lambda x: F.struct(F.lit(name).alias("space"), x.alias("value")))


def manifest_components(records: DataFrame, *, near_distance: int = 4) -> DataFrame:
    """The records with ``root``: the smallest id that all relations of ``record_links``, taken together, reach."""
    roots = components(record_links(records, near_distance=near_distance)).withColumnRenamed("u", "id")
    return records.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def closed_fields(keys: Column) -> Column:
    """Whether a record's keys hold all required ones and none but these and the optional ones."""
    required, allowed = (F.array(*map(F.lit, x)) for x in (REQUIRED, REQUIRED + OPTIONAL))
    return (F.size(F.array_except(required, keys)) == 0) & (F.size(F.array_except(keys, allowed)) == 0)


def eligible(split: str) -> Column:
    """Whether a record may be in a split. Protected ones take only unexposed records that no training is known of; holdout
    also asks for a capture, a session, a set of tiles and an annotation."""
    if split not in PROTECTED:
        return F.lit(True)
    clean = (F.col("exposure") == "unexposed") & (F.col("upstream_training_status") != "known_in_training")
    if split == "holdout":
        for k in ("parent_capture", "session_id", "physical_tile_set", "annotation_sha256"):
            clean = clean & F.col(k).isNotNull()
    return F.coalesce(clean, F.lit(False))


def group_units(records: DataFrame, *, root: str, seed: str, id_col: str) -> DataFrame:
    """A value in [0, 1) for each group, ``_unit``: the first 52 bits of the hash of the seed and the sorted ids, with zero bytes between."""
    digests = group_hashes(records, by=root, id_col=id_col, start=f"{seed}\0", between="\0")
    return digests.select(root, (F.conv(F.substring("digest", 1, 13), 16, 10).cast("double") / float(2**52)).alias("_unit"))


def assign_groups(records: DataFrame, *, root: str, seed: str, ratios: dict[str, float], id_col: str = "id") -> DataFrame:
    """The records with ``to_split``, the same for a whole group (``root``): a split that is fixed stays; records
    exposed in training or development go to train or dev; other groups are dealt by their unit value among the splits
    that all their records are eligible for, or get none. A group fixed to several splits has the first by name (audits report it).

    A group's ids are hashed together, so they pass through one task, as a sorted stream."""
    if not ratios or not set(ratios) <= set(SPLITS) - {"unassigned"} or not all(0 <= v < float("inf") for v in ratios.values()) or not sum(ratios.values()):
        raise ValueError("invalid split ratios")
    names = sorted(s for s, w in ratios.items() if w > 0)
    by = records.groupBy(root).agg(
        F.min(F.when(F.col("split") != "unassigned", F.col("split"))).alias("_fixed"), F.bool_or(F.col("exposure") == "training").alias("_train"), F.bool_or(F.col("exposure") == "development").alias("_dev"),
        *[F.bool_and(eligible(s)).alias(f"_fits_{s}") for s in names],
    ).join(group_units(records, root=root, seed=seed, id_col=id_col), root)
    total = sum((F.when(F.col(f"_fits_{s}"), F.lit(float(ratios[s]))).otherwise(0.0) for s in names), F.lit(0.0))
    at, dealt, last = F.lit(0.0), F.lit(None).cast("string"), F.lit(None).cast("string")
    for s in names:
        at = at + F.when(F.col(f"_fits_{s}"), F.lit(float(ratios[s]))).otherwise(0.0)
        dealt = F.coalesce(dealt, F.when(F.col(f"_fits_{s}") & (F.col("_unit") * total < at), F.lit(s)))
        last = F.when(F.col(f"_fits_{s}"), F.lit(s)).otherwise(last)
    to = F.coalesce(F.col("_fixed"), F.when(F.col("_train"), "train").when(F.col("_dev"), "dev").otherwise(F.coalesce(dealt, last)))
    return records.join(by.select(root, to.alias("to_split")), root)


def split_violations(records: DataFrame, *, root: str, id_col: str = "id", split: str = "split") -> DataFrame:
    """Records in groups of several splits, and records not eligible for their own: id, rule."""
    named = F.when(F.col(split) != "unassigned", F.col(split))
    leaks = records.groupBy(root).agg(F.count_distinct(named).alias("_n")).where("_n > 1").select(root)
    may = F.lit(True)
    for s in PROTECTED:
        may = F.when(F.col(split) == s, eligible(s)).otherwise(may)
    a = records.join(leaks, root, "left_semi").select(id_col, F.lit("split_leakage").alias("rule"))
    return a.unionByName(records.where(~may).select(id_col, F.lit("not_eligible").alias("rule")))


def manifest_rollup(records: DataFrame, *, root: str) -> DataFrame:
    """Counts of an audit: metric, key, n."""
    protected = F.col("split").isin(*PROTECTED)
    whole = records.agg(
        F.count("*").alias("records"), F.count_distinct(root).alias("components"), F.count_if(protected & (F.col("upstream_training_status") == "unknown")).alias("upstream_unknown_test_records"),
        F.count_if(protected & F.col("physical_tile_set").isNull()).alias("physical_identity_unknown_test_records"), F.count_if(F.col("dhash64").isNull()).alias("missing_perceptual_hashes"),
    )
    names = whole.columns
    one = whole.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).alias("n")) for c in names])).alias("x")).select("x.*")
    by_split = records.groupBy(F.col("split").alias("key")).agg(F.count("*").alias("n")).select(F.lit("split_records").alias("metric"), "key", "n")
    first = records.groupBy(root).agg(F.min_by("split", "id").alias("key")).groupBy("key").agg(F.count("*").alias("n")).select(F.lit("split_components").alias("metric"), "key", "n")
    return one.unionByName(by_split).unionByName(first)


def record_json(columns: list[str]) -> Column:
    """A record as JSON: keys and the two lists sorted, optional fields that are null left out."""
    quoted = lambda k: F.regexp_extract(F.to_json(F.array(F.col(k))), r"(?s)\A\[(.*)\]\z", 1)
    parts = []
    for k in sorted(columns):
        value = F.to_json(F.array_sort(k)) if k in ("parent_ids", "near_duplicate_clusters") else F.coalesce(quoted(k), F.lit("null"))
        pair = F.concat(F.lit(f'"{k}":'), value)
        parts.append(F.when(F.col(k).isNotNull(), pair) if k in OPTIONAL else pair)
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def manifest_digest(records: DataFrame, manifest_id: str, digits: int = 4) -> str:
    """A SHA-256 of the manifest that many tasks work out: of each record, of the sorted hashes of the records whose ids' hashes begin with
    the same ``digits`` hexadecimal digits, and of those ``16 ** digits`` hashes at most in order, which the driver gets."""
    rows = records.select(F.substring(F.sha2("id", 256), 1, digits).alias("bucket"), F.sha2(record_json(records.columns), 256).alias("h"))
    by = rows.groupBy("bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h")).orderBy("bucket").collect()
    return hashlib.sha256("\n".join([manifest_id, *(f"{r['bucket']}:{r['h']}" for r in by)]).encode()).hexdigest()


def canonical_hash(records: DataFrame, manifest_id: str) -> str:
    """SHA-256 of the whole manifest as one JSON text, for exchange with tools that hash that text: records by id, written as
    ``record_json`` does. A hash of one text is one sequence: a single task reads the sorted records as a stream. ``manifest_digest`` scales."""
    columns = sorted(records.columns)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        h, first = hashlib.sha256(f'{{"manifest_id":{json.dumps(manifest_id, ensure_ascii=False)},"records":['.encode()), True
        for pdf in batches:
            for row in zip(*[pdf[c] for c in columns], strict=True):
                record = {}
                for k, v in zip(columns, row, strict=True):
                    if k in ("parent_ids", "near_duplicate_clusters"):
                        record[k] = sorted(v)
                    elif v is not None or k not in OPTIONAL:
                        record[k] = v
                h.update((("" if first else ",") + json.dumps(record, sort_keys=True, ensure_ascii=False, allow_nan=False, separators=(",", ":"))).encode())
                first = False
        h.update(b'],"schema_version":1}')
        yield pd.DataFrame({"hash": [h.hexdigest()]})

    return records.repartition(1).sortWithinPartitions("id").mapInPandas(run, "hash string").first()["hash"]


def make_lock(manifest_hash: str, report: dict) -> dict:
    """A lock over a manifest and an audit report, with its own hash."""
    lock = {"manifest_sha256": manifest_hash, "report": report}
    return lock | {"lock_sha256": hashlib.sha256(json.dumps(lock, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()}


def check_lock(lock: dict, manifest_hash: str, report: dict) -> list[str]:
    """What differs: the lock itself, the manifest or the report."""
    want = make_lock(lock.get("manifest_sha256"), lock.get("report"))
    return [name for name, bad in (("lock", want != lock), ("manifest", lock.get("manifest_sha256") != manifest_hash), ("report", lock.get("report") != report)) if bad]


def verify_files(records: DataFrame, digests: DataFrame) -> DataFrame:
    """Records whose file is missing or has another digest than the pinned one: id, path, issue. ``digests``: path, sha256."""
    found = digests.select("path", F.col("sha256").alias("_found"))
    issue = F.when(F.col("_found").isNull(), "missing").when(F.col("_found") != F.col("sha256"), "differs")
    return records.join(found, "path", "left").select("id", "path", issue.alias("issue")).where("issue IS NOT NULL")


def consume(register: DataFrame, ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, DataFrame]:
    """Ids that may be used (never registered), to append to the register, and those that were used before."""
    ids = ids.select(id_col).distinct()
    used = register.select(id_col)
    return ids.join(used, id_col, "left_anti"), ids.join(used, id_col, "left_semi")
