"""Queries on manifest records: closed checks, eligibility, splits of groups, roll-ups, hashes, settings and registers."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.operators.audit import grouped
from lumora.operators.fingerprints import near_links
from lumora.operators.manifest import EXPOSURES, REQUIRED, SPLITS, UPSTREAM, assign_groups, closed_fields, consume, eligible, header_violations, manifest_components, manifest_digest, manifest_rollup, record_links, record_violations, split_violations, verify_files
from lumora.plans.audits import _ROOTS, _fingerprints, _near
from lumora.operators.session import confirm, fence, quiet_polls
from lumora.plans.base import register, table

QUERIES: dict = {}

# Records of a manifest, one for each vector; some break a rule. Spark and DuckDB read the same expressions.
_RECORD = {
    "id": "concat('r', CAST(vec_id AS VARCHAR(20)))", "path": "CASE WHEN vec_id % 41 = 0 THEN 'a/../b' WHEN vec_id % 43 = 0 THEN '/abs' WHEN vec_id % 73 = 0 THEN './a//b/' WHEN vec_id % 79 = 0 THEN '.' WHEN vec_id % 83 = 0 THEN concat('a', chr(92), 'b') WHEN vec_id % 89 = 0 THEN 'a ' ELSE concat('img/', CAST(vec_id AS VARCHAR(20)), '.png') END",
    "source_image": "CASE WHEN vec_id % 47 = 0 THEN ' ' WHEN vec_id % 97 = 0 THEN concat('s', chr(9)) ELSE concat('s', CAST(label AS VARCHAR(20))) END", "parent_capture": "CASE WHEN vec_id % 3 > 0 THEN 'cap' WHEN vec_id % 53 = 0 THEN 'Unknown' END",
    "session_id": "CASE WHEN vec_id % 5 > 0 THEN 'ses' END", "physical_tile_set": "CASE WHEN vec_id % 7 > 0 THEN 'set' END", "dataset_version": "'v1'",
    "sha256": "CASE WHEN vec_id % 59 = 0 THEN 'zz' WHEN vec_id % 101 = 0 THEN concat(sha256(CAST(vec_id AS VARCHAR(20))), chr(10)) ELSE sha256(CAST(vec_id AS VARCHAR(20))) END", "source_sha256": "sha256(CAST(label AS VARCHAR(20)))",
    "split": "CASE WHEN vec_id % 61 = 0 THEN 'bogus' WHEN vec_id % 10 = 0 THEN 'train' WHEN vec_id % 10 = 1 THEN 'holdout' WHEN vec_id % 10 = 2 THEN 'dev' ELSE 'unassigned' END",
    "exposure": "CASE WHEN vec_id % 11 = 0 THEN 'training' WHEN vec_id % 13 = 0 THEN 'development' ELSE 'unexposed' END",
    "upstream_training_status": "CASE WHEN vec_id % 17 = 0 THEN 'known_in_training' WHEN vec_id % 19 = 0 THEN 'verified_disjoint' ELSE 'unknown' END",
    "upstream_evidence": "CASE WHEN vec_id % 38 = 0 THEN 'letter' END", "dhash64": "CASE WHEN vec_id % 23 = 0 THEN NULL WHEN vec_id % 67 = 0 THEN 'xyz' ELSE substr(sha256(CAST(vec_id AS VARCHAR(20))), 1, 16) END",
    "annotation_path": "CASE WHEN vec_id % 2 = 0 THEN 'ann/a.json' END", "annotation_sha256": "CASE WHEN vec_id % 2 = 0 AND vec_id % 71 > 0 THEN sha256('a') END",
    "p1": "CASE WHEN vec_id % 29 = 0 THEN concat('r', CAST(vec_id AS VARCHAR(20))) WHEN vec_id % 31 = 0 THEN 'gone' WHEN vec_id % 103 = 1 THEN concat('r', CAST(vec_id + 1 AS VARCHAR(20))) WHEN vec_id % 103 = 2 THEN concat('r', CAST(vec_id - 1 AS VARCHAR(20))) WHEN vec_id % 4 = 0 AND vec_id > 0 THEN concat('r', CAST(vec_id - 1 AS VARCHAR(20))) END",
}
_REC_SQL = "SELECT vec_id, " + ", ".join(f"{v} AS {k}" for k, v in _RECORD.items()) + " FROM embeddings"


def _records(spark, d):
    import re

    exprs = {k: re.sub(r"sha256\(((?:CAST\([^()]*\([^()]*\)\))|'a')\)", r"sha2(\1, 256)", v) for k, v in _RECORD.items()}
    rows = table(spark, d, "embeddings").selectExpr("vec_id", *[f"{v} AS {k}" for k, v in exprs.items()])
    none = F.array().cast("array<string>")
    return rows.withColumn("parent_ids", F.when(F.col("p1").isNull(), none).otherwise(F.array("p1"))).withColumn("near_duplicate_clusters", none).drop("p1")


_RULES_SQL = """
CASE WHEN length(source_image) = 0 OR regexp_matches(source_image, '^\\s|\\s$') THEN 'invalid_source_image' END, CASE WHEN lower(parent_capture) = 'unknown' THEN 'unknown_parent_capture_not_null' END,
CASE WHEN path LIKE '/%' OR list_contains(string_split(path, '/'), '..') OR path = '.' OR contains(path, chr(92)) OR regexp_matches(path, '^\\s|\\s$') THEN 'unsafe_path' END, CASE WHEN NOT regexp_full_match(sha256, '[0-9a-f]{64}') THEN 'invalid_sha256' END,
CASE WHEN split NOT IN (""" + ", ".join(f"'{s}'" for s in SPLITS) + """) THEN 'invalid_split' END, CASE WHEN upstream_training_status = 'verified_disjoint' AND upstream_evidence IS NULL THEN 'evidence_required' END,
CASE WHEN p1 = id THEN 'self_parent' END, CASE WHEN NOT regexp_full_match(dhash64, '[0-9a-f]{16}') THEN 'invalid_dhash64' END,
CASE WHEN (annotation_path IS NULL) <> (annotation_sha256 IS NULL) THEN 'invalid_annotation_pair' END, CASE WHEN p1 IS NOT NULL AND p1 NOT IN (SELECT id FROM r) THEN 'dangling_parent' END, CASE WHEN id IN (SELECT a.id FROM r a JOIN r b ON a.p1 = b.id AND b.p1 = a.id AND a.id <> b.id) THEN 'cyclic_parents' END"""


@register(QUERIES, f"WITH r AS ({_REC_SQL}) SELECT id, rule FROM (SELECT id, unnest([{_RULES_SQL}]) AS rule FROM r) WHERE rule IS NOT NULL")
def record_rule_violations(spark, d):
    return record_violations(_records(spark, d).drop("vec_id"))


@register(QUERIES, "WITH k AS (SELECT vec_id, list_filter([" + ", ".join(f"'{k}'" for k in REQUIRED) + "], lambda x: NOT (vec_id % 7 = 0 AND x = 'path')) AS keys FROM embeddings), j AS (SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN list_append(keys, 'notes') WHEN vec_id % 11 = 0 THEN list_append(keys, 'colour') ELSE keys END AS keys FROM k) SELECT vec_id, NOT (vec_id % 7 = 0) AND NOT list_contains(keys, 'colour') AS closed FROM j")
def closed_record_fields(spark, d):
    """Whether the keys of a record are the required ones and none but optional ones beside them."""
    v = F.col("vec_id")
    keys = F.filter(F.array(*map(F.lit, REQUIRED)), lambda x: ~((v % 7 == 0) & (x == "path")))
    keys = F.when(v % 5 == 0, F.array_append(keys, F.lit("notes"))).when(v % 11 == 0, F.array_append(keys, F.lit("colour"))).otherwise(keys)
    return table(spark, d, "embeddings").select("vec_id", closed_fields(keys).alias("closed"))


_FIT_SQL = "exposure = 'unexposed' AND upstream_training_status <> 'known_in_training'"
_HOLD_SQL = f"{_FIT_SQL} AND parent_capture IS NOT NULL AND session_id IS NOT NULL AND physical_tile_set IS NOT NULL AND annotation_sha256 IS NOT NULL"


@register(QUERIES, f"WITH r AS ({_REC_SQL}) SELECT id, true AS dev, {_FIT_SQL} AS internal_test, {_HOLD_SQL} AS holdout FROM r")
def split_eligibility(spark, d):
    return _records(spark, d).select("id", *[eligible(s).alias(s) for s in ("dev", "internal_test", "holdout")])


def _grouped_records(spark, d):
    root = grouped(_fingerprints(spark, d), _near(spark, d), "vec_id").select("vec_id", "root")
    return _records(spark, d).join(root, "vec_id")


_RATIOS = {"train": 0.6, "dev": 0.2, "internal_test": 0.15, "holdout": 0.05}
_GROUPED_SQL = f"WITH RECURSIVE {_ROOTS}, r AS ({_REC_SQL}), m AS (SELECT r.*, roots.root FROM r JOIN roots USING (vec_id))"
_WEIGHTS = "0.2 AS w_dev, CASE WHEN fits_h THEN 0.05 ELSE 0.0 END AS w_hold, CASE WHEN fits_i THEN 0.15 ELSE 0.0 END AS w_int, 0.6 AS w_train"


@register(QUERIES, f"""{_GROUPED_SQL}, g AS (SELECT root, min(CASE WHEN split <> 'unassigned' THEN split END) AS fixed, bool_or(exposure = 'training') AS tr, bool_or(exposure = 'development') AS de,
  CAST('0x' || substr(sha256('7' || chr(0) || string_agg(id, chr(0) ORDER BY id)), 1, 13) AS BIGINT) / pow(2, 52) AS u, bool_and({_FIT_SQL}) AS fits_i, bool_and({_HOLD_SQL}) AS fits_h FROM m GROUP BY root),
w AS (SELECT *, {_WEIGHTS} FROM g), t AS (SELECT *, u * (w_dev + w_hold + w_int + w_train) AS v FROM w)
SELECT id, m.root, coalesce(fixed, CASE WHEN tr THEN 'train' WHEN de THEN 'dev' WHEN v < w_dev THEN 'dev' WHEN v < w_dev + w_hold THEN 'holdout' WHEN v < w_dev + w_hold + w_int THEN 'internal_test' ELSE 'train' END) AS to_split FROM m JOIN t USING (root)""")
def split_assignment(spark, d):
    """Splits of whole groups of near duplicates: fixed ones stay, exposed ones follow, others are dealt by a seeded hash."""
    return assign_groups(_grouped_records(spark, d), root="root", seed="7", ratios=_RATIOS).select("id", "root", "to_split")


@register(QUERIES, f"""{_GROUPED_SQL}, b AS (SELECT root FROM m WHERE split <> 'unassigned' GROUP BY root HAVING count(DISTINCT split) > 1)
SELECT id, 'split_leakage' AS rule FROM m WHERE root IN (SELECT root FROM b) UNION ALL SELECT id, 'not_eligible' FROM m WHERE split = 'holdout' AND NOT ({_HOLD_SQL})""")
def split_rule_violations(spark, d):
    return split_violations(_grouped_records(spark, d), root="root")


@register(QUERIES, f"""{_GROUPED_SQL}, fs AS (SELECT root, arg_min(split, id) AS split FROM m GROUP BY root)
SELECT 'records' AS metric, '' AS key, count(*) AS n FROM m UNION ALL SELECT 'components', '', count(DISTINCT root) FROM m
UNION ALL SELECT 'upstream_unknown_test_records', '', count(CASE WHEN split = 'holdout' AND upstream_training_status = 'unknown' THEN 1 END) FROM m
UNION ALL SELECT 'physical_identity_unknown_test_records', '', count(CASE WHEN split = 'holdout' AND physical_tile_set IS NULL THEN 1 END) FROM m
UNION ALL SELECT 'missing_perceptual_hashes', '', count(CASE WHEN dhash64 IS NULL THEN 1 END) FROM m
UNION ALL SELECT 'split_records', split, count(*) FROM m GROUP BY split UNION ALL SELECT 'split_components', split, count(*) FROM fs GROUP BY split""")
def manifest_counts(spark, d):
    return manifest_rollup(_grouped_records(spark, d), root="root")


@register(QUERIES, """WITH r AS (SELECT 'd' || doc_id AS id, CASE WHEN lang IS NOT NULL THEN '"' || lang || '"' ELSE 'null' END AS session, n_chars FROM documents WHERE doc_id IS NOT NULL),
j AS (SELECT substr(sha256(id), 1, 4) AS bucket, sha256('{"id":"' || id || '",' || CASE WHEN n_chars % 2 = 0 THEN '"notes":"n' || n_chars || '",' ELSE '' END || '"parent_ids":["a","b"],"session_id":' || session || '}') AS h FROM r),
b AS (SELECT bucket, sha256(string_agg(h, '' ORDER BY h)) AS h FROM j GROUP BY bucket)
SELECT sha256('m' || coalesce(string_agg(chr(10) || bucket || ':' || h, '' ORDER BY bucket), '')) AS hash FROM b""")
def manifest_hash(spark, d):
    r = table(spark, d, "documents").where("doc_id is not null")
    rows = r.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), F.when(F.col("n_chars") % 2 == 0, F.concat(F.lit("n"), F.col("n_chars").cast("string"))).alias("notes"), F.array(F.lit("b"), F.lit("a")).alias("parent_ids"), F.col("lang").alias("session_id"))
    return spark.createDataFrame([(manifest_digest(rows, "m"),)], "hash string")


@register(QUERIES, f"WITH r AS ({_REC_SQL}), f AS (SELECT path, sha256 || CASE WHEN vec_id % 37 = 0 THEN 'x' ELSE '' END AS found FROM r WHERE vec_id % 8 > 0) SELECT id, r.path, CASE WHEN found IS NULL THEN 'missing' ELSE 'differs' END AS issue FROM r LEFT JOIN f USING (path) WHERE path LIKE 'img/%' AND (found IS NULL OR found <> sha256)")
def file_verification(spark, d):
    """Pinned digests against those that were found."""
    r = _records(spark, d).where("path LIKE 'img/%'")
    found = r.where("vec_id % 8 > 0").select("path", F.concat("sha256", F.when(F.col("vec_id") % 37 == 0, "x").otherwise("")).alias("sha256"))
    return verify_files(r, found)


@register(QUERIES, "SELECT item_id, NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = item_id AND quality = 0) AS may_use FROM benchmark")
def exposure_register(spark, d):
    """Test ids that were never used, and those that were."""
    used = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("id"))
    new, old = consume(used, table(spark, d, "benchmark").select(F.col("item_id").cast("bigint").alias("id")))
    return new.select(F.col("id").alias("item_id"), F.lit(True).alias("may_use")).unionByName(old.select(F.col("id").alias("item_id"), F.lit(False).alias("may_use")))


@register(QUERIES, "SELECT page_id AS id, 'pages/' || page_id AS path, sha256(html) AS sha256, 'dev' AS split, 'development' AS exposure, 'unknown' AS upstream_training_status, CASE WHEN page_id % 10 IN (1, 3, 7) THEN 'conservative-review' ELSE '' END AS clusters FROM pages")
def provenance_records(spark, d):
    """Records of sources that were used before: all of them development, some in a cluster to be on the safe side."""
    p = table(spark, d, "pages")
    clusters = F.array_join(F.when((p["page_id"] % 10).isin(1, 3, 7), F.array(F.lit("conservative-review"))).otherwise(F.array().cast("array<string>")), ",")
    return p.select(F.col("page_id").alias("id"), F.concat(F.lit("pages/"), F.col("page_id").cast("string")).alias("path"), F.sha2("html", 256).alias("sha256"), F.lit("dev").alias("split"), F.lit(EXPOSURES[1]).alias("exposure"), F.lit(UPSTREAM[0]).alias("upstream_training_status"), clusters.alias("clusters"))


ALLOWED_SOURCES = ("web", "wiki", "books", "forum")


@register(QUERIES, "SELECT doc_id, source FROM documents WHERE source IN (SELECT source FROM (SELECT source, count(*) AS n FROM documents WHERE source IS NOT NULL GROUP BY source ORDER BY n DESC, source LIMIT 3))")
def allowed_sources(spark, d):
    """Rows whose source is on an allow-list, here the three most frequent ones: a broadcast semi-join."""
    docs = table(spark, d, "documents").select("doc_id", "source")
    allowed = docs.where("source is not null").groupBy("source").count().orderBy(F.desc("count"), "source").limit(3).select("source")
    return docs.join(F.broadcast(allowed), "source", "left_semi").select("doc_id", "source")


_BITS = "list_sum(list_transform(range({n}), lambda i: CASE WHEN embedding[i + {a}] > embedding[i + {b}] THEN CAST(1 AS BIGINT) << i ELSE 0 END))::BIGINT"


@register(QUERIES, f"""WITH f AS (SELECT vec_id, {_BITS.format(n=14, a=1, b=2)} AS dh, {_BITS.format(n=20, a=20, b=21)} AS ph, CAST(100 + label AS DOUBLE) / 100 AS ratio, [vec_id % 7 * 3, vec_id % 5 * 2, label] AS rgb FROM embeddings),
p AS (SELECT a.vec_id AS u, b.vec_id AS v, bit_count(xor(a.dh, b.dh)) AS d1, bit_count(xor(a.ph, b.ph)) AS d2, abs(b.ratio / a.ratio - 1) AS da, (abs(a.rgb[1] - b.rgb[1]) + abs(a.rgb[2] - b.rgb[2]) + abs(a.rgb[3] - b.rgb[3])) / 3.0 AS mae FROM f a JOIN f b ON a.vec_id < b.vec_id),
c AS (SELECT dh, min(vec_id) AS rep FROM f GROUP BY dh), k AS (SELECT dh, ph, ratio, rgb, min(vec_id) AS lo FROM f GROUP BY ALL),
m AS (SELECT vec_id, lo FROM f JOIN k ON f.dh = k.dh AND f.ph = k.ph AND f.ratio = k.ratio AND f.rgb = k.rgb)
SELECT u, v, 'dhash' AS reason FROM p WHERE d1 = 1 AND u IN (SELECT rep FROM c) AND v IN (SELECT rep FROM c) UNION ALL SELECT rep, vec_id, 'dhash' FROM f JOIN c USING (dh) WHERE vec_id <> rep
UNION ALL SELECT DISTINCT least(a.lo, b.lo), greatest(a.lo, b.lo), 'phash_mae' FROM p JOIN m a ON a.vec_id = p.u JOIN m b ON b.vec_id = p.v WHERE d1 > 1 AND d2 <= 2 AND da <= 0.05 AND mae <= 4.0""")
def near_link_reasons(spark, d):
    """Near duplicates by either rule, with the first one that holds."""
    e = F.col("embedding")

    def bits(n, at):
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0).cast("bigint"), lambda s, i: s + F.when(F.get(e, i + at) > F.get(e, i + at + 1), F.pow(F.lit(2), i).cast("bigint")).otherwise(F.lit(0).cast("bigint")))

    v = F.col("vec_id")
    rows = table(spark, d, "embeddings").select("vec_id", bits(14, 0).alias("dh"), bits(20, 19).alias("ph"), (100 + F.col("label")).cast("double").alias("w"), F.lit(100.0).alias("h"), F.array(v % 7 * 3, v % 5 * 2, F.col("label").cast("bigint")).alias("rgb"))
    return near_links(rows, id_col="vec_id", dhash_col="dh", phash_col="ph", width_col="w", height_col="h", rgb_col="rgb", dhash_distance=1, phash_distance=2, mae=4.0)


# Settings as JSON texts: some cut off, some with a value that no rule allows, some with overrides of unknown patterns.
_SETTINGS = {
    "raw": """CASE WHEN c_custkey % 7 = 0 THEN '{"minimum":' WHEN c_custkey % 11 = 0 THEN NULL ELSE concat('{"minimum":', CAST(c_custkey % 14 AS VARCHAR(9)), ',"cap":', CAST(8 + c_custkey % 3 AS VARCHAR(9)), ',"overrides":{"chows":', CAST(c_custkey % 4 AS VARCHAR(9)), ',"colour":2}}') END""",
}
DEFAULT_MINIMUM, DEFAULT_CAP = 3, 10
VALID_PATTERNS = ("chows", "pungs", "flush")


def read_settings(raw):
    """Settings of a JSON text, or the defaults where it can't be read or breaks a rule; overrides of known patterns only.
    A struct of minimum, cap, overrides and whether the defaults were used."""
    got = F.from_json(raw, "minimum int, cap int, overrides map<string,int>", {"mode": "PERMISSIVE"})
    fine = F.coalesce((got["minimum"] >= 0) & (got["cap"] >= 1) & (got["minimum"] <= got["cap"]), F.lit(False))
    kept = F.map_filter(got["overrides"], lambda k, v: k.isin(*VALID_PATTERNS) & v.isNotNull())
    return F.struct(
        F.when(fine, got["minimum"]).otherwise(DEFAULT_MINIMUM).alias("minimum"), F.when(fine, got["cap"]).otherwise(DEFAULT_CAP).alias("cap"),
        F.when(fine & kept.isNotNull(), kept).otherwise(F.create_map().cast("map<string,int>")).alias("overrides"), (~fine & raw.isNotNull()).alias("defaulted"),
    )


@register(QUERIES, f"""WITH s AS (SELECT c_custkey, {_SETTINGS['raw']} AS raw FROM customer), j AS (SELECT c_custkey, raw, CASE WHEN json_valid(raw) THEN CAST(json_extract_string(raw, '$.minimum') AS INT) END AS m, CASE WHEN json_valid(raw) THEN CAST(json_extract_string(raw, '$.cap') AS INT) END AS c,
  CASE WHEN json_valid(raw) THEN json_extract_string(raw, '$.overrides.chows') END AS o FROM s)
SELECT c_custkey, CASE WHEN m <= c THEN m ELSE 3 END AS minimum, CASE WHEN m <= c THEN c ELSE 10 END AS cap, CASE WHEN m <= c THEN 'chows=' || o ELSE '' END AS overrides, raw IS NOT NULL AND coalesce(m > c, true) AS defaulted FROM j""")
def settings_read(spark, d):
    rows = table(spark, d, "customer").selectExpr("c_custkey", f"{_SETTINGS['raw']} AS raw").withColumn("s", read_settings(F.col("raw")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("s.overrides")), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    return rows.select("c_custkey", "s.minimum", "s.cap", text.alias("overrides"), "s.defaulted")


@register(QUERIES, """SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'hongKong' ELSE 'taiwanese' END AS family, CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN CAST(o_custkey % 4 AS INT) END AS liable_player,
CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_custkey % 3 AS INT) ELSE 0 END AS continuations, CASE WHEN o_orderkey % 3 = 0 THEN 'selfDraw' ELSE 'discard' END AS source, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey % 4 AS INT) END AS discarder FROM orders""")
def draft_cascade(spark, d):
    """A change of rules clears what depends on them: liability is known to one family, continuations to the other; a hand
    that was drawn has no discarder."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    family = F.when(k % 2 == 0, "hongKong").otherwise("taiwanese")
    draft = F.struct(family.alias("family"), F.when(k % 3 == 0, c % 4).cast("int").alias("liable_player"), (c % 3).cast("int").alias("continuations"), F.when(k % 3 == 0, "selfDraw").otherwise("discard").alias("source"), (c % 4).cast("int").alias("discarder"))
    none = F.lit(None).cast("int")
    rows = table(spark, d, "orders").select("o_orderkey", draft.alias("d"))
    x = F.col("d")
    x = x.withField("liable_player", F.when(F.col("d.family") == "hongKong", F.col("d.liable_player")).otherwise(none)).withField("continuations", F.when(F.col("d.family") == "taiwanese", F.col("d.continuations")).otherwise(0)).withField("discarder", F.when(F.col("d.source") != "selfDraw", F.col("d.discarder")).otherwise(none))
    return rows.select("o_orderkey", x.alias("d")).select("o_orderkey", "d.*")


@register(QUERIES, "WITH l AS (SELECT DISTINCT lang AS x FROM documents WHERE lang IS NOT NULL UNION SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) SELECT x AS label FROM l")
def label_domain(spark, d):
    """The union of the domains of two labellings."""
    docs = table(spark, d, "documents")
    return docs.select(F.col("lang").alias("label")).union(docs.select("source")).where("label is not null").distinct()


@register(QUERIES, """WITH r AS (SELECT p.page_id, p.url, p.page_id % 7 AS source_id FROM pages p), s AS (SELECT n_nationkey AS source_id, n_name FROM nation WHERE n_nationkey < 5) SELECT page_id, n_name, s.source_id IS NULL AS orphan FROM r LEFT JOIN s USING (source_id)""")
def regions_with_sources(spark, d):
    """Regions with their sources, by a lookup; regions whose source is missing are said so."""
    s = table(spark, d, "nation").where("n_nationkey < 5").select(F.col("n_nationkey").cast("bigint").alias("source_id"), "n_name", F.lit(True).alias("found"))
    r = table(spark, d, "pages").select("page_id", (F.col("page_id") % 7).alias("source_id"))
    return r.join(F.broadcast(s), "source_id", "left").select("page_id", "n_name", F.col("found").isNull().alias("orphan"))


@register(QUERIES, "SELECT event_id FROM events WHERE event_id % 25 = 0 EXCEPT SELECT event_id FROM events WHERE event_type <> 'purchase'")
def undecoded_frames(spark, d):
    """Selected frames that were not decoded: must be empty for a complete replay."""
    e = table(spark, d, "events")
    return e.where("event_id % 25 = 0").select("event_id").join(e.where("event_type <> 'purchase'").select("event_id"), "event_id", "left_anti")


@register(QUERIES, "WITH a AS (SELECT doc_id, n_chars FROM documents), b AS (SELECT doc_id, quality, toxic FROM labels), c AS (SELECT item_id AS doc_id FROM benchmark) SELECT CASE WHEN a.doc_id IS NULL THEN 'no_original' WHEN b.doc_id IS NULL THEN 'no_assignment' WHEN c.doc_id IS NULL THEN 'no_crop' WHEN a.n_chars % 2 <> b.quality THEN 'quality_differs' WHEN a.n_chars % 3 = 0 AND b.toxic = 1 THEN 'toxic_differs' ELSE 'same' END AS state, count(*) AS n FROM a FULL JOIN b ON a.doc_id = b.doc_id FULL JOIN c ON coalesce(a.doc_id, b.doc_id) = c.doc_id GROUP BY state")
def lineage_states(spark, d):
    """Three inventories joined, with the first thing that differs."""
    a, b = table(spark, d, "documents").select("doc_id", "n_chars"), table(spark, d, "labels").select("doc_id", "quality", "toxic")
    c = table(spark, d, "benchmark").select(F.col("item_id").cast("bigint").alias("doc_id"), F.lit(True).alias("crop"))
    both = a.withColumn("a", F.lit(True)).join(b.withColumn("b", F.lit(True)), "doc_id", "full").join(c, "doc_id", "full")
    state = F.when(F.col("a").isNull(), "no_original").when(F.col("b").isNull(), "no_assignment").when(F.col("crop").isNull(), "no_crop").when(F.col("n_chars") % 2 != F.col("quality"), "quality_differs").when((F.col("n_chars") % 3 == 0) & (F.col("toxic") == 1), "toxic_differs").otherwise("same")
    return both.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@register(QUERIES, f"""WITH RECURSIVE {_ROOTS}, s AS (SELECT vec_id, root, CASE vec_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' END AS split FROM roots), g AS (SELECT root, count(*) AS size, count(DISTINCT split) AS splits FROM s GROUP BY root),
x AS (SELECT 'rows' AS metric, coalesce(split, 'none') AS key, count(*) AS n FROM s GROUP BY split UNION ALL SELECT 'groups', '', count(*) FROM g UNION ALL SELECT 'groups_of_several', '', count(CASE WHEN size > 1 THEN 1 END) FROM g UNION ALL SELECT 'largest_group', '', max(size) FROM g
  UNION ALL SELECT 'groups_across_splits', '', count(CASE WHEN splits > 1 THEN 1 END) FROM g)
SELECT metric, key, CAST(n AS BIGINT) AS n FROM x""")
def group_rollup(spark, d):
    """Rows by split, groups, those of several rows, the largest, and those across splits."""
    split = F.when(F.col("vec_id") % 4 == 0, "train").when(F.col("vec_id") % 4 == 1, "valid").when(F.col("vec_id") % 4 == 2, "test")
    s = grouped(_fingerprints(spark, d), _near(spark, d), "vec_id").withColumn("split", split)
    g = s.groupBy("root").agg(F.count("*").alias("size"), F.count_distinct("split").alias("splits"))
    one = g.agg(F.count("*").alias("groups"), F.count_if(F.col("size") > 1).alias("groups_of_several"), F.max("size").alias("largest_group"), F.count_if(F.col("splits") > 1).alias("groups_across_splits"))
    wide = one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.lit("").alias("key"), F.col(c).alias("n")) for c in one.columns])).alias("x")).select("x.*")
    return wide.unionByName(s.groupBy(F.coalesce("split", F.lit("none")).alias("key")).agg(F.count("*").alias("n")).select(F.lit("rows").alias("metric"), "key", "n"))


@register(QUERIES, "WITH g AS (SELECT user_id, event_id, CAST(floor(value) AS BIGINT) % 5 + event_id // 40 AS generation FROM events), m AS (SELECT *, max(generation) OVER (PARTITION BY user_id ORDER BY event_id) AS newest FROM g) SELECT event_id, generation FROM m WHERE generation = newest")
def fenced_results(spark, d):
    """Results of the newest generation so far; those of an older one are dropped."""
    g = table(spark, d, "events").select("user_id", "event_id", (F.floor("value") % 5 + F.floor(F.col("event_id") / 40)).alias("generation"))
    return fence(g, key="user_id", order="event_id", generation="generation").select("event_id", "generation")


@register(QUERIES, "WITH s AS (SELECT user_id, event_id, event_type, lag(event_id % 3) OVER w AS shown, lag(event_id) OVER w AS shown_at, event_id % 3 AS current FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, coalesce(shown = current AND event_id - shown_at <= 60, false) AS accepted FROM s WHERE event_type = 'click'")
def confirmed_clicks(spark, d):
    """A click counts if what was shown is still what is current, and not too old."""
    rows = table(spark, d, "events").select("user_id", "event_id", "event_type")
    return confirm(rows, key="user_id", order="event_id", at="event_id", shown=F.col("event_id") % 3, click=F.col("event_type") == "click", within=60).select("event_id", "accepted")


@register(QUERIES, "WITH m AS (SELECT user_id, event_id, event_id * 130 AS ms, lead(event_id * 130) OVER (PARTITION BY user_id ORDER BY event_id) AS next FROM events), p AS (SELECT *, ((ms + 1200) // 200 + 1) * 200 AS poll FROM m) SELECT event_id, poll FROM p WHERE next IS NULL OR next > poll")
def expiry_polls(spark, d):
    """The first poll, every 200 ms, that finds the last frame more than 1200 ms old, where no other frame came before."""
    rows = table(spark, d, "events").select("user_id", "event_id", (F.col("event_id") * 130).alias("ms"))
    return quiet_polls(rows, key="user_id", order="event_id", at="ms", expiry=1200, every=200).select("event_id", "poll")


# Records whose relations make small groups: fields, hashes across their two columns, clusters, parents and near fingerprints.
_RELATED = {
    "id": "concat('d', CAST(doc_id AS VARCHAR(20)))", "source_image": "concat('i', CAST(CASE WHEN doc_id % 7 = 0 THEN doc_id - 3 ELSE doc_id END AS VARCHAR(20)))",
    "parent_capture": "CASE WHEN n_chars % 5 = 0 THEN concat('cap', CAST(n_chars AS VARCHAR(20))) END", "session_id": "CASE WHEN doc_id % 23 = 0 THEN concat('ses', CAST(FLOOR(doc_id / 69) AS VARCHAR(20))) END", "physical_tile_set": "CAST(NULL AS VARCHAR(9))",
    "sha256": "CASE WHEN doc_id % 10 = 3 THEN sha256(CAST(doc_id AS VARCHAR(20))) ELSE sha256(coalesce(text, '')) END", "source_sha256": "CASE WHEN doc_id % 9 = 0 THEN sha256(CAST(doc_id + 4 AS VARCHAR(20))) ELSE sha256(CAST(doc_id AS VARCHAR(20))) END",
    "p1": "CASE WHEN doc_id % 37 = 5 THEN concat('d', CAST(doc_id - 5 AS VARCHAR(20))) END", "c1": "CASE WHEN doc_id % 29 < 2 THEN concat('c', CAST(FLOOR(doc_id / 29) AS VARCHAR(20))) END", "c2": "CASE WHEN doc_id % 31 < 2 THEN concat('c', CAST(1000000 + FLOOR(doc_id / 31) AS VARCHAR(20))) END",
    "dhash64": "CASE WHEN doc_id % 4 = 0 THEN concat(substr(sha256(CAST(FLOOR(doc_id / 24) AS VARCHAR(20))), 1, 15), CAST(doc_id % 6 AS VARCHAR(9))) END",
}
_RELATED_SQL = f"""r AS (SELECT doc_id, {', '.join(f'{v} AS {k}' for k, v in _RELATED.items())} FROM documents WHERE doc_id IS NOT NULL),
k AS (SELECT id, 'source_image' AS space, source_image AS value FROM r UNION ALL SELECT id, 'parent_capture', parent_capture FROM r UNION ALL SELECT id, 'session_id', session_id FROM r UNION ALL SELECT id, 'hash', sha256 FROM r
  UNION ALL SELECT id, 'hash', source_sha256 FROM r UNION ALL SELECT id, 'near_cluster', c1 FROM r UNION ALL SELECT id, 'near_cluster', c2 FROM r),
o AS (SELECT space, value, min(id) AS u FROM k WHERE value IS NOT NULL GROUP BY ALL), h AS (SELECT id, CAST('0x' || dhash64 AS UBIGINT) AS bits FROM r WHERE dhash64 IS NOT NULL), hc AS (SELECT bits, min(id) AS u FROM h GROUP BY bits),
l AS (SELECT DISTINCT u, v, reason FROM (SELECT o.u, k.id AS v, o.space AS reason FROM k JOIN o USING (space, value) UNION ALL SELECT least(p1, id), greatest(p1, id), 'parent' FROM r WHERE p1 IS NOT NULL
  UNION ALL SELECT least(a.u, b.u), greatest(a.u, b.u), 'near_hash' FROM hc a JOIN hc b ON a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= 4 UNION ALL SELECT hc.u, h.id, 'near_hash' FROM h JOIN hc USING (bits)) WHERE u <> v)"""


def _related(spark, d):
    import re

    rows = table(spark, d, "documents").where("doc_id IS NOT NULL").selectExpr(*[f"{re.sub(r'sha256[(]((?:CAST|coalesce)[(](?:[^()]|[(][^()]*[)])*[)])[)]', r'sha2(\1, 256)', v)} AS {k}" for k, v in _RELATED.items()])
    some = lambda *names: F.array_compact(F.array(*names))
    return rows.withColumn("parent_ids", some("p1")).withColumn("near_duplicate_clusters", some("c1", "c2")).drop("p1", "c1", "c2")


@register(QUERIES, f"WITH {_RELATED_SQL} SELECT u, v, reason FROM l")
def manifest_links(spark, d):
    """Links of records by all their relations, with the reason of each."""
    return record_links(_related(spark, d))


@register(QUERIES, f"WITH RECURSIVE {_RELATED_SQL}, e AS (SELECT u, v FROM l UNION SELECT v, u FROM l), reach(a, b) AS (SELECT id, id FROM r UNION SELECT reach.a, e.v FROM reach JOIN e ON reach.b = e.u) SELECT a AS id, min(b) AS root FROM reach GROUP BY a")
def manifest_groups(spark, d):
    """The group of each record: what all its relations reach."""
    return manifest_components(_related(spark, d)).select("id", "root")


@register(QUERIES, """SELECT name AS manifest_id, unnest(list_filter([CASE WHEN k % 5 = 0 THEN 'header_keys' END, CASE WHEN k % 3 = 0 THEN 'schema_version' END, CASE WHEN name <> trim(name) THEN 'manifest_id' END, CASE WHEN n = 0 THEN 'no_records' END], lambda x: x IS NOT NULL)) AS rule
FROM (SELECT CASE WHEN c_nationkey % 4 = 0 THEN ' m' || c_nationkey ELSE 'm' || c_nationkey END AS name, c_nationkey AS k, count(*) FILTER (c_acctbal > 9000) AS n FROM customer GROUP BY c_nationkey)""")
def manifest_headers(spark, d):
    """Rules that headers of manifests break."""
    k = F.col("c_nationkey")
    by = table(spark, d, "customer").groupBy(k).agg(F.count_if(F.col("c_acctbal") > 9000).alias("n_records"))
    keys = F.when(k % 5 == 0, F.array(F.lit("records"), F.lit("manifest_id"))).otherwise(F.array(F.lit("schema_version"), F.lit("records"), F.lit("manifest_id")))
    header = by.select(keys.alias("keys"), F.when(k % 3 == 0, 2).otherwise(1).alias("schema_version"), F.concat(F.when(k % 4 == 0, " m").otherwise("m"), k.cast("string")).alias("manifest_id"), "n_records")
    return header_violations(header)
