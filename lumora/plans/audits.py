"""Queries that audit data sets: duplicates, leakage, groups, splits, manifests and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.operators.audit import conflicts, exact_duplicates, group_ids, grouped, keep_first, leaking_groups, promote, shared_key_links
from lumora.operators.fingerprints import hamming_links
from lumora.operators.graph import cycle_nodes
from lumora.operators.ordered import running_sums
from lumora.plans.base import derive, derive_sql, register, table

QUERIES: dict = {}


@register(QUERIES, "SELECT text AS content, count(DISTINCT (lang, source)) AS n FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(DISTINCT (lang, source)) > 1")
def label_conflicts(spark, d):
    return conflicts(table(spark, d, "documents").where("text is not null"), "text", "lang", "source").withColumnRenamed("text", "content")


@register(QUERIES, "SELECT doc_id, lang, source FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"), "lang", "source")
    return keep_first(rows, "digest", "doc_id").select("doc_id", "lang", "source")


@register(QUERIES, "SELECT sha256(text) AS sha, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def duplicate_content(spark, d):
    return exact_duplicates(table(spark, d, "documents"), "text")


@register(QUERIES, "SELECT source, count(DISTINCT lang) AS n FROM documents GROUP BY source HAVING count(DISTINCT lang) <> 1")
def fd_violations(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count_distinct("lang").alias("n")).where("n <> 1")


@register(QUERIES, "SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def source_histogram(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


# Records of a manifest, from documents: keys, hashes, splits and exposures, some of them broken.
_REC = {
    "id": "doc_id", "path": "CASE WHEN doc_id % 17 = 0 THEN '../x' WHEN doc_id % 19 = 0 THEN '/abs' ELSE concat('img/', CAST(doc_id AS VARCHAR(20)), '.png') END",
    "sha": "CASE WHEN doc_id % 23 = 0 THEN 'zz' ELSE sha256(text) END", "split": "CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' WHEN 3 THEN 'bogus' END",
    "capture": "CASE WHEN n_chars % 3 = 0 THEN concat(source, '-', CAST(n_chars AS VARCHAR(20))) END", "parent": "CASE WHEN doc_id % 4 = 1 THEN doc_id * 2 END",
}


def _records(spark, d):
    exprs = {k: v.replace("sha256(text)", "sha2(text, 256)") for k, v in _REC.items()}
    return derive(table(spark, d, "documents"), exprs)


@register(QUERIES, f"""WITH r AS ({derive_sql('documents', _REC)})
SELECT id, rule FROM (SELECT id, unnest([CASE WHEN path LIKE '/%' OR path LIKE '%..%' THEN 'unsafe_path' END, CASE WHEN NOT regexp_full_match(sha, '[0-9a-f]{{64}}') THEN 'bad_hash' END, CASE WHEN split = 'bogus' THEN 'unknown_split' END, CASE WHEN capture IS NULL AND split = 'test' THEN 'holdout_needs_capture' END]) AS rule FROM r) WHERE rule IS NOT NULL""")
def manifest_violations(spark, d):
    safe = ~F.col("path").rlike(r"^/|(^|/)\.\.?(/|$)|\\")
    rules = F.array(F.when(~safe, "unsafe_path"), F.when(~F.col("sha").rlike("^[0-9a-f]{64}$"), "bad_hash"), F.when(F.col("split").isNotNull() & ~F.col("split").isin("train", "valid", "test"), "unknown_split"), F.when(F.col("capture").isNull() & (F.col("split") == "test"), "holdout_needs_capture"))
    return _records(spark, d).select("id", F.explode(F.array_compact(rules)).alias("rule"))


@register(QUERIES, f"WITH r AS ({derive_sql('documents', _REC)}) SELECT id, parent FROM r WHERE parent IS NOT NULL AND parent NOT IN (SELECT id FROM r)")
def dangling_parents(spark, d):
    r = _records(spark, d)
    return r.where("parent is not null").join(r.select(F.col("id").alias("parent")), "parent", "left_anti").select("id", "parent")


# Directed links with planted cycles of three turns in every seventh conversation.
_EDGES = "e AS (SELECT conv_id * 1000 + turn AS src, conv_id * 1000 + turn + 1 AS dst FROM conversations UNION SELECT conv_id * 1000 + 2, conv_id * 1000 FROM conversations WHERE conv_id % 7 = 0)"


@register(QUERIES, f"""WITH RECURSIVE {_EDGES}, r(src, dst) AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src) SELECT DISTINCT src AS node FROM r WHERE src = dst""")
def cycle_members(spark, d):
    c = table(spark, d, "conversations")
    n = F.col("conv_id") * 1000
    e = c.select((n + F.col("turn")).alias("src"), (n + F.col("turn") + 1).alias("dst")).unionByName(c.where("conv_id % 7 = 0").select((n + 2).alias("src"), n.alias("dst"))).distinct()
    return cycle_nodes(e)


# Fingerprints: which of neighbouring coordinates rises, 24 bits.
_FP = "f AS (SELECT vec_id, label, list_sum(list_transform(range(24), lambda i: CASE WHEN embedding[i + 1] > embedding[i + 2] THEN CAST(1 AS BIGINT) << i ELSE 0 END))::BIGINT AS bits FROM embeddings)"
_LINKS = f"{_FP}, l AS (SELECT a.vec_id AS u, b.vec_id AS v, CAST(bit_count(xor(a.bits, b.bits)) AS INT) AS distance FROM f a JOIN f b ON a.vec_id < b.vec_id AND bit_count(xor(a.bits, b.bits)) <= 2)"


def _fingerprints(spark, d):
    e = F.col("embedding")
    bits = sum((F.when(F.get(e, F.lit(i)) > F.get(e, F.lit(i + 1)), 1 << i).otherwise(0) for i in range(24)), F.lit(0).cast("bigint"))
    return table(spark, d, "embeddings").select("vec_id", "label", bits.alias("bits"))


def _near(spark, d):
    return hamming_links(_fingerprints(spark, d), id_col="vec_id", bits_col="bits", distance=2, width=24)


@register(QUERIES, f"WITH {_FP}, o AS (SELECT bits, min(vec_id) AS rep FROM f GROUP BY bits) SELECT least(a.rep, b.rep) AS u, greatest(a.rep, b.rep) AS v, CAST(bit_count(xor(a.bits, b.bits)) AS INT) AS distance FROM o a JOIN o b ON a.bits < b.bits AND bit_count(xor(a.bits, b.bits)) <= 2 UNION ALL SELECT rep, vec_id, 0 FROM f JOIN o USING (bits) WHERE vec_id <> rep")
def neardup_edges(spark, d):
    """Pairs of different fingerprints, by the smallest id of each, and each copy's link to that id."""
    return _near(spark, d)


_ROOTS = f"{_LINKS}, both_ways AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l), reach(a, b) AS (SELECT vec_id, vec_id FROM f UNION SELECT reach.a, both_ways.v FROM reach JOIN both_ways ON reach.b = both_ways.u), roots AS (SELECT a AS vec_id, min(b) AS root FROM reach GROUP BY a)"


@register(QUERIES, f"WITH RECURSIVE {_ROOTS} SELECT vec_id, root FROM roots")
def neardup_components(spark, d):
    return grouped(_fingerprints(spark, d), _near(spark, d), "vec_id").select("vec_id", "root")


_SPLIT = "CASE vec_id % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'valid' WHEN 2 THEN 'test' END"


@register(QUERIES, f"WITH RECURSIVE {_ROOTS} SELECT root, count(DISTINCT {_SPLIT}) AS splits FROM roots WHERE {_SPLIT} IS NOT NULL GROUP BY root HAVING count(DISTINCT {_SPLIT}) > 1")
def leakage_audit(spark, d):
    g = grouped(_fingerprints(spark, d), _near(spark, d), "vec_id").withColumn("split", F.expr(_SPLIT))
    return leaking_groups(g, "root", "split")


@register(QUERIES, f"WITH RECURSIVE {_ROOTS}, s AS (SELECT vec_id, root, {_SPLIT} AS split FROM roots), t AS (SELECT root, CASE WHEN bool_or(split = 'train') THEN 'train' WHEN bool_or(split = 'valid') THEN 'dev' ELSE 'internal_test' END AS to_split FROM s GROUP BY root) SELECT vec_id, root, split, to_split FROM s JOIN t USING (root)")
def promotions(spark, d):
    g = grouped(_fingerprints(spark, d), _near(spark, d), "vec_id").withColumn("split", F.expr(_SPLIT))
    return promote(g, "root", "split").select("vec_id", "root", "split", "to_split")


@register(QUERIES, f"WITH RECURSIVE {_ROOTS} SELECT root, substr(sha256(string_agg(CAST(vec_id AS VARCHAR), chr(10) ORDER BY CAST(vec_id AS VARCHAR))), 1, 20) AS group_id, count(*) AS size FROM roots GROUP BY root")
def group_names(spark, d):
    return group_ids(grouped(_fingerprints(spark, d), _near(spark, d), "vec_id"), "vec_id")


@register(QUERIES, """WITH k AS (SELECT doc_id, 'source' AS k, source || ':' || n_chars AS x FROM documents UNION ALL SELECT doc_id, 'text', sha256(text) FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT u, v FROM (SELECT min(doc_id) OVER (PARTITION BY k, x) AS u, doc_id AS v FROM k) WHERE u <> v""")
def shared_key_edges(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.concat_ws(":", "source", F.col("n_chars").cast("string")).alias("source"), F.sha2("text", 256).alias("text"))
    return shared_key_links(rows, "doc_id", "source", "text").select("u", "v")


@register(QUERIES, "SELECT d.doc_id FROM documents d WHERE d.doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0) AND d.source NOT IN (SELECT source FROM documents WHERE n_chars > 60000)")
def protected_anti_join(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    bad = table(spark, d, "labels").where("quality = 0").select("doc_id")
    return docs.join(bad, "doc_id", "left_anti").join(docs.where("n_chars > 60000").select("source").distinct(), "source", "left_anti").select("doc_id")


@register(QUERIES, "SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NULL THEN 'missing_document' WHEN l.doc_id IS NULL THEN 'missing_label' WHEN d.n_chars % 2 <> l.quality % 2 THEN 'differs' ELSE 'same' END AS state FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id")
def lineage_check(spark, d):
    a, b = table(spark, d, "documents").alias("a"), table(spark, d, "labels").alias("b")
    state = F.when(F.col("a.doc_id").isNull(), "missing_document").when(F.col("b.doc_id").isNull(), "missing_label").when(F.col("n_chars") % 2 != F.col("quality") % 2, "differs").otherwise("same")
    return a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full").select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), state.alias("state"))


@register(QUERIES, "SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, count(CASE WHEN n_chars < 200 THEN 1 END) AS short FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def dataset_rollup(spark, d):
    table(spark, d, "documents").createOrReplaceTempView("_rollup_documents")
    return spark.sql("SELECT lang, source, count(*) AS docs, sum(n_chars) AS chars, count_if(n_chars < 200) AS short FROM _rollup_documents GROUP BY GROUPING SETS ((lang), (source), ())")


@register(QUERIES, "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) SELECT lang, count(CASE WHEN n = 14 THEN 1 END) AS n14, count(CASE WHEN n < 14 THEN 1 END) AS fewer, max(n) AS most FROM c GROUP BY lang")
def count_coverage(spark, d):
    c = table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    return c.groupBy("lang").agg(F.count_if(F.col("n") == 14).alias("n14"), F.count_if(F.col("n") < 14).alias("fewer"), F.max("n").alias("most"))


@register(QUERIES, r"SELECT page_id, sha256(regexp_replace(html, '<[^>]+>', '', 'g')) AS sha, length(regexp_replace(html, '<[^>]+>', '', 'g')) AS n FROM pages")
def html_strip(spark, d):
    text = F.regexp_replace("html", "<[^>]+>", "")
    return table(spark, d, "pages").select("page_id", F.sha2(text, 256).alias("sha"), F.length(text).cast("bigint").alias("n"))


@register(QUERIES, r"WITH f AS (SELECT p_partkey, 'IMG_' || p_partkey || CASE WHEN p_partkey % 2 = 0 THEN '_jpg.rf.' || substr(sha256(p_name), 1, 12) || '.jpg' ELSE '.png' END AS name FROM part) SELECT p_partkey, regexp_replace(name, '\.rf\.[0-9a-f]+\.[^.]+$', '') AS root FROM f")
def filename_root(spark, d):
    name = F.concat(F.lit("IMG_"), F.col("p_partkey").cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("_jpg.rf."), F.substring(F.sha2("p_name", 256), 1, 12), F.lit(".jpg"))).otherwise(F.lit(".png")))
    return table(spark, d, "part").select("p_partkey", F.regexp_replace(name, r"\.rf\.[0-9a-f]+\.[^.]+$", "").alias("root"))


_DRAGONS = {"red": "7z", "green": "6z", "white": "5z", "east": "1z", "0m": "5m", "0p": "5p", "0s": "5s"}


@register(QUERIES, "WITH v(raw, code) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _DRAGONS.items()) + "), n AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'red' WHEN 1 THEN '0m' WHEN 2 THEN split_part(p_name, ' ', 1) ELSE 'east' END AS raw FROM part) SELECT p_partkey, n.raw, v.code, v.code IS NULL AS unknown FROM n LEFT JOIN v ON n.raw = v.raw")
def canonical_names(spark, d):
    dim = spark.createDataFrame(list(_DRAGONS.items()), "raw string, code string")
    m = F.col("p_partkey") % 4
    raw = F.when(m == 0, "red").when(m == 1, "0m").when(m == 2, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise("east")
    return table(spark, d, "part").select("p_partkey", raw.alias("raw")).join(F.broadcast(dim), "raw", "left").select("p_partkey", "raw", "code", F.col("code").isNull().alias("unknown"))


@register(QUERIES, "SELECT doc_id, source, CAST(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) > 100000 AS over_budget FROM documents")
def cumulative_budget(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    used = running_sums(rows, by=["source"], order=[F.col("doc_id")], sums={"used": F.col("n_chars")})
    return used.select("doc_id", "source", "used", (F.col("used") > 100000).alias("over_budget"))


@register(QUERIES, "SELECT c_nationkey, c_name FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier) INTERSECT SELECT c_nationkey, c_name FROM customer WHERE c_acctbal > 5000 EXCEPT SELECT c_nationkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def set_operations(spark, d):
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    a = c.join(s.select(F.col("s_nationkey").alias("c_nationkey")), "c_nationkey", "left_semi").select("c_nationkey", "c_name")
    return a.intersect(c.where("c_acctbal > 5000").select("c_nationkey", "c_name")).subtract(c.where("c_mktsegment = 'BUILDING'").select("c_nationkey", "c_name"))
