"""Benchmark decontamination by spaced-seed hashing, in DataFrame operations only.

Words (runs of letters and digits, lower-cased) of the benchmark and of the documents are hashed under masks: a
mask hashes only the words at its ones, so a differing word at a zero does not hide a match. Seeds at every
position of the documents are joined with those at every position of the benchmark; each hit fixes an alignment
of an item with a document. On that diagonal the words around the hit are compared, and the longest overlap that
begins and ends with a match is kept in which at most ``1 - similarity`` of the words differ. An item leaks into
a document if such an overlap has at least ``least_words`` words, or if the whole item stands there with at most
that share of its words changed, its first and last words included.

No overlap is missed: ``seed_masks`` and ``short_seeds`` split a passage with k changed words into k + 2 blocks, of
which two are unchanged, and have a mask for every such pair.

The benchmark's seeds are broadcast while their counted number is at most ``broadcast_rows``; beyond it
they are joined by a shuffle on the hash and the texts are joined again by the document's id and a hash of its words.

Nulls and odd rows: an id names its rows together. Each text of a document's id is searched for each text of an item's
id, and a document and item are reported once, with the best overlap; equal rows count once. A null id is one too. Null or
empty texts have no seeds; an item without words is not searched. Overlaps that lie apart on different
diagonals are judged apart. Very long texts are searched whole. An empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _changed(n: int, similarity: float) -> int:
    """How many of ``n`` words may differ."""
    return max(k for k in range(n + 1) if n - k >= similarity * n)


def _pair(block: int, apart: int) -> str:
    return "1" * block + "0" * (apart - block) + "1" * block


#: Words that count (1) and that are ignored (0): pairs of three words for overlaps of 13 words at 80 %. They hit every placement of
#: 2 changed words in 13, 3 in 15, 4 in 20 and 5 in 25, and so in any longer overlap; with one pair less some are missed.
MASKS = tuple(_pair(3, d) for d in (3, 6, 9, 12, 15))


def seed_masks(least_words: int, similarity: float) -> tuple[str, ...]:
    """Masks that hit, at some position, every overlap of at least ``least_words`` words. A longer one holds one of less than twice as many."""
    if (least_words, similarity) == (13, 0.8):
        return MASKS
    cases = [(n, _changed(n, similarity)) for n in range(least_words, 2 * least_words)]
    return tuple(dict.fromkeys(_pair(b, b * j) if b else "1" for n, k in cases for b in [n // (k + 2)] for j in range(1, k + 2)))


def short_seeds(n: int, similarity: float) -> list[tuple[str, int]]:
    """Masks and their places in an item of ``n`` words, one for each two of the blocks it is split into."""
    parts = _changed(n, similarity) + 2
    ends = [n * i // parts for i in range(parts + 1)]
    kept = [[*range(*ends[i : i + 2]), *range(*ends[j : j + 2])] for i in range(parts) for j in range(i + 1, parts)]
    return list(dict.fromkeys(("".join("01"[x in k] for x in range(k[0], k[-1] + 1)), k[0]) for k in kept if k))


def word_array(text: Column) -> Column:
    """Words of a text: runs of letters and digits, lower-cased, so that marks and line breaks hide nothing."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _seed(words: Column, at: Column, mask: str) -> Column:
    return F.xxhash64(F.lit(mask), *[F.get(words, at + i) for i, c in enumerate(mask) if c == "1"])


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...], short: dict[int, list[tuple[str, int]]]) -> DataFrame:
    """Seeds of _item, _words, _n: at every position, or the given ones of an item of a length in ``short``: _h, _item, _at, _n, and
    what tells whether the mask hits one word before as well: the words before its blocks, _w1 and _w2, the second one _off words on. A
    mask of more than two blocks, or at an item's first word, or in an item of such a length, has none."""
    words, n, at = F.col("_words"), F.col("_n"), F.col("_at")
    long = items.where((n > 0) & ~n.isin(list(short))).withColumn("_at", F.explode(F.sequence(F.lit(0), n - 1)))

    def seed(m: str) -> Column:
        starts = [i for i, c in enumerate(m) if c == "1" and (i == 0 or m[i - 1] == "0")]
        w1 = F.when(at > 0, F.get(words, at - 1)) if len(starts) <= 2 else F.lit(None).cast("string")
        return F.struct(_seed(words, at, m).alias("_h"), w1.alias("_w1"), F.get(words, at + starts[-1] - 1).alias("_w2"), F.lit(starts[-1]).alias("_off"))

    out = long.select(F.explode(F.array(*[F.when(at + len(m) <= n, seed(m)) for m in masks])).alias("_s"), "_item", "_at", "_n").where("_s IS NOT NULL").select("_s._h", "_item", "_at", "_n", "_s._w1", "_s._w2", "_s._off")
    for size, seeds in short.items():
        each = F.explode(F.array(*[F.struct(_seed(words, F.lit(a), m).alias("_h"), F.lit(a).alias("_at")) for m, a in seeds])).alias("_s")
        out = out.unionByName(items.where(n == size).select(each, "_item", "_n").select("_s._h", "_item", "_s._at", "_n", F.lit(None).cast("string").alias("_w1"), F.lit(None).cast("string").alias("_w2"), F.lit(0).alias("_off")))
    return out


def _best_overlap(same: Column, similarity: float) -> Column:
    """Of an array of booleans, the longest run of positions that begins and ends with true and whose share of
    true is at least ``similarity``: a struct of its length, its matches and its first position, negated.

    The k-th match at i has the balance k * d - i * n before it, n / d being the similarity; a run's share suffices if the balance after its
    last match isn't less than that before its first one. Both are sorted together, largest first, and a fold over them keeps the
    furthest last match so far, which is the best one for each first match that comes: n log n steps.
    """
    share = Fraction(similarity).limit_denominator(10_000)
    n, d = F.lit(share.numerator).cast("bigint"), F.lit(share.denominator).cast("bigint")
    true_at = F.filter(F.transform(same, lambda x, i: F.when(x, i)), lambda i: i.isNotNull())
    point = lambda value, last, i, k: F.struct(value.alias("value"), F.lit(last).alias("last"), i.cast("int").alias("i"), k.cast("int").alias("k"))
    first = F.transform(true_at, lambda i, k: point(k * d - i * n, False, i, k))
    last = F.transform(true_at, lambda i, k: point((k + 1) * d - (i + 1) * n, True, i, k))
    run = lambda length, matches, start: F.struct(length.alias("length"), matches.alias("matches"), start.alias("neg_start"))
    state = lambda i, k, best: F.struct(i.alias("i"), k.alias("k"), best.alias("best"))
    none = F.lit(-1)

    def step(s: Column, p: Column) -> Column:
        further = p["last"] & (p["i"] > s["i"])
        here = run(s["i"] - p["i"] + 1, s["k"] - p["k"] + 1, -p["i"])
        return state(F.when(further, p["i"]).otherwise(s["i"]), F.when(further, p["k"]).otherwise(s["k"]), F.when(p["last"], s["best"]).otherwise(F.greatest(s["best"], here)))

    best = F.aggregate(F.sort_array(F.concat(first, last), asc=False), state(none, none, run(none, none, none)), step, lambda s: s["best"])
    return F.when(best["length"] > 0, best)


def find_leaks(docs: DataFrame, benchmark: DataFrame, *, doc_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", masks: tuple[str, ...] | None = None, least_words: int = 13, similarity: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """One row for each document and benchmark item that leaks into it, with the best overlap:
    doc, item, start word in the document and in the item, overlap length in words, matches, similarity."""
    # rows of the benchmark by a key of their own: an id may have several texts
    items = benchmark.select(F.col(item_col).alias("_item_id"), word_array(F.col(item_text_col)).alias("_words")).where(F.size("_words") > 0).distinct()
    items = items.select("_item_id", "_words", F.struct(F.xxhash64("_item_id", "_words"), F.xxhash64(F.lit(1), "_item_id", "_words")).alias("_item"))
    sized = items.select("_item", "_words", F.size("_words").alias("_n"))
    short = {r["_n"]: short_seeds(r["_n"], similarity) for r in sized.where(F.col("_n").between(1, least_words - 1)).select("_n").distinct().collect()}
    masks = seed_masks(least_words, similarity) if masks is None else masks
    seeds = benchmark_seeds(sized, masks, short)
    few = seeds.limit(broadcast_rows + 1).count() <= broadcast_rows
    texts = docs.select(F.col(doc_col).alias("_doc"), word_array(F.col(text_col)).alias("_words"))
    texts = texts if few else texts.withColumn("_t", F.xxhash64("_words"))  # once for each text, not for each seed
    held = ["_doc", *([] if few else ["_t"]), "_words"]
    words, pos = F.col("_words"), F.col("_pos")
    used = dict.fromkeys([*masks, *[m for seeds_of in short.values() for m, _ in seeds_of]])
    hashes = [F.when(pos + len(m) <= F.size(words), _seed(words, pos, m)) for m in used]
    rows = texts.where(F.size(words) > 0).select(*held, F.explode(F.sequence(F.lit(0), F.size(words) - 1)).alias("_pos"))
    rows = rows.select(*held, "_pos", F.explode(F.array(*hashes)).alias("_k")).where(F.col("_k").isNotNull())
    start = pos - F.col("_at")
    skip = F.greatest(F.lit(0), -F.col("_start"))
    part = F.slice("_words", F.col("_start") + skip + 1, F.col("_n") - skip)
    keys = ("_doc", "_item", "_start", "_n")
    if few:  # explode, hash, look up and cut out the words in one stage; of hits that follow one another on a diagonal, the first is enough
        hit = rows.join(F.broadcast(seeds), F.col("_k") == F.col("_h"))
        follows = (F.get(words, pos - 1) == F.col("_w1")) & (F.get(words, pos + F.col("_off") - 1) == F.col("_w2"))
        hit = hit.where(~F.coalesce(follows, F.lit(False))).select("_doc", "_item", start.alias("_start"), "_n", "_words").select(*keys, part.alias("_part"))
        one = hit.distinct()
    else:
        hit = rows.select("_doc", "_t", "_pos", "_k").join(seeds, F.col("_k") == F.col("_h")).select("_doc", "_t", "_item", start.alias("_start"), "_n").distinct()
        own = texts.select(F.col("_doc").alias("_d"), "_t", "_words").distinct()
        one = own.join(hit, (own["_t"] == hit["_t"]) & F.col("_d").eqNullSafe(F.col("_doc"))).select(*keys, part.alias("_part"))
    one = one.join(items.withColumnRenamed("_words", "_item_words"), "_item").withColumn("_skip", skip)
    same = F.zip_with(F.slice("_item_words", F.col("_skip") + 1, F.size("_part")), F.col("_part"), lambda a, b: a == b)
    n_same = F.size(F.filter("_same", lambda x: x))
    whole = F.when((F.size("_same") == F.col("_n")) & (n_same >= F.lit(similarity) * F.col("_n")), F.struct(F.col("_n").alias("length"), n_same.alias("matches"), F.lit(0).alias("neg_start")))
    run = _best_overlap(F.col("_same"), similarity)
    judged = one.withColumn("_same", same).withColumn("_run", run).select("_doc", F.col("_item_id").alias("_item"), "_start", "_skip", F.coalesce(F.when(F.col("_run.length") >= least_words, F.col("_run")), whole).alias("_o")).where(F.col("_o").isNotNull())
    best = judged.groupBy("_doc", "_item").agg(F.max(F.struct("_o.length", "_o.matches", (-F.col("_start")).alias("neg"), "_o.neg_start", "_skip")).alias("b"))
    item_start = F.col("b._skip") - F.col("b.neg_start")
    return best.select(
        F.col("_doc").alias(doc_col), F.col("_item").alias(item_col), (item_start - F.col("b.neg")).cast("int").alias("doc_start"), item_start.cast("int").alias("item_start"),
        F.col("b.length").cast("int").alias("n_words"), F.col("b.matches").cast("int").alias("n_same"), (F.col("b.matches") / F.col("b.length")).alias("similarity"),
    )
