"""URL filter: host and path rules, then a ratio of two character language models.

All URLs that a rule accepts or rejects train two variable-order Markov models on host and path: counts of
the next character in contexts of up to ``order`` characters, kept only for contexts seen often enough,
smoothed by Witten-Bell interpolation down to a uniform one. A URL that no rule fits is judged by the
difference of its log-likelihoods over its length, against a threshold from all these URLs, each judged by models of
the four fifths that it isn't in (by a hash of host and path, so copies are together).

The models are a table of counts of ``order + 1`` characters; shorter ones are its sums by the last characters. A table of
distinct grams gets its values level by level: a key of such a join has as many rows as there are characters. The
``frequent`` commonest grams are broadcast and summed up where the URLs are read, all others are joined by a shuffle.
Values are rounded to 2^-32, so a URL's sum doesn't depend on its order.

Nulls and odd rows: a null URL, or one without ``://``, has empty host and path, fits no rule and has
score 0, which is ``allow``. With fewer than two training URLs of a class every score is 0. Very long URLs are judged whole; rows
that repeat are judged each; of equally good thresholds the nearest to 0 is taken, and a score at the threshold is ``allow``. An
empty table gives an empty result. A kept column with the name of a new one (host, path, rule, verdict, score) is an error
(ValueError); other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import cut, out_schema, release_after, small_batches
from lumora.operators.ordered import running_sums

#: Parts of the training URLs; each is judged by models of the others.
FOLDS = 5
#: What a value of 1 is, as a whole number; rows of one Arrow batch; grams of URLs that a task counts before it passes them on.
UNIT, URL_ROWS, MEMO = 1 << 32, 4096, 300_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a URL."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, pattern, 1), _UPPER, _LOWER), F.regexp_extract(url, pattern, 2)


def first_rule(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


class Markov:
    """Variable-order Markov model of characters with Witten-Bell smoothing."""

    def __init__(self, texts: list[str], order: int, least: int) -> None:
        self.order = order
        counts: dict[str, dict[str, int]] = defaultdict(lambda: defaultdict(int))
        counts[""]
        for n in range(order + 1):
            for t in texts:
                s = "\x02" * order + t + "\x03"
                for i in range(order, len(s)):
                    ctx = s[i - n : i]
                    if n == 0 or ctx[1:] in counts:
                        counts[ctx][s[i]] += 1
            if n:  # a longer context is tried only where this one is kept
                for ctx in [c for c in counts if len(c) == n and sum(counts[c].values()) < least]:
                    del counts[ctx]
        self.counts = {c: (dict(k), sum(k.values())) for c, k in counts.items()}
        self.base = 1.0 / (len(self.counts[""][0]) + 1)

    def prob(self, ctx: str, char: str) -> float:
        p = self.base
        for n in range(len(ctx) + 1):
            got = self.counts.get(ctx[len(ctx) - n :])
            if got is None:
                break
            seen, total = got
            if total:
                p = (seen.get(char, 0) + len(seen) * p) / (total + len(seen))
        return p


@dataclass
class UrlModel:
    """``counts``: gram (of ``order + 1`` characters), c0 and c1: how often accepted and rejected URLs hold it; None without a model."""

    counts: DataFrame | None
    order: int
    least: int
    threshold: float

    def scorer(self):  # noqa: ANN201
        """A function from a text to its score, at least 0 for accepted ones. For tests of small models: it holds all counts."""
        if self.counts is None:
            return lambda text: 0.0
        rows, models = self.counts.collect(), []
        for c in ("c0", "c1"):
            m = Markov([], self.order, self.least)
            counts: dict[str, Counter] = defaultdict(Counter)
            for r in rows:
                for n in range(self.order + 1) if r[c] else ():
                    counts[r["gram"][self.order - n : -1]][r["gram"][-1]] += r[c]
            m.counts = {x: (k, sum(k.values())) for x, k in counts.items() if not x or sum(k.values()) >= self.least}
            m.base = 1.0 / (len(counts[""]) + 1)
            models.append(m)

        def score(text: str) -> float:
            total = sum(n * round(math.log(models[0].prob(g[:-1], g[-1]) / models[1].prob(g[:-1], g[-1])) * UNIT) for g, n in grams(text, self.order).items())
            return total / UNIT / (len(text) + 1) - self.threshold if text else 0.0

        return score


def grams(text: str, order: int) -> Counter:
    """How often a text, with its ends marked, holds each run of ``order + 1`` characters."""
    s = "\x02" * order + text + "\x03"
    return Counter(s[i : i + order + 1] for i in range(len(text) + 1))


def gram_counts(rows: DataFrame, order: int, kinds: int) -> DataFrame:
    """Counts of the grams of ``_text`` in the rows of each ``_kind`` (0 to ``kinds`` - 1): gram, c0, c1, ..."""
    names = [f"c{k}" for k in range(kinds)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(Counter() for _ in names)

        def flush() -> pa.RecordBatch:
            every = list(dict.fromkeys(g for k in held for g in k))
            out = pa.record_batch([pa.array(every, pa.string()), *[pa.array([k.get(g, 0) for g in every], pa.int64()) for k in held]], names=["gram", *names])
            for k in held:
                k.clear()
            return out

        for b in batches:
            for t, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[kind].update(grams(t, order))
                if sum(map(len, held)) > MEMO:
                    yield flush()
        yield flush()

    got = rows.select("_text", "_kind").mapInArrow(release_after(run), "gram string, " + ", ".join(f"{c} bigint" for c in names))
    return got.groupBy("gram").agg(*[F.sum(c).alias(c) for c in names])


def gram_values(counts: DataFrame, models: list[tuple[Column, Column]], order: int, least: int) -> DataFrame:
    """gram and v, the values of each model (the logarithm of both classes' ratio, in units): ``models`` gives the counts of the two classes in
    each. Level by level: a shorter gram's counts are sums, its context's are sums of these, its lower level's value is joined."""
    names = [f"{c}{m}" for m in range(len(models)) for c in "ab"]
    table = counts.select("gram", *[x.cast("bigint").alias(n) for pair, m in zip(models, range(len(models)), strict=True) for x, n in zip(pair, (f"a{m}", f"b{m}"), strict=True)])
    parts = F.explode(F.transform(F.sequence(F.lit(1), F.lit(order + 1)), lambda n: F.substring(F.col("gram"), order + 2 - n, n)))
    every = cut(table.select(parts.alias("gram"), *names).groupBy("gram").agg(*[F.sum(n).alias(n) for n in names]), "url-grams")
    context = lambda: F.expr("substring(gram, 1, length(gram) - 1)")
    totals = every.groupBy(context().alias("ctx")).agg(*[F.sum(n).alias(f"t_{n}") for n in names], *[F.count_if(F.col(n) > 0).alias(f"d_{n}") for n in names])
    every = cut(every.withColumn("ctx", context()).join(totals, "ctx"), "url-levels")
    lower = None
    for n in range(order + 1):
        level = every.where(F.length("gram") == n + 1)
        if lower is None:
            level = level.select("*", *[(1.0 / (F.col(f"d_{x}") + 1)).alias(f"low_{x}") for x in names])
        else:
            level = level.withColumn("key", F.expr("substring(gram, 2)")).join(lower, "key")
        kept = lambda x, n=n: F.col(f"t_{x}") >= (least if n else 1)
        value = lambda x: F.when(kept(x), (F.col(x) + F.col(f"d_{x}") * F.col(f"low_{x}")) / F.greatest(F.col(f"t_{x}") + F.col(f"d_{x}"), F.lit(1))).otherwise(F.col(f"low_{x}"))
        lower = level.select(F.col("gram").alias("key"), *[value(x).alias(f"low_{x}") for x in names])
    values = [F.round(F.log(F.col(f"low_a{m}") / F.col(f"low_b{m}")) * UNIT).cast("bigint") for m in range(len(models))]
    return lower.select(F.col("key").alias("gram"), F.array(*values).alias("v"))


def url_sums(rows: DataFrame, values: DataFrame, often: DataFrame, order: int, frequent: int) -> DataFrame:
    """_row and total: the sum of the values of all grams of ``_text`` by the model ``_model`` of a row. ``often``: gram and n, in all."""
    top = often.orderBy(F.desc("n"), "gram").limit(frequent).select("gram")
    values = cut(values, "url-values")
    held = values.join(F.broadcast(top), "gram").toArrow()
    known = rows.sparkSession.sparkContext.broadcast((held["gram"].to_pylist(), held["v"].to_pylist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = dict(zip(*known.value, strict=True))
        for b in batches:
            out = ([], [], [], [], [])
            for i, t, m in zip(*(c.to_pylist() for c in b.columns), strict=True):
                total = 0
                for g, n in grams(t, order).items():
                    v = found.get(g)
                    if v is None:
                        for column, x in zip(out, (i, m, g, n, 0), strict=True):
                            column.append(x)
                    else:
                        total += n * v[m]
                for column, x in zip(out, (i, m, "\x02" * (order + 2) + str(i), 0, total), strict=True):  # a key that is no gram
                    column.append(x)
            yield pa.record_batch([pa.array(x, y) for x, y in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["_row", "_model", "gram", "n", "sum"])

    parts = rows.select("_row", "_text", F.col("_model").cast("int")).mapInArrow(release_after(run), "_row bigint, _model int, gram string, n bigint, sum bigint")
    x = F.coalesce(F.col("n") * F.get("v", F.col("_model")), F.col("sum"))
    return parts.join(values, "gram", "left").groupBy("_row").agg(F.sum(x).alias("total"))


def best_threshold(scores: DataFrame) -> float:
    """The threshold with the greatest sum of the shares of accepted URLs at or over it and of rejected ones under it: 0, or the middle of
    two neighbouring scores. ``scores``: score, a and b (how many accepted and rejected URLs have it)."""
    n_a, n_b, a0, b0 = scores.agg(F.sum("a"), F.sum("b"), F.sum(F.when(F.col("score") >= 0, F.col("a")).otherwise(0)), F.sum(F.when(F.col("score") < 0, F.col("b")).otherwise(0))).first()
    upto = running_sums(scores, by=["g"], order=[F.col("score")], sums={"under_a": F.col("a"), "under_b": F.col("b")})
    whole = lambda c: c.cast("decimal(19,0)")
    cuts = cut(upto.select("score", ((F.lit(n_a) - F.col("under_a")).cast("decimal(19,0)") * F.lit(n_b).cast("decimal(19,0)") + whole(F.col("under_b")) * F.lit(n_a).cast("decimal(19,0)")).alias("good")), "url-cuts")
    best = cuts.agg(F.max("good")).first()[0]
    if int(best) <= a0 * n_b + b0 * n_a:
        return 0.0
    # of the best cuts, in the order of their scores, only those next to 0 can be the nearest to it
    ends = cuts.where(F.col("good") == best).select("score")
    near = [r["score"] for r in ends.where("score <= 0").orderBy(F.desc("score")).limit(2).collect() + ends.where("score > 0").orderBy("score").limit(1).collect()]
    after = cuts.agg(*[F.min(F.when(F.col("score") > x, F.col("score"))) for x in near]).first()
    return max(((x + y) / 2 for x, y in zip(near, after, strict=True) if y is not None), key=lambda c: (-abs(c), c), default=0.0)


def fit_urls(pages: DataFrame, rules: list[Rule], *, id_col: str = "page_id", url_col: str = "url", order: int = 6, least: int = 3, frequent: int = 1 << 15) -> UrlModel:
    """Fit on all URLs that the rules judge; the threshold is from all of them, each judged by models without its fold."""
    small_batches(pages.sparkSession, URL_ROWS)
    host, path = url_parts(F.col(url_col))
    rows = pages.select(host.alias("_host"), path.alias("_path")).withColumn("_verdict", first_rule(F.col("_host"), F.col("_path"), rules)[1]).where("_verdict IS NOT NULL")
    block = (F.col("_verdict") == "block").cast("int")
    rows = rows.select(F.concat("_host", "_path").alias("_text"), block.alias("_block"), F.pmod(F.xxhash64("_host", "_path"), F.lit(FOLDS)).cast("int").alias("_model")).withColumn("_kind", F.col("_model") * 2 + F.col("_block"))
    rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
    seen = {r["_block"]: r["count"] for r in rows.groupBy("_block").count().collect()}
    if min(seen.get(0, 0), seen.get(1, 0)) < 2:
        return UrlModel(None, order, least, 0.0)
    counts = cut(gram_counts(rows, order, 2 * FOLDS), "url-counts")
    all_of = [sum(F.col(f"c{2 * k + c}") for k in range(FOLDS)) for c in (0, 1)]
    values = gram_values(counts, [tuple(all_of[c] - F.col(f"c{2 * k + c}") for c in (0, 1)) for k in range(FOLDS)], order, least)
    sums = url_sums(rows, values, counts.select("gram", (all_of[0] + all_of[1]).alias("n")), order, frequent)
    scores = rows.select("_row", "_block", F.length("_text").alias("_n")).join(sums, "_row").select("_block", (F.col("total") / float(UNIT) / (F.col("_n") + 1)).alias("score"))
    scores = scores.groupBy("score").agg(F.count_if(F.col("_block") == 0).alias("a"), F.count_if(F.col("_block") == 1).alias("b")).withColumn("g", F.lit(0))
    return UrlModel(counts.select("gram", *[x.alias(f"c{c}") for c, x in enumerate(all_of)]), order, least, best_threshold(cut(scores, "url-scores")))


def judge_urls(pages: DataFrame, rules: list[Rule], model: UrlModel, *, url_col: str = "url", keep: tuple[str, ...] = ("page_id",), frequent: int = 1 << 15) -> DataFrame:
    """The columns of ``keep``, host, path, rule, verdict and score of every URL."""
    small_batches(pages.sparkSession, URL_ROWS)
    text = F.lit(None).cast("string")
    out_schema(pages, keep, {"host": text, "path": text, "rule": text, "verdict": text, "score": F.lit(0.0)})
    host, path = url_parts(F.col(url_col))
    rows = pages.select(*keep, host.alias("host"), path.alias("path"))
    if model.counts is None:
        rows = rows.withColumn("score", F.lit(0.0))
    else:
        rows = cut(rows.withColumn("_row", F.monotonically_increasing_id()), "urls")
        given = rows.select("_row", F.concat("host", "path").alias("_text"), F.lit(0).alias("_model"), F.lit(0).alias("_kind")).where("_text != ''")
        asked = gram_counts(given, model.order, 1).select("gram", F.col("c0").alias("n"), F.lit(0).cast("bigint").alias("c0"), F.lit(0).cast("bigint").alias("c1"))
        known = model.counts.select("gram", F.lit(0).cast("bigint").alias("n"), "c0", "c1")
        table = cut(known.unionByName(asked).groupBy("gram").agg(*[F.sum(c).alias(c) for c in ("n", "c0", "c1")]), "url-counts")
        values = gram_values(table, [(F.col("c0"), F.col("c1"))], model.order, model.least)
        sums = url_sums(given, values, table, model.order, frequent)
        score = F.col("total") / float(UNIT) / (F.length("host") + F.length("path") + 1) - model.threshold
        rows = rows.join(sums, "_row", "left").withColumn("score", F.coalesce(score, F.lit(0.0)))
    rule, verdict = first_rule(F.col("host"), F.col("path"), rules)
    return rows.select(*keep, "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("score") >= 0, "allow").otherwise("block")).alias("verdict"), "score")
