"""Quality: positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives and unlabelled texts (all of them) train a model that never sees negatives.
The class prior is estimated first: a preliminary classifier, fitted on half of the rows, tells positives
from unlabelled texts, and on the other half the smallest ratio of the two classes' shares above a
threshold, with a confidence margin, bounds the share of positives among the unlabelled; so for both halves, and
the mean counts. Then the non-negative risk
  prior * R+(positives) + max(0, R-(unlabelled) - prior * R-(positives))
with the logistic loss is minimised. While its second part is positive the risk is convex: Newton steps, each with the gradient
and the Hessian summed over all unlabelled texts by one job; where a minimum would make that part negative, the penalty
(of differences between neighbouring bins) is doubled until it doesn't. At last the intercept is moved so that the share of all unlabelled texts that score 0.5 or
more is the prior, or near it where scores are sparsest. Texts' statistics and their bins are written tables; bins are
quantiles of all of them, up to 0.8 % of a value. Only trusted texts are bounded; all unlabelled ones count in every step.
The model is additive: each of some statistics of the text is cut into bins with a weight each.

Nulls and odd rows: a null text is an empty one; both get a score from their (zero) statistics. Very long texts
are blocks of their own. Rows with a null label or a null id are not trusted; unlabelled rows with a null id are
learned from where ``keep`` holds for them. Rows that repeat are each unlabelled and each scored; an id that is trusted counts once, with one of its texts (the first by a hash). Without positives
every score is 0, without unlabelled rows 1. An empty table gives an empty result. Other columns of the input
are ignored; a kept column with the name of the score is refused.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import batch_rows, cut, give_back, out_schema, release_after, row_key, small_batches, sum_vectors, text_blocks
from lumora.llm.linear import sigmoid
from lumora.llm.shingles import words

#: Statistics of a text, in this order.
STATS = ("log_bytes", "log_words", "word_bytes", "distinct_words", "repeated_next", "upper", "digit", "mark", "symbol", "beyond_ascii", "lines", "distinct_pairs", "same_byte_next", "entropy")


#: The share of weights' squares in the penalty of their differences.
RIDGE = 0.1
#: Shares of all rows at which the tails of a statistic have edges.
TAILS = (0.005, 0.01, 0.02, 0.98, 0.99, 0.995)
#: Partitions of the table of trusted texts; rows of statistics in a batch.
_FIT_TASKS, _STATS_ROWS = 16, 50_000


@dataclass
class QualityModel:
    edges: np.ndarray  # statistics x inner edges of bins
    weights: np.ndarray  # statistics x bins
    bias: float
    prior: float


def _class_table() -> np.ndarray:
    out = np.zeros(256, np.int64)  # 0 other
    out[65:91], out[97:123], out[48:58], out[128:] = 1, 2, 3, 4
    for c in b".,;:!?'\"()-":
        out[c] = 5
    for c in b"|#$%&*@^~_=+<>/\\{}[]`":
        out[c] = 6
    out[10] = 7
    return out


_CLASS = _class_table()


def text_stats(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Statistics of each text of a block."""
    n = len(offs) - 1
    w, of = words(data, offs)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(of, minlength=n), out=at[1:])
    out = np.zeros((n, len(STATS)))
    with np.errstate(over="ignore"):
        pairs = w[:-1] * np.uint64(3) + w[1:] if len(w) > 1 else w[:0]
    for i in range(n):
        d = data[offs[i] : offs[i + 1]]
        if not len(d):
            continue
        x = w[at[i] : at[i + 1]]
        kinds = np.bincount(_CLASS[d], minlength=8) / len(d)
        freq = np.bincount(d, minlength=256)
        freq = freq[freq > 0] / len(d)
        m = max(1, len(x))
        pair = pairs[at[i] : max(at[i], at[i + 1] - 1)]
        out[i] = (
            np.log1p(len(d)), np.log1p(len(x)), len(d) / m, len(np.unique(x)) / m, (x[1:] == x[:-1]).sum() / m, kinds[1], kinds[3], kinds[5], kinds[6], kinds[4], kinds[7] * 100,
            len(np.unique(pair)) / max(1, len(pair)) if len(pair) else 0.0, (d[1:] == d[:-1]).sum() / len(d), -(freq * np.log2(freq)).sum(),
        )
    return out


def _bins(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The flat index of the bin of each statistic."""
    k = edges.shape[1] + 1
    return np.stack([np.searchsorted(e, s, "right") + j * k for j, (e, s) in enumerate(zip(edges, stats.T, strict=True))], axis=1)


def _grad(rows: np.ndarray, e: np.ndarray, size: int) -> np.ndarray:
    """Sums of ``e`` by bin, and in all."""
    return np.append(np.bincount(rows.ravel(), np.repeat(e, rows.shape[1]), size), e.sum())


def pu_risk(z_pos: np.ndarray, loss_unl: float, prior: float) -> tuple[float, float]:
    """The two parts of the risk: prior * R+(positives), and R-(unlabelled) - prior * R-(positives)."""
    return prior * float(np.logaddexp(0, -z_pos).mean()), loss_unl - prior * float(np.logaddexp(0, z_pos).mean())


def bound_prior(share_pos: np.ndarray, share_unl: np.ndarray, n_pos: int, n_unl: int, delta: float = 0.1) -> float:
    """The share of positives among unlabelled rows, from the shares of both above each threshold."""
    margin = np.sqrt(np.log(4 / delta) / 2) * (max(1, n_pos) ** -0.5 + max(1, n_unl) ** -0.5)
    on = share_pos > 0
    if not on.any() or not n_unl:
        return 0.5
    best = np.argmin((share_unl[on] + margin) / share_pos[on])
    return float(np.clip(share_unl[on][best] / share_pos[on][best], 0.02, 0.98))


def _read_stats(b: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(0).to_pylist()), np.float32).reshape(-1, len(STATS))


def _stats_of(rows: DataFrame) -> DataFrame:
    """A written table of _u and the statistics of each _text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, d, o in text_blocks(b.column(1)):
                got = text_stats(d, o).astype(np.float32)
                yield pa.record_batch([b.column(0).slice(at, len(got)), pa.array([x.tobytes() for x in got], pa.binary())], names=["_u", "stats"])

    return cut(rows.select("_u", "_text").mapInArrow(release_after(run), "_u long, stats binary"), "stats")


def _collect_stats(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    got = rows.toArrow().sort_by([("_u", "ascending"), ("stats", "ascending")])
    stats = np.frombuffer(b"".join(got["stats"].to_pylist()), np.float32).reshape(-1, len(STATS)).astype(float)
    return got["_u"].to_numpy(), stats


def _add_up(rows: DataFrame, held: object, of: Callable[[np.ndarray, object], np.ndarray]) -> np.ndarray | None:
    """The sum of ``of`` (bins of a batch of texts, held) over a table of bins."""
    value = rows.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for b in batches:
            if len(b):
                total = total + of(np.frombuffer(b"".join(b.column(0).to_pylist()), np.uint8).reshape(len(b), -1), value.value)
        if not isinstance(total, float):
            yield pa.record_batch([pa.array([np.ascontiguousarray(total).tobytes()], pa.binary())], names=["v"])

    got = sum_vectors(rows.select("b").mapInArrow(release_after(run), "v binary"))
    value.unpersist()
    return got


def _quantiles(stats: DataFrame, p: np.ndarray, shares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of each statistic, of the positives and all rows with twice their weight, and of all rows alone, from counts of the rows'
    float32 values by sign, exponent and seven bits of the fraction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key, n = np.unique(_keys(_read_stats(b)), return_counts=True)
            yield pa.record_batch([pa.array(key, pa.int64()), pa.array(n, pa.int64())], names=["key", "n"])

    got = stats.select("stats").mapInArrow(release_after(run), "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(STATS) << 16)
    count[got["key"].to_numpy()] = got["n"].to_numpy()
    all_rows = count.reshape(len(STATS), -1)
    mine = np.bincount(_keys(p.astype(np.float32)), minlength=len(STATS) << 16).reshape(len(STATS), -1)
    mixed = mine + all_rows * (2 * len(p) / all_rows[0].sum())
    value = np.nan_to_num((np.arange(1, (1 << 16) + 1, dtype=np.uint64) << np.uint64(16)).astype(np.uint32).view(np.float32)).astype(float)  # the end of each bucket
    at = lambda c, q: np.stack([value[np.searchsorted(np.cumsum(row), np.asarray(q) * row.sum())] for row in c])
    return at(mixed, shares), at(all_rows, TAILS)


def _keys(stats: np.ndarray) -> np.ndarray:
    bits = np.abs(np.ascontiguousarray(stats, np.float32)).view(np.uint32) >> np.uint32(16)
    return (bits.astype(np.int64) + (np.arange(len(STATS), dtype=np.int64) << 16)).ravel()


def _curves(b: np.ndarray, held: tuple[np.ndarray, int]) -> np.ndarray:
    """Of a batch: rows, summed loss log(1 + exp(z)), its gradient and Hessian by bins and intercept."""
    w, k = held
    size, flat = len(w) - 1, b + np.arange(b.shape[1]) * k
    z = w[flat].sum(1) + w[-1]
    s = sigmoid(z)
    h, out = s * (1 - s), np.zeros((size + 1, size + 1))
    for i in range(b.shape[1]):
        out[i * k : (i + 1) * k, -1] = np.bincount(b[:, i], h, k)
        for j in range(i, b.shape[1]):
            out[i * k : (i + 1) * k, j * k : (j + 1) * k] = np.bincount(b[:, i].astype(np.int64) * k + b[:, j], h, k * k).reshape(k, k)
    out[-1, -1] = h.sum()
    return np.concatenate([[len(b), np.logaddexp(0, z).sum()], _grad(flat, s, size), out.ravel()])


def newton(curves: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, *, rounds: int = 25) -> np.ndarray:
    """Minimise a convex function of weights given value, gradient and Hessian, by damped Newton steps."""
    x, step, best = start, None, None
    for _ in range(rounds):
        value, g, h = curves(x)
        if best is not None and not value <= best[0] + 1e-10:
            step = step / 2
            x = best[1] + step
            continue
        if best is not None and best[0] - value < 1e-7 * max(1.0, abs(value)):
            best = (value, x)
            break
        best = (value, x)
        step = -np.linalg.solve(h + 1e-9 * np.eye(len(x)), g)
        x = x + step
    return best[1]


def _objective(bins: DataFrame, pos: np.ndarray, k: int, l2: float, prior: float | None) -> Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]]:
    """Value, gradient and Hessian of the risk with its penalty; without a prior, of the logistic regression of positives against all rows."""
    flat = pos + np.arange(pos.shape[1]) * k

    def curves(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        size = len(w) - 1
        got = _add_up(bins, (w, k), _curves)
        n = got[0]
        value, g, h = got[1] / n, got[2 : size + 3] / n, got[size + 3 :].reshape(size + 1, size + 1) / n
        h = np.triu(h) + np.triu(h, 1).T
        z = w[flat].sum(1) + w[-1]
        if prior is None:
            own = _curves(pos.astype(np.uint8), (-w, k))
            hp = own[size + 3 :].reshape(size + 1, size + 1) / own[0]
            value, g, h = value + own[1] / own[0], g - own[2 : size + 3] / own[0], h + np.triu(hp) + np.triu(hp, 1).T
        else:  # prior * (R+ - R-) of the positives is linear: log(1 + exp(-z)) - log(1 + exp(z)) = -z
            value, g = value - prior * z.mean(), g - prior * _grad(flat, np.full(len(z), 1 / len(z)), size)
        penalty = l2 * _roughness(pos.shape[1], k)
        return value + 0.5 * w @ penalty @ w, g + penalty @ w, h + penalty

    return curves


def _roughness(parts: int, k: int) -> np.ndarray:
    """The penalty of weights: squared differences of neighbouring bins, and a share of their squares. The intercept has none."""
    step = np.diff(np.eye(k), axis=0)
    out = np.zeros((parts * k + 1,) * 2)
    for j in range(parts):
        out[j * k : (j + 1) * k, j * k : (j + 1) * k] = step.T @ step + RIDGE * np.eye(k)
    return out


def _fit_risk(bins: DataFrame, pos: np.ndarray, k: int, prior: float, l2: float) -> np.ndarray:
    """The weights of least non-negative risk."""
    size, flat = pos.shape[1] * k, pos + np.arange(pos.shape[1]) * k
    w = np.zeros(size + 1)
    for _ in range(20):
        w = newton(_objective(bins, pos, k, l2, prior), w)
        got = _add_up(bins, (w, k), _curves)
        if pu_risk(w[flat].sum(1) + w[-1], got[1] / got[0], prior)[1] >= 0:
            break
        l2 *= 2
    return w


def _scores_counted(bins: DataFrame, w: np.ndarray, k: int, cuts: np.ndarray) -> np.ndarray:
    """How many rows score between each two of the ``cuts``."""

    def of(b: np.ndarray, held: tuple[np.ndarray, int, np.ndarray]) -> np.ndarray:
        w, k, cuts = held
        return np.bincount(np.searchsorted(cuts, w[b + np.arange(b.shape[1]) * k].sum(1), "right"), minlength=len(cuts) + 1).astype(float)

    return _add_up(bins, (w, k, cuts), of)


def _cut_near(count: np.ndarray, cuts: np.ndarray, prior: float, near: float) -> float:
    """Of the places where at most ``near`` more or less than a share ``prior`` of the rows lies above, the middle of the longest run of
    the sparsest ones; without any, the place whose share is nearest."""
    above = count[::-1].cumsum()[::-1][1:] / count.sum()
    fits = np.abs(above - prior) <= near
    if not fits.any():
        return float(cuts[np.argmin(np.abs(above - prior))])
    between = np.flatnonzero(fits[:-1] & fits[1:])
    if not len(between):
        return float(cuts[np.flatnonzero(fits)[0]])
    least = between[count[1:-1][between] == count[1:-1][between].min()]
    runs = np.split(least, np.flatnonzero(np.diff(least) > 1) + 1)
    longest = max(runs, key=len)
    return float((cuts[longest[0]] + cuts[longest[-1] + 1]) / 2)


def fit_quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", keep: Column | None = None, positives: int = 4000, bins: int = 24, l2: float = 8.0) -> QualityModel:
    """Fit on at most ``positives`` trusted texts and all unlabelled ones; ``keep``: a condition on ids to learn from. The number of bins is
    ``bins``, or some 40 positives a bin where there are few."""
    spark = docs.sparkSession
    small_batches(spark)
    trusted = labels.where((F.col(label_col) == 1) & F.col(id_col).isNotNull())
    trusted = (trusted if keep is None else trusted.where(keep)).select(F.col(id_col).alias("_id")).distinct().orderBy(F.xxhash64("_id"), "_id").limit(positives)
    all_rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    known = all_rows.join(F.broadcast(trusted), "_id").groupBy("_id").agg(F.min_by("_text", F.xxhash64("_text")).alias("_text"))
    p = _collect_stats(_stats_of(known.select(F.xxhash64("_id").alias("_u"), "_text").repartition(_FIT_TASKS, "_u")))[1]
    rows = (docs if keep is None else docs.where(keep)).select(row_key(id_col, text_col).alias("_u"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    stats = _stats_of(rows)
    with batch_rows(spark, _STATS_ROWS):
        n, parts = stats.count(), len(STATS)
        if not len(p) or not n:
            return QualityModel(np.zeros((parts, 0)), np.zeros((parts, 1)), -30.0 if not len(p) else 30.0, float(len(p) > 0))
        inner, tails = _quantiles(stats, p, np.linspace(0, 1, int(np.clip(len(p) // 40, 4, bins)) + 1)[1:-1])
        # outliers of the unlabelled rows alone are far apart: finer edges in the tails
        edges = np.sort(np.hstack([inner, tails]), axis=1)
        k = edges.shape[1] + 1
        held = spark.sparkContext.broadcast(edges)

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _places(_read_stats(pa.record_batch([b.column(1)], names=["stats"])), held.value)
                yield pa.record_batch([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["_u", "b"])

        table = cut(stats.mapInArrow(release_after(binned), "_u long, b binary"), "bins")
        pos, bounds = _places(p, edges).astype(np.int64), []
        for own in (0, 1):
            half = F.pmod(F.xxhash64(F.col("_u"), F.lit(2)), F.lit(2)) == own
            fit_rows, other = table.where(half), table.where(~half)
            if len(p) > 1 and fit_rows.head(1) and other.head(1):
                w = newton(_objective(fit_rows, pos[own::2], k, 1.0 / len(pos[own::2]), None), np.zeros(parts * k + 1))[:-1]
                held_p = np.sort(w[pos[1 - own :: 2] + np.arange(parts) * k].sum(1))
                cuts = np.unique(held_p)
                count = _scores_counted(other, w, k, cuts)
                bounds.append(bound_prior(1 - np.searchsorted(held_p, cuts) / len(held_p), count[::-1].cumsum()[::-1][1:] / count.sum(), len(held_p), int(count.sum())))
        prior = float(np.mean(bounds)) if bounds else 0.5
        w = _fit_risk(table, pos, k, prior, l2 / len(p))
        ways = w[:-1].reshape(parts, k)
        cuts = np.linspace(ways.min(1).sum(), ways.max(1).sum() + 1e-9, 4097)
        w[-1] = -_cut_near(_scores_counted(table, w[:-1], k, cuts), cuts, prior, min(0.05, 0.5 / np.sqrt(max(1, len(p) // 2))))
        held.unpersist()
    give_back()
    return QualityModel(edges, ways, float(w[-1]), prior)


def _places(stats: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bin of each statistic."""
    return np.stack([np.searchsorted(e, s, "right") for e, s in zip(edges, stats.T, strict=True)], axis=1).astype(np.uint8)


def score_quality(docs: DataFrame, model: QualityModel, *, text_col: str = "text", score_col: str = "score", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep`` and a score from 0 to 1 of each whole text."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.edges, model.weights.ravel(), model.bias))
    rows = docs.select(*keep, F.col(text_col).alias("_score_text"))
    schema = out_schema(docs, keep, {score_col: F.lit(0.0).cast("double")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges, weights, bias = held.value
        for b in batches:
            z = [weights[_bins(text_stats(d, o), edges)].sum(1) + bias for _, d, o in text_blocks(b.column(b.num_columns - 1))]
            yield pa.record_batch([*b.columns[:-1], pa.array(sigmoid(np.concatenate(z)) if z else np.empty(0))], names=[*b.schema.names[:-1], score_col])

    return rows.mapInArrow(release_after(run), schema)
