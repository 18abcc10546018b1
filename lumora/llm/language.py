"""Language identification: string kernel ridge regression with Nystroem landmarks.

The kernel of two texts is the number of character n-grams (n in ``orders``, hashed to buckets)
present in both, over the geometric mean of the numbers present in each. A few landmark texts of
each language span the feature space; a ridge regression per language (one against the rest) is
fitted there on a bounded sample. Texts are scored in batches: a presence matrix times the
landmarks' matrix gives the kernels, and a second product the scores of the languages.

The scores of a text always have the same sum, so none of them tells a text in no learned language. For
that there is a fit: the mean, over the letter trigrams of a text, of the log share of the language's learned
texts that have the trigram. Each learned text is judged without itself; the least fit of a language is halfway
between the median of those fits and that of a text of unseen trigrams, or lower where those fits spread widely
(four times from the median to the lower quartile, so that mislabelled texts do not move it).

Nulls and odd rows: a null text, or one without a letter, is ``und`` with score 0. Very long texts are read in
parts, with the same result. Rows with a null language or text are not learned from; those with a null id are,
where ``keep`` holds for them. Rows that repeat are learned from once and scored each; rows that share an id are
rows of their own. Without learned languages every text is ``und``. Ties go to the language first in order of its
name. An empty table gives an empty result. Other columns of the input are ignored; a kept column with the name
of a new one is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lumora.llm.common import cut, give_back, out_schema, release_after, row_key, small_batches, thinned
from lumora.llm.grams import Grams, word_trigrams

UNDETERMINED = "und"
_ROWS = 64
_FIT_BITS = 17
#: Partitions of the table of learned texts.
_FIT_TASKS = 16


@dataclass
class LanguageModel:
    langs: list[str]
    landmarks: np.ndarray  # buckets x landmarks, presence over root of the number present
    weights: np.ndarray  # landmarks x languages
    orders: tuple[int, ...]
    bits: int
    shares: np.ndarray  # trigram buckets x languages, log share of the learned texts that have one
    least_fit: np.ndarray  # of each language


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct trigrams of a text and their counts."""
    return np.unique(np.concatenate([*word_trigrams(text, _FIT_BITS), np.empty(0, np.uint32)]), return_counts=True)


def _fits(texts: DataFrame, langs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Log shares and least fits of the learned texts (_lang, _text)."""
    at, n_langs = {k: i for i, k in enumerate(langs)}, len(langs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((n_langs, 1 << _FIT_BITS), np.int32)
        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen[at[k], _trigrams(t)[0]] += 1
        lang, bucket = np.nonzero(seen)
        yield pa.record_batch([pa.array(lang.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(seen[lang, bucket])], names=["k", "bucket", "n"])

    rows = texts.select("_lang", "_text")
    got = rows.mapInArrow(release_after(count), "k int, bucket int, n int").groupBy("k", "bucket").agg(F.sum("n").cast("int").alias("n")).toArrow()
    seen = np.zeros((1 << _FIT_BITS, n_langs), np.int32)
    seen[got["bucket"].to_numpy(), got["k"].to_numpy()] = got["n"].to_numpy()
    n_of = {r["_lang"]: r["n"] for r in rows.groupBy("_lang").agg(F.count("*").alias("n")).collect()}
    texts_of = np.array([n_of[k] for k in langs])
    held = texts.sparkSession.sparkContext.broadcast((seen, texts_of))

    def own_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each text, without itself."""
        seen, texts_of = held.value
        for b in batches:
            of, fit = [at[k] for k in b.column(0).to_pylist()], []
            for k, t in zip(of, b.column(1).to_pylist(), strict=True):
                ids, n = _trigrams(t)
                fit.append(float(np.average(np.log((seen[ids, k] - 0.5) / (texts_of[k] + 1)), weights=n)) if len(ids) else 0.0)
            yield pa.record_batch([pa.array(of, pa.int32()), pa.array(fit, pa.float64())], names=["k", "fit"])

    got = rows.mapInArrow(release_after(own_fit), "k int, fit double").toArrow()
    of, own = got["k"].to_numpy(), got["fit"].to_numpy()
    unseen = np.log(0.5 / (texts_of + 1))
    quarter, middle = np.array([np.quantile(own[of == k], (0.25, 0.5)) for k in range(n_langs)]).T
    least = np.minimum((middle + unseen) / 2, middle - 4 * (middle - quarter))
    return np.log((seen + 0.5) / (texts_of + 1)).astype(np.float32), least


def _kernel(present: np.ndarray, landmarks: np.ndarray) -> np.ndarray:
    return (present @ landmarks) / np.sqrt(np.maximum(present.sum(1, keepdims=True), 1.0))


def fit_language(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: Column | None = None, per_lang: int = 300, landmarks_per_lang: int = 24, most_rows: int = 4800, most_landmarks: int = 384, orders: tuple[int, ...] = (1, 2, 3, 4), bits: int = 15, ridge: float = 1e-2, with_fit: bool = False) -> LanguageModel:
    """Fit on at most ``per_lang`` texts of each language and ``most_rows`` in all, with at most ``most_landmarks`` landmarks in all; but of
    every language, however many there are, two texts and landmarks where it has them. ``with_fit``: also learn the fits."""
    small_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows if keep is None else rows.where(keep)
    counts = {r["_lang"]: r["n"] for r in rows.groupBy(F.col(lang_col).alias("_lang")).agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    none = (np.zeros((1 << _FIT_BITS, len(langs)), np.float32), np.zeros(len(langs)))
    if not langs:
        return LanguageModel([], np.zeros((1 << bits, 0), np.float32), np.zeros((0, 0), np.float32), orders, bits, *none)
    per_lang, per_mark = min(per_lang, max(2, most_rows // len(langs))), min(landmarks_per_lang, max(2, most_landmarks // len(langs)))
    known = docs.sparkSession.createDataFrame(list(counts.items()), "_lang string, _count long")
    counted = rows.select(row_key(id_col, lang_col, text_col).alias("_key"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_lang")
    some = thinned(counted, F.col("_key"), F.lit(per_lang), F.col("_count"), "_lang", "_text")
    first = F.row_number().over(Window.partitionBy("_lang").orderBy("_u"))
    texts = cut(some.withColumn("_n", first).where(F.col("_n") <= per_lang).drop("_n").repartition(_FIT_TASKS, "_u"), "learned")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, row = Grams(orders, bits), np.zeros(1 << bits, np.uint8)
        for b in batches:
            out = []
            for t in b.column(2).to_pylist():
                grams.presence(t, row)
                out.append(np.packbits(row).tobytes())
            yield pa.record_batch([b.column(0), b.column(1), pa.array(out, pa.binary())], names=["_u", "_lang", "bits"])

    got = texts.select("_u", "_lang", "_text").mapInArrow(release_after(run), "_u long, _lang string, bits binary").toArrow().sort_by("_u")
    y = np.array(got["_lang"].to_pylist())
    packed = np.frombuffer(b"".join(got["bits"].to_pylist()), np.uint8).reshape(len(y), -1)
    del got

    def spelled(at: np.ndarray | slice) -> np.ndarray:
        return np.unpackbits(packed[at], axis=1).astype(np.float32)

    at = np.concatenate([np.flatnonzero(y == k)[:per_mark] for k in langs])
    marks = spelled(at).T
    marks /= np.sqrt(np.maximum(marks.sum(0, keepdims=True), 1.0))
    inner = np.concatenate([_kernel(spelled(at[i : i + _ROWS]), marks) for i in range(0, len(at), _ROWS)]).astype(float)
    values, vectors = np.linalg.eigh(inner + 1e-6 * np.eye(len(at)))
    root = vectors / np.sqrt(np.maximum(values, 1e-6))  # inner**-1/2, up to a rotation
    phi = np.concatenate([_kernel(spelled(slice(i, i + _ROWS)), marks) for i in range(0, len(y), _ROWS)]).astype(float) @ root
    weights = kernel_ridge(phi, y, langs, ridge)
    del packed
    shares = _fits(texts, langs) if with_fit else none
    model = LanguageModel(langs, marks, np.vstack([root @ weights[:-1], weights[-1:]]).astype(np.float32), orders, bits, *shares)
    give_back()
    return model


def kernel_ridge(phi: np.ndarray, y: np.ndarray, langs: list[str], ridge: float) -> np.ndarray:
    """Ridge regression of one language against the rest, each language weighing the same; the last row is the intercept."""
    phi1 = np.hstack([phi, np.ones((len(y), 1))])
    of = np.searchsorted(langs, y)
    target = (of[:, None] == np.arange(len(langs))[None]) * 2.0 - 1.0
    balance = (1.0 / np.bincount(of, minlength=len(langs)))[of] * len(y) / len(langs)
    weighted = (phi1 * balance[:, None]).T
    return np.linalg.solve(weighted @ phi1 + ridge * np.eye(phi1.shape[1]), weighted @ target)


def predict_language(docs: DataFrame, model: LanguageModel, *, text_col: str = "text", lang_out: str = "lang_pred", score_col: str = "score", fit_col: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of ``keep``, the predicted language of each whole text and its score from 0 to 1; with ``fit_col``
    also how far the text's fit is above the least of that language, or of the one it fits best if it doesn't fit the predicted
    one: negative for texts in no learned language, -1 for ``und``."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast((model.langs, model.landmarks, model.weights, model.orders, model.bits))
    held_fit = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(model.shares.T), model.least_fit)) if fit_col else None
    rows = docs.select(*keep, F.col(text_col).alias("_lang_text"))
    added = {lang_out: F.lit("").cast("string"), score_col: F.lit(0.0).cast("double")} | ({fit_col: F.lit(0.0).cast("double")} if fit_col else {})
    schema = out_schema(docs, keep, added)
    out_names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, marks, weights, orders, bits = held.value
        grams = Grams(orders, bits)
        present = np.zeros((_ROWS, 1 << bits), np.float32)
        names = np.array([*langs, UNDETERMINED], object)
        for b in batches:
            texts = b.column(b.num_columns - 1).to_pylist()
            best, score = np.full(len(texts), len(langs)), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if langs and t and any(map(str.isalpha, t))]
            for k in range(0, len(known), _ROWS):
                part = known[k : k + _ROWS]
                for j, i in enumerate(part):
                    grams.presence(texts[i], present[j])
                f = _kernel(present[: len(part)], marks) @ weights[:-1] + weights[-1]
                best[part] = f.argmax(1)
                score[part] = np.clip((f.max(1).astype(float) + 1) / 2, 0.0, 1.0)
            out = [pa.array(names[best].tolist(), pa.string()), pa.array(score)]
            if held_fit is not None:
                shares, least_fit = held_fit.value
                fit = np.full(len(texts), -1.0)
                for i in known:
                    ids = [*word_trigrams(texts[i], _FIT_BITS)]
                    for k in sorted(range(len(langs)), key=lambda k: k != best[i]):  # the others only where the predicted one does not fit
                        found = sum(shares[k][part].sum(dtype=float) for part in ids) / sum(map(len, ids)) - least_fit[k]
                        fit[i] = found if k == best[i] else max(fit[i], found)
                        if fit[i] >= 0:
                            break
                out.append(pa.array(fit))
            yield pa.record_batch([*b.columns[:-1], *out], names=out_names)

    return rows.mapInArrow(release_after(run), schema)
