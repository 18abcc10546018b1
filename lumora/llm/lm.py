"""LM scoring: the marginal probability of a text over all subword segmentations of its words.

The pieces are those of an existing subword vocabulary. Its scores give the first weights (a BPE file's
scores are ranks, read as a Zipf law). Expectation-maximisation sets the weights, the first ones staying in
as a prior: every round runs over the word counts of all training texts. A word's probability is the sum over its segmentations, by a log-space forward recursion over
its lattice, divided by the sum over all words and the end (``token_mass``): a distribution over tokens. That is
``lattice_score``. For ``score`` the lattice of a word that occurs in training texts has one more arc, the whole word
by its count less a ``discount``, over the number of training tokens; what all words are discounted is shared out by the
lattice of pieces, among all words. So the probabilities of all tokens have the sum 1 at most, and a text is its tokens
and one end. The discount is the one with the best likelihood of all training documents, each held back once: in five
folds, by a hash of their text, each under the word counts of the four others.

Words are counted over all texts. The ``frequent`` most common words are broadcast and scored where the
texts are read; all others are joined by a shuffle, so no table of the corpus is held in one place.

Nulls and odd rows: a null or empty text is one end token. A very long text is read as one; a long word has its own
recursion. Rows with a null id are in fold -1, so they are learned from. Repeated rows are scored each. Without training
texts the score is that of the pieces, the counts are 0 and the base score of a token is log10(0.1 / 0.1) = 0. An empty table gives an empty
result. Extra columns are ignored; a kept column with the name of a new one is refused.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumora.llm.common import batch_rows, cut, out_schema, release_after, small_batches, sum_vectors
from lumora.llm.lattice import WORD_START, Lattice

LOG10 = math.log(10.0)
MEMO = 400_000
#: Words in one Arrow batch.
WORD_ROWS = 20_000
#: Folds of the training texts; columns with a word's count in each.
FOLDS = 5
IN_FOLD = [f"f{k}" for k in range(FOLDS)]


@dataclass
class Vocabulary:
    pieces: list[str]  # empty where a piece spells nothing
    logp: np.ndarray
    bytes_at: np.ndarray
    end: int

    @classmethod
    def load(cls, path: str, offset: float = 2.7) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        score = np.array([sp.get_score(i) for i in range(n)])
        odd = np.array([sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(n)])
        weight = 1.0 / (offset - np.minimum(score, 0.0))  # rank -score: Zipf
        weight[odd] = weight[~odd].min()
        pieces = ["" if odd[i] else sp.id_to_piece(i) for i in range(n)]
        byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)])
        return cls(pieces, np.log(weight / weight.sum()), byte_ids, sp.eos_id())


def tokens(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased: runs other than space and \\t \\n \\v \\f \\r."""
    return text.encode("utf-8", "replace").lower().split() if text else []


def token_mass(vocab: Vocabulary) -> float:
    """The sum of all words' marginals and the end's, before they are divided by it.

    A word is a piece with a mark of its start and any number of pieces without one; the mark alone is no word.
    """
    p = np.exp(vocab.logp)
    start = np.array([x.startswith(WORD_START) and WORD_START not in x[1:] for x in vocab.pieces])
    inner = np.array([bool(x) and WORD_START not in x for x in vocab.pieces])
    inner[vocab.bytes_at] = True
    alone = sum(p[i] for i, x in enumerate(vocab.pieces) if x == WORD_START)
    return float(p[start].sum() / (1 - p[inner].sum()) - alone + p[vocab.end])


def word_counts(docs: DataFrame, text_col: str, train: Column) -> DataFrame:
    """Every word of all texts: word binary, c (in training texts), f0 to f4 (in each fold of these), n (in all); the end
    token is the empty word."""
    small_batches(docs.sparkSession)
    sums = [*IN_FOLD, "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, ...] = tuple(Counter() for _ in range(FOLDS + 1))  # the folds, not learned from

        def flush() -> pa.RecordBatch:
            at = {w: i for i, w in enumerate(dict.fromkeys(w for k in held for w in k))}
            counts = np.zeros((FOLDS + 1, len(at)), np.int64)
            for row, k in zip(counts, held, strict=True):
                row[np.fromiter(map(at.__getitem__, k), np.int64, len(k))] = np.fromiter(k.values(), np.int64, len(k))
                k.clear()
            counts[FOLDS] = counts.sum(0)
            return pa.record_batch([pa.array(at, pa.binary()), *map(pa.array, counts)], names=["word", *sums])

        for b in batches:
            for t, kind in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = held[kind]
                to.update(tokens(t))
                to[b""] += 1
            if sum(map(len, held)) > MEMO:
                yield flush()
        yield flush()

    fold = F.pmod(F.xxhash64(text_col, F.lit(3)), F.lit(FOLDS)).cast("int")
    rows = docs.select(F.col(text_col), F.when(F.coalesce(train, F.lit(False)), fold).otherwise(FOLDS).alias("_fold"))
    got = rows.mapInArrow(release_after(run), "word binary, " + ", ".join(f"{x} bigint" for x in sums)).groupBy("word").agg(*[F.sum(x).alias(x) for x in sums])
    return got.select("word", sum(map(F.col, IN_FOLD)).alias("c"), *sums)


def train_pieces(words: DataFrame, vocab: Vocabulary, rounds: int = 4, prior: float = 1000.0) -> Vocabulary:
    """Re-estimate the pieces' probabilities from word counts (word, c) by expectation-maximisation."""
    sc = words.sparkSession.sparkContext
    first = np.exp(vocab.logp)
    for _ in range(rounds):
        held = sc.broadcast(vocab)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            v = held.value
            lattice, total = Lattice(v.pieces, v.logp, v.bytes_at), np.zeros(len(v.logp))
            for b in batches:
                w, c = b.column(0).to_pylist(), b.column(1).to_numpy()
                total[v.end] += c[[i for i, x in enumerate(w) if not x]].sum()
                some = [i for i, x in enumerate(w) if x]
                total += lattice.expected([w[i] for i in some], c[some])
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], names=["v"])

        total = sum_vectors(words.where("c > 0").select("word", "c").mapInArrow(run, "v binary"))
        if total is None or not total.sum():
            return vocab
        vocab = Vocabulary(vocab.pieces, np.log((total + prior * first) / (total.sum() + prior)), vocab.bytes_at, vocab.end)
    return vocab


#: Discounts that are tried.
DISCOUNTS = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99)


def mixed(c: np.ndarray, total: int, size: int, sub: np.ndarray, discount: float) -> np.ndarray:
    """log10 of ``(c - discount) / total + discount * size / total * 10 ** sub`` of seen words (``size`` in all), without
    the first part for others; ``sub`` where there are no training tokens."""
    if not total:
        return sub
    with np.errstate(divide="ignore"):
        arc, rest = np.log(np.maximum(c - discount, 0.0) / total), np.log(discount * size / total)
    return np.logaddexp(arc, rest + sub * LOG10) / LOG10


def _mixed(c: Column, total: Column, size: Column, sub: Column, discount: float) -> Column:
    """As ``mixed``, for a discount over 0 and under 1."""
    n = F.greatest(total, F.lit(1))
    rest = sub + F.log10(discount * F.greatest(size, F.lit(1)) / n)
    arc = F.log10((c - discount) / n)
    m = F.greatest(arc, rest)
    both = F.when(c > 0, m + F.log10(F.pow(F.lit(10.0), arc - m) + F.pow(F.lit(10.0), rest - m))).otherwise(rest)
    return F.when(total > 0, both).otherwise(sub)


def fit_discount(rare: DataFrame, top: tuple[np.ndarray, ...], totals: list[int], sizes: list[int]) -> float:
    """The discount with the best likelihood of all tokens, those of a fold from the others: ``totals`` ones, ``sizes`` distinct ones
    without each fold. ``top``: c, the values and the counts in each fold of the words that are not in ``rare``."""
    if not any(totals):
        return 0.5
    at = lambda values: F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("k"))
    held = rare.select("c", "sub", F.posexplode(F.array(*IN_FOLD)).alias("k", "d")).where("d > 0").select("d", "sub", (F.col("c") - F.col("d")).alias("o"), at(totals).alias("n"), at(sizes).alias("v"))
    row = held.agg(*[F.sum(F.col("d") * _mixed(F.col("o"), F.col("n"), F.col("v"), F.col("sub"), x)) for x in DISCOUNTS]).first()
    c, sub, folds = top
    sums = [r or 0.0 for r in row]
    for d, total, size in zip(folds, totals, sizes, strict=True):
        on = d > 0
        sums = [s + float((d[on] * mixed(c[on] - d[on], total, size, sub[on], x)).sum()) for s, x in zip(sums, DISCOUNTS, strict=True)]
    return DISCOUNTS[int(np.argmax(sums))]


def score_texts(docs: DataFrame, vocab: Vocabulary, *, train: Column, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), frequent: int = 1 << 16, discount: float | None = None, rounds: int = 4) -> DataFrame:
    """The columns of ``keep`` and n_tokens, n_known, train_tokens, base_score, lattice_score and score of each whole text."""
    spark = docs.sparkSession
    small_batches(spark)
    new = {"n_tokens": F.lit(0).cast("bigint"), "n_known": F.lit(0).cast("bigint"), "train_tokens": F.lit(0).cast("bigint")} | {x: F.lit(0.0).cast("double") for x in ("base_score", "lattice_score", "score")}
    out_schema(docs, keep, new)  # names must differ
    words = cut(word_counts(docs, text_col, train), "lm-words")
    counted = [F.count(F.when(F.col("c") > 0, 1)).alias("v"), *[F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in IN_FOLD], *[F.count(F.when(F.col("c") > F.col(k), 1)).alias(f"without_{k}") for k in IN_FOLD]]
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), *counted).first()
    total, size = int(row["n"]), int(row["v"])
    with batch_rows(spark, WORD_ROWS):
        vocab = train_pieces(words, vocab, rounds)
    floor = total + 0.1 * (size + 1)
    held = spark.sparkContext.broadcast((vocab, math.log(token_mass(vocab))))

    def value_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """log10 of each token's base and lattice probability."""
        v, mass = held.value
        lattice = Lattice(v.pieces, v.logp, v.bytes_at)
        for b in batches:
            w, c = b.column(0).to_pylist(), b.column(1).to_numpy()
            sub = np.array([v.logp[v.end] if not x else 0.0 for x in w])
            some = [i for i, x in enumerate(w) if x]
            sub[some] = lattice.log_prob([w[i] for i in some])
            yield pa.record_batch([*b.columns, pa.array(np.log10((c + 0.1) / floor)), pa.array((sub - mass) / LOG10)], names=[*b.schema.names, "base", "sub"])

    table_schema = f"word binary, c bigint, {', '.join(f'{k} bigint' for k in IN_FOLD)}, base double, sub double"
    top = words.orderBy(F.desc("n"), "word").limit(frequent).select("word", "c", *IN_FOLD)
    with batch_rows(spark, WORD_ROWS):
        top_rows = top.mapInArrow(release_after(value_rows), table_schema).toArrow()
    rare = words.join(F.broadcast(top.select("word")), "word", "left_anti") if frequent else words
    with batch_rows(spark, WORD_ROWS):
        rare = cut(rare.select("word", "c", *IN_FOLD).mapInArrow(release_after(value_rows), table_schema), "lm-rare")
    c, base, sub, *folds = (top_rows[x].to_numpy() for x in ("c", "base", "sub", *IN_FOLD))
    discount = fit_discount(rare, (c, sub, folds), [total - int(row[k]) for k in IN_FOLD], [int(row[f"without_{k}"]) for k in IN_FOLD]) if discount is None else discount
    top_held = spark.sparkContext.broadcast((top_rows["word"].to_pylist(), c, base, sub, mixed(c, total, size, sub, discount)))
    del top_rows, folds

    rows = docs.select(*keep, F.col(text_col).alias("_lm_text")).withColumn("_row", F.monotonically_increasing_id())
    n_keep = len(keep)
    schema = rows.select("_row", *keep, F.lit(b"").alias("_word"), F.lit(0).cast("bigint").alias("_tf"), F.lit(0).cast("bigint").alias("_n"), F.lit(0).cast("bigint").alias("_k"), *[F.lit(0.0).cast("double").alias(x) for x in ("_b", "_s", "_m")]).schema

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class Index(dict):
            def __missing__(self, key: bytes) -> int:
                return -1

        top_words, c, *logs = top_held.value
        index = Index((w, i) for i, w in enumerate(top_words))
        at_end = index[b""]
        find, known = index.__getitem__, c > 0
        for b in batches:
            ids = b.column(n_keep + 1).to_pylist()
            src, word, tf, out = [], [], [], []
            for i, t in enumerate(b.column(n_keep).to_pylist()):
                w = tokens(t)
                at = np.fromiter(map(find, w), np.int64, len(w))
                hit = at[at >= 0]
                if at_end >= 0:
                    hit = np.append(hit, at_end)
                # a key that is no word: it has a space
                src.append(i)
                word.append(b" %d" % ids[i])
                tf.append(0)
                out.append((len(w) + 1, int(known[hit].sum()), *[float(x[hit].sum()) for x in logs]))
                missing = Counter([w[j] for j in np.flatnonzero(at < 0)] + ([b""] if at_end < 0 else []))
                src += [i] * len(missing)
                word += missing
                tf += missing.values()
                out += [(0, 0, 0.0, 0.0, 0.0)] * len(missing)
            take = pa.array(src, pa.int64())
            cols = list(zip(*out, strict=True)) if out else [()] * 5
            yield pa.record_batch([b.column(n_keep + 1).take(take), *[b.column(j).take(take) for j in range(n_keep)], pa.array(word, pa.binary()), pa.array(tf, pa.int64()), *[pa.array(x, pa.int64() if j < 2 else pa.float64()) for j, x in enumerate(cols)]], names=schema.names)

    parts = rows.mapInArrow(release_after(read), schema)
    values = rare.select(F.col("word").alias("_word"), F.col("c").alias("_c"), F.col("base").alias("_base"), F.col("sub").alias("_sub"), _mixed(F.col("c"), F.lit(total), F.lit(size), F.col("sub"), discount).alias("_mix"))
    joined = parts.join(values, "_word", "left")
    total_of = {"n_tokens": F.col("_n"), "n_known": F.col("_k"), "base_score": F.col("_b"), "lattice_score": F.col("_s"), "score": F.col("_m")}
    more = {"n_tokens": F.lit(0), "n_known": F.when(F.col("_c") > 0, F.col("_tf")), "base_score": F.col("_tf") * F.col("_base"), "lattice_score": F.col("_tf") * F.col("_sub"), "score": F.col("_tf") * F.col("_mix")}  # tokens are counted where the text is read
    zero = {"n_tokens": 0, "n_known": 0, "base_score": 0.0, "lattice_score": 0.0, "score": 0.0}
    got = joined.groupBy("_row", *keep).agg(*[F.sum(total_of[x] + F.coalesce(more[x], F.lit(zero[x]))).alias(x) for x in total_of])
    return got.select(*keep, "n_tokens", "n_known", F.lit(total).cast("bigint").alias("train_tokens"), "base_score", "lattice_score", "score")
