"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
folder and reads it back for the next. All but the last return the columns of documents. Rows whose id is
null pass the stages that decide by id. Rows that share an id are one document: they stay or go together.
An empty table gives an empty result.

Null and empty texts: toxicity scores them by its bias alone, the language stage rejects them (they have no letter), they link with
nothing and nothing leaks into them. Texts of any length are read whole. Ties and repeated rows are those of the operators. More
columns may have any name: columns for a time take names that the documents don't have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm.bpe import Tokenizer, build_lexicon, encode
from lumora.llm.common import cut, drop_ids, table
from lumora.llm.decontaminate import find_leaks
from lumora.llm.jaccard import link_documents
from lumora.llm.language import UNDETERMINED, fit_language, predict_language
from lumora.llm.queries import tokenizer_path
from lumora.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_FROM = 0.5
#: Near duplicates: five-word shingles, similarity 0.8.
SHINGLE, SIMILAR = 5, (80, 100)


def _free(docs: DataFrame, name: str) -> str:
    """A column name that the documents don't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not judged toxic. The classifier learns from the labels of documents of this stage."""
    model = fit_toxicity(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    score = _free(docs, "_toxicity")
    return score_toxicity(docs, model, score_col=score, keep=tuple(docs.columns)).where(F.col(score) < TOXIC_FROM).drop(score)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in one of the learned languages: neither undetermined nor below the least fit of held-back texts."""
    model = fit_language(docs.select("doc_id", "text", "lang"), with_fit=True)
    lang, score, fit = (_free(docs, x) for x in ("_lang_pred", "_lang_score", "_lang_fit"))
    judged = predict_language(docs, model, lang_out=lang, score_col=score, fit_col=fit, keep=tuple(docs.columns))
    return judged.where((F.col(lang) != UNDETERMINED) & (F.col(fit) >= 0)).drop(lang, score, fit)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents."""
    linked = link_documents(docs.select("doc_id", "text"), k=SHINGLE, num=SIMILAR[0], den=SIMILAR[1])
    return drop_ids(docs, linked.where("component_id != doc_id").select("doc_id"), "doc_id").select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents into which no benchmark item leaks."""
    leaks = find_leaks(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return drop_ids(docs, leaks.select("doc_id"), "doc_id").select(docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the ids of each document's tokens."""
    tok = Tokenizer.load(tokenizer_path())
    return encode(docs, tok, build_lexicon(docs.select("text"), tok), outputs=("n_tokens", "ids"), keep=("doc_id", "lang", "source"), memo_size=100_000, batch_bytes=1 << 21)


STAGES = [("toxicity", toxicity), ("language_id", language), ("ngram_jaccard_join", near_duplicates), ("benchmark_decontamination", decontamination), ("bpe", bpe)]

#: SQL can't express the fitted classifiers or the tokenizer; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
