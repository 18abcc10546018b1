"""The queries ``opN_<name>`` of the operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumora.llm import codes, conversations, extraction, warc
from lumora.llm.ann import search
from lumora.llm.bpe import Tokenizer, build_lexicon, encode
from lumora.llm.common import fold, table
from lumora.llm.decontaminate import find_leaks
from lumora.llm.jaccard import link_documents
from lumora.llm.language import fit_language, predict_language
from lumora.llm.lm import Vocabulary, score_texts
from lumora.llm.quality import fit_quality, score_quality
from lumora.llm.toxicity import fit_toxicity, score_toxicity
from lumora.llm.urls import Rule, fit_urls, judge_urls

URL_RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = fit_toxicity(docs, labels, keep=fold("doc_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op2_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("_id") % 20 == 0)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit_language(docs, keep=fold("doc_id", 5) != 0)
    return predict_language(docs, model).select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit_quality(docs, labels, keep=fold("doc_id", 3) != 1)
    return score_quality(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tok = Tokenizer.load(tokenizer_path())
    rows = encode(docs, tok, build_lexicon(docs, tok, most=1 << 17), outputs=("n_tokens", "ids_text", "decoded"), memo_size=600_000)
    return rows.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = score_texts(docs, Vocabulary.load(tokenizer_path("piece_bpe_32k.model")), train=fold("doc_id", 10) != 0)
    return rows.select("doc_id", (fold("doc_id", 10) == 0).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "lattice_score")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derive(warc.responses(table(spark, sf_dir, "pages").select("page_id", "url", "html")))


def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return judge_urls(pages, URL_RULES, fit_urls(pages, URL_RULES))


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return conversations.repair(conversations.damage(rows), gone_col="gone")


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    return codes.with_label_error(coded).select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.extract(pages, extraction.fit_pages(pages))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_ann": op2_ann, "op3_language": op3_language, "op4_quality": op4_quality, "op5_decontaminate": op5_decontaminate, "op6_bpe": op6_bpe, "op7_lm": op7_lm, "op8_jaccard": op8_jaccard, "op9_warc": op9_warc, "op10_urls": op10_urls, "op11_conversations": op11_conversations, "op12_codes": op12_codes, "op13_extraction": op13_extraction}


def oracle_sql() -> dict[str, str]:
    return {"op9_warc": warc.oracle(), "op11_conversations": conversations.oracle(), "op12_codes": codes.oracle(), "op13_extraction": extraction.oracle()}
