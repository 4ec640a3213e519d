"""One query for each operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm import bpe, edit_fingerprint, langid, line_dedup, mixing, ngram_join, token_counts, topk, toxicity, url_rules
from pulse.llm.common import table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def bpe_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.against_next(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_rules.judge(pages, url_rules.mine(pages, table(spark, sf_dir, "labels")))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), tokenizer(BPE_FILE), bpe_pattern(), keep_ids=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("probability", 6).alias("probability"), "kept")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count(table(spark, sf_dir, "documents"), tokenizer(PIECE_FILE), limit=4096, keep_steps=False)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit", "longest_within")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.predict(docs.select("doc_id", "text"), langid.fit(langid.teaching(docs)))
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_edit_fingerprint, op2_toxicity, op3_line_dedup, op4_url_rules, op5_topk, op6_byte_bpe, op7_mixing, op8_token_counts, op9_ngram_join, op10_language_id)}
