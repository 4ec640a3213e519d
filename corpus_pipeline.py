"""Stages that turn the documents table into a mixed, encoded corpus.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; all but the last return the columns of documents. run() writes each
stage's result to the shared folder and reads it back as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulse.llm import bpe, langid, line_dedup, mixing, ngram_join, queries
from pulse.llm.common import lasting, scope

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go; the others' lang becomes the predicted one."""
    judged = langid.predict(docs.select(*COLUMNS), langid.fit(langid.teaching(docs)))
    kept = judged.where(F.col("lang_pred") != langid.UNKNOWN)
    return kept.select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in COLUMNS])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; a document stays, however little of it is left."""
    out = line_dedup.dedup(docs.select(*COLUMNS))
    return out.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in COLUMNS])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of smallest id stays."""
    found = ngram_join.classes(docs)
    first = found.where(F.col("component_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.select(*COLUMNS).join(first, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi").select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target marginals."""
    return mixing.sample(docs).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, their number, and hashes of both them and the decoded text."""
    return bpe.encode(docs, queries.tokenizer(queries.BPE_FILE), queries.bpe_pattern())


STAGES = [
    ("language_id", languages),
    ("line_dedup", lines),
    ("ngram_jaccard_join", near_copies),
    ("source_mixing", mixed),
    ("byte_level_bpe", encoded),
]

#: Language ID and encoding can't be expressed in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with scope():  # what a stage writes on its way goes when its result is there
            docs = lasting(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
