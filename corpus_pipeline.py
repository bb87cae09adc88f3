"""From raw documents to token ids: quality, toxicity, near copies, mixture, BPE.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and but for the last returns the
columns of documents. run() writes each stage's result as Parquet in the shared folder and reads it again.

Defined results: null, empty and blank texts have no quality and leave in the first stage (the other stages, asked alone,
keep them: they link with nothing, are repeated like the rest of their source, at no cost in words, and have no ids).
Rows without an id are kept like others. Rows that repeat both id and text are one document after the third stage. An
empty table passes every stage. Columns beyond those of documents are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prismcat.llm import bpe, mixing, ngram_join, quality, toxicity
from prismcat.llm.common import read, written

#: Words whose ids a worker keeps in the last stage, beside what earlier stages have left in its memory.
WORDS = 100_000
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled documents of sf_dir."""
    scored = quality.score_quality(_documents(docs), read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return _documents(scored.where("predicted = 1"))


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic by their nearest labelled examples, which come from sf_dir."""
    scored = toxicity.score_toxicity(_documents(docs), read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return _documents(scored.where("predicted = 0"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more."""
    return ngram_join.keep_one(_documents(docs), words=5, share=(8, 10))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of the sources: each document as often as its source's repetition rate says."""
    return mixing.mix(_documents(docs))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture, with a digest of what they decode to."""
    coded = bpe.bpe_round_trip(_documents(docs), bpe.default_path(), table=WORDS)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("toxicity", toxicity_filter),
    ("ngram_jaccard", ngram_jaccard),
    ("mix_sources", mix_sources),
    ("bpe", bpe_tokens),
]

#: SQL can express neither the classifiers nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(spark, stage(spark, docs, sf_dir), name)
    return docs
