"""Documents to packed training sequences, in five stages.

Each stage works on all documents that the one before kept, and its decisions
take effect: rejected documents go, frequent lines go, one document of each
group of near copies stays, secrets are masked. The last stage returns the
pieces of the packed sequences; all others return the columns of documents.

Null and empty texts and those without a letter have no language and go in the
first stage. Rows with null or equal ids are documents of their own until the
third, where of equal ids in one group those with different texts stay. Columns
of other names pass through as they are. An empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterloom.llm import langid, line_dedup, ngram_join, packing, secrets
from meterloom.llm.queries import tokenizer_path
from meterloom.llm.shared import bounded_batches, written


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where the table has it, follows the text."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; the others go."""
    bounded_batches(spark)
    model = langid.fit(docs.select("doc_id", "text", "lang"))
    return langid.recognised(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that ten or more of them share."""
    return _counted(line_dedup.drop_frequent_lines(docs, min_docs=10).select(*docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard of 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, num=80, den=100)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets masked in their texts."""
    return _counted(secrets.redact(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of 2048 tokens."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), window=2048)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express a fitted classifier, a forest or a tokenizer; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
