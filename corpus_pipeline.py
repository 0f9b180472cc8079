"""From raw documents to token ids: five stages, each written as Parquet and read again as the next one's input.

Every stage works on all documents that the one before kept, and all but the last
return the columns of ``documents``.  Null texts count as empty.  Columns of the
documents with names that a stage uses itself are left as they are, and empty
tables go through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veil.llm import byte_bpe, decontaminate, line_dedup, ngram_join, quality
from veil.llm.rows import col, fresh
from veil.operators.materialize import materialize

#: The rank file of the last stage.
RANK_FILE = "byte_bpe_multi_50k.tiktoken"


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives a probability of a half or more."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, = fresh(docs, "pipeline_score")
    return quality.score_quality(docs, model, out=score).filter(col(score) >= 0.5).drop(score)


def new_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has; documents that lose all but white space go."""
    deleted, = fresh(docs, "pipeline_deleted")
    cut = line_dedup.delete_common_lines(docs, out=deleted)
    changed = col(deleted) > 0
    left = cut.filter(~changed | F.col("text").rlike(r"\S"))
    return left.withColumn("n_chars", F.when(changed, F.length("text").cast("bigint")).otherwise(
        F.col("n_chars"))).drop(deleted)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return ngram_join.keep_one(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    n_items, longest = fresh(docs, "n_items", "longest")
    return decontaminate.mark_contaminated(docs, items).filter(col(n_items) == 0).drop(n_items, longest)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts, and whether they decode to the text again.

    The ids are stored in between: encoding and decoding in one plan would hold
    two Python workers for each task, beside a JVM that has all earlier stages behind it,
    and Spark keeps workers for the stages that follow.
    """
    vocabulary = byte_bpe.Vocabulary(spark, public_tokenizers.path(RANK_FILE), public_tokenizers.PATTERN)
    docs = docs.select("doc_id", "lang", "source", "text")
    encoded = materialize(byte_bpe.encode(docs, vocabulary))
    decoded = byte_bpe.decode(encoded, vocabulary)
    return decoded.select(
        "doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids",
        (F.col("bytes") == F.coalesce("text", F.lit("")).cast("binary")).alias("round_trip"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", new_lines),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", unseen_documents),
    ("byte_bpe", token_ids),
]
#: No stage can be said in SQL: models, alignments, MinHash and merges; the tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
