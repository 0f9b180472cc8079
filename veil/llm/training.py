"""Labelled rows to learn from, and scores of whole texts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veil.llm.rows import col, extended, fresh, mapped, whole_text


def held_out(doc_id: Column) -> Column:
    """One third of the documents, by the checksum of the id; a document without an id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int,
                  doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """At most ``most`` labelled documents that are not held out, as (text, label).

    Which ones is decided by a hash of the id.  A document labelled twice counts
    as 1 if one of its labels does; of rows with one id the text that comes first
    is learned from; null ids and labels are left out.  The chosen ids are few
    enough to be broadcast (16 bytes a row).
    """
    known = labels.select(col(doc_id).alias("id"), col(label).cast("int").alias("label"))
    known = known.filter("id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)
    texts = docs.select(col(doc_id).alias("id"), whole_text(text).alias("text"))
    return texts.join(F.broadcast(chosen), "id").groupBy("id").agg(
        F.min("text").alias("text"), F.max("label").alias("label")).select("text", "label")


def with_scores(df: DataFrame, text: str, scorer: Callable[[], Callable[[list[str]], np.ndarray]],
                out: str = "score") -> DataFrame:
    """All rows and columns with the score of the whole text (null counts as empty).

    ``scorer`` is called once in each task.  If ``out`` is taken, the new column
    gets underscores after its name.
    """
    def run(batches):
        score = scorer()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield extended(batch, 1, [pa.array(np.asarray(score(texts), dtype=np.float64))])

    return mapped(df, [whole_text(text)], run, {fresh(df, out)[0]: "double"})


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
