"""Training rows for the classifiers: a bounded sample of labelled documents, and which documents are held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id: str = "doc_id") -> Column:
    """Whether a row's label is never learned: crc32 of the id's text leaves 1 by 3, or there is no id."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, text, y) of at most ``most`` labelled rows, chosen by hash of the id, none of them held out.

    Of documents with equal ids the first by text is learned from.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & ~held_out())
    sample = rows.orderBy(F.xxhash64("doc_id"), "y").limit(most)
    found = documents.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "y")  # at most ``most`` rows
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")
