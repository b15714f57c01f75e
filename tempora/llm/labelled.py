"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_remainder


HASH_BITS = 63


def sample_bound(labelled: int, sample_rows: int) -> int:
    """Of hashes of ``HASH_BITS`` bits, the number below which about ``sample_rows`` of so many lie."""
    return (1 << HASH_BITS) - 1 if labelled <= sample_rows else (sample_rows << HASH_BITS) // labelled


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str, modulus: int, held_out: int, sample_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, label, h, text)`` of labelled documents outside the held-out fold.

    About ``sample_rows`` rows at most, those of the least hashes ``h`` of the id, so the choice does
    not depend on partitioning.  Rows with a null id, label or text are left out; an id labelled
    twice takes its larger label, and of the texts of one id the least counts, so an id
    that very many rows share adds one row.
    """
    marks = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("label"))
    marks = marks.where(id_remainder("doc_id", modulus) != held_out)
    h = F.shiftrightunsigned(F.xxhash64("doc_id"), 64 - HASH_BITS)
    marks = marks.withColumn("h", h).where(F.col("h") <= sample_bound(marks.count(), sample_rows))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    # the chosen marks are bounded by sample_rows, whatever the corpus holds
    return rows.join(F.broadcast(marks), "doc_id").groupBy("doc_id", "label", "h").agg(F.min("text").alias("text"))


def within_bytes(rows: DataFrame, size: Column, budget: int) -> DataFrame:
    """Of stored ``rows(h, ...)`` those of the least hashes whose sizes come to about ``budget``."""
    total, most = rows.agg(F.sum(size), F.max("h")).first()
    return rows if not total or total <= budget else rows.where(F.col("h") <= most * budget // total)
