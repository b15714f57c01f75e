"""Corpus pipeline: toxic documents go, one document of each near-duplicate group stays,
documents that hold benchmark items go, secrets are masked, and what is left is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet
and read again as the next stage's ``docs``.  All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tempora.llm.common import discard, materialize, scratch, table
from tempora.llm.decontaminate import decontaminate
from tempora.llm.packing import pack
from tempora.llm.registry import tokenizer_path
from tempora.llm.secrets import mask_secrets
from tempora.llm.simhash import keep_one_per_group
from tempora.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_per_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs, length_col="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, tokenizer_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secrets", secrets),
    ("packing", packing),
]

# Models, fingerprint links, edit distances and token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's output is written; what the stage wrote on its way, and its input, then go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as kept:
            done = materialize(stage(spark, docs, sf_dir), name)
            kept.append(done)
        discard(docs)
        docs = done
    return docs
