"""Stage helpers: names that clash, empty tables, no labels, samples of any size."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempora.llm import decontaminate, labelled, quality_model, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, row_key long, row_key_ string, ROW_PRINT string, text_digest string, fp long, least string, item_id string, label int, h string, score double"
EXTRA = (7, "k", "p", "d", 5, "l", "i", 9, "h", 0.25)
LABELS = "doc_id long, toxic int, quality int"
ITEM = "the quick brown fox jumps over the lazy dog while nobody is watching it closely"


def docs(spark, texts):
    return spark.createDataFrame([(k, t, *EXTRA) for k, t in enumerate(texts)], SCHEMA)


def labels(spark, n):
    return spark.createDataFrame([(k, int(k % 3 == 0), int(k % 2 == 0)) for k in range(n)], LABELS)


def stages(spark):
    items = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    return {
        "toxic": lambda df: toxicity.drop_toxic(df, labels(spark, 60)),
        "near": lambda df: simhash.keep_one_per_group(df),
        "items": lambda df: decontaminate.decontaminate(df, items),
        "secrets": lambda df: secrets.mask_secrets(df, length_col="row_key"),
    }


TEXTS = ["clean words only", "clean words only", f"before {ITEM} after", "password = hunter2hunter2", None, "", "x " * 30_000]


@pytest.mark.parametrize("name", ["toxic", "near", "items", "secrets"])
def test_columns_of_any_name_stay(spark, name):
    df = docs(spark, TEXTS)
    made = stages(spark)[name](df)
    assert made.columns == df.columns and made.schema.simpleString() == df.schema.simpleString()
    kept = [c for c in df.columns if c not in (("text", "row_key") if name == "secrets" else ())]
    assert made.select(kept).exceptAll(df.select(kept)).isEmpty()
    assert made.count() == {"toxic": 7, "near": 5, "items": 6, "secrets": 7}[name]


@pytest.mark.parametrize("name", ["toxic", "near", "items", "secrets"])
def test_empty_tables_stay_empty(spark, name):
    made = stages(spark)[name](docs(spark, TEXTS).limit(0))
    assert made.count() == 0 and len(made.columns) == 12


def test_scoring_queries_on_empty_tables(spark):
    none = docs(spark, TEXTS).limit(0)
    assert toxicity.toxicity(none, labels(spark, 9)).count() == 0
    assert quality_model.quality(none, labels(spark, 9)).count() == 0
    assert secrets.scan_secrets(none).count() == 0
    assert decontaminate.contaminated(none, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(docs(spark, TEXTS), spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("marks", [[], [(k, 1, 1) for k in range(50)], [(k, 0, 0) for k in range(50)]])
def test_no_document_goes_for_want_of_a_model(spark, marks):
    df = docs(spark, [f"some clean text number {k}" for k in range(50)])
    assert toxicity.drop_toxic(df, spark.createDataFrame(marks, LABELS)).count() == 50


@pytest.mark.parametrize("n", [10, 16_000, 10**6, 10**9, 4 * 10**10, 10**13])
@pytest.mark.parametrize("sample", [8_000, 16_000])
def test_a_sample_of_any_number_of_labels(n, sample):
    """Of so many hashes about ``sample`` lie below the bound, and never none."""
    share = labelled.sample_bound(n, sample) / (1 << labelled.HASH_BITS)
    assert abs(share * n - min(n, sample)) < 0.001 * min(n, sample)


def test_sample_is_spread_evenly(spark):
    ids = spark.range(200_000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    texts = ids.select("doc_id", F.lit("t").alias("text"))
    n = labelled.training_rows(texts, ids, "toxic", 5, 0, 4_000).count()
    assert 3_700 < n < 4_300


def test_a_sample_of_long_texts_is_bounded_in_bytes(spark):
    rows = spark.range(1000).select(F.shiftrightunsigned(F.xxhash64("id"), 1).alias("h"), F.lit(100).alias("size"))
    assert labelled.within_bytes(rows, F.col("size"), 10**6).count() == 1000
    assert 200 < labelled.within_bytes(rows, F.col("size"), 30_000).count() < 400


def test_features_summed_in_spark_equal_those_at_hand(spark):
    rng = random.Random(4)
    bad, words = ["vile", "scum"], [f"word{k}" for k in range(40)]
    texts = [" ".join(rng.choices(words, k=12) + ([rng.choice(bad)] if k % 3 == 0 else [])) for k in range(300)]
    df, marks = docs(spark, texts), labels(spark, 300)
    model = toxicity.train(df, marks)
    ids = [k for k in range(300) if labelled_fold(spark, k)]
    plain = toxicity.fit([toxicity.buckets(texts[k]) for k in ids], np.array([int(k % 3 == 0) for k in ids]))
    assert (model.feature_of == plain.feature_of).all() and np.allclose(model.weights, plain.weights) and np.allclose(model.factors, plain.factors)


def labelled_fold(spark, k):
    import zlib

    return zlib.crc32(str(k).encode()) % toxicity.MODULUS != toxicity.HELD_OUT
