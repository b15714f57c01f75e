"""Phrase mining against its SQL, which counts every phrase of every length."""

import random

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempora.llm import collocations

DOCS = "doc_id long, text string, lang string, n string, word string, shard string, k string"


def mined(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, lang, "a", "b", "c", "d") for i, (t, lang) in enumerate(rows)], DOCS)
    return collocations.collocations(docs, **options).orderBy("lang", "rank").toPandas()


def by_sql(rows, **options):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["text", "lang"], dtype="string"))
    return con.execute(collocations.sql(**options)).df().sort_values(["lang", "rank"]).reset_index(drop=True)


def same(made, told):
    pd.testing.assert_frame_equal(made, told[made.columns], check_dtype=False)


def corpus(seed, n=80):
    rng = random.Random(seed)
    words = ["New", "york", "city", "of", "the", "é", "ÉA", "b\x1cc", "x", "of the", "a"]
    join = lambda: rng.choice([" ", " ", " ", "\t", "  ", ", ", ".", "\n", "\r\n", "; ", " - "])
    rows = [("".join(rng.choice(words) + join() for _ in range(rng.randrange(0, 90))), rng.choice(["en", "en", "de", None, "und", ""])) for _ in range(n)]
    return rows + [(None, "en"), ("", None), ("new york city of the", "en"), *[("the the the the the the", "de")] * 30, (" the a" * 4000, "fr")]


@pytest.mark.parametrize("options", [{"threshold": 12}, {"threshold": 5, "top": 7, "shards": 3}, {"threshold": 40, "longest": 3, "shards": 1}, {"threshold": 3, "contained": 60, "shards": 7}])
def test_collocations_equal_sql(spark, options):
    options = dict(options)
    rows = corpus(options["threshold"])
    shards = options.pop("shards", 4)
    made = mined(spark, rows, shards=shards, **options)
    assert len(made) > 3
    same(made, by_sql(rows, **options))


def test_a_full_filter_changes_no_count(spark):
    """A filter of 128 bits knows nearly everything, so that almost all phrases are counted early."""
    rows = corpus(3, 40)
    same(mined(spark, rows, threshold=8, filter_bits=7), by_sql(rows, threshold=8))


def test_phrases_that_only_late_shards_hold(spark):
    """Found in the last shard first, so that their cycle runs into the next round."""
    rows = [("filler words here", "en")] * 3 + [(" ".join(["q r s t u"] * 40), "en")]
    made = mined(spark, rows * 1, threshold=20)
    assert "q r s t u" in set(made["phrase"])
    same(made, by_sql(rows, threshold=20))


def test_products_beyond_64_bits(spark):
    rows = [("a b " * 3000, "en")] * 20
    options = {"threshold": 100, "scale": 10**12, "longest": 2}
    same(mined(spark, rows, **options), by_sql(rows, **options))


def test_nothing_to_mine(spark):
    assert len(mined(spark, [("one two", "en")])) == 0
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0


def test_hashes_agree_with_spark(spark):
    rng = np.random.default_rng(1)
    a, b = rng.integers(-(2**63), 2**63 - 1, (2, 100))
    df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b}))
    told = df.select(collocations.joined_column(F.col("a"), F.col("b")).alias("h")).toPandas()["h"]
    assert (collocations.joined(a.view(np.uint64), b.view(np.uint64)).view(np.int64) == told.to_numpy()).all()
    bits = collocations._bits(df.select(F.lit(1).alias("k"), "a", "b"), 20)
    assert collocations.known(bits, a.view(np.uint64)).all() and collocations.known(bits, b.view(np.uint64)).mean() < 0.1
