"""Array operators one behind another: every step is computed once a subject, not once an element."""

import pytest
from pyspark.sql import functions as F

from tempora.operators import sequences
from tempora.plans import pipelines

TOKENS = "subject_id long, seq long, code int, abspos double, segment int, age double"


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def token_rows(spark, n):
    return spark.createDataFrame([(s, k, 2 if k % 7 == 6 else 5 + k % 3, float(k), k // 7, 1.0) for s in range(2) for k in range(n)], TOKENS)


def test_pretraining_steps_are_not_repeated(spark):
    """Filters that pass the steps, and lambdas that name what they made, had put them into each other."""
    n = 600
    done = sequences.explode_sequences(pipelines.prepare_pretrain(token_rows(spark, 700), n, 3))
    assert plan(done).count("exists(") <= 4
    told = done.groupBy("subject_id").agg(F.count("*").alias("n"), F.max("segment").alias("last"), F.sum("abspos").alias("sum")).collect()
    # the 597 last rows begin in segment 14, row 103 of which is no separator; the first three are segment 0
    assert sorted(map(tuple, told)) == [(s, n, 86, float(3 + sum(range(103, 700)))) for s in range(2)]


@pytest.mark.parametrize("delays", [None, {5: 1.0}])
def test_finetuning_steps_are_not_repeated(spark, delays):
    seqs = sequences.to_sequences(token_rows(spark, 300)).withColumn("censor_date", F.lit(250.5))
    cut = sequences.censor(seqs) if delays is None else sequences.censor_with_delays(seqs, delays)
    cut = sequences.truncate(cut, 200, 3) if delays is None else sequences.truncate_prioritized(cut, 200, 3, [7])
    done = sequences.explode_sequences(sequences.normalize_segments(sequences.drop_incomplete_units(cut, [6], 1)))
    assert plan(done).count("filter(") <= 8 and plan(done).count("sort_array") <= 2
    assert done.groupBy("subject_id").count().where("count between 150 and 200").count() == 2
