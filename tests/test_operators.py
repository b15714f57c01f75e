"""Operators on small literal tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tempora.operators import features, filters, metrics, outcomes, sequences, splits
from tempora.sources import io

T = dt.datetime(2021, 1, 1)
SCHEMA = "subject_id long, time timestamp_ntz, code string, numeric_value double, row_id long"


def hours(*xs):
    return [T + dt.timedelta(hours=x) for x in xs]


def segments(spark, rows, stays):
    df = spark.createDataFrame([(1, t, c, None, k) for k, (t, c) in enumerate(rows)], SCHEMA)
    return [r["segment"] for r in features.assign_segments(df, stays).orderBy("row_id").collect()]


def test_gap_of_exactly_48_hours_stays(spark):
    a, b, c = hours(0, 48, 96.001)
    assert segments(spark, [(a, "D1"), (b, "D2"), (c, "D3")], False) == [0, 0, 1]


def test_stays_open_close_and_lone_discharge(spark):
    rows = list(zip(hours(0, 1, 100, 101, 102, 103), ["X", "ADM_ADMISSION", "Y", "ADM_DISCHARGE", "ADM_DISCHARGE", "Z"], strict=True))
    assert segments(spark, rows, True) == [0, 1, 1, 1, 2, 3]


def test_aggregation_fixture(spark):
    rows = [(1, hours(0)[0], "A", 10.0, 0), (1, hours(0)[0], "A", 20.0, 1), (1, hours(24)[0], "A", 30.0, 2), (2, hours(0)[0], "B", 40.0, 3), (2, hours(1 / 12)[0], "B", 50.0, 4), (2, dt.datetime(2024, 1, 1), "B", 60.0, 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert features.aggregate_events(df, "first").count() == 5
    assert features.aggregate_events(df, "first", window_hours=25).count() == 3


def test_labels_fixture(spark):
    index = spark.createDataFrame([(1, 100.0), (2, 200.0), (3, 300.0), (4, 400.0), (5, 500.0)], "subject_id long, abspos double")
    hits = spark.createDataFrame([(1, 90.0), (1, 110.0), (2, 200.0), (2, 1000.0), (4, 390.0), (4, 405.0)], "subject_id long, abspos double")
    found = {r["subject_id"]: r["outcome"] for r in outcomes.label_binary(index, hits, 0, 10).collect()}
    assert found == {1: 1, 2: 1, 3: 0, 4: 1, 5: 0}


def sequence(spark, codes, positions):
    events = [(c, float(p), k // 2, 1.0) for k, (c, p) in enumerate(zip(codes, positions, strict=True))]
    return spark.createDataFrame([(1, events)], "subject_id long, events array<struct<code:int,abspos:double,segment:int,age:double>>")


def codes(df):
    return [e["code"] for e in df.first()["events"]]


def test_censor_strips_one_separator_and_handles_nothing_left(spark):
    seqs = sequence(spark, [1, 5, 2, 6], [0, 1, 2, 9])
    assert codes(sequences.censor(seqs.withColumn("censor_date", F.lit(5.0)))) == [1, 5, 1]
    assert codes(sequences.censor(seqs.withColumn("censor_date", F.lit(-5.0)))) == [1]
    assert codes(sequences.censor_with_delays(seqs.withColumn("censor_date", F.lit(2.0)), {6: 7.0})) == [1, 5, 2, 6, 1]


def test_truncate_drops_a_separator_at_the_cut(spark):
    seqs = sequence(spark, [1, 12, 2, 7, 7, 2, 8, 8], range(8))
    assert codes(sequences.truncate(seqs, 6, 3)) == [1, 12, 2, 8, 8]
    assert codes(sequences.truncate(seqs, 5, 3)) == [1, 12, 2, 8, 8]
    assert codes(sequences.truncate(seqs, 3, 3)) == [1, 12, 2]
    assert codes(sequences.truncate_prioritized(seqs, 6, 3, [7])) == [1, 12, 2, 2, 8, 8]


def test_ranks_are_dense_and_repeatable(spark):
    ids = spark.range(1000).select(F.col("id").alias("subject_id"))
    a = splits.shuffled_rank(ids.repartition(7), 3).collect()
    b = splits.shuffled_rank(ids.repartition(2), 3).collect()
    assert sorted(r["rank"] for r in a) == list(range(1000)) and sorted(a) == sorted(b)
    folds = splits.create_folds(ids, 4).where("part = 'val'")
    assert folds.count() == folds.select("subject_id").distinct().count() == 1000


def test_single_class_area_is_zero(spark):
    df = spark.createDataFrame([(1, 0, 1, 0.2), (2, 0, 1, 0.4), (3, 1, 1, 0.5), (4, 1, 0, 0.5)], "subject_id long, fold int, target int, proba double")
    assert {r["fold"]: r["roc_auc"] for r in metrics.areas(df, ["fold"]).collect()} == {0: 0.0, 1: 0.5}


def test_filters_on_null(spark):
    df = spark.createDataFrame([(1, "A"), (2, None), (3, "B")], "subject_id long, kind string")
    assert filters.filter_by_rule(df, "kind", exclude=["A"]).count() == 2
    assert filters.exclude_codes_regex(df, "a|b", "kind").count() == 1


def test_to_meds_and_round_trips(spark, tmp_path):
    patients = spark.createDataFrame([("p1", T, None, "F"), ("p2", T, T, "M")], "PID string, BIRTHDATE timestamp_ntz, DEATHDATE timestamp_ntz, GENDER string")
    concepts = spark.createDataFrame([("p1", T, "D1", "1.239"), ("p2", T, "D2", None)], "PID string, TIMESTAMP timestamp_ntz, CONCEPT string, RESULT string")
    events = io.to_meds(patients, concepts, ["GENDER"])
    assert sorted(r["code"] for r in events.collect()) == ["D1", "D2", "DOB", "DOB", "DOD", "GENDER//F", "GENDER//M"]
    io.write_pids(events, str(tmp_path / "a"))
    assert io.read_pids(spark, str(tmp_path / "a"), str(tmp_path / "a")).count() == 2


def test_combinations_meet_at_both_ends_and_once(spark):
    rows = [(1, 0.0, 1), (1, 10.0, 2), (1, 10.1, 3), (2, 10.0, 4), (1, -3.0, 5), (1, None, 6)]
    at = spark.createDataFrame(rows, "subject_id long, abspos double, row_id long")
    primary = at.where("row_id = 1")
    assert outcomes.match_combinations(primary, at.where("row_id = 2"), 0, 10).count() == 1
    assert outcomes.match_combinations(primary, at.where("row_id in (3, 4, 5, 6)"), 0, 10).count() == 0
    assert outcomes.match_combinations(primary, at, -3, -3).count() == 1
    assert outcomes.match_combinations(at.where("abspos is not null"), at, float("-inf"), float("inf")).count() == 5
    assert [r["row_id"] for r in outcomes.closest_secondary(primary, at.where("row_id in (2, 3, 5)"), -20, 20).collect()] == [5]


def test_resample_follows_the_class_weights(spark):
    df = spark.range(400).select(F.col("id").alias("subject_id"), (F.col("id") % 40 == 0).cast("int").alias("target"))
    drawn = metrics.weighted_resample(df, metrics.class_weights(df, "inverse_sqrt"), 5000)
    rows = drawn.toPandas()
    share = 10**0.5 / (10**0.5 + 390**0.5)
    assert len(rows) == 5000 and abs(rows["target"].mean() - share) < 0.03
    assert ((rows["subject_id"] % 40 == 0).astype(int) == rows["target"]).all()
    assert rows[rows["target"] == 1]["subject_id"].nunique() == 10
    assert drawn.exceptAll(metrics.weighted_resample(df, metrics.class_weights(df, "inverse_sqrt"), 5000)).isEmpty()


def test_attrition_counts_every_step(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], "subject_id long, code string")
    kept, counts = filters.attrition(df, {"b": F.col("code") == "b", "one": F.col("subject_id") == 1})
    assert kept.count() == 1
    assert {r["stage"]: (r["rows"], r["subjects"]) for r in counts.collect()} == {"start": (3, 2), "b": (2, 2), "one": (1, 1)}


def test_pad_fills_every_field(spark):
    kind = "subject_id long, grp int, events array<struct<code:int,abspos:double,segment:int,age:double>>, target array<int>"
    df = spark.createDataFrame([(1, 0, [(5, 1.0, 1, 30.0)], [5]), (2, 0, [(6, 1.0, 1, 3.0), (7, 2.0, 2, 3.0)], [-100, 7])], kind)
    row = sequences.pad(df, "grp").where("subject_id = 1").first()
    assert (row["codes"], row["positions"], row["segments"], row["ages"]) == ([5, 0], [1.0, 0.0], [1, 0], [30.0, 0.0])
    assert (row["attention"], row["target"]) == ([1, 0], [5, -100])


@pytest.mark.parametrize("buckets", [1, 4, 256])
def test_ranked_scores_equal_plain_sums(spark, buckets):
    rng = random.Random(3)
    data = [(rng.choice([0, 1, None]), rng.randint(0, 1), rng.choice([0.0, 0.5, 1.0, round(rng.random(), 2)])) for _ in range(600)]
    rows = spark.createDataFrame(data, "fold int, target int, proba double")
    made = {(r["fold"], r["proba"]): r for r in metrics.ranked_scores(rows, ["fold"], buckets).collect()}
    assert set(made) == {(f, s) for f, _, s in data}
    for (fold, score), r in made.items():
        among = [(t, s) for f, t, s in data if f == fold]
        assert (r["tp"], r["fp"]) == tuple(sum(t == k and s >= score for t, s in among) for k in (1, 0))
        assert (r["positives"], r["negatives"]) == tuple(sum(t == k for t, _ in among) for k in (1, 0))
    assert metrics.ranked_scores(rows.limit(0), ["fold"], buckets).count() == 0
