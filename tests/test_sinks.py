"""Readers, writers, checks that fail, and scratch tables."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tempora.operators import features, metrics, sequences, splits
from tempora.plans import pipelines
from tempora.sources import io, scratch

T = dt.datetime(2021, 1, 1)
EVENTS = "subject_id long, time timestamp_ntz, code string, numeric_value double, row_id long"


def events(spark, births=(1, 2)):
    rows = [(s, T + dt.timedelta(days=k), c, None, 10 * s + k) for s in (1, 2) for k, c in enumerate(["D_A", "D_B", "D_A"])]
    rows += [(s, dt.datetime(1980, 1, 1), "DOB", None, -s) for s in births]
    return spark.createDataFrame(rows, EVENTS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def fails(action, words):
    with pytest.raises(Exception, match=words):
        action()


def test_splits_are_found_or_listed(spark, tmp_path):
    root = str(tmp_path)
    for name in ("train", "tuning"):
        events(spark).write.parquet(f"{root}/{name}")
    os.makedirs(f"{root}/.hidden")
    (tmp_path / "_SUCCESS").write_text("")
    found = io.read_splits(spark, root)
    assert {r["split"] for r in found.select("split").distinct().collect()} == {"train", "tuning"} and found.count() == 16
    assert io.read_splits(spark, root, ["train", "held_out"]).count() == 8
    fails(lambda: io.read_splits(spark, root, ["train", "other"]), "no split 'other'")
    events(spark).write.csv(f"{root}/plain", header=True)
    assert rows_of(io.read_meds(spark, f"{root}/plain", "csv").select("subject_id", "code", "row_id")) == rows_of(events(spark).select("subject_id", "code", "row_id"))


def test_clinical_folder(spark, tmp_path):
    people = spark.createDataFrame([("a", T, None, "F")], "PID string, BIRTHDATE timestamp_ntz, DEATHDATE timestamp_ntz, GENDER string")
    one = spark.createDataFrame([("a", T, "D1"), ("a", T, "D1")], "PID string, TIMESTAMP timestamp_ntz, CONCEPT string")
    two = spark.createDataFrame([("a", T, "L1", "0.5")], "PID string, TIMESTAMP timestamp_ntz, CONCEPT string, RESULT string")
    people.write.parquet(f"{tmp_path}/patients_info.parquet")
    one.write.csv(f"{tmp_path}/concept.diagnose.csv", header=True)
    two.write.parquet(f"{tmp_path}/concept.lab.parquet")
    fails(lambda: io.read_clinical(spark, f"{tmp_path}/concept.lab.parquet"), "lacks")
    patients, concepts = io.read_clinical(spark, str(tmp_path))
    assert concepts.count() == 2
    assert rows_of(io.to_meds(patients, concepts, ["GENDER"]).select("code", "numeric_value")) == [("D1", None), ("DOB", None), ("GENDER//F", None), ("L1", 0.5)]


def test_feature_patient_vocabulary_and_mapping_tables(spark, tmp_path):
    feats = pipelines.build_features(events(spark), stays=False).withColumn("split", F.lit("train"))
    io.write_features(feats, f"{tmp_path}/features")
    back = spark.read.parquet(f"{tmp_path}/features")
    assert [f.dataType.simpleString() for f in back.schema][:6] == ["bigint", "double", "double", "int", "string", "bigint"] and back.count() == 8
    fails(lambda: io.write_features(feats.drop("age"), f"{tmp_path}/x"), "lacks the columns")
    info = features.patient_info(features.promote_background(features.attach_birthdate(events(spark))), ["GENDER"])
    io.write_patient_info(info, f"{tmp_path}/info")
    assert spark.read.parquet(f"{tmp_path}/info").count() == 2
    _, vocabulary = pipelines.tokenize_features(feats)
    io.write_vocabulary(vocabulary, f"{tmp_path}/vocabulary")
    assert rows_of(io.read_vocabulary(spark, f"{tmp_path}/vocabulary")) == rows_of(vocabulary)
    spark.createDataFrame([("D_A", "D_C")], "code string, new_code string").write.parquet(f"{tmp_path}/mapping")
    assert io.read_code_mapping(spark, None) is None
    mapped, codes = pipelines.tokenize_features(feats, mapping=io.read_code_mapping(spark, f"{tmp_path}/mapping"))
    assert {"D_B", "D_C"} <= {r["code"] for r in codes.collect()} and codes.where("code = 'D_A'").count() == 0


def test_outcome_tables_warn_of_empty_ones(spark, tmp_path):
    table = spark.createDataFrame([(1, T, 5, "a")], "subject_id long, time timestamp_ntz, abspos long, outcome string")
    with pytest.warns(UserWarning, match="'b' has no rows"):
        io.write_outcomes(table, f"{tmp_path}/o", ["a", "b"])
    assert spark.read.parquet(f"{tmp_path}/o").count() == 1


def test_cohort_sequences_and_evaluation_round_trip(spark, tmp_path):
    pi = spark.createDataFrame([(k, dt.datetime(1980, 1, 1), None) for k in [*range(20), 3]], "subject_id long, birthdate timestamp_ntz, deathdate timestamp_ntz")
    made = pipelines.build_cohort(pi, "absolute", date=F.lit(T), test_share=0.25, test_shift_hours=24, folds=2)
    io.write_cohort(made, f"{tmp_path}/cohort")
    back = io.read_cohort(spark, f"{tmp_path}/cohort")
    assert set(back) == {"pids", "index_dates", "test_pids", "folds"}
    test = {r["subject_id"] for r in back["test_pids"].collect()}
    assert len(test) == 5 and back["pids"].count() == 20
    assert {(r["subject_id"] in test, r["time"]) for r in back["index_dates"].collect()} == {(True, T + dt.timedelta(hours=24)), (False, T)}
    assert splits.overlap(back["folds"], back["test_pids"]).count() == 0 and back["folds"].count() == 30
    none = pipelines.build_cohort(pi, "absolute", date=F.lit(T))
    io.write_cohort(none, f"{tmp_path}/none")
    assert "test_pids" not in io.read_cohort(spark, f"{tmp_path}/none")
    fails(lambda: pipelines.build_cohort(pi, "relative"), "absolute, with a date")

    toks, vocabulary = pipelines.tokenize_features(pipelines.build_features(events(spark), stays=False))
    seqs = pipelines.prepare_pretrain(toks, 5, 1, cohort=pi.where("subject_id = 1"))
    io.write_sequences(seqs, f"{tmp_path}/seqs", vocabulary)
    assert rows_of(spark.read.parquet(f"{tmp_path}/seqs/sequences")) == rows_of(seqs) and seqs.count() == 1
    train, val = pipelines.pretrain_parts(pipelines.prepare_pretrain(toks, 9, 1), 0.5)
    assert (train.count(), val.count()) == (1, 1)
    fails(lambda: splits.apply_predefined_split(seqs, None), "stored folds")

    p = spark.createDataFrame([(k, f, k % 2, (k * 7 % 10 + f) / 12) for k in range(100, 120) for f in (0, 1)], "subject_id long, fold int, target int, proba double")
    tables = pipelines.evaluate_models(p, made["folds"])
    io.write_evaluation(tables, f"{tmp_path}/out")
    told = spark.read.csv(f"{tmp_path}/out/metrics", header=True, inferSchema=True)
    assert told.count() == 3 and set(told.columns) == {"fold", "roc_auc", "average_precision", "accuracy"}
    assert spark.read.csv(f"{tmp_path}/out/predictions", header=True).columns == ["subject_id", "target", "fold_0", "fold_1"]
    fails(lambda: pipelines.evaluate_models(p.withColumn("subject_id", F.col("subject_id") - 100), made["folds"]), "are in the folds")
    fails(lambda: metrics.metric("nothing"), "unknown metric")
    assert metrics.metric("recall", threshold=2.0)(p, ["fold"]).where("value <> 0").count() == 0


def test_errors_of_the_event_model(spark):
    fails(lambda: pipelines.build_features(events(spark, births=(1,)), stays=False).collect(), "no birth date: subject 2")
    assert pipelines.build_features(events(spark, births=(1,)), stays=False, birth_required=False).count() > 0
    one = spark.createDataFrame([(1, 1), (2, 1)], "subject_id long, target int")
    fails(lambda: metrics.weights_inverse_sqrt(one).collect(), "two classes")
    fails(lambda: metrics.weights_effective_n(one).collect(), "two classes")
    fails(lambda: metrics.pos_weights(one).collect(), "both classes")
    toks, _ = pipelines.tokenize_features(pipelines.build_features(events(spark), stays=False))
    index = spark.createDataFrame([(1, T + dt.timedelta(days=1)), (2, None)], "subject_id long, time timestamp_ntz")
    bought = spark.createDataFrame([(1, 0)], "subject_id long, abspos long")
    fails(lambda: pipelines.prepare_finetune(toks, index, bought, 9, 1, 0, None).collect(), "no index date: subject 2")
    assert pipelines.prepare_finetune(toks, index.where("time is not null"), bought, 9, 1, 0, None).count() == 1
    fails(lambda: pipelines.prepare_finetune(toks, index.where("subject_id = 1"), bought, 9, 1, 0, None, cohort=index).collect(), "no index date: subject 2")
    mixed = toks.withColumn("abspos", -F.col("abspos"))
    fails(lambda: pipelines.prepare_pretrain(mixed, 9, 1).collect(), "positions not in order")


def test_incomplete_units_equal_a_count(spark):
    import random

    rng = random.Random(3)
    seqs = [(k, [(rng.choice([5, 6, 7]), float(rng.randrange(6)), 0, 0.0) for _ in range(rng.randint(0, 20))]) for k in range(30)]
    df = spark.createDataFrame(seqs, "subject_id long, events array<struct<code:int,abspos:double,segment:int,age:double>>")
    for parts in (1, 2, 3):
        for r in sequences.drop_incomplete_units(df, [6, 7], parts).collect():
            own = seqs[r["subject_id"]][1]
            low = [e[1] for e in own if e[0] in (6, 7)]
            assert [tuple(e) for e in r["events"]] == [e for e in own if e[0] == 5 or low.count(e[1]) == parts]


def test_scratch_tables_go_at_the_end(spark):
    with scratch.scratch(spark) as kept:
        a, b = scratch.materialize(spark.range(5), "a"), scratch.bucketed(spark.range(7), "id", "b")
        kept.append(b)
        assert a.count() == 5
    assert b.count() == 7
    assert not os.path.exists(a._scratch_path.removeprefix("file:").replace("//", "/", 1)) and os.path.exists(b._scratch_path.removeprefix("file:").replace("//", "/", 1))
    grouped = b.groupBy("id").count()
    assert "Exchange" not in grouped._jdf.queryExecution().executedPlan().toString()
    scratch.discard(b)
