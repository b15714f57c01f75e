"""Runs over splits, slices of time, rows before arrays, one-pass metrics, the stored baseline."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tempora.functions.scalars import alternation, match_contains, match_startswith
from tempora.operators import features, filters, metrics, outcomes, sequences, splits
from tempora.plans import pipelines
from tempora.plans.observed import StageCounts
from tempora.sources import io

T = dt.datetime(2021, 1, 1)
EVENTS = "subject_id long, time timestamp_ntz, code string, numeric_value double, row_id long"
TOKENS = "subject_id long, seq long, code int, abspos double, segment int, age double"


def random_events(seed, subjects=8, rows=60):
    rng, out = random.Random(seed), []
    for k in range(subjects * rows):
        hour = rng.choice([0, 1, 2, 30, 47.9, 48, 48.1]) + 24 * rng.randrange(0, 90)
        when = None if rng.random() < 0.03 else T + dt.timedelta(hours=hour)
        code = rng.choice(["D1", "M2", "ADM_ADMISSION", "ADM_DISCHARGE", "ADM_DISCHARGE//X", "DOD", None])
        out.append((rng.randrange(subjects), when, code, None, k))
    return out


@pytest.mark.parametrize("stays", [True, False, None])
@pytest.mark.parametrize("slice_hours", [5.0, 48.0, 10_000.0])
def test_slices_equal_windows(spark, stays, slice_hours):
    ev = spark.createDataFrame(random_events(int(slice_hours)), EVENTS)
    rule = stays if stays is not None else F.col("subject_id") % 2 == 0
    plain = features.order_features(features.assign_segments(ev, rule))
    sliced = features.assign_segments_sliced(ev, rule, slice_hours)
    key = lambda df: sorted((r["row_id"], r["segment"], r["seq"]) for r in df.collect())
    assert key(plain) == key(sliced)


def test_slices_spread_one_subject(spark):
    """Half a million events of one subject: no task of the scan's windows holds a tenth of them."""
    n = 500_000
    code = F.when(F.col("id") % 97 == 0, "ADM_ADMISSION").when(F.col("id") % 97 == 40, "ADM_DISCHARGE").otherwise("D1")
    time = F.expr("TIMESTAMP_NTZ '2021-01-01 00:00:00' + make_dt_interval(0, cast(id as int), 0, 0)")
    ev = spark.range(n).select(F.lit(1).cast("long").alias("subject_id"), time.alias("time"), code.alias("code"), F.lit(None).cast("double").alias("numeric_value"), F.col("id").alias("row_id"))
    made = features.assign_segments_sliced(ev, True, 24.0 * 365)
    held = made.withColumn("slice", F.floor(F.col("row_id") / (24 * 365))).groupBy("slice").count().agg(F.max("count"), F.count("*")).first()
    assert held[0] <= n / 10 and held[1] > 50
    plain = features.assign_segments(ev, True).agg(F.sum("segment"), F.max("segment")).first()
    assert tuple(made.agg(F.sum("segment"), F.max("segment")).first()) == tuple(plain)


def token_rows(seed, subjects=30):
    rng, out = random.Random(seed), []
    for s in range(subjects):
        for k in range(rng.choice([1, 3, 7, 8, 9, 40])):
            out.append((s, 10 + 2 * k, rng.choice([1, 2, 2, 7, 8]), float(k), k // 3, 30.0))
    return out


@pytest.mark.parametrize("max_len,background", [(8, 3), (5, 5), (9, 1), (1, 0), (1000, 3)])
def test_truncating_rows_equals_truncating_arrays(spark, max_len, background):
    toks = spark.createDataFrame(token_rows(max_len), TOKENS)
    plain = sequences.truncate(sequences.to_sequences(toks), max_len, background)
    made = sequences.to_truncated_sequences(toks, max_len, background)
    key = lambda df: sorted((r["subject_id"], [tuple(e) for e in r["events"]]) for r in df.collect())
    assert key(made) == key(plain)


def test_a_very_long_subject_is_not_gathered(spark):
    n = 1_000_000
    toks = spark.range(n).select(F.lit(1).cast("long").alias("subject_id"), F.col("id").alias("seq"), F.lit(7).alias("code"), F.col("id").cast("double").alias("abspos"), F.lit(0).alias("segment"), F.lit(1.0).alias("age"))
    made = sequences.to_truncated_sequences(toks, 64, 3)
    events = made.first()["events"]
    assert [e["abspos"] for e in events] == [0.0, 1.0, 2.0, *map(float, range(n - 61, n))]
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("Filter") < plan.index("Window")  # rows go before they are gathered


def test_splits_are_folders_with_parquet(spark, tmp_path):
    root = str(tmp_path / "meds")
    ev = spark.createDataFrame([(1, T, "A", 1.0, 0), (2, T, "B", None, 1)], EVENTS)
    for name in ("train", "tuning"):
        ev.write.parquet(f"{root}/{name}")
    (tmp_path / "meds" / "notes").mkdir()
    (tmp_path / "meds" / "notes" / "a.txt").write_text("x")
    (tmp_path / "meds" / "readme.md").write_text("x")
    assert io.split_names(spark, root) == ["train", "tuning"]
    assert io.split_names(spark, root, ["train", "held_out"]) == ["train"]
    with pytest.raises(ValueError, match="notes"):
        io.split_names(spark, root, ["notes"])
    only = io.read_splits(spark, root, pids=ev.where("subject_id = 2"), shard=True)
    assert sorted((r["split"], r["subject_id"]) for r in only.collect()) == [("train", 2), ("tuning", 2)]
    assert only.where(F.col("shard").contains("/train/")).count() == 1


def test_a_run_of_splits(spark, tmp_path):
    root, out = str(tmp_path / "meds"), str(tmp_path / "run")
    day = lambda k: T + dt.timedelta(days=k)
    rows = {"train": [(1, day(0), "DOB"), (1, None, "SEX//F"), (1, day(9), "A")], "tuning": [(2, day(0), "DOB"), (2, None, "SEX//M"), (2, day(5), "B"), (2, day(6), "A"), (2, day(7), "X9")]}
    for name, some in rows.items():
        spark.createDataFrame([(s, t, c, None) for s, t, c in some], "subject_id long, time timestamp_ntz, code string, numeric_value double").write.parquet(f"{root}/{name}")
    made = pipelines.create_data(spark, root, out, ["train", "tuning", "held_out"], exclude_regex="^X")
    known = {r["code"]: r["token_id"] for r in made["vocabulary"].collect()}
    assert set(known) == {"[PAD]", "[CLS]", "[SEP]", "[UNK]", "[MASK]", "A", "BG_SEX//F", "DOB"}
    tuning = [r["code"] for r in made["tokens"].where("split = 'tuning'").orderBy("seq").collect()]
    assert tuning == [1, known["DOB"], 3, 2, 3, known["A"]]  # the sex and B are unknown
    assert {(r["split"], r["subject_id"]) for r in made["pids"].collect()} == {("train", 1), ("tuning", 2)}
    assert {(r["stage"], r["split"]): r["rows"] for r in made["counts"].collect()} == {(s, p): n for s, t, u in [("loaded", 3, 5), ("aggregated", 3, 5), ("kept", 3, 4), ("aged", 3, 4)] for p, n in (("train", t), ("tuning", u))}
    info = {r["subject_id"]: r["background"] for r in made["patient_info"].collect()}
    assert info == {1: {"SEX": "F"}, 2: {"SEX": "M"}}
    frozen = pipelines.create_data(spark, root, str(tmp_path / "again"), vocabulary=spark.createDataFrame([("[UNK]", 3), ("B", 9)], "code string, token_id int"))
    assert {r["code"] for r in frozen["tokens"].collect()} == {3, 9}


def test_counts_come_from_one_run(spark, tmp_path):
    counts = StageCounts()
    df = counts.mark("b", counts.mark("a", spark.range(10)).where("id > 3"))
    df.write.parquet(str(tmp_path / "x"))
    assert [(r["stage"], r["rows"]) for r in counts.table(spark).collect()] == [("a", 10), ("b", 6)]


def test_background_of_any_names(spark):
    rows = [(1, T, "BG_SEX//F", None, 2), (1, T, "BG_SEX//M", None, 3), (1, T, "BG_X", None, 4), (1, T, "BG_//no", None, 5), (1, T, "DOB", None, 1), (2, T, "DOD", None, 6), (2, T, "D1", None, 7)]
    ev = spark.createDataFrame(rows, EVENTS)
    found = {r["subject_id"]: (r["birthdate"], r["deathdate"], r["background"]) for r in features.patient_info(ev).collect()}
    assert found == {1: (T, None, {"SEX": "F", "X": None}), 2: (None, T, {})}
    named = {r["subject_id"]: (r["SEX"], r["NONE"]) for r in features.patient_info(ev, ["SEX", "NONE"]).collect()}
    assert named == {1: ("F", None), 2: (None, None)}
    both = features.patient_info(ev)
    assert filters.filter_by_categories(both, {"SEX": {"include": ["F"]}}).count() == 1
    assert filters.filter_by_categories(both, {"SEX": {"exclude": ["F"]}}).count() == 1


def test_many_patterns_equal_a_chain(spark):
    rng = random.Random(5)
    letters = "AB/."
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    codes = [word(rng.randrange(0, 9)) for _ in range(400)] + [None]
    prefixes = [word(rng.randrange(1, 6)) for _ in range(60)] + [f"LONG{k}" for k in range(5000)]
    df = spark.createDataFrame([(k, c) for k, c in enumerate(codes)], "row_id long, code string")
    found = {r["row_id"] for r in df.where(match_startswith(F.col("code"), prefixes)).collect()}
    assert found == {k for k, c in enumerate(codes) if c is not None and c.startswith(tuple(prefixes))}
    plan = df.where(match_startswith(F.col("code"), prefixes))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("substring") < 20  # one look-up a length, not a term a pattern
    expressions = ["^A", "B/$", "\\."]
    many = expressions + [f"^NONE{k}$" for k in range(300)]
    plain = {r["row_id"] for r in df.where(match_contains(F.col("code"), expressions)).collect()}
    assert plain == {r["row_id"] for r in outcomes.match_codes(df, "code", many, "contains").collect()}
    assert alternation(["(a)\\1", "b"]) is None and alternation(["(?i)a"]) is None and alternation(["a", "a", "(?:b|c)"]) == "(?:a)|(?:(?:b|c))"


def test_all_metrics_from_one_aggregation(spark):
    rng = random.Random(2)
    rows = [(k, rng.randrange(3), rng.randint(0, 1), round(rng.random(), 2)) for k in range(500)]
    df = spark.createDataFrame(rows, "subject_id long, fold int, target int, proba double")
    chosen = {f"{name}_{t}": {"metric": name, "threshold": t} for name in metrics.SCORES for t in (0.3, 0.5)} | {name: {"metric": name} for name in ("roc_auc", "average_precision", *metrics.MEANS)}
    told = metrics.metric_table(df, chosen, ["fold"])
    made = {r["fold"]: r for r in told.collect()}
    for t in (0.3, 0.5):
        for r in metrics.scores(df, ["fold"], t).join(metrics.areas(df, ["fold"]), "fold").collect():
            for name in metrics.SCORES:
                assert made[r["fold"]][f"{name}_{t}"] == pytest.approx(r[name])
            for name in ("roc_auc", "average_precision", *metrics.MEANS):
                assert made[r["fold"]][name] == pytest.approx(r[name])
    plan = metrics.named_metrics(df, chosen)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange SinglePartition") < 10
    with pytest.raises(ValueError, match="unknown"):
        metrics.named_metrics(df, {"x": {"metric": "nothing"}})


def planted(spark, n=1500):
    """Sequences of which codes 7 and 9 make a positive label likelier, and age somewhat."""
    rng, rows = random.Random(11), []
    for s in range(n):
        codes = [c for c in range(5, 12) if rng.random() < 0.4]
        age = rng.uniform(20, 80)
        odds = -2.2 + 1.9 * (7 in codes) + 1.6 * (9 in codes) + 0.01 * age
        rows.append((s, int(rng.random() < 1 / (1 + 2.718281828 ** -odds)), [(1, 0.0, 0, age)] + [(c, float(k), 0, age) for k, c in enumerate(codes)]))
    vocabulary = [("[PAD]", 0), ("[CLS]", 1), ("[SEP]", 2), ("[UNK]", 3), ("[MASK]", 4), *[(f"C{c}", c) for c in range(5, 12)]]
    return spark.createDataFrame(rows, "subject_id long, outcome int, events array<struct<code:int,abspos:double,segment:int,age:double>>"), spark.createDataFrame(vocabulary, "code string, token_id int")


def test_stored_baseline(spark, tmp_path):
    seqs, vocabulary = planted(spark)
    folds = splits.create_folds(seqs.where("subject_id < 1200").select("subject_id"), 2)
    path = str(tmp_path / "baseline")
    told = pipelines.baseline_cv(seqs, folds, vocabulary, path, positive_weight=1.0, patience=8)
    auc = {r["fold"]: r["roc_auc"] for r in pipelines.evaluate(told).collect()}
    assert metrics.metric_gate(pipelines.evaluate(told), "roc_auc", 0.7, 0.9).isEmpty(), auc
    models, index = pipelines.read_baseline(spark, path)
    assert sorted(models) == [0, 1] and [1 <= m.getNumTrees < 200 for m in models.values()] == [True, True], [m.getNumTrees for m in models.values()]  # stopped early
    assert [r["code"] for r in index.orderBy("index").collect()] == [f"C{c}" for c in range(5, 12)] + ["age"]
    top = [r["code"] for r in pipelines.top_features(pipelines.feature_importance(models, index), 3).collect()]
    assert {"C7", "C9"} <= set(top)
    # other subjects, another vocabulary: other ids, one code more, one fewer
    held = seqs.where("subject_id >= 1200")
    told = pipelines.score_held_out(spark, path, held, vocabulary)
    moved = held.withColumn("events", F.transform("events", lambda e: e.withField("code", F.when(e["code"] > 4, 30 - e["code"]).otherwise(e["code"]))))
    other = vocabulary.withColumn("token_id", F.when(F.col("token_id") > 4, 30 - F.col("token_id")).otherwise(F.col("token_id"))).unionByName(spark.createDataFrame([("NEW", 77)], vocabulary.schema))
    again = pipelines.score_held_out(spark, path, moved, other)
    assert told.exceptAll(again).isEmpty() and told.count() == 600
    assert metrics.metric_gate(pipelines.evaluate(told), "roc_auc", 0.7, 0.95).isEmpty()
    fewer = pipelines.score_held_out(spark, path, held, vocabulary.where("code <> 'C7'"))
    assert fewer.count() == 600 and not fewer.exceptAll(told).isEmpty()


def test_positive_weight_raises_scores(spark):
    seqs, vocabulary = planted(spark, 300)
    folds = splits.create_folds(seqs.select("subject_id"), 1)
    mean = lambda weight: pipelines.baseline_cv(seqs, folds, vocabulary, positive_weight=weight, iterations=5).agg(F.avg("proba")).first()[0]
    assert mean(6.0) > mean(1.0) + 0.1


def test_a_cohort_is_counted_in_two_aggregations(spark):
    rows = [(s, dt.datetime(1950 + s, 1, 1), None, "F" if s % 3 else "M", s) for s in range(40)]
    pi = spark.createDataFrame(rows, "subject_id long, birthdate timestamp_ntz, deathdate timestamp_ntz, GENDER string, row_id long")
    ids = pi.select("subject_id")
    made = pipelines.build_cohort(pi, "absolute", date=F.lit("2020-01-01").cast("timestamp_ntz"), exclude=ids.where("subject_id < 4"), rules={"GENDER": {"include": ["F"]}}, ages=(40, None), test_share=0.5)
    assert {r["stage"]: r["rows"] for r in made["attrition"].collect()} == {"patients": 40, "excluded": 36, "categories": 24, "dated": 24, "age": 18, "living": 18}
    assert made["pids"].count() == 18 and made["test_pids"].count() == 12
    plan = made["attrition"].where("rows >= 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 2
