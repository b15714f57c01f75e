"""Pipelines that compose the operators, in the order that their results depend on."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import abspos, shift_hours
from ..operators import features, filters, metrics, outcomes, sequences, splits, tokens
from ..schema import BACKGROUND_PREFIX, SPECIAL_TOKENS
from ..sources import io
from ..sources.scratch import bucketed, materialize
from .observed import StageCounts

ID = "subject_id"
BROADCAST_CODES = 1_000_000


def build_features(
    ev: DataFrame,
    exclude_regex: str | None = None,
    aggregate: dict | None = None,
    values: dict | None = None,
    stays: bool | None = None,
    gap_hours: float = features.GAP_HOURS,
    ages: tuple[float, float] = (-1, 120),
    birth_required: bool = True,
    shard: str | None = None,
    slice_hours: float | None = None,
    counts: StageCounts | None = None,
) -> DataFrame:
    """Clean events to ``(subject_id, age, abspos, segment, code, seq, time)`` and, where the events
    have them, ``split`` and ``shard``.

    ``stays`` is found in the data unless given: for each value of the column ``shard``, or for the
    whole table.  All windows share one partitioning by subject; with ``slice_hours`` a subject is
    spread over slices of time instead, for data in which one has very many events.  ``counts`` tells
    the rows of every stage.  A subject without a birth is an error unless that is allowed.
    """
    seen = (lambda name, df: df) if counts is None else counts.mark
    ev = seen("loaded", ev)
    if aggregate:
        ev = features.aggregate_events(ev, **aggregate)
    ev = seen("aggregated", ev)
    if exclude_regex:
        ev = filters.exclude_codes_regex(ev, exclude_regex)
    ev = seen("kept", ev)
    order = ("row_id",)
    if values is not None:
        ev, order = features.append_value_rows(ev, **values), ("row_id", "order")
    else:
        ev = ev.drop("numeric_value")
    done = filters.drop_null_events(features.featurise(ev, birth_required, slice_hours is None))
    rule: bool | Column = stays
    if stays is None:
        timed = features.prefix_admissions(ev.where(F.col("time").isNotNull() & F.col(ID).isNotNull()))
        modes = features.stay_modes(timed, shard).withColumnRenamed("stays", "_stays")
        done = done.join(modes, shard, "left") if shard else done.crossJoin(F.broadcast(modes))  # one row
        rule = F.col("_stays")
    if slice_hours is None:
        done = features.order_features(features.assign_segments(done, rule, gap_hours, order), order)
    else:
        done = features.assign_segments_sliced(materialize(done, "events"), rule, slice_hours, gap_hours, order)
    done = seen("aged", filters.filter_event_age(done, *ages))
    return done.select(ID, "age", "abspos", "segment", "code", "seq", "time", *[c for c in features.PER_SUBJECT if c in done.columns])


def segment_summary(feats: DataFrame) -> DataFrame:
    """Per subject: segments, events, admissions, hours of the longest segment, last age."""
    part = feats.groupBy(ID, "segment").agg(F.count("*").alias("n"), F.count_if(F.col("code") == "ADM_ADMISSION").alias("a"), (F.max("abspos") - F.min("abspos")).alias("hours"), F.max(F.struct("seq", "age")).alias("last"))
    return part.groupBy(ID).agg(F.count("*").alias("segments"), F.sum("n").alias("events"), F.sum("a").alias("admissions"), F.round(F.max("hours"), 6).alias("longest_hours"), F.max("last")["age"].alias("last_age"))


def settled(feats: DataFrame) -> DataFrame:
    """Features written once in buckets of subjects: the vocabulary and the tokens both read them,
    and what is done by subject after that needs no shuffle."""
    return feats if hasattr(feats, "_scratch_path") else bucketed(feats, ID, "features", "seq")


def tokenize_features(feats: DataFrame, limits: dict[str, int] | None = None, vocabulary: DataFrame | None = None, mapping: DataFrame | None = None, train: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(tokens, vocabulary)``; a given vocabulary is frozen.

    With ``train`` the vocabulary is built from the rows of that split alone and frozen for the
    others, whose further codes become [UNK]; the tokens keep their ``split``.
    """
    if mapping is not None:
        feats = tokens.map_codes(feats, mapping)
    if limits:
        feats = tokens.cut_codes(feats, limits)
    feats = settled(feats)
    if vocabulary is None:
        vocabulary = materialize(tokens.build_vocabulary(feats if train is None else feats.where(F.col("split") == train)), "vocabulary")
    codes = F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_CODES else vocabulary
    return tokens.tokenize(tokens.add_special_tokens(feats), codes), vocabulary


def create_data(spark: SparkSession, root: str, out: str, splits: list[str] | None = None, train: str = "train", limits: dict[str, int] | None = None, mapping: DataFrame | None = None, vocabulary: DataFrame | None = None, background: list[str] | None = None, adapt: Callable[[DataFrame], DataFrame] | None = None, **options) -> dict[str, DataFrame]:
    """From the events of all splits under ``root`` to the tables of a run under ``out``: features and
    tokens by split, ids by split, the patients, the vocabulary, and the rows of every stage by split.

    Every split goes through in the same plans; features are read once for their counts, their
    patients and themselves.  ``options`` are those of ``build_features``; ``adapt`` may change the
    events as they are read.  The tables are read back.
    """
    events = io.read_splits(spark, root, splits)
    events = events if adapt is None else adapt(events)
    names = io.split_names(spark, root, splits)
    counts = StageCounts(names)
    io.write_features(build_features(events, counts=counts, **options), f"{out}/features")
    info = features.patient_info(features.promote_background(features.attach_birthdate(events)), background)
    io.write_patient_info(info, f"{out}/patient_info")
    told, known = tokenize_features(spark.read.parquet(f"{out}/features"), limits, vocabulary, mapping, train)
    io.write_tokens(told, f"{out}/tokens")
    io.write_vocabulary(known, f"{out}/vocabulary")
    return {"features": spark.read.parquet(f"{out}/features"), "tokens": spark.read.parquet(f"{out}/tokens"), "pids": io.read_split_pids(spark, f"{out}/tokens"), "patient_info": spark.read.parquet(f"{out}/patient_info"), "vocabulary": io.read_vocabulary(spark, f"{out}/vocabulary"), "counts": counts.table(spark)}


def select_cohort(pi: DataFrame, index: DataFrame, prior: DataFrame | None = None, rules: dict | None = None, ages: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Patients with an index date that pass all rules."""
    pi = filters.filter_by_categories(pi, rules or {}).join(index.select(ID, "time"), ID)
    pi = filters.filter_by_death(filters.filter_by_age(pi, *ages))
    return pi if prior is None else filters.filter_by_prior_outcomes(pi, prior)


def index_dates(pids: DataFrame, mode: str, date: Column | None = None, exposures: DataFrame | None = None, exposure_hours: float = 0, seed: int = 42) -> DataFrame:
    """``(subject_id, time)``: one date for all, or hours from a subject's first exposure, where
    the unexposed draw the date of an exposed one."""
    if mode == "absolute" and date is not None:
        return splits.index_dates_absolute(pids, date)
    if mode == "relative" and exposures is not None:
        exposed = splits.index_dates_exposed(filters.filter_by_pids(exposures, pids), exposure_hours)
        return exposed.unionByName(splits.index_dates_unexposed(pids, exposed, seed))
    raise ValueError("index dates are absolute, with a date, or relative, with exposures")


def build_cohort(
    pi: DataFrame,
    mode: str,
    date: Column | None = None,
    exposures: DataFrame | None = None,
    exposure_hours: float = 0,
    initial: DataFrame | None = None,
    exclude: DataFrame | None = None,
    exposed_only: bool = False,
    rules: dict | None = None,
    ages: tuple[float | None, float | None] = (None, None),
    prior: DataFrame | None = None,
    test_share: float = 0.0,
    test_shift_hours: float = 0,
    folds: int = 1,
    val_share: float = 0.1,
    seed: int = 42,
) -> dict[str, DataFrame]:
    """``pids``, ``index_dates``, ``test_pids``, ``folds`` and ``attrition`` of a cohort.

    Of repeated patients the first row counts, by ``row_id`` where there is one.  Index dates are
    given and test subjects drawn after the rules on patients; test subjects' absolute dates may be
    shifted.  Rules that need the index date come last, so test subjects and folds hold subjects
    which these rules drop, as index dates do.
    """
    order = "row_id" if "row_id" in pi.columns else ID
    marked, steps = filters.dedupe_patients(pi, order), {}
    if initial is not None:
        marked, steps["initial"] = filters.with_mark(marked, initial, "_initial"), F.col("_initial")
    if exclude is not None:
        marked, steps["excluded"] = filters.with_mark(marked, exclude, "_excluded"), ~F.col("_excluded")
    if exposed_only:
        marked, steps["exposed"] = filters.with_mark(marked, exposures, "_exposed"), F.col("_exposed")
    if rules:
        steps["categories"] = filters.categories_hold(marked, rules)
    marked = materialize(marked, "patients")
    chosen, before = filters.attrition(marked, steps, "patients")
    chosen = chosen.select(*pi.columns)
    parts = materialize(splits.split_share(chosen, test_share, seed), "parts")
    test = parts.where("part = 'test'").select(ID)
    dates = index_dates(chosen.select(ID), mode, date, exposures, exposure_hours, seed)
    if mode == "absolute" and test_shift_hours:
        shifted = F.when(F.col("part") == "test", shift_hours(F.col("time"), test_shift_hours)).otherwise(F.col("time"))
        dates = dates.join(parts, ID).select(ID, shifted.alias("time"))
    dates = materialize(dates, "index_dates")
    dated, steps = chosen.join(dates, ID), {}
    if ages != (None, None):
        steps["age"] = filters.age_holds(*ages)
    steps["living"] = filters.is_alive()
    if prior is not None:
        dated, steps["no_prior"] = filters.with_first_outcome(dated, prior), filters.no_prior_outcome()
    kept, behind = filters.attrition(materialize(dated, "dated"), steps, "dated")
    made = splits.create_folds(parts.where("part = 'train_val'").select(ID), folds, seed, val_share)
    return {"pids": kept.select(ID), "index_dates": dates, "test_pids": test, "folds": made, "attrition": before.unionByName(behind)}


def find_background(toks: DataFrame, vocabulary: DataFrame) -> int:
    """How many tokens at the beginning are background, with the leading one and the separator."""
    return sequences.background_rows(toks, tokens_with_prefix(vocabulary, [BACKGROUND_PREFIX]))


def prepare_pretrain(toks: DataFrame, max_len: int, background: int | None = None, cutoff_hours: float | None = None, min_len: int = 0, cohort: DataFrame | None = None, vocabulary: DataFrame | None = None) -> DataFrame:
    """Truncated sequences of the cohort, or of all; positions out of order are an error.

    Rows are truncated before a subject's are gathered, so no array is longer than ``max_len``.
    Without ``background`` its length is found in the tokens, by the ``vocabulary``.
    """
    if cohort is not None:
        toks = filters.filter_by_pids(toks, cohort)
    if cutoff_hours is not None:
        toks = filters.cutoff(toks, cutoff_hours)
    background = find_background(toks, vocabulary) if background is None else background
    seqs = sequences.require_sorted(sequences.to_truncated_sequences(toks, max_len, background))
    return sequences.normalize_segments(filters.exclude_short_sequences(seqs, min_len + background))


def pretrain_parts(seqs: DataFrame, val_share: float = 0.2, folds: DataFrame | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and validation sequences: by stored folds, else by a shuffled share."""
    if folds is None:
        folds = splits.split_train_val(seqs, val_share, seed).withColumn("fold", F.lit(0))
    return splits.apply_predefined_split(seqs, folds)


def censor_dates(index: DataFrame, events: DataFrame, start: float, end: float | None, censor_hours: float = 0) -> DataFrame:
    """``(subject_id, censor_date, outcome)`` of the subjects with an index date."""
    dates = index.select(ID, abspos(F.col("time")).alias("abspos"))
    labels = outcomes.label_binary(dates, events, start, end)
    return dates.select(ID, (F.col("abspos") + censor_hours).alias("censor_date")).join(labels, ID)


def prepare_finetune(
    toks: DataFrame,
    index: DataFrame,
    events: DataFrame,
    max_len: int,
    background: int | None,
    start: float,
    end: float | None,
    censor_hours: float = 0,
    min_len: int = 1,
    cohort: DataFrame | None = None,
    cutoff_hours: float | None = None,
    delays: dict[int, float] | None = None,
    non_priority: list[int] | None = None,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """Censored, labelled and truncated sequences of the cohort, or of the subjects with an index
    date.

    ``delays`` are hours by token id for which censoring waits; ``non_priority`` are the token ids
    that go first where a sequence is too long.  Without ``background`` its length is found in the
    tokens, by the ``vocabulary``.  A subject of the cohort without an index date and positions out
    of order are errors.  After the one grouping by subject the sequence stage
    consists of array expressions.
    """
    per_subject = censor_dates(index, events, start, end, censor_hours)
    return _finetuned(toks, per_subject, index if cohort is None else cohort, max_len, background, min_len, cutoff_hours, delays, non_priority, vocabulary)


def _finetuned(toks: DataFrame, per_subject: DataFrame, cohort: DataFrame, max_len: int, background: int | None, min_len: int, cutoff_hours: float | None, delays: dict[int, float] | None, non_priority: list[int] | None, vocabulary: DataFrame | None) -> DataFrame:
    toks = filters.filter_by_pids(toks, cohort)
    if cutoff_hours is not None:
        toks = filters.cutoff(toks, cutoff_hours)
    background = find_background(toks, vocabulary) if background is None else background
    seqs = sequences.require_sorted(sequences.to_sequences(toks)).join(per_subject, ID, "left")
    missing = F.raise_error(F.concat(F.lit("no index date: subject "), F.col(ID).cast("string"))).cast("double")
    seqs = seqs.withColumn("censor_date", F.when(F.col("censor_date").isNull(), missing).otherwise(F.col("censor_date")))
    seqs = sequences.censor(seqs) if delays is None else sequences.censor_with_delays(seqs, delays)
    seqs = filters.exclude_short_sequences(seqs, min_len + background)
    cut = sequences.truncate(seqs, max_len, background) if non_priority is None else sequences.truncate_prioritized(seqs, max_len, background, non_priority)
    return sequences.normalize_segments(cut)


def prepare_test(
    toks_by_split: dict[str, DataFrame],
    index: DataFrame,
    events: DataFrame,
    max_len: int,
    background: int | None,
    start: float,
    end: float | None,
    censor_hours: float = 0,
    min_len: int = 1,
    cohort: DataFrame | None = None,
    cutoff_hours: float | None = None,
    delays: dict[int, float] | None = None,
    non_priority: list[int] | None = None,
    vocabulary: DataFrame | None = None,
) -> DataFrame:
    """``prepare_finetune`` of every split's tokens, all in one set; dates and labels are derived
    once for all splits."""
    per_subject = materialize(censor_dates(index, events, start, end, censor_hours), "dates")
    cohort = per_subject if cohort is None else cohort
    return sequences.combine(*[_finetuned(toks, per_subject, cohort, max_len, background, min_len, cutoff_hours, delays, non_priority, vocabulary) for toks in toks_by_split.values()])


AGE = "age"


def feature_index(vocabulary: DataFrame) -> DataFrame:
    """``(code, index)``: the ordinary codes, densely from 0 in the order of their ids, then the age.

    Numbered in one task, as the vocabulary is."""
    codes = vocabulary.where(F.col("token_id") >= len(SPECIAL_TOKENS)).select("code", "token_id")
    last = codes.sparkSession.createDataFrame([(AGE, (1 << 31) - 1)], "code string, token_id int")
    return codes.unionByName(last).select("code", (F.row_number().over(Window.orderBy("token_id")) - 1).alias("index"))


def baseline_features(seqs: DataFrame, vocabulary: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """``(subject_id[, target], features)``: one-hot ordinary tokens at the places of the feature
    index, by default that of the vocabulary, then the last age.

    A stored index reads sequences of another vocabulary by the codes: those that it lacks count for
    nothing, those that only it has are absent.
    """
    from pyspark.ml.feature import CountVectorizerModel, VectorAssembler

    index = feature_index(vocabulary) if index is None else index
    known = index.where(F.col("code") != AGE).join(vocabulary.select("code", "token_id"), "code", "left").orderBy("index")
    names = [str(r["token_id"]) if r["token_id"] is not None else f"absent {r['index']}" for r in known.collect()]  # a vocabulary, as the model holds
    words = F.transform(F.array_distinct(F.transform("events", lambda e: e["code"])), lambda c: c.cast("string"))
    age = F.coalesce(F.try_element_at("events", F.lit(-1))["age"], F.lit(0.0))
    target = [F.col("outcome").alias("target")] if "outcome" in seqs.columns else []
    data = seqs.select(ID, *target, words.alias("words"), age.alias("age"))
    data = CountVectorizerModel.from_vocabulary(names or ["none"], inputCol="words", outputCol="tokens").setBinary(True).transform(data)
    return VectorAssembler(inputCols=["tokens", "age"], outputCol="features").transform(data).drop("words", "tokens", "age")


def fold_numbers(folds: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in folds.select("fold").distinct().collect())  # one row per fold


def _fit_watched(booster, train: DataFrame, watched: DataFrame, iterations: int, patience: int):
    """The booster fitted for the number of trees of least loss on ``watched``: trees are added until
    none of the last ``patience`` has lowered it, or to ``iterations``.

    A longer fit begins with the same trees as a shorter one, so it is made as long as is needed by
    doubling, and cut by a last fit."""
    rounds = min(2 * patience, iterations)
    while True:
        model = booster.setMaxIter(rounds).fit(train)
        losses = model.evaluateEachIteration(watched)
        best = 1 + min(range(rounds), key=losses.__getitem__)
        if rounds == iterations or rounds - best >= patience:
            return model if best == rounds else booster.setMaxIter(best).fit(train)
        rounds = min(2 * rounds, iterations)


def baseline_models(features: DataFrame, folds: DataFrame, iterations: int = 1000, patience: int = 50, positive_weight: float = 1.0, depth: int = 4, rate: float = 0.1, rows_share: float = 0.8, columns_share: float = 0.8, least_rows: int = 3, bins: int = 256, seed: int = 42, parallelism: int = 4) -> dict[int, object]:
    """Boosted trees of every fold, fitted on its training part: as many, of ``iterations`` at most,
    as lower the loss of its validation part, up to ``patience`` trees without a gain.

    Positive subjects weigh ``positive_weight``.  A fold without a validation part is fitted for all
    iterations.  Up to ``parallelism`` folds are fitted at a time, as a tree is a row of small jobs.
    """
    from pyspark import inheritable_thread_target
    from pyspark.ml.classification import GBTClassifier

    data = features.withColumn("weight", F.when(F.col("target") == 1, float(positive_weight)).otherwise(1.0))
    part = lambda fold, name: materialize(data.join(folds.where((F.col("fold") == fold) & (F.col("part") == name)).select(ID), ID, "left_semi"), name)
    parts = {fold: (part(fold, "train"), part(fold, "val")) for fold in fold_numbers(folds)}

    def fit(fold: int):
        train, watched = parts[fold]
        booster = GBTClassifier(labelCol="target", weightCol="weight", maxIter=iterations, stepSize=rate, maxDepth=depth, subsamplingRate=rows_share, featureSubsetStrategy=str(columns_share), minInstancesPerNode=least_rows, maxBins=bins, seed=seed)
        return booster.fit(train) if watched.isEmpty() else _fit_watched(booster, train, watched, iterations, patience)

    if not parts:
        return {}
    with ThreadPool(min(parallelism, len(parts))) as pool:
        return dict(zip(parts, pool.map(inheritable_thread_target(data.sparkSession)(fit), parts), strict=True))


def write_baseline(models: dict[int, object], index: DataFrame, path: str) -> None:
    """Every fold's model, and the feature index that they share."""
    index.write.mode("overwrite").parquet(f"{path}/encoding")
    for fold, model in models.items():
        model.write().overwrite().save(f"{path}/models/{fold}")


def read_baseline(spark: SparkSession, path: str) -> tuple[dict[int, object], DataFrame]:
    from pyspark.ml.classification import GBTClassificationModel

    names = sorted(map(int, io.entries(spark, f"{path}/models")))
    return {fold: GBTClassificationModel.load(f"{path}/models/{fold}") for fold in names}, spark.read.parquet(f"{path}/encoding")


def baseline_predict(models: dict[int, object], features: DataFrame, folds: DataFrame | None = None, part: str = "val") -> DataFrame:
    """``(subject_id, fold[, target], proba)``: the subjects of a part of each fold by its own model,
    or, without folds, all subjects by every model."""
    from pyspark.ml.functions import vector_to_array

    parts = []
    for fold, model in models.items():
        data = features if folds is None else features.join(folds.where((F.col("fold") == fold) & (F.col("part") == part)).select(ID), ID, "left_semi")
        target = [c for c in ("target",) if c in features.columns]
        parts.append(model.transform(data).select(ID, F.lit(fold).alias("fold"), *target, vector_to_array("probability")[1].alias("proba")))
    return reduce(DataFrame.unionByName, parts)


def score_held_out(spark: SparkSession, path: str, seqs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(subject_id, fold[, target], proba)`` of all subjects by every stored model, through the
    stored feature index, whatever ids the codes have here."""
    models, index = read_baseline(spark, path)
    return baseline_predict(models, baseline_features(seqs, vocabulary, index))


def feature_importance(models: dict[int, object], index: DataFrame) -> DataFrame:
    """``(fold, code, importance)`` of every feature that a model uses; the age is ``age``."""
    used = [(fold, int(i), float(v)) for fold, m in models.items() for i, v in zip(m.featureImportances.indices, m.featureImportances.values, strict=True)]
    rows = index.sparkSession.createDataFrame(used, "fold int, index int, importance double")
    return rows.join(index, "index", "left").select("fold", "code", "importance")


def top_features(importance: DataFrame, k: int) -> DataFrame:
    """The ``k`` codes of greatest mean importance over the folds."""
    folds = importance.select("fold").distinct().count()
    return importance.groupBy("code").agg((F.sum("importance") / F.lit(folds)).alias("importance")).orderBy(F.desc("importance"), "code").limit(k)


def baseline_cv(seqs: DataFrame, folds: DataFrame, vocabulary: DataFrame, path: str | None = None, **options) -> DataFrame:
    """``(subject_id, fold, target, proba)`` of the validation subjects: boosted trees on one-hot
    tokens and last age.  Models and feature index are stored under ``path``, if given."""
    index = materialize(feature_index(vocabulary), "encoding")
    features = materialize(baseline_features(seqs, vocabulary, index), "one_hot")  # read by every fold and tree
    models = baseline_models(features, folds, **options)
    if path is not None:
        write_baseline(models, index, path)
    return baseline_predict(models, features, folds)


def evaluate(predictions: DataFrame) -> DataFrame:
    """All metrics per fold, from one aggregation."""
    names = [*metrics.SCORES, *metrics.MEANS, "roc_auc", "average_precision"]
    return metrics.metric_table(predictions, {name: {"metric": name} for name in names}, ["fold"])


def evaluate_models(predictions: DataFrame, folds: DataFrame, chosen: dict[str, dict] | None = None) -> dict[str, DataFrame]:
    """``predictions``, ``metrics``, ``summary`` and ``curves`` of test subjects scored by every
    fold's model.  A test subject in a fold is an error.

    ``predictions`` has a column per fold, ``metrics`` a row per fold and one of their means,
    ``summary`` mean and deviation of each metric.
    """
    chosen = {name: {"metric": name} for name in ("roc_auc", "average_precision", "accuracy")} if chosen is None else chosen
    splits.require_disjoint(folds, predictions)
    numbers = fold_numbers(predictions)
    target = predictions.groupBy(ID).agg(F.max("target").alias("target"))
    scored = metrics.named_metrics(predictions, chosen)
    return {
        "predictions": target.join(metrics.prediction_table(predictions, numbers), ID),
        "metrics": scored,
        "summary": metrics.mean_std(scored.where("fold is not null"), list(chosen)),
        "curves": metrics.curves(predictions, ["fold"]),
    }


def tokens_with_prefix(vocabulary: DataFrame, prefixes: list[str]) -> list[int]:
    """Ids of the codes that begin so; at most a vocabulary."""
    return [r["token_id"] for r in sequences.token_ids(vocabulary, prefixes).collect()]
