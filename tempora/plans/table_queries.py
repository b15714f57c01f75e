"""Registered queries of readers and writers: what is written from the given tables is read back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import micros
from ..operators import filters, outcomes, sequences, splits
from ..sources import io
from ..sources.adapters import EVENTS_SQL, ORDERS_SQL, table
from ..sources.scratch import scratch_path
from . import pipelines
from .queries import BUYS_SQL, EVALUATED_SQL, FEATS_SQL, INDEX_SQL, INFO_SQL, SPLIT, TOKENS_SQL, VOCABULARY_SQL, buys, ev, evaluated, feats, index_dates, info, od, query, split_folder

ROW = "row_id, subject_id, epoch_us(time) AS time_us, code, round(numeric_value, 9) AS value"


def told(df: DataFrame) -> DataFrame:
    return df.select("row_id", "subject_id", micros(F.col("time")).alias("time_us"), "code", F.round("numeric_value", 9).alias("value"))


@query(f"WITH {ORDERS_SQL} SELECT kind, {ROW} FROM od, (VALUES ('parquet'), ('csv')) k(kind)")
def a1_a5_a6_read_meds(spark: SparkSession, folder: str) -> DataFrame:
    """Events written in both formats, times in csv with a zone and some that are none."""
    rows = od(spark, folder)
    paths = {kind: scratch_path(spark, f"meds-{kind}") for kind in ("parquet", "csv")}
    rows.write.parquet(paths["parquet"])
    rows.withColumn("time", F.coalesce(F.col("time").cast("string"), F.lit("no time"))).write.csv(paths["csv"], header=True)
    found = {kind: io.require_columns(io.read_meds(spark, path, kind), ["subject_id", "time", "code", "numeric_value"], kind) for kind, path in paths.items()}
    return reduce(DataFrame.unionByName, [told(df).withColumn("kind", F.lit(kind)) for kind, df in found.items()])


@query(f"WITH {EVENTS_SQL} SELECT {SPLIT} AS split, row_id, CASE WHEN code = 'M_VIEW' AND subject_id % 20 = 9 THEN 'M_SEEN' ELSE code END AS code FROM ev WHERE subject_id % 3 > 0 AND {SPLIT} <> 'tuning'")
def a2_read_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Two of three splits beside a folder that is none, for some subjects."""
    some = ev(spark, folder).where("subject_id % 3 > 0")
    return io.read_splits(spark, split_folder(spark, folder), ["train", "held_out", "held_out2"], optional=("held_out", "held_out2"), pids=some).select("split", "row_id", "code")


@query(f"WITH {INFO_SQL} SELECT subject_id, epoch_us(birthdate) AS birth_us FROM info WHERE subject_id IN (SELECT subject_id FROM ev WHERE code = 'LAB/PURCHASE')")
def a3_a8_patients_of_events(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "patients")
    io.write_patient_info(info(spark, folder), path)
    kept = filters.restrict_patient_info(spark.read.parquet(path), ev(spark, folder).where("code = 'LAB/PURCHASE'"))
    return kept.select("subject_id", micros(F.col("birthdate")).alias("birth_us"))


@query("""WITH c AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS PID, CAST(o_orderdate AS TIMESTAMP) AS t, 'D_' || left(o_orderpriority, 1) AS concept, NULL::DOUBLE AS result FROM orders
UNION SELECT DISTINCT CAST(o_custkey AS VARCHAR), CAST(l_shipdate AS TIMESTAMP), 'L_' || l_returnflag, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT PID, epoch_us(t) AS time_us, concept, round(result, 6) AS result, (SELECT count(*) FROM customer) AS patients FROM c""")
def a4_read_clinical(spark: SparkSession, folder: str) -> DataFrame:
    """Diagnoses as csv and labs as parquet, every row twice, a third type left unread."""
    root, orders = scratch_path(spark, "clinical"), table(spark, folder, "orders")
    at = lambda c: F.col(c).cast("timestamp_ntz").alias("TIMESTAMP")
    pid = F.col("o_custkey").cast("string").alias("PID")
    diagnoses = orders.select(pid, at("o_orderdate"), F.concat(F.lit("D_"), F.substring("o_orderpriority", 1, 1)).alias("CONCEPT"))
    items = table(spark, folder, "lineitem").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    labs = items.select(pid, at("l_shipdate"), F.concat(F.lit("L_"), "l_returnflag").alias("CONCEPT"), F.col("l_discount").cast("double").alias("RESULT"))
    diagnoses.unionByName(diagnoses).write.csv(f"{root}/concept.diagnose.csv", header=True)
    labs.unionByName(labs).write.parquet(f"{root}/concept.lab.parquet")
    labs.write.parquet(f"{root}/concept.other.parquet")
    table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("PID")).write.parquet(f"{root}/patients_info.parquet")
    patients, concepts = io.read_clinical(spark, root, ["diagnose", "lab"])
    rows = concepts.select(F.col("PID").cast("string").alias("PID"), micros(F.col("TIMESTAMP").cast("timestamp_ntz")).alias("time_us"), F.col("CONCEPT").alias("concept"), F.round("RESULT", 6).alias("result"))
    return rows.crossJoin(F.broadcast(patients.agg(F.count("*").alias("patients"))))  # one row


@query(f"WITH {FEATS_SQL} SELECT {SPLIT} AS split, subject_id, seq, age, round(abspos, 6) AS abspos, segment, code FROM f")
def a7_write_features(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "features")
    io.write_features(feats(spark, folder).withColumn("split", F.expr(SPLIT)), path)
    return spark.read.parquet(path).select("split", "subject_id", "seq", "age", F.round("abspos", 6).alias("abspos"), "segment", "code")


@query(f"WITH {VOCABULARY_SQL} SELECT CASE WHEN code = 'D_CLICK' THEN 'D_TAP' ELSE code END AS code, token_id FROM vocab")
def a9_a16_vocabulary_and_mapping(spark: SparkSession, folder: str) -> DataFrame:
    """A vocabulary and a mapping of codes read back; a mapping without a path is none."""
    from ..operators import tokens

    paths = [scratch_path(spark, name) for name in ("vocabulary", "mapping")]
    io.write_vocabulary(tokens.build_vocabulary(feats(spark, folder)), paths[0])
    spark.createDataFrame([("D_CLICK", "D_TAP", 1)], "code string, new_code string, extra int").write.parquet(paths[1])
    known = tokens.map_codes(io.read_vocabulary(spark, paths[0]), io.read_code_mapping(spark, paths[1]))
    return known.select("code", "token_id") if io.read_code_mapping(spark, None) is None else known


@query(f"WITH {FEATS_SQL}, p AS (SELECT DISTINCT {SPLIT} AS split, subject_id FROM f) SELECT split, subject_id FROM p UNION ALL SELECT 'all', subject_id FROM p")
def a10_pids_of_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every split, and those of several files as one set."""
    root = scratch_path(spark, "pids")
    io.write_split_pids(feats(spark, folder).withColumn("split", F.expr(SPLIT)), root)
    paths = [f"{root}/split={s}" for s in io.names_of(spark, root, "split")]
    whole = io.read_pids(spark, *paths, paths[0]).select(F.lit("all").alias("split"), "subject_id")
    return spark.read.parquet(root).select(F.col("split").cast("string").alias("split"), "subject_id").unionByName(whole)


@query(f"WITH {EVENTS_SQL}, {BUYS_SQL} SELECT kind, 'buys' AS outcome, subject_id, CAST(abspos AS BIGINT) AS abspos FROM buys, (VALUES ('parquet'), ('csv')) k(kind)")
def a11_write_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """A folder per outcome in both formats; an outcome without rows has none."""
    rows = outcomes.build_outcomes(ev(spark, folder), {"buys": {"type": ["code"], "match": [["LAB"]]}, "never": {"type": ["code"], "match": [["NONE"]]}})
    out = []
    for kind in ("parquet", "csv"):
        path = scratch_path(spark, "outcomes")
        io.write_outcomes(rows, path, kind=kind)
        found = spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True)
        out.append(found.select(F.lit(kind).alias("kind"), "outcome", F.col("subject_id").cast("bigint").alias("subject_id"), F.col("abspos").cast("bigint").alias("abspos")))
    return reduce(DataFrame.unionByName, out)


@query(f"WITH {EVENTS_SQL}, {INDEX_SQL} SELECT 'index_dates' AS part, subject_id, epoch_us(time) AS time_us FROM idx UNION ALL SELECT 'pids', subject_id, NULL FROM idx UNION ALL SELECT 'folds', subject_id, 3 FROM idx")
def a12_write_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Ids, dates and folds; without test subjects there is no table of them."""
    path, dates = scratch_path(spark, "cohort"), index_dates(spark, folder)
    io.write_cohort({"pids": dates, "index_dates": dates, "test_pids": dates.limit(0).select("subject_id"), "folds": splits.create_folds(dates, 3)}, path)
    found = io.read_cohort(spark, path)
    as_time = {"index_dates": micros(F.col("time")), "pids": F.lit(None).cast("bigint"), "folds": F.col("n")}
    found["folds"] = found["folds"].groupBy("subject_id").agg(F.countDistinct("fold").alias("n"))
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("part"), "subject_id", as_time[name].alias("time_us")) for name, df in found.items()])


@query(f"WITH {TOKENS_SQL}, {INDEX_SQL} SELECT subject_id, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes, (SELECT count(*) FROM vocab) AS words, (SELECT count(*) FROM idx) AS dates FROM toks GROUP BY 1")
def a13_write_sequences(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "sequences")
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder))
    io.write_sequences(sequences.to_sequences(made), path, vocabulary, buys(spark, folder), index_dates(spark, folder))
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    total = F.aggregate("events", F.lit(0).cast("bigint"), lambda a, e: a + e["code"])
    rows = read("sequences").select("subject_id", F.size("events").cast("bigint").alias("n"), total.alias("codes"))
    counts = io.read_vocabulary(spark, f"{path}/vocabulary").agg(F.count("*").alias("words")).crossJoin(read("index_dates").agg(F.count("*").alias("dates")))  # one row
    return rows.crossJoin(F.broadcast(counts))  # one row


@query(f"WITH {EVALUATED_SQL} SELECT fold, round(auc, 6) AS auc, round(ap, 6) AS ap, round(acc, 6) AS acc, (SELECT count(*) FROM g) AS points, (SELECT count(*) FROM orders) AS subjects FROM m UNION ALL SELECT NULL, round(avg(auc), 6), round(avg(ap), 6), round(avg(acc), 6), (SELECT count(*) FROM g), (SELECT count(*) FROM orders) FROM m")
def a14_write_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics, curves and predictions as csv."""
    path = scratch_path(spark, "evaluation")
    io.write_evaluation(evaluated(spark, folder), path)
    read = lambda name: spark.read.csv(f"{path}/{name}", header=True, inferSchema=True)
    rows = read("metrics").select(F.col("fold").cast("bigint").alias("fold"), *[F.round(c, 6).alias(c) for c in ("auc", "ap", "acc")])
    counts = read("curves").agg(F.count("*").alias("points")).crossJoin(read("predictions").agg(F.count("*").alias("subjects")))  # one row
    return rows.crossJoin(F.broadcast(counts))  # one row
