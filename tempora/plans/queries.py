"""Registered queries on the star-schema tables, each with DuckDB SQL where SQL expresses it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import abspos, age_fraction, age_years, background_name, background_value, hours_truncated, limit_code_length, match_contains, match_startswith, micros, shift_hours, sigmoid, value_bin, value_prefix
from ..operators import features, filters, metrics, outcomes, sequences, splits, tokens
from ..schema import SPECIAL_TOKENS
from ..sources.adapters import EVENTS_SQL, ORDERS_SQL, meds_from_events, meds_from_orders, table
from ..sources.io import to_meds
from ..sources.scratch import bucketed, materialize, scratch_path
from . import pipelines

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def ev(spark: SparkSession, folder: str) -> DataFrame:
    return meds_from_events(table(spark, folder, "events"))


def od(spark: SparkSession, folder: str) -> DataFrame:
    return meds_from_orders(table(spark, folder, "customer"), table(spark, folder, "orders"), table(spark, folder, "lineitem"))


HOURS = "(floor(epoch_us({0}) / 1000000.0) / 3600.0)"
FEATURES_SQL = f"""{EVENTS_SQL},
birth AS (SELECT subject_id, arg_max(time, row_id) AS birthdate FROM ev WHERE code = 'DOB' GROUP BY 1),
promoted AS (SELECT e.row_id, e.subject_id, coalesce(time, birthdate) AS time, birthdate, numeric_value, CASE WHEN time IS NULL THEN 'BG_' || code ELSE code END AS code FROM ev e LEFT JOIN birth USING (subject_id)),
prefixed AS (SELECT row_id, subject_id, time, birthdate, numeric_value, CASE WHEN contains(code, 'ADMISSION') OR contains(code, 'DISCHARGE') THEN 'ADM_' || code ELSE code END AS code FROM promoted),
aged AS (SELECT *, floor(floor((epoch_us(time) - epoch_us(birthdate)) / 86400000000.0) / 365.25) AS age, {HOURS.format("time")} AS abspos FROM prefixed WHERE time IS NOT NULL AND code IS NOT NULL)"""
KIND = "CASE WHEN starts_with(code, 'ADM_ADMISSION') THEN 'A' WHEN starts_with(code, 'ADM_DISCHARGE') THEN 'D' END"
GAP = "epoch_us(time) - lag(epoch_us(time)) OVER w > 172800000000"


def _segments_sql(stays: bool) -> str:
    opens = f"(lag(1) OVER w IS NULL OR {GAP})"
    if stays:
        opens = f"CASE WHEN kind = 'A' THEN true WHEN coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY time, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'A' THEN false WHEN kind = 'D' THEN true ELSE coalesce(lag(kind) OVER w, '') = 'D' OR {opens} END"
    return f"""{FEATURES_SQL},
kinds AS (SELECT *, {KIND} AS kind FROM aged),
opened AS (SELECT *, {opens} AS opens FROM kinds WINDOW w AS (PARTITION BY subject_id ORDER BY time, row_id)),
numbered AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w - 1 AS INTEGER) AS nth, row_number() OVER w AS seq FROM opened WINDOW w AS (PARTITION BY subject_id ORDER BY time, row_id)),
feats AS (SELECT subject_id, age, abspos, CASE WHEN code = 'DOD' THEN max(nth) OVER (PARTITION BY subject_id) ELSE nth END AS segment, code, seq, time, row_id FROM numbered)"""


STAYS_SQL, GAPS_SQL = _segments_sql(True), _segments_sql(False)
FEATS_SQL = f"{STAYS_SQL}, f AS (SELECT * FROM feats WHERE age BETWEEN -1 AND 120)"


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Adapted events written once, for queries that read them several times."""
    return bucketed(ev(spark, folder), "subject_id", "events")


def feats(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    return pipelines.build_features(ev(spark, folder) if events is None else events, stays=True)


@query(f"""WITH {FEATS_SQL}, part AS (SELECT subject_id, segment, count(*) AS n, count(*) FILTER (code = 'ADM_ADMISSION') AS a, max(abspos) - min(abspos) AS hours FROM f GROUP BY 1, 2), lasts AS (SELECT subject_id, arg_max(age, seq) AS last_age FROM f GROUP BY 1)
SELECT subject_id, count(*) AS segments, CAST(sum(n) AS BIGINT) AS events, CAST(sum(a) AS BIGINT) AS admissions, round(max(hours), 6) AS longest_hours, any_value(last_age) AS last_age FROM part JOIN lasts USING (subject_id) GROUP BY 1""")
def p1_build_features(spark: SparkSession, folder: str) -> DataFrame:
    return pipelines.segment_summary(feats(spark, folder))


@query(f"WITH {GAPS_SQL} SELECT row_id, subject_id, segment, seq FROM feats")
def f1_sessionize_gap(spark: SparkSession, folder: str) -> DataFrame:
    done = filters.drop_null_events(features.featurise(ev(spark, folder)))
    done = features.order_features(features.assign_segments(done, stays=False))
    return done.select("row_id", "subject_id", "segment", F.col("seq").cast("bigint").alias("seq"))


@query(f"WITH {STAYS_SQL} SELECT row_id, subject_id, segment, seq FROM feats")
def f2_sessionize_admissions(spark: SparkSession, folder: str) -> DataFrame:
    done = filters.drop_null_events(features.featurise(ev(spark, folder)))
    done = features.order_features(features.assign_segments(done, stays=True))
    return done.select("row_id", "subject_id", "segment", F.col("seq").cast("bigint").alias("seq"))


@query(f"WITH {FEATURES_SQL} SELECT coalesce(bool_or(starts_with(code, 'ADM_ADMISSION')), false) AND coalesce(bool_or(starts_with(code, 'ADM_DISCHARGE')), false) AS stays FROM aged")
def f3_segment_mode(spark: SparkSession, folder: str) -> DataFrame:
    return spark.createDataFrame([(features.has_stays(features.featurise(ev(spark, folder))),)], "stays boolean")


@query(f"WITH {STAYS_SQL} SELECT subject_id, max(segment) FILTER (code = 'DOD') AS death_segment, max(segment) AS last_segment FROM feats GROUP BY 1")
def f5_death_segment(spark: SparkSession, folder: str) -> DataFrame:
    done = features.assign_segments(filters.drop_null_events(features.featurise(ev(spark, folder))), stays=True)
    return done.groupBy("subject_id").agg(F.max(F.when(F.col("code") == "DOD", F.col("segment"))).alias("death_segment"), F.max("segment").alias("last_segment"))


@query(f"WITH {FEATURES_SQL} SELECT row_id, subject_id, code, round(abspos, 6) AS abspos, age FROM aged")
def c1_c4_positions_and_prefixes(spark: SparkSession, folder: str) -> DataFrame:
    return features.featurise(ev(spark, folder)).select("row_id", "subject_id", "code", F.round("abspos", 6).alias("abspos"), "age")


@query(f"WITH {EVENTS_SQL} SELECT row_id, 'VAL_' || CAST(trunc(numeric_value * 100) AS BIGINT) AS bin, coalesce(nullif(regexp_extract(code, '^([A-Z]+)/', 1), ''), 'UNK') AS prefix FROM ev")
def c5_c6_bin_values(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).select("row_id", value_bin(F.col("numeric_value")).alias("bin"), value_prefix(F.col("code"), "^([A-Z]+)/").alias("prefix"))


@query(f"WITH {EVENTS_SQL}, m(code, new_code) AS (VALUES ('D_CLICK', 'D_TAP'), ('NONE', 'X')) SELECT row_id, coalesce(new_code, code) AS code FROM ev LEFT JOIN m USING (code)")
def c7_map_codes(spark: SparkSession, folder: str) -> DataFrame:
    mapping = spark.createDataFrame([("D_CLICK", "D_TAP"), ("NONE", "X")], "code string, new_code string")
    return tokens.map_codes(ev(spark, folder), mapping).select("row_id", "code")


@query(f"WITH {EVENTS_SQL}, a AS (SELECT row_id, CASE WHEN starts_with(code, 'LAB') THEN left(code, 6) ELSE code END AS c FROM ev) SELECT row_id, CASE WHEN starts_with(c, 'LAB/PU') THEN left(c, 6) WHEN starts_with(c, 'D_') THEN left(c, 4) ELSE c END AS code FROM a")
def c8_limit_code_length(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).select("row_id", limit_code_length(F.col("code"), {"LAB": 6, "LAB/PU": 6, "D_": 4}).alias("code"))


@query(f"WITH {EVENTS_SQL} SELECT row_id, CAST(trunc({HOURS.format('time')}) AS BIGINT) AS hours, round({HOURS.format('time')} + 36.5, 6) AS shifted FROM ev WHERE time IS NOT NULL")
def c10_c11_hours(spark: SparkSession, folder: str) -> DataFrame:
    dated = filters.drop_missing_time(ev(spark, folder))
    return dated.select("row_id", hours_truncated(abspos(F.col("time"))).alias("hours"), F.round(abspos(shift_hours(F.col("time"), 36.5)), 6).alias("shifted"))


@query(f"WITH {FEATURES_SQL} SELECT row_id, nullif(replace(split_part(code, '//', 1), 'BG_', ''), '') AS name, nullif(split_part(code, '//', 2), '') AS val FROM promoted WHERE starts_with(code, 'BG_')")
def c12_background_fields(spark: SparkSession, folder: str) -> DataFrame:
    rows = features.promote_background(features.attach_birthdate(ev(spark, folder))).where(F.col("code").startswith("BG_"))
    return rows.select("row_id", background_name(F.col("code")).alias("name"), background_value(F.col("code")).alias("val"))


INFO_SQL = f"""{FEATURES_SQL}, info AS (SELECT subject_id, arg_max(time, row_id) FILTER (code = 'DOB') AS birthdate, arg_max(time, row_id) FILTER (code = 'DOD') AS deathdate, max(split_part(code, '//', 2)) FILTER (starts_with(code, 'BG_GENDER')) AS GENDER FROM promoted GROUP BY 1)"""


def info(spark: SparkSession, folder: str) -> DataFrame:
    return features.patient_info(features.promote_background(features.attach_birthdate(ev(spark, folder))))


@query(f"WITH {INFO_SQL} SELECT subject_id, epoch_us(birthdate) AS birth_us, epoch_us(deathdate) AS death_us, GENDER AS gender FROM info")
def e3_patient_info(spark: SparkSession, folder: str) -> DataFrame:
    return info(spark, folder).select("subject_id", micros(F.col("birthdate")).alias("birth_us"), micros(F.col("deathdate")).alias("death_us"), F.try_element_at("background", F.lit("GENDER")).alias("gender"))


@query(f"WITH {EVENTS_SQL}, h AS (SELECT * FROM ev WHERE starts_with(code, 'LAB') AND time IS NOT NULL), b AS (SELECT *, CAST(floor((epoch_us(time) - (SELECT min(epoch_us(time)) FROM h)) / 86400000000.0) AS BIGINT) AS bucket FROM h) SELECT subject_id, code, epoch_us(min(time)) AS time_us, round(sum(numeric_value), 6) AS total FROM b GROUP BY subject_id, code, bucket")
def e2_aggregate_window(spark: SparkSession, folder: str) -> DataFrame:
    done = features.aggregate_events(ev(spark, folder), "sum", "LAB", window_hours=24)
    return done.where(F.col("code").startswith("LAB")).select("subject_id", "code", micros(F.col("time")).alias("time_us"), F.round("numeric_value", 6).alias("total"))


@query(f"WITH {ORDERS_SQL} SELECT subject_id, epoch_us(time) AS time_us, code, round(max(numeric_value), 6) AS top FROM od WHERE starts_with(code, 'M_') GROUP BY ALL UNION ALL SELECT subject_id, epoch_us(time), code, round(numeric_value, 6) FROM od WHERE NOT starts_with(code, 'M_')")
def e1_aggregate_events(spark: SparkSession, folder: str) -> DataFrame:
    done = features.aggregate_events(od(spark, folder), "max", "M_")
    return done.select("subject_id", micros(F.col("time")).alias("time_us"), "code", F.round("numeric_value", 6).alias("top"))


@query(f"WITH {EVENTS_SQL} SELECT row_id, code, nth FROM (SELECT row_id, code, 0 AS nth FROM ev UNION ALL SELECT row_id, 'VAL_' || CAST(trunc(numeric_value * 100) AS BIGINT), 1 FROM ev WHERE numeric_value IS NOT NULL)")
def h2_append_value_rows(spark: SparkSession, folder: str) -> DataFrame:
    return features.append_value_rows(ev(spark, folder)).select("row_id", "code", F.col("order").alias("nth"))


@query(f"WITH {EVENTS_SQL} SELECT code, count(*) AS n FROM ev WHERE NOT coalesce(regexp_matches(code, '(?i)^(lab|m_)'), false) GROUP BY 1")
def b6_exclude_codes_regex(spark: SparkSession, folder: str) -> DataFrame:
    return filters.exclude_codes_regex(ev(spark, folder), "^(lab|m_)").groupBy("code").agg(F.count("*").alias("n"))


@query(f"""WITH {EVENTS_SQL}, r AS (SELECT *, 'timed' AS rule FROM ev WHERE time IS NOT NULL UNION ALL SELECT *, 'included' FROM ev WHERE code IN ('DOB', 'DOD') UNION ALL SELECT *, 'excluded' FROM ev WHERE code IS NULL OR code NOT IN ('DOB', 'DOD')
UNION ALL SELECT *, 'starts' FROM ev WHERE starts_with(lower(code), 'd_c') OR starts_with(lower(code), 'lab') UNION ALL SELECT *, 'contained' FROM ev WHERE regexp_matches(code, 'VI.W|CLICK$') UNION ALL SELECT *, 'early' FROM ev WHERE {HOURS.format('time')} <= 473500)
SELECT rule, count(*) AS n, CAST(sum(row_id) AS BIGINT) AS ids FROM r GROUP BY 1""")
def b3_b7_b12_b13_predicates(spark: SparkSession, folder: str) -> DataFrame:
    events, code = ev(spark, folder), F.col("code")
    kept = {
        "timed": filters.drop_missing_time(events),
        "included": filters.filter_by_rule(events, "code", include=["DOB", "DOD"]),
        "excluded": filters.filter_by_rule(events, "code", exclude=["DOB", "DOD"]),
        "starts": events.where(match_startswith(code, ["d_C", "LAB"], False)),
        "contained": events.where(match_contains(code, ["VI.W", "CLICK$"])),
        "early": filters.cutoff(outcomes.with_position(events), 473500),
    }
    return reduce(DataFrame.unionByName, [df.agg(F.lit(rule).alias("rule"), F.count("*").alias("n"), F.sum("row_id").alias("ids")) for rule, df in kept.items()])


POSITIONED_SQL = f"{EVENTS_SQL}, pos AS (SELECT *, {HOURS.format('time')} AS abspos FROM ev WHERE time IS NOT NULL)"


@query(f"WITH {POSITIONED_SQL} SELECT row_id, subject_id FROM pos p WHERE code = 'ADMISSION' AND EXISTS (SELECT 1 FROM pos s WHERE s.subject_id = p.subject_id AND s.code = 'LAB/PURCHASE' AND s.abspos BETWEEN p.abspos - 12 AND p.abspos + 48)")
def d2_match_combinations(spark: SparkSession, folder: str) -> DataFrame:
    pos = outcomes.with_position(ev(spark, folder))
    return outcomes.match_combinations(pos.where("code = 'ADMISSION'"), pos.where("code = 'LAB/PURCHASE'"), -12, 48).select("row_id", "subject_id")


@query(f"WITH {POSITIONED_SQL}, j AS (SELECT p.row_id AS primary_row, s.row_id, row_number() OVER (PARTITION BY p.row_id ORDER BY abs(s.abspos - p.abspos), s.row_id) AS nth FROM pos p JOIN pos s ON s.subject_id = p.subject_id AND s.code = 'LAB/PURCHASE' AND s.abspos BETWEEN p.abspos - 12 AND p.abspos + 48 WHERE p.code = 'ADMISSION') SELECT primary_row, row_id FROM j WHERE nth = 1")
def d3_closest_secondary(spark: SparkSession, folder: str) -> DataFrame:
    pos = outcomes.with_position(ev(spark, folder))
    return outcomes.closest_secondary(pos.where("code = 'ADMISSION'"), pos.where("code = 'LAB/PURCHASE'"), -12, 48).select("primary_row", "row_id")


@query(f"WITH {POSITIONED_SQL}, hit AS (SELECT *, 'buys' AS outcome FROM pos WHERE starts_with(code, 'LAB') UNION ALL SELECT *, 'others' FROM pos WHERE code <> 'DOB' AND NOT starts_with(code, 'LAB')) SELECT outcome, subject_id, epoch_us(time) AS time_us, CAST(trunc(abspos) AS BIGINT) AS abspos FROM hit")
def p3_build_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    specs = {"buys": {"type": ["code"], "match": [["LAB"]]}, "others": {"type": ["code"], "match": [["LAB"]], "exclude": ["DOB"], "negation": True}}
    return outcomes.build_outcomes(ev(spark, folder), specs).select("outcome", "subject_id", micros(F.col("time")).alias("time_us"), "abspos")


INDEX_SQL = "idx AS (SELECT subject_id, min(time) + INTERVAL 24 HOUR AS time FROM ev WHERE code = 'ADMISSION' GROUP BY 1)"
BUYS_SQL = f"buys AS (SELECT subject_id, time, trunc({HOURS.format('time')}) AS abspos FROM ev WHERE code = 'LAB/PURCHASE')"


def index_dates(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    events = ev(spark, folder) if events is None else events
    return splits.index_dates_exposed(events.where("code = 'ADMISSION'"), 24)


def buys(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    events = ev(spark, folder) if events is None else events
    return outcomes.outcome_table(outcomes.with_position(events.where("code = 'LAB/PURCHASE'")))


@query(f"WITH {EVENTS_SQL}, {INDEX_SQL} SELECT subject_id, epoch_us(time) AS time_us FROM idx")
def j9_index_dates_exposed(spark: SparkSession, folder: str) -> DataFrame:
    return index_dates(spark, folder).select("subject_id", micros(F.col("time")).alias("time_us"))


@query(f"WITH {EVENTS_SQL}, {INDEX_SQL}, {BUYS_SQL} SELECT i.subject_id, CAST(coalesce(max(CASE WHEN b.abspos - {HOURS.format('i.time')} BETWEEN 1 AND 72 THEN 1 ELSE 0 END), 0) AS INTEGER) AS outcome FROM idx i LEFT JOIN buys b USING (subject_id) GROUP BY 1")
def d4_label_binary(spark: SparkSession, folder: str) -> DataFrame:
    dates = index_dates(spark, folder).select("subject_id", abspos(F.col("time")).alias("abspos"))
    return outcomes.label_binary(dates, buys(spark, folder), 1, 72)


COHORT_SQL = f"""{INFO_SQL}, {INDEX_SQL}, {BUYS_SQL}, cohort AS (SELECT i.subject_id, x.time, birthdate, deathdate FROM info i JOIN idx x USING (subject_id) LEFT JOIN (SELECT subject_id, min(time) AS first FROM buys GROUP BY 1) USING (subject_id)
WHERE GENDER = 'F' AND (epoch_us(x.time) - epoch_us(birthdate)) / 31557600000000.0 BETWEEN 20 AND 70 AND (deathdate IS NULL OR deathdate > x.time) AND (first IS NULL OR first >= x.time))"""


@query(f"WITH {COHORT_SQL} SELECT subject_id, epoch_us(time) AS time_us FROM cohort")
def p4_select_cohort(spark: SparkSession, folder: str) -> DataFrame:
    cohort = pipelines.select_cohort(info(spark, folder), index_dates(spark, folder), buys(spark, folder), {"GENDER": {"include": ["F"]}}, (20, 70))
    return cohort.select("subject_id", micros(F.col("time")).alias("time_us"))


BUILT_SQL = f"""{INFO_SQL}, {INDEX_SQL}, {BUYS_SQL}, s0 AS (SELECT * FROM info), s1 AS (SELECT * FROM s0 WHERE subject_id IN (SELECT subject_id FROM buys)), s2 AS (SELECT * FROM s1 WHERE subject_id % 5 > 0), s3 AS (SELECT s2.*, time FROM s2 JOIN idx USING (subject_id)), s4 AS (SELECT * FROM s3 WHERE GENDER = 'F'),
s5 AS (SELECT * FROM s4 WHERE (epoch_us(time) - epoch_us(birthdate)) / 31557600000000.0 BETWEEN 20 AND 70), s6 AS (SELECT * FROM s5 WHERE deathdate IS NULL OR deathdate > time), s7 AS (SELECT s6.* FROM s6 JOIN (SELECT subject_id, min(time) AS first FROM buys GROUP BY 1) USING (subject_id) WHERE first >= time)"""


def cohort(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    events = ev(spark, folder)
    exposures, bought = events.where("code = 'ADMISSION'"), buys(spark, folder)
    ids = events.select("subject_id").distinct()
    return pipelines.build_cohort(info(spark, folder), "relative", exposures=exposures, exposure_hours=24, initial=bought, exclude=ids.where("subject_id % 5 = 0"), exposed_only=True, rules={"GENDER": {"include": ["F"]}}, ages=(20, 70), prior=bought, test_share=0.25, folds=4)


@query(f"WITH {BUILT_SQL} SELECT 'kept' AS kind, subject_id, epoch_us(time) AS time_us FROM s7 UNION ALL SELECT 'dated', subject_id, epoch_us(time) FROM s4 UNION ALL SELECT 'drawn', NULL, CAST(trunc(count(*) * 0.25) AS BIGINT) FROM s4 UNION ALL SELECT 'folded', subject_id, 4 FROM s4")
def p4_build_cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects kept, index dates, the number of test subjects, and per subject the folds in which
    it is, or, of a test subject, would be."""
    made = cohort(spark, folder)
    dates = made["index_dates"].select("subject_id", micros(F.col("time")).alias("time_us"))
    kept = dates.join(made["pids"], "subject_id", "left_semi").select(F.lit("kept").alias("kind"), "subject_id", "time_us")
    drawn = made["test_pids"].agg(F.lit("drawn").alias("kind"), F.lit(None).cast("bigint").alias("subject_id"), F.count("*").alias("time_us"))
    folded = made["folds"].groupBy("subject_id").agg(F.countDistinct("fold").alias("n")).unionByName(made["test_pids"].withColumn("n", F.lit(4).cast("bigint")))
    return kept.unionByName(dates.select(F.lit("dated").alias("kind"), "subject_id", "time_us")).unionByName(drawn).unionByName(folded.select(F.lit("folded").alias("kind"), "subject_id", F.col("n").alias("time_us")))


@query(f"""WITH {BUILT_SQL} SELECT 'patients' AS stage, count(*) AS rows, count(DISTINCT subject_id) AS subjects FROM s0 UNION ALL SELECT 'initial', count(*), count(DISTINCT subject_id) FROM s1 UNION ALL SELECT 'excluded', count(*), count(DISTINCT subject_id) FROM s2 UNION ALL SELECT 'exposed', count(*), count(DISTINCT subject_id) FROM s3 UNION ALL SELECT 'categories', count(*), count(DISTINCT subject_id) FROM s4
UNION ALL SELECT 'dated', count(*), count(DISTINCT subject_id) FROM s4 UNION ALL SELECT 'age', count(*), count(DISTINCT subject_id) FROM s5 UNION ALL SELECT 'living', count(*), count(DISTINCT subject_id) FROM s6 UNION ALL SELECT 'no_prior', count(*), count(DISTINCT subject_id) FROM s7""")
def p4_cohort_attrition(spark: SparkSession, folder: str) -> DataFrame:
    return cohort(spark, folder)["attrition"]


@query(f"WITH {INFO_SQL}, {INDEX_SQL} SELECT subject_id, round((epoch_us(time) - epoch_us(birthdate)) / 31557600000000.0, 6) AS exact_age, floor(floor((epoch_us(time) - epoch_us(birthdate)) / 86400000000.0) / 365.25) AS whole_age FROM info JOIN idx USING (subject_id)")
def c2_b9_ages(spark: SparkSession, folder: str) -> DataFrame:
    both = info(spark, folder).join(index_dates(spark, folder), "subject_id")
    return both.select("subject_id", F.round(age_fraction(F.col("time"), F.col("birthdate")), 6).alias("exact_age"), age_years(F.col("time"), F.col("birthdate")).alias("whole_age"))


@query(f"WITH {EVENTS_SQL}, {BUYS_SQL} SELECT b.subject_id, epoch_us(min(time)) AS first_us FROM buys b GROUP BY 1")
def e4_e5_first_event(spark: SparkSession, folder: str) -> DataFrame:
    return outcomes.first_events(buys(spark, folder)).select("subject_id", micros(F.col("time")).alias("first_us"))


VOCABULARY_SQL = f"{FEATS_SQL}, vocab AS (SELECT code, CAST(4 + row_number() OVER (ORDER BY code) AS INTEGER) AS token_id FROM (SELECT DISTINCT code FROM f) UNION ALL SELECT * FROM (VALUES ('[PAD]', 0), ('[CLS]', 1), ('[SEP]', 2), ('[UNK]', 3), ('[MASK]', 4)))"


@query(f"WITH {VOCABULARY_SQL} SELECT code, token_id FROM vocab")
def e6_build_vocabulary(spark: SparkSession, folder: str) -> DataFrame:
    return tokens.build_vocabulary(feats(spark, folder))


TOKENS_SQL = f"""{VOCABULARY_SQL},
parts AS (SELECT subject_id, age, abspos, segment, code, 0 AS rank, seq AS s FROM f
  UNION ALL SELECT subject_id, arg_min(age, seq), arg_min(abspos, seq) - 0.001, 0, '[CLS]', 1, min(seq) FROM f GROUP BY 1
  UNION ALL SELECT subject_id, age, abspos + 0.001, segment, '[SEP]', 2, seq FROM (SELECT *, lead(segment) OVER (PARTITION BY subject_id ORDER BY abspos, segment, seq) AS nxt FROM f) WHERE nxt <> segment),
toks AS (SELECT subject_id, row_number() OVER (PARTITION BY subject_id ORDER BY abspos, rank, segment, s) AS seq, coalesce(token_id, 3) AS code, abspos, segment, age FROM parts LEFT JOIN vocab USING (code))"""


def toks(spark: SparkSession, folder: str, events: DataFrame | None = None) -> DataFrame:
    return pipelines.tokenize_features(feats(spark, folder, events))[0]


@query(f"WITH {TOKENS_SQL} SELECT subject_id, seq, code, round(abspos, 6) AS abspos, segment, age FROM toks")
def p2_tokenize_features(spark: SparkSession, folder: str) -> DataFrame:
    return toks(spark, folder).select("subject_id", F.col("seq").cast("bigint").alias("seq"), "code", F.round("abspos", 6).alias("abspos"), "segment", "age")


FINETUNE_SQL = f"""WITH {TOKENS_SQL}, {INDEX_SQL}, {BUYS_SQL},
dated AS (SELECT subject_id, {HOURS.format('time')} + 6 AS d FROM idx),
kept AS (SELECT t.*, d, row_number() OVER (PARTITION BY subject_id ORDER BY seq DESC) AS back FROM toks t JOIN dated USING (subject_id) WHERE abspos <= d),
trimmed AS (SELECT * FROM kept WHERE NOT (back = 1 AND code = 2)),
ended AS (SELECT subject_id, seq, code, abspos, segment, age FROM trimmed UNION ALL SELECT x.subject_id, 1000000000, 1, x.d, coalesce(m.last_segment + 1, 0), coalesce((x.d - m.first_pos) / (365.25 * 24), 0.0) FROM dated x JOIN (SELECT DISTINCT subject_id FROM toks) USING (subject_id) LEFT JOIN (SELECT subject_id, arg_max(segment, seq) AS last_segment, arg_min(abspos, seq) AS first_pos FROM trimmed GROUP BY 1) m USING (subject_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM ended),
cuts AS (SELECT subject_id, max(CASE WHEN rn = n - 27 + 1 AND code = 2 THEN 1 ELSE 0 END) AS cut FROM placed GROUP BY 1),
short AS (SELECT p.* FROM placed p JOIN cuts USING (subject_id) WHERE n <= 30 OR rn <= 3 OR rn > n - 27 + cut),
lab AS (SELECT i.subject_id, max(CASE WHEN b.abspos - {HOURS.format('i.time')} BETWEEN 1 AND 72 THEN 1 ELSE 0 END) AS outcome FROM idx i LEFT JOIN buys b USING (subject_id) GROUP BY 1)
SELECT subject_id, CAST(coalesce(outcome, 0) AS INTEGER) AS outcome, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY rn) - 1 AS INTEGER) AS pos, code, round(abspos, 6) AS abspos, CAST(dense_rank() OVER (PARTITION BY subject_id ORDER BY segment) - 1 AS INTEGER) AS segment, round(age, 6) AS age FROM short JOIN lab USING (subject_id) WHERE n >= 4"""


def finetune_options() -> dict:
    return {"max_len": 30, "background": 3, "start": 1, "end": 72, "censor_hours": 6}


def exploded(done: DataFrame) -> DataFrame:
    return sequences.explode_sequences(done.select("subject_id", "outcome", "events")).select("subject_id", "outcome", "pos", "code", F.round("abspos", 6).alias("abspos"), "segment", F.round("age", 6).alias("age"))


@query(FINETUNE_SQL)
def p6_prepare_finetune(spark: SparkSession, folder: str) -> DataFrame:
    events = stored(spark, folder)
    return exploded(pipelines.prepare_finetune(toks(spark, folder, events), index_dates(spark, folder, events), buys(spark, folder, events), **finetune_options()))


@query(FINETUNE_SQL)
def p7_h5_prepare_test(spark: SparkSession, folder: str) -> DataFrame:
    """Two splits of subjects, prepared each and appended."""
    events = stored(spark, folder)
    made = toks(spark, folder, events)
    parts = {"tuning": made.where("subject_id % 2 = 0"), "held_out": made.where("subject_id % 2 = 1")}
    return exploded(pipelines.prepare_test(parts, index_dates(spark, folder, events), buys(spark, folder, events), **finetune_options()))


@query(f"""WITH {TOKENS_SQL}, {INDEX_SQL}, {BUYS_SQL}, low AS (SELECT token_id FROM vocab WHERE starts_with(code, 'M_') OR starts_with(code, 'D_')), delays AS (SELECT token_id, 24.0 AS delay FROM vocab WHERE code = 'LAB/PURCHASE'),
dated AS (SELECT subject_id, {HOURS.format('time')} + 6 AS d FROM idx WHERE subject_id % 4 > 0),
early AS (SELECT t.*, d FROM toks t JOIN dated USING (subject_id) WHERE abspos <= 473600),
kept AS (SELECT e.* FROM early e LEFT JOIN delays ON code = token_id WHERE abspos <= d + coalesce(delay, 0)),
ended AS (SELECT subject_id, seq, code, abspos, segment, age FROM kept UNION ALL SELECT x.subject_id, 1000000000, 1, x.d, coalesce(m.last_segment + 1, 0), coalesce((x.d - m.first_pos) / (365.25 * 24), 0.0) FROM dated x JOIN (SELECT DISTINCT subject_id FROM early) USING (subject_id) LEFT JOIN (SELECT subject_id, arg_max(segment, seq) AS last_segment, arg_min(abspos, seq) AS first_pos FROM kept GROUP BY 1) m USING (subject_id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM ended),
ranked AS (SELECT *, sum(CASE WHEN rn > 3 AND code NOT IN (SELECT token_id FROM low) THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY seq) AS nth FROM placed),
short AS (SELECT * FROM ranked WHERE n <= 20 OR rn <= 3 OR (code NOT IN (SELECT token_id FROM low) AND nth <= 17)),
lab AS (SELECT i.subject_id, max(CASE WHEN b.abspos - {HOURS.format('i.time')} BETWEEN 1 AND 72 THEN 1 ELSE 0 END) AS outcome FROM idx i LEFT JOIN buys b USING (subject_id) GROUP BY 1)
SELECT subject_id, CAST(coalesce(outcome, 0) AS INTEGER) AS outcome, CAST(row_number() OVER (PARTITION BY subject_id ORDER BY rn) - 1 AS INTEGER) AS pos, code, round(abspos, 6) AS abspos, CAST(dense_rank() OVER (PARTITION BY subject_id ORDER BY segment) - 1 AS INTEGER) AS segment, round(age, 6) AS age FROM short JOIN lab USING (subject_id) WHERE n >= 4""")
def p6_prepare_finetune_options(spark: SparkSession, folder: str) -> DataFrame:
    """A cohort, a cutoff, delayed censoring and prioritised truncation together."""
    events = stored(spark, folder)
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder, events))
    low = pipelines.tokens_with_prefix(vocabulary, ["M_", "D_"])
    delays = {r["token_id"]: r["delay"] for r in sequences.concept_delays(vocabulary, {"^LAB/PURCHASE$": 24}).collect()}  # bounded by the vocabulary
    dates = index_dates(spark, folder, events)
    # the background's length is found in the tokens
    return exploded(pipelines.prepare_finetune(made, dates, buys(spark, folder, events), 20, None, 1, 72, censor_hours=6, cohort=dates.where("subject_id % 4 > 0"), cutoff_hours=473600, delays=delays, non_priority=low, vocabulary=vocabulary))


@query(f"WITH {TOKENS_SQL}, least AS (SELECT min(subject_id) AS subject_id FROM toks) SELECT CAST(count(DISTINCT code) + 2 AS INTEGER) AS n FROM toks JOIN least USING (subject_id) WHERE code IN (SELECT token_id FROM vocab WHERE starts_with(code, 'BG_'))")
def i9_background_length(spark: SparkSession, folder: str) -> DataFrame:
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder))
    n = pipelines.find_background(made, vocabulary)
    return spark.createDataFrame([(n,)], "n int")


@query(f"WITH {TOKENS_SQL} SELECT subject_id, CAST(sum(code) AS BIGINT) AS codes FROM toks GROUP BY 1")
def i14_l3_map_patients(spark: SparkSession, folder: str) -> DataFrame:
    """A user's function on batches of subjects."""

    def total(batches):
        for pdf in batches:
            yield pdf.assign(codes=[sum(e["code"] for e in events) for events in pdf["events"]])[["subject_id", "codes"]]

    return sequences.map_patients(sequences.to_sequences(toks(spark, folder)), total, "subject_id long, codes long")


@query(f"""WITH {TOKENS_SQL}, placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM toks),
cuts AS (SELECT subject_id, max(CASE WHEN rn = n - 37 + 1 AND code = 2 THEN 1 ELSE 0 END) AS cut FROM placed GROUP BY 1),
short AS (SELECT p.* FROM placed p JOIN cuts USING (subject_id) WHERE n <= 40 OR rn <= 3 OR rn > n - 37 + cut)
SELECT subject_id, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes, CAST(max(dense) AS INTEGER) AS last_segment FROM (SELECT *, dense_rank() OVER (PARTITION BY subject_id ORDER BY segment) - 1 AS dense FROM short) GROUP BY 1""")
def p5_prepare_pretrain(spark: SparkSession, folder: str) -> DataFrame:
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder))
    done = pipelines.prepare_pretrain(made, max_len=40, vocabulary=vocabulary)
    return sequences.explode_sequences(done).groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("code").alias("codes"), F.max("segment").alias("last_segment"))


@query(f"WITH {TOKENS_SQL} SELECT subject_id, code AS token_id, round(any_value(last_age), 6) AS last_age FROM toks JOIN (SELECT subject_id, arg_max(age, seq) AS last_age FROM toks GROUP BY 1) USING (subject_id) WHERE code >= 5 GROUP BY 1, 2")
def e13_one_hot(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.one_hot(sequences.to_sequences(toks(spark, folder))).select("subject_id", "token_id", F.round("last_age", 6).alias("last_age"))


@query(f"WITH {TOKENS_SQL}, s AS (SELECT subject_id, count(*) AS n, max(segment) AS max_segment FROM toks GROUP BY 1) SELECT subject_id, n, max_segment FROM s UNION ALL SELECT NULL, CAST(sum(n) AS BIGINT), max(max_segment) FROM s")
def e10_e12_sequences(spark: SparkSession, folder: str) -> DataFrame:
    """Per subject, and for all, whose id is null."""
    seqs = sequences.to_sequences(toks(spark, folder))
    whole = sequences.totals(seqs).select(F.lit(None).cast("bigint").alias("subject_id"), F.col("events").alias("n"), "max_segment")
    return sequences.lengths(seqs).unionByName(whole)


@query(f"""WITH {TOKENS_SQL}, p AS (SELECT subject_id, subject_id % 8 AS grp, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes, round(sum(abspos), 3) AS positions, CAST(sum(segment) AS BIGINT) AS segments, sum(age) AS ages, arg_max(code, seq) AS last_code FROM toks GROUP BY 1)
SELECT subject_id, max(n) OVER (PARTITION BY grp) AS padded, n AS attended, codes, positions, segments, ages, CASE WHEN n = max(n) OVER (PARTITION BY grp) THEN last_code ELSE 0 END AS last_code FROM p""")
def i13_pad(spark: SparkSession, folder: str) -> DataFrame:
    seqs = sequences.to_sequences(toks(spark, folder)).withColumn("grp", F.col("subject_id") % 8)
    done = sequences.pad(seqs, "grp")
    total = lambda name, kind: F.aggregate(name, F.lit(0).cast(kind), lambda a, x: a + x)
    whole = {name: total(name, "bigint") for name in ("codes", "segments")} | {"ages": total("ages", "double"), "positions": F.round(total("positions", "double"), 3), "attended": total("attention", "bigint")}
    return done.select("subject_id", F.size("codes").cast("bigint").alias("padded"), F.element_at("codes", -1).alias("last_code"), *[c.alias(name) for name, c in whole.items()])


@query(f"WITH {TOKENS_SQL}, p AS (SELECT subject_id, code, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS rn FROM toks) SELECT subject_id, count(*) AS n, count(*) AS inputs, CAST(sum(code * rn) AS BIGINT) AS restored, CAST(coalesce(sum(code * rn) FILTER (code < 5), 0) AS BIGINT) AS special FROM p GROUP BY 1")
def i12_mask_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """What does not depend on the draws: the targets put back give the tokens, place by place, and
    special tokens, of which none is a target, stand as they were."""
    seqs = sequences.to_sequences(toks(spark, folder))
    done = sequences.mask_tokens(seqs, 20)
    at = lambda i: (i + 1).cast("bigint")
    total = lambda values: F.aggregate(values, F.lit(0).cast("bigint"), lambda a, x: a + x)
    restored = F.zip_with(F.col("input"), F.col("target"), lambda x, t: F.when(t == -100, x).otherwise(t))
    kept = F.zip_with(F.col("input"), F.transform("events", lambda e: e["code"]), lambda x, c: F.when(c < 5, x).otherwise(0))
    placed = lambda values: total(F.transform(values, lambda x, i: x * at(i)))
    return done.select("subject_id", F.size("target").cast("bigint").alias("n"), F.size("input").cast("bigint").alias("inputs"), placed(restored).alias("restored"), placed(kept).alias("special"))


PREDICTIONS_SQL = "pr AS (SELECT o_orderkey AS subject_id, o_custkey % 3 AS fold, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS target, floor(o_totalprice / 5000) / 100.0 AS proba FROM orders)"


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders")
    return o.select(F.col("o_orderkey").alias("subject_id"), (F.col("o_custkey") % 3).alias("fold"), (F.col("o_orderstatus") == "F").cast("int").alias("target"), (F.floor(F.col("o_totalprice") / 5000) / 100.0).alias("proba"))


@query(f"""WITH {PREDICTIONS_SQL}, c AS (SELECT fold, count(*) FILTER (proba <= 0.5 AND target = 0) AS tn, count(*) FILTER (proba > 0.5 AND target = 0) AS fp, count(*) FILTER (proba <= 0.5 AND target = 1) AS fn, count(*) FILTER (proba > 0.5 AND target = 1) AS tp FROM pr GROUP BY 1)
SELECT fold, tn, fp, fn, tp, round((tp + tn) / (tn + fp + fn + tp), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0.0), 6) AS precision_score, round(coalesce(tp / nullif(tp + fn, 0), 0.0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0.0), 6) AS specificity, round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c""")
def k1_k2_scores(spark: SparkSession, folder: str) -> DataFrame:
    s = metrics.scores(predictions(spark, folder), ["fold"])
    return s.select("fold", "tn", "fp", "fn", "tp", *[F.round(c, 6).alias(c) for c in ("accuracy", "precision_score", "recall", "specificity", "f1")])


@query(f"""WITH {PREDICTIONS_SQL}, g AS (SELECT fold, proba, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS q FROM pr GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS pp, sum(q) OVER (PARTITION BY fold) AS nn FROM g WINDOW w AS (PARTITION BY fold ORDER BY proba DESC))
SELECT fold, round(coalesce(sum(q * (tp - p / 2.0)) / nullif(max(pp) * max(nn), 0), 0.0), 6) AS roc_auc, round(coalesce(sum(p / nullif(pp, 0) * tp / (tp + fp)), 0.0), 6) AS average_precision FROM r GROUP BY 1""")
def k4_k5_areas(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.areas(predictions(spark, folder), ["fold"]).select("fold", F.round("roc_auc", 6).alias("roc_auc"), F.round("average_precision", 6).alias("average_precision"))


@query(f"WITH {PREDICTIONS_SQL}, c AS (SELECT target, count(*) AS n FROM pr GROUP BY 1), t AS (SELECT sum(n)::DOUBLE AS total FROM c), e AS (SELECT target, n, (1 - pow((total - 1) / total, n)) * total AS eff FROM c, t) SELECT target, n, round(1 / sqrt(n), 9) AS inverse_sqrt, round(eff / (SELECT sum(eff) FROM e) / n, 9) AS effective FROM e")
def j11_j12_weights(spark: SparkSession, folder: str) -> DataFrame:
    p = predictions(spark, folder)
    a, b = metrics.weights_inverse_sqrt(p), metrics.weights_effective_n(p)
    return a.join(b.select("target", F.col("weight").alias("effective")), "target").select("target", "n", F.round("weight", 9).alias("inverse_sqrt"), F.round("effective", 9).alias("effective"))


@query(f"WITH {PREDICTIONS_SQL}, c AS (SELECT count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1 FROM pr) SELECT round(sqrt(n0 / n1), 6) AS sqrt_weight FROM c")
def j13_pos_weight(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.pos_weights(predictions(spark, folder)).select(F.round("sqrt_weight", 6).alias("sqrt_weight"))


def customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id"))


@query("WITH n AS (SELECT count(DISTINCT c_custkey) AS n FROM customer), r AS (SELECT c_custkey AS subject_id, row_number() OVER (ORDER BY c_custkey) - 1 AS k FROM customer) SELECT subject_id, CASE WHEN k < trunc(n * 0.5) THEN 'pretrain' WHEN k < trunc(n * 0.75) THEN 'finetune' ELSE 'test' END AS part FROM r, n")
def j1_split_sequential(spark: SparkSession, folder: str) -> DataFrame:
    return splits.split_sequential(table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id")), (0.5, 0.25, 0.25))


@query("WITH n AS (SELECT count(*) AS n FROM customer) SELECT CAST(f AS INTEGER) AS fold, CAST(n - (n - f + 4) // 5 AS BIGINT) AS train, CAST((n - f + 4) // 5 AS BIGINT) AS val FROM n, range(5) t(f)")
def j4_j5_folds(spark: SparkSession, folder: str) -> DataFrame:
    folds = splits.create_folds(table(spark, folder, "customer").select(F.col("c_custkey").alias("subject_id")), 5)
    return folds.groupBy("fold").agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "val").alias("val"))


@query("""WITH n AS (SELECT count(*) AS n, CAST(trunc(count(*) * 0.2) AS BIGINT) AS test, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer) SELECT kind, test, n - test AS train_val, n AS subjects, ids FROM n, (VALUES ('split'), ('sample')) k(kind)""")
def j2_split_test(spark: SparkSession, folder: str) -> DataFrame:
    """Sizes of both parts; that all subjects are in one of them is told by their number and sum."""
    ids = customers(spark, folder)
    made = {"split": splits.split_share(ids, 0.2), "sample": splits.sample_test(ids, 0.2, 7)}
    return reduce(DataFrame.unionByName, [parts.agg(F.lit(kind).alias("kind"), F.count_if(F.col("part") == "test").alias("test"), F.count_if(F.col("part") == "train_val").alias("train_val"), F.countDistinct("subject_id").alias("subjects"), F.sum("subject_id").alias("ids")) for kind, parts in made.items()])


@query("SELECT c_custkey AS subject_id, 1::BIGINT AS val, 4::BIGINT AS train, 5::BIGINT AS folds FROM customer")
def j5_fold_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Every subject validates one fold of five and trains in the others."""
    folds = splits.create_folds(customers(spark, folder), 5)
    return folds.groupBy("subject_id").agg(F.count_if(F.col("part") == "val").alias("val"), F.count_if(F.col("part") == "train").alias("train"), F.countDistinct("fold").alias("folds"))


@query("WITH n AS (SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer) SELECT CAST(trunc(n * 0.8) AS BIGINT) AS train, CAST(n - trunc(n * 0.8) AS BIGINT) AS val, n AS subjects, ids FROM n")
def j3_split_train_val(spark: SparkSession, folder: str) -> DataFrame:
    parts = splits.split_train_val(customers(spark, folder), 0.2)
    return parts.agg(F.count_if(F.col("part") == "train").alias("train"), F.count_if(F.col("part") == "val").alias("val"), F.countDistinct("subject_id").alias("subjects"), F.sum("subject_id").alias("ids"))


@query("SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 4 = 0 THEN 'val' ELSE 'train' END AS part FROM customer WHERE c_custkey % 3 > 0")
def j7_predefined_split(spark: SparkSession, folder: str) -> DataFrame:
    """Stored folds, of which the first counts; subjects that it lacks are in no part."""
    ids = customers(spark, folder)
    part = F.when(F.col("subject_id") % 4 == 0, "val").otherwise("train")
    folds = ids.where("subject_id % 3 > 0").select(F.explode(F.array(F.lit(0), F.lit(1))).alias("fold"), part.alias("part"), "subject_id").where("fold = 0 or part = 'val'")
    train, val = splits.apply_predefined_split(ids, folds)
    return train.withColumn("part", F.lit("train")).unionByName(val.withColumn("part", F.lit("val")))


@query("SELECT c_custkey AS subject_id FROM customer WHERE c_custkey % 6 = 0")
def d9_overlap(spark: SparkSession, folder: str) -> DataFrame:
    ids = customers(spark, folder)
    return splits.overlap(ids.where("subject_id % 2 = 0"), ids.where("subject_id % 3 = 0"))


@query(f"WITH {INFO_SQL}, {INDEX_SQL}, {BUYS_SQL}, pairs AS (SELECT i.subject_id, x.time, deathdate, first FROM info i JOIN idx x USING (subject_id) LEFT JOIN (SELECT subject_id, min(time) AS first FROM buys GROUP BY 1) USING (subject_id)) SELECT subject_id, 'alive' AS rule FROM pairs WHERE deathdate IS NULL OR deathdate > time UNION ALL SELECT subject_id, 'no_prior' FROM pairs WHERE first IS NULL OR first >= time")
def b10_b11_patient_filters(spark: SparkSession, folder: str) -> DataFrame:
    both = info(spark, folder).join(index_dates(spark, folder), "subject_id")
    kept = {"alive": filters.filter_by_death(both), "no_prior": filters.filter_by_prior_outcomes(both, buys(spark, folder))}
    return kept["alive"].select("subject_id", F.lit("alive").alias("rule")).unionByName(kept["no_prior"].select("subject_id", F.lit("no_prior").alias("rule")))


@query(f"WITH {EVENTS_SQL}, a AS (SELECT subject_id, min(row_id) AS row_id FROM ev WHERE code = 'ADMISSION' GROUP BY 1) SELECT subject_id, row_id FROM a WHERE subject_id IN (SELECT subject_id FROM ev WHERE code = 'LAB/PURCHASE') AND subject_id NOT IN (SELECT subject_id FROM ev WHERE code = 'DOD')")
def b1_b2_b19_id_filters(spark: SparkSession, folder: str) -> DataFrame:
    events = ev(spark, folder)
    first = filters.dedupe_patients(events.where("code = 'ADMISSION'"))
    exposed = filters.filter_by_pids(first, events.where("code = 'LAB/PURCHASE'"))
    return filters.exclude_pids(exposed, events.where("code = 'DOD'")).select("subject_id", "row_id")


@query(f"""WITH {INFO_SQL}, s0 AS (SELECT subject_id, GENDER AS g, birthdate, deathdate FROM info), s1 AS (SELECT * FROM s0 WHERE g = 'F'), s2 AS (SELECT * FROM s1 WHERE deathdate IS NULL)
SELECT 'start' AS stage, count(*) AS rows, count(DISTINCT subject_id) AS subjects FROM s0 UNION ALL SELECT 'women', count(*), count(DISTINCT subject_id) FROM s1 UNION ALL SELECT 'living', count(*), count(DISTINCT subject_id) FROM s2""")
def e7_e8_attrition(spark: SparkSession, folder: str) -> DataFrame:
    patients = info(spark, folder)
    return filters.attrition(patients, {"women": filters.categories_hold(patients, {"GENDER": {"include": ["F"]}}), "living": F.col("deathdate").isNull()})[1]


@query(f"WITH {EVENTS_SQL}, t AS (SELECT subject_id, {HOURS.format('time')} < lag({HOURS.format('time')}) OVER (PARTITION BY subject_id ORDER BY row_id) AS back FROM ev WHERE time IS NOT NULL) SELECT subject_id, count(*) FILTER (back) AS violations FROM t GROUP BY 1 HAVING count(*) FILTER (back) > 0")
def f8_check_sorted(spark: SparkSession, folder: str) -> DataFrame:
    return sequences.check_sorted(outcomes.with_position(ev(spark, folder)).withColumn("seq", F.col("row_id")))


@query("""WITH r AS (SELECT o_orderkey AS row_id, k AS class, floor(o_totalprice * k) % 97 AS score, CAST(left(o_orderpriority, 1) AS INTEGER) AS label FROM orders, range(1, 6) t(k)),
p AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, class) AS place FROM r), h AS (SELECT row_id, max(CASE WHEN place <= 2 AND class = label THEN 1 ELSE 0 END) AS hit FROM p GROUP BY 1)
SELECT round(avg(hit), 6) AS precision_at_k FROM h""")
def g5_precision_at_k(spark: SparkSession, folder: str) -> DataFrame:
    o = table(spark, folder, "orders").withColumn("class", F.explode(F.sequence(F.lit(1), F.lit(5))))
    rows = o.select(F.col("o_orderkey").alias("row_id"), "class", (F.floor(F.col("o_totalprice") * F.col("class")) % 97).alias("score"), F.substring("o_orderpriority", 1, 1).cast("int").alias("label"))
    return metrics.precision_at_k(rows, 2).select(F.round("precision_at_k", 6).alias("precision_at_k"))


@query(f"""WITH {TOKENS_SQL}, {INDEX_SQL}, delays AS (SELECT token_id, 24.0 AS delay FROM vocab WHERE code = 'LAB/PURCHASE'),
dated AS (SELECT subject_id, {HOURS.format('time')} + 6 AS d FROM idx), all_ids AS (SELECT DISTINCT subject_id, d FROM toks JOIN dated USING (subject_id)),
kept AS (SELECT t.*, d FROM toks t JOIN dated USING (subject_id) LEFT JOIN delays ON code = token_id WHERE abspos <= d + coalesce(delay, 0)),
agg AS (SELECT subject_id, count(*) AS n, sum(code) AS codes, arg_max(segment, seq) AS last_segment, arg_min(abspos, seq) AS first FROM kept GROUP BY 1)
SELECT subject_id, coalesce(n, 0) + 1 AS n, CAST(coalesce(codes, 0) + 1 AS BIGINT) AS codes, CAST(coalesce(last_segment + 1, 0) AS INTEGER) AS segment, round(coalesce((d - first) / 8766.0, 0.0), 6) AS age FROM all_ids LEFT JOIN agg USING (subject_id)""")
def i2_i11_censor_with_delays(spark: SparkSession, folder: str) -> DataFrame:
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder))
    delays = {r["token_id"]: r["delay"] for r in sequences.concept_delays(vocabulary, {"^LAB/PURCHASE$": 24}).collect()}  # bounded by the vocabulary
    dates = index_dates(spark, folder).select("subject_id", (abspos(F.col("time")) + 6).alias("censor_date"))
    done = sequences.censor_with_delays(sequences.to_sequences(made).join(dates, "subject_id"), delays)
    last = F.element_at("events", -1)
    total = F.aggregate("events", F.lit(0).cast("bigint"), lambda a, e: a + e["code"])
    return done.select("subject_id", F.size("events").cast("bigint").alias("n"), total.alias("codes"), last["segment"].alias("segment"), F.round(last["age"], 6).alias("age"))


@query(f"""WITH {TOKENS_SQL}, low AS (SELECT token_id FROM vocab WHERE starts_with(code, 'M_') OR starts_with(code, 'D_')), placed AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM toks),
ranked AS (SELECT *, sum(CASE WHEN rn > 3 AND code NOT IN (SELECT token_id FROM low) THEN 1 ELSE 0 END) OVER (PARTITION BY subject_id ORDER BY seq) AS nth FROM placed)
SELECT subject_id, count(*) AS n, CAST(sum(code) AS BIGINT) AS codes, round(max(abspos), 6) AS last_position FROM ranked WHERE n <= 20 OR rn <= 3 OR (code NOT IN (SELECT token_id FROM low) AND nth <= 17) GROUP BY 1""")
def i6_i10_truncate_prioritized(spark: SparkSession, folder: str) -> DataFrame:
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder))
    low = [r["token_id"] for r in sequences.token_ids(vocabulary, ["M_", "D_"]).collect()]  # bounded by the vocabulary
    done = sequences.truncate_prioritized(sequences.to_sequences(made), 20, 3, low)
    rows = sequences.explode_sequences(done)
    return rows.groupBy("subject_id").agg(F.count("*").alias("n"), F.sum("code").alias("codes"), F.round(F.max("abspos"), 6).alias("last_position"))


@query(f"""WITH {TOKENS_SQL}, low AS (SELECT token_id FROM vocab WHERE starts_with(code, 'M_') OR starts_with(code, 'D_')), marked AS (SELECT *, code IN (SELECT token_id FROM low) AS is_low FROM toks),
counted AS (SELECT *, count(*) FILTER (is_low) OVER (PARTITION BY subject_id, abspos) AS parts FROM marked), ids AS (SELECT DISTINCT subject_id FROM toks)
SELECT subject_id, coalesce(n, 0) AS n FROM ids LEFT JOIN (SELECT subject_id, count(*) AS n FROM counted WHERE NOT is_low OR parts = 2 GROUP BY 1) USING (subject_id)""")
def i7_drop_incomplete_units(spark: SparkSession, folder: str) -> DataFrame:
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder))
    low = [r["token_id"] for r in sequences.token_ids(vocabulary, ["M_", "D_"]).collect()]  # bounded by the vocabulary
    done = sequences.drop_incomplete_units(sequences.to_sequences(made), low, 2)
    return done.select("subject_id", F.size("events").cast("bigint").alias("n"))


@query(f"WITH {TOKENS_SQL}, p AS (SELECT subject_id, code, row_number() OVER (PARTITION BY subject_id ORDER BY seq) AS rn, count(*) OVER (PARTITION BY subject_id) AS n FROM toks) SELECT subject_id, max(code) FILTER (rn = 1) AS first_code, max(code) FILTER (rn = n) AS last_code FROM p GROUP BY 1")
def i8_subset(spark: SparkSession, folder: str) -> DataFrame:
    done = sequences.subset(sequences.to_sequences(toks(spark, folder)), F.array(F.lit(0), F.size("events") - 1))
    return done.select("subject_id", F.col("events")[0]["code"].alias("first_code"), F.col("events")[1]["code"].alias("last_code"))


@query(f"WITH {EVENTS_SQL} SELECT DISTINCT subject_id, epoch_us(TIMESTAMP '2024-01-01') AS time_us FROM ev")
def j8_index_dates_absolute(spark: SparkSession, folder: str) -> DataFrame:
    ids = ev(spark, folder).select("subject_id").distinct()
    return splits.index_dates_absolute(ids, F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'")).select("subject_id", micros(F.col("time")).alias("time_us"))


@query(f"WITH {EVENTS_SQL}, {INDEX_SQL} SELECT subject_id, 1::BIGINT AS dates, 1::BIGINT AS known FROM (SELECT DISTINCT subject_id FROM ev) WHERE subject_id % 3 = 0 OR subject_id NOT IN (SELECT subject_id FROM idx)")
def j8_j10_index_dates(spark: SparkSession, folder: str) -> DataFrame:
    """For every subject that is not exposed its number of dates, and of those that an exposed one has."""
    ids, exposed = ev(spark, folder).select("subject_id").distinct(), index_dates(spark, folder).where("subject_id % 3 > 0")
    drawn = splits.index_dates_unexposed(ids, exposed).join(exposed.select("time").distinct().withColumn("hit", F.lit(True)), "time", "left")
    return drawn.groupBy("subject_id").agg(F.count("*").alias("dates"), F.count("hit").alias("known"))


@query(f"WITH {PREDICTIONS_SQL}, c AS (SELECT count(*) FILTER (target = 0) AS n0, count(*) FILTER (target = 1) AS n1, (count(*) - 1) / count(*)::DOUBLE AS beta FROM pr) SELECT round(((1 - beta) / (1 - pow(beta, n1))) / ((1 - beta) / (1 - pow(beta, n0))), 6) AS effective_weight FROM c")
def j14_pos_weight_effective(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.pos_weights(predictions(spark, folder)).select(F.round("effective_weight", 6).alias("effective_weight"))


@query(f"""WITH {PREDICTIONS_SQL}, c AS (SELECT target, count(*) AS n FROM pr GROUP BY 1), m AS (SELECT target, n, sqrt(n) AS mass FROM c) SELECT target, n, (SELECT count(*) FROM pr) AS draws, round(mass / (SELECT sum(mass) FROM m), 6) AS share, 0::BIGINT AS strangers, true AS near FROM m""")
def j15_weighted_resample(spark: SparkSession, folder: str) -> DataFrame:
    """Per class its rows, its share by weight, draws that are no row of it, and whether the share
    drawn is within 0.05 of that by weight."""
    p = predictions(spark, folder)
    weights = metrics.class_weights(p, "inverse_sqrt")
    draws = metrics.weighted_resample(p, weights, p.count())
    known = draws.join(p.select("subject_id", F.col("target").alias("own")), "subject_id", "left")
    told = known.groupBy("target").agg(F.count("*").alias("drawn"), F.count_if(~F.col("own").eqNullSafe(F.col("target"))).alias("strangers"))
    whole = told.agg(F.sum("drawn").alias("draws"))
    mass = F.col("n") * F.col("weight")
    share = weights.crossJoin(F.broadcast(weights.agg(F.sum(mass).alias("whole")))).select("target", "n", (mass / F.col("whole")).alias("share"))  # one row
    out = told.join(share, "target").crossJoin(F.broadcast(whole))  # one row
    return out.select("target", "n", "draws", F.round("share", 6).alias("share"), "strangers", (F.abs(F.col("drawn") / F.col("draws") - F.col("share")) < 0.05).alias("near"))


@query(f"""WITH {PREDICTIONS_SQL}, c AS (SELECT fold, (count(*) FILTER (proba <= 0.5 AND target = 0))::DOUBLE AS tn, (count(*) FILTER (proba > 0.5 AND target = 0))::DOUBLE AS fp, (count(*) FILTER (proba <= 0.5 AND target = 1))::DOUBLE AS fn, (count(*) FILTER (proba > 0.5 AND target = 1))::DOUBLE AS tp, avg(proba) AS mp, avg(target) AS pos FROM pr GROUP BY 1)
SELECT fold, round((coalesce(tp / nullif(tp + fn, 0), 0) + coalesce(tn / nullif(tn + fp, 0), 0)) / 2, 6) AS balanced_accuracy,
round(coalesce(((tp + tn) / (tn + fp + fn + tp) - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / pow(tn + fp + fn + tp, 2)) / nullif(1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / pow(tn + fp + fn + tp, 2), 0), 0), 6) AS kappa,
round(coalesce((tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0), 0), 6) AS mcc, round(mp, 6) AS mean_probability, round(pos, 6) AS pct_positive FROM c""")
def k2_k3_agreement(spark: SparkSession, folder: str) -> DataFrame:
    s = metrics.scores(predictions(spark, folder), ["fold"])
    return s.select("fold", *[F.round(c, 6).alias(c) for c in ("balanced_accuracy", "kappa", "mcc", "mean_probability", "pct_positive")])


@query(f"""WITH {PREDICTIONS_SQL}, g AS (SELECT fold, proba, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS q FROM pr GROUP BY 1, 2)
SELECT fold, proba AS threshold, round(sum(p) OVER w / sum(p) OVER (PARTITION BY fold), 6) AS tpr, round(sum(q) OVER w / sum(q) OVER (PARTITION BY fold), 6) AS fpr, round(sum(p) OVER w / (sum(p) OVER w + sum(q) OVER w), 6) AS precision_score FROM g WINDOW w AS (PARTITION BY fold ORDER BY proba DESC)""")
def k6_curves(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.curves(predictions(spark, folder), ["fold"]).select("fold", "threshold", *[F.round(c, 6).alias(c) for c in ("tpr", "fpr", "precision_score")])


@query(f"WITH {PREDICTIONS_SQL} SELECT subject_id, max(proba) FILTER (fold = 0) AS fold_0, max(proba) FILTER (fold = 1) AS fold_1, max(proba) FILTER (fold = 2) AS fold_2 FROM pr GROUP BY 1")
def k7_prediction_table(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.prediction_table(predictions(spark, folder), [0, 1, 2])


FOLDS_SQL = f"{PREDICTIONS_SQL}, s AS (SELECT fold, avg(CASE WHEN (proba > 0.5)::INTEGER = target THEN 1.0 ELSE 0.0 END) AS accuracy, avg(proba) AS mean_probability FROM pr GROUP BY 1)"


def fold_scores(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.scores(predictions(spark, folder), ["fold"]).select("fold", "accuracy", "mean_probability")


@query(f"WITH {FOLDS_SQL} SELECT 'accuracy' AS metric, round(avg(accuracy), 6) AS mean, round(stddev_samp(accuracy), 6) AS std FROM s UNION ALL SELECT 'mean_probability', round(avg(mean_probability), 6), round(stddev_samp(mean_probability), 6) FROM s")
def e14_mean_std(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.mean_std(fold_scores(spark, folder), ["accuracy", "mean_probability"]).select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {FOLDS_SQL} SELECT fold::BIGINT AS fold, round(accuracy, 6) AS accuracy, round(mean_probability, 6) AS mean_probability FROM s UNION ALL SELECT NULL, round(avg(accuracy), 6), round(avg(mean_probability), 6) FROM s")
def e16_average_row(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.average_row(fold_scores(spark, folder)).select("fold", F.round("accuracy", 6).alias("accuracy"), F.round("mean_probability", 6).alias("mean_probability"))


EVALUATED_SQL = f"""{PREDICTIONS_SQL}, g AS (SELECT fold, proba, count(*) FILTER (target = 1) AS p, count(*) FILTER (target = 0) AS q FROM pr GROUP BY 1, 2),
r AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY fold) AS pp, sum(q) OVER (PARTITION BY fold) AS nn FROM g WINDOW w AS (PARTITION BY fold ORDER BY proba DESC)),
a AS (SELECT fold, sum(q * (tp - p / 2.0)) / max(pp * nn) AS auc, sum(p / pp * tp / (tp + fp)) AS ap FROM r GROUP BY 1),
m AS (SELECT fold::BIGINT AS fold, auc, ap, acc FROM a JOIN (SELECT fold, avg(CASE WHEN (proba > 0.3)::INTEGER = target THEN 1.0 ELSE 0.0 END) AS acc FROM pr GROUP BY 1) USING (fold))"""


def evaluated(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    p = predictions(spark, folder)
    folds = table(spark, folder, "orders").select((-1 - F.col("o_orderkey")).alias("subject_id"), F.lit(0).alias("fold"), F.lit("train").alias("part"))
    return pipelines.evaluate_models(p, folds, {"auc": {"metric": "roc_auc"}, "ap": {"metric": "average_precision"}, "acc": {"metric": "accuracy", "threshold": 0.3}})


@query(f"WITH {EVALUATED_SQL} SELECT fold, round(auc, 6) AS auc, round(ap, 6) AS ap, round(acc, 6) AS acc FROM m UNION ALL SELECT NULL, round(avg(auc), 6), round(avg(ap), 6), round(avg(acc), 6) FROM m")
def p8_l1_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """Named metrics, of which one has a threshold of its own, per fold and their means."""
    return evaluated(spark, folder)["metrics"].select("fold", *[F.round(c, 6).alias(c) for c in ("auc", "ap", "acc")])


@query(f"WITH {EVALUATED_SQL}, l AS (UNPIVOT m ON auc, ap, acc INTO NAME metric VALUE value) SELECT metric, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM l GROUP BY 1")
def p8_summary(spark: SparkSession, folder: str) -> DataFrame:
    return evaluated(spark, folder)["summary"].select("metric", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query(f"WITH {EVALUATED_SQL} SELECT fold, round(auc, 6) AS auc FROM m WHERE NOT auc BETWEEN 0.5 AND 0.505")
def k11_metric_gate(spark: SparkSession, folder: str) -> DataFrame:
    told = evaluated(spark, folder)["metrics"].where("fold is not null")
    return metrics.metric_gate(told, "auc", 0.5, 0.505).select("fold", F.round("auc", 6).alias("auc"))


@query(f"WITH {EVENTS_SQL} SELECT round(coalesce(avg(CASE WHEN numeric_value <> 0 AND NOT isnan(numeric_value) THEN numeric_value END), 0), 6) AS mean_nonzero FROM ev")
def e15_mean_nonzero(spark: SparkSession, folder: str) -> DataFrame:
    return ev(spark, folder).agg(F.round(metrics.mean_nonzero("numeric_value"), 6).alias("mean_nonzero"))


@query("""WITH m AS (SELECT c_custkey AS id, 'DOB' AS code, TIMESTAMP '1940-01-01' AS t, NULL::DOUBLE AS v FROM customer UNION ALL SELECT c_custkey, 'SEGMENT//' || c_mktsegment, NULL, NULL FROM customer UNION ALL SELECT c_custkey, 'DOD', TIMESTAMP '2020-01-01', NULL FROM customer WHERE c_custkey % 5 = 0
  UNION ALL SELECT o_custkey, 'D_' || left(o_orderpriority, 1), o_orderdate, round(o_totalprice, 2) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT code, count(*) AS n, round(sum(v), 2) AS total, count(DISTINCT id) AS subjects, epoch_us(min(t)) AS first_us, epoch_us(max(t)) AS last_us, (SELECT count(*) - 1 FROM customer) AS last_id FROM m GROUP BY 1""")
def a15_to_meds(spark: SparkSession, folder: str) -> DataFrame:
    born = F.expr("TIMESTAMP_NTZ '1940-01-01 00:00:00'")
    people = table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("PID"), born.alias("BIRTHDATE"), F.when(F.col("c_custkey") % 5 == 0, F.expr("TIMESTAMP_NTZ '2020-01-01 00:00:00'")).alias("DEATHDATE"), F.col("c_mktsegment").alias("SEGMENT"))
    placed = table(spark, folder, "orders").select(F.col("o_custkey").cast("string").alias("PID"), F.col("o_orderdate").alias("TIMESTAMP"), F.concat(F.lit("D_"), F.substring("o_orderpriority", 1, 1)).alias("CONCEPT"), F.col("o_totalprice").alias("RESULT"))
    made = to_meds(people, placed, ["SEGMENT"])
    last = made.agg(F.max("subject_id").alias("last_id"))
    told = made.groupBy("code").agg(F.count("*").alias("n"), F.round(F.sum("numeric_value"), 2).alias("total"), F.countDistinct("subject_id").alias("subjects"), micros(F.min("time")).alias("first_us"), micros(F.max("time")).alias("last_us"))
    return told.crossJoin(F.broadcast(last))  # one row


PATIENCE = 5  # trees without a gain; a tree costs a few Spark jobs, however small the table


def baseline(spark: SparkSession, folder: str):
    """Sequences of the finetuning subjects, their folds and the vocabulary."""
    events = stored(spark, folder)
    made, vocabulary = pipelines.tokenize_features(feats(spark, folder, events))
    seqs = materialize(pipelines.prepare_finetune(made, index_dates(spark, folder, events), buys(spark, folder, events), max_len=30, background=3, start=1, end=72, censor_hours=6), "finetune")
    return seqs, splits.create_folds(seqs.where("subject_id % 4 > 0").select("subject_id"), 2), vocabulary


LABELS_SQL = f"""{EVENTS_SQL}, {INDEX_SQL}, {BUYS_SQL}, lab AS (SELECT i.subject_id, CAST(coalesce(max(CASE WHEN b.abspos - {HOURS.format('i.time')} BETWEEN 1 AND 72 THEN 1 ELSE 0 END), 0) AS INTEGER) AS outcome FROM idx i LEFT JOIN buys b USING (subject_id) GROUP BY 1)"""


@query(f"WITH {LABELS_SQL} SELECT subject_id, outcome AS target, true AS scored, 1::BIGINT AS models FROM lab WHERE subject_id % 4 > 0")
def k8_baseline_cv(spark: SparkSession, folder: str) -> DataFrame:
    """Boosted trees that stop by the validation part, positives weighing twice: every subject of the
    folds is scored once, by the model that it did not train."""
    seqs, folds, vocabulary = baseline(spark, folder)
    told = pipelines.baseline_cv(seqs, folds, vocabulary, positive_weight=2.0, patience=PATIENCE)
    return told.groupBy("subject_id", "target").agg(F.min(F.col("proba").between(0, 1)).alias("scored"), F.count("*").alias("models"))


@query(f"WITH {LABELS_SQL} SELECT subject_id, outcome AS target, 2::BIGINT AS models, true AS same FROM lab WHERE subject_id % 4 = 0")
def k9_p9_held_out(spark: SparkSession, folder: str) -> DataFrame:
    """Subjects outside the folds scored by the stored models of both, from sequences whose codes
    have other ids; the scores are those of the models and ids as they were."""
    seqs, folds, vocabulary = baseline(spark, folder)
    path = scratch_path(spark, "baseline")
    pipelines.baseline_cv(seqs, folds, vocabulary, path, patience=PATIENCE)
    held_out = seqs.where("subject_id % 4 = 0")
    plain = pipelines.score_held_out(spark, path, held_out, vocabulary).withColumnRenamed("proba", "expected").drop("target")
    ordinary = lambda c: F.when(c >= len(SPECIAL_TOKENS), c + 1000).otherwise(c)
    moved = held_out.withColumn("events", F.transform("events", lambda e: e.withField("code", ordinary(e["code"]))))
    renamed = vocabulary.withColumn("token_id", ordinary(F.col("token_id"))).unionByName(spark.createDataFrame([("NEW", 9999)], vocabulary.schema))
    told = pipelines.score_held_out(spark, path, moved, renamed).join(plain, ["subject_id", "fold"])
    return told.groupBy("subject_id", "target").agg(F.count("*").alias("models"), F.min(F.col("proba") == F.col("expected")).alias("same"))


@query()
def g3_k10_top_features(spark: SparkSession, folder: str) -> DataFrame:
    """The five codes of greatest importance to the baseline."""
    seqs, folds, vocabulary = baseline(spark, folder)
    path = scratch_path(spark, "baseline")
    pipelines.baseline_cv(seqs, folds, vocabulary, path, patience=PATIENCE)
    return pipelines.top_features(pipelines.feature_importance(*pipelines.read_baseline(spark, path)), 5)


SPLIT = "CASE WHEN subject_id % 10 < 7 THEN 'train' WHEN subject_id % 10 < 9 THEN 'tuning' ELSE 'held_out' END"
"""The split of a subject."""


def split_folder(spark: SparkSession, folder: str) -> str:
    """Events by split, a folder of parquet each, beside a folder that is none.  One subject in two
    of the held-out split has a code that no other split has."""
    root = scratch_path(spark, "meds")
    held_out_only = F.when((F.col("code") == "M_VIEW") & (F.col("subject_id") % 20 == 9), "M_SEEN").otherwise(F.col("code"))
    events = ev(spark, folder).withColumn("code", held_out_only).withColumn("split", F.expr(SPLIT))
    for name in ("train", "tuning", "held_out"):
        events.where(F.col("split") == name).drop("split").write.parquet(f"{root}/{name}")
    spark.range(1).write.csv(f"{root}/notes")
    return root


SPLIT_EVENTS_SQL = EVENTS_SQL.replace("ev AS (", "ev0 AS (", 1) + ", ev AS (SELECT row_id, subject_id, time, CASE WHEN code = 'M_VIEW' AND subject_id % 20 = 9 THEN 'M_SEEN' ELSE code END AS code, numeric_value FROM ev0)"
SPLIT_TOKENS_SQL = TOKENS_SQL.replace(EVENTS_SQL, SPLIT_EVENTS_SQL, 1).replace("(SELECT DISTINCT code FROM f)", f"(SELECT DISTINCT code FROM f WHERE {SPLIT} = 'train')", 1)


@query(f"WITH {SPLIT_TOKENS_SQL} SELECT {SPLIT} AS split, subject_id, seq, code, round(abspos, 6) AS abspos, segment, age FROM toks")
def p1_p2_tokens_of_splits(spark: SparkSession, folder: str) -> DataFrame:
    """From a folder of splits to their tokens, by the vocabulary of the first alone."""
    made = pipelines.create_data(spark, split_folder(spark, folder), scratch_path(spark, "run"), stays=True)
    return made["tokens"].select("split", "subject_id", F.col("seq").cast("bigint").alias("seq"), "code", F.round("abspos", 6).alias("abspos"), "segment", "age")


@query(f"""WITH {SPLIT_TOKENS_SQL}, told AS (SELECT {SPLIT} AS split, * FROM ev), aged0 AS (SELECT {SPLIT} AS split, * FROM f)
SELECT 'ids' AS kind, split, count(DISTINCT subject_id) AS n FROM aged0 GROUP BY 2 UNION ALL SELECT 'loaded', split, count(*) FROM told GROUP BY 2 UNION ALL SELECT 'aggregated', split, count(*) FROM told GROUP BY 2
UNION ALL SELECT 'kept', split, count(*) FROM told WHERE code <> 'D_CLICK' GROUP BY 2 UNION ALL SELECT 'aged', split, count(*) FROM aged0 WHERE code <> 'D_CLICK' GROUP BY 2 UNION ALL SELECT 'patients', 'all', count(DISTINCT subject_id) FROM told UNION ALL SELECT 'unknown', split, count(*) FROM aged0 WHERE code = 'M_SEEN' GROUP BY 2""")
def e7_a10_run_of_splits(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of every stage, observed in the run that writes the features, and the ids, patients and
    unknown codes of what is written, by split."""
    made = pipelines.create_data(spark, split_folder(spark, folder), scratch_path(spark, "run"), exclude_regex="^D_CLICK$")
    count = lambda df, kind: df.groupBy("split").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "split", "n")
    unknown = count(made["tokens"].where(F.col("code") == SPECIAL_TOKENS["[UNK]"]), "unknown")
    patients = made["patient_info"].agg(F.lit("patients").alias("kind"), F.lit("all").alias("split"), F.count("*").alias("n"))
    stages = made["counts"].select(F.col("stage").alias("kind"), "split", F.col("rows").alias("n"))
    return count(made["pids"], "ids").unionByName(stages).unionByName(patients).unionByName(unknown)


MIXED_SQL = f"""{FEATURES_SQL}, shards AS (SELECT *, CASE WHEN subject_id % 2 = 0 THEN 'a' ELSE 'b' END AS shard FROM aged WHERE NOT (subject_id % 2 = 1 AND starts_with(code, 'ADM_DISCHARGE'))),
modes AS (SELECT shard, bool_or(starts_with(code, 'ADM_ADMISSION')) AND bool_or(starts_with(code, 'ADM_DISCHARGE')) AS stays FROM shards GROUP BY 1),
kinds AS (SELECT s.*, stays, {KIND} AS kind FROM shards s JOIN modes USING (shard)),
opened AS (SELECT *, CASE WHEN NOT stays THEN (lag(1) OVER w IS NULL OR {GAP}) WHEN kind = 'A' THEN true WHEN coalesce(last_value(kind IGNORE NULLS) OVER (PARTITION BY subject_id ORDER BY time, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') = 'A' THEN false WHEN kind = 'D' THEN true ELSE coalesce(lag(kind) OVER w, '') = 'D' OR (lag(1) OVER w IS NULL OR {GAP}) END AS opens FROM kinds WINDOW w AS (PARTITION BY subject_id ORDER BY time, row_id)),
numbered AS (SELECT *, CAST(sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w - 1 AS INTEGER) AS nth, row_number() OVER w AS seq FROM opened WINDOW w AS (PARTITION BY subject_id ORDER BY time, row_id)),
feats AS (SELECT shard, subject_id, CASE WHEN code = 'DOD' THEN max(nth) OVER (PARTITION BY subject_id) ELSE nth END AS segment, code, seq, age FROM numbered)"""


def mixed_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Events of two shards, of which one has no discharge."""
    shard = F.when(F.col("subject_id") % 2 == 0, "a").otherwise("b")
    return ev(spark, folder).where("NOT (subject_id % 2 = 1 AND code = 'DISCHARGE')").withColumn("shard", shard)


@query(f"WITH {MIXED_SQL} SELECT shard, subject_id, seq, segment, code FROM feats WHERE age BETWEEN -1 AND 120")
def f3_mode_of_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The rule for segments is found for each shard when the plan runs."""
    done = pipelines.build_features(mixed_shards(spark, folder), shard="shard")
    return done.select("shard", "subject_id", F.col("seq").cast("bigint").alias("seq"), "segment", "code")


@query(f"WITH {MIXED_SQL} SELECT shard, subject_id, seq, segment, code FROM feats WHERE age BETWEEN -1 AND 120")
def f1_f2_f5_slices(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by slices of two days, so that no task holds a whole subject."""
    done = pipelines.build_features(mixed_shards(spark, folder), shard="shard", slice_hours=48)
    return done.select("shard", "subject_id", F.col("seq").cast("bigint").alias("seq"), "segment", "code")


@query(f"WITH {EVENTS_SQL} SELECT 'starts' AS rule, row_id FROM ev WHERE code IN ('D_CLICK', 'DOB', 'DOD', 'DISCHARGE') OR starts_with(code, 'LAB') UNION ALL SELECT 'contains', row_id FROM ev WHERE regexp_matches(code, 'PURCH|CLICK$') UNION ALL SELECT 'outcome', row_id FROM ev WHERE time IS NOT NULL AND regexp_matches(code, 'PURCH|CLICK$')")
def b12_b13_many_patterns(spark: SparkSession, folder: str) -> DataFrame:
    """Thousands of prefixes and of expressions, of which few match."""
    prefixes = ["D", "LAB", *[f"LOINC/{k}" for k in range(5000)]]
    expressions = ["PURCH", "CLICK$", *[f"^ICD{k}\\." for k in range(2000)]]
    events, code = ev(spark, folder), F.col("code")
    some = outcomes.match_codes(events, "code", expressions, "contains")
    outcome = outcomes.match_events(outcomes.with_position(events), ["code"], [expressions], "contains")
    return reduce(DataFrame.unionByName, [df.select(F.lit(rule).alias("rule"), "row_id") for rule, df in {"starts": events.where(match_startswith(code, prefixes)), "contains": some, "outcome": outcome}.items()])


@query(f"WITH {PREDICTIONS_SQL} SELECT subject_id, round(1 / (1 + exp(-(proba * 4 - 2))), 9) AS proba FROM pr")
def c13_sigmoid(spark: SparkSession, folder: str) -> DataFrame:
    return predictions(spark, folder).select("subject_id", F.round(sigmoid(F.col("proba") * 4 - 2), 9).alias("proba"))


@query(f"""WITH {PREDICTIONS_SQL}, c AS (SELECT fold, (count(*) FILTER (proba <= 0.3 AND target = 0))::DOUBLE AS tn, (count(*) FILTER (proba > 0.3 AND target = 0))::DOUBLE AS fp, (count(*) FILTER (proba <= 0.3 AND target = 1))::DOUBLE AS fn, (count(*) FILTER (proba > 0.3 AND target = 1))::DOUBLE AS tp FROM pr GROUP BY 1)
SELECT fold, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS dice, round((tp + tn) / (tn + fp + fn + tp), 6) AS hit FROM c""")
def k2_dice_and_hit(spark: SparkSession, folder: str) -> DataFrame:
    chosen = {name: {"metric": name, "threshold": 0.3} for name in ("dice", "hit")}
    return metrics.metric_table(predictions(spark, folder), chosen, ["fold"]).select("fold", F.round("dice", 6).alias("dice"), F.round("hit", 6).alias("hit"))


from . import table_queries  # noqa: E402,F401  registers the queries of readers and writers
