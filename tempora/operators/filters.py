"""Row filters on events and patient tables."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import age_fraction, excluded_by_regex
from .outcomes import first_events

ID = "subject_id"


def filter_by_pids(df: DataFrame, pids: DataFrame) -> DataFrame:
    return df.join(pids.select(ID), ID, "left_semi")


def exclude_pids(df: DataFrame, pids: DataFrame) -> DataFrame:
    return df.join(pids.select(ID), ID, "left_anti")


def restrict_patient_info(pi: DataFrame, ev: DataFrame) -> DataFrame:
    """Patients that the events have."""
    return filter_by_pids(pi, ev.select(ID).distinct())


def drop_missing_time(df: DataFrame) -> DataFrame:
    return df.where(F.col("time").isNotNull())


def drop_null_events(df: DataFrame) -> DataFrame:
    return df.dropna(how="any", subset=[ID, "time", "code"])


def filter_event_age(df: DataFrame, low: float = -1, high: float = 120) -> DataFrame:
    return df.where(F.col("age").between(low, high))


def exclude_codes_regex(df: DataFrame, regex: str, column: str = "code") -> DataFrame:
    return df.where(~excluded_by_regex(F.col(column), regex))


def rule_holds(column: Column, include: list | None = None, exclude: list | None = None) -> Column:
    if include is not None and exclude is not None:
        raise ValueError("give include or exclude, not both")
    if include is not None:
        return F.coalesce(column.isin(include), F.lit(False))
    return column.isNull() | ~column.isin(exclude) if exclude is not None else F.lit(True)


def filter_by_rule(df: DataFrame, column: str, include: list | None = None, exclude: list | None = None) -> DataFrame:
    return df.where(rule_holds(F.col(column), include, exclude))


def category(df: DataFrame, name: str) -> Column:
    """A background value of a patient table: a column of its own, or an entry of ``background``."""
    return F.col(name) if name in df.columns else F.try_element_at("background", F.lit(name))


def categories_hold(df: DataFrame, rules: dict[str, dict[str, list]]) -> Column:
    """Rules on several columns must all hold; include wins over exclude; null survives exclude."""
    kind = lambda rule: "include" if "include" in rule else "exclude"
    return reduce(and_, [rule_holds(category(df, name), **{kind(rule): rule[kind(rule)]}) for name, rule in rules.items()], F.lit(True))


def filter_by_categories(df: DataFrame, rules: dict[str, dict[str, list]]) -> DataFrame:
    return df.where(categories_hold(df, rules))


def age_holds(low: float | None = None, high: float | None = None) -> Column:
    """Fractional age at the index date, bounds inclusive."""
    age, keep = age_fraction(F.col("time"), F.col("birthdate")), F.lit(True)
    if low is not None:
        keep = keep & (age >= low)
    if high is not None:
        keep = keep & (age <= high)
    return F.coalesce(keep, F.lit(False))


def filter_by_age(pi: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    return pi.where(age_holds(low, high))


def is_alive() -> Column:
    """No death up to the index date."""
    return F.coalesce(F.col("deathdate").isNull() | (F.col("deathdate") > F.col("time")), F.lit(False))


def filter_by_death(pi: DataFrame) -> DataFrame:
    return pi.where(is_alive())


def with_first_outcome(pi: DataFrame, outcomes: DataFrame) -> DataFrame:
    return pi.join(first_events(outcomes).withColumnRenamed("time", "_first"), ID, "left")


def no_prior_outcome() -> Column:
    return F.coalesce(F.col("_first").isNull() | (F.col("_first") >= F.col("time")), F.lit(False))


def filter_by_prior_outcomes(pi: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Drop patients whose earliest outcome lies before their index date."""
    return with_first_outcome(pi, outcomes).where(no_prior_outcome()).drop("_first")


def with_mark(df: DataFrame, pids: DataFrame, name: str) -> DataFrame:
    """``df`` with a flag of the subjects that ``pids`` has."""
    marks = pids.select(ID).distinct().withColumn(name, F.lit(True))
    return df.join(marks, ID, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def cutoff(df: DataFrame, hours: float) -> DataFrame:
    return df.where(F.col("abspos") <= hours)


def dedupe_patients(pi: DataFrame, order: str = "row_id") -> DataFrame:
    first = F.row_number().over(Window.partitionBy(ID).orderBy(order))
    return pi.withColumn("_nth", first).where("_nth = 1").drop("_nth")


def exclude_short_sequences(seqs: DataFrame, min_len: int) -> DataFrame:
    return seqs.where(F.size("events") >= min_len)


def stage_counts(df: DataFrame, steps: dict[str, Column], start: str = "start") -> DataFrame:
    """``(stage, rows, subjects)``: what is left of ``df`` after each step, a row fulfilling it and all
    before.  All steps are counted in one pass; ``df`` has a row per subject, or repeated ones."""
    return attrition(df, steps, start)[1]


def attrition(patients: DataFrame, steps: dict[str, Column], start: str = "start") -> tuple[DataFrame, DataFrame]:
    """The rows that fulfil all steps, and the ``stage_counts`` of all.

    A subject's rows are told by the furthest stage that one of them reaches, so rows and subjects
    come from one grouping by subject, then one by stage.
    """
    names = [start, *steps]
    reached, so_far = F.lit(0), F.lit(True)
    for k, step in enumerate(steps.values(), 1):
        so_far = so_far & F.coalesce(step, F.lit(False))
        reached = F.when(so_far, k).otherwise(reached)
    marked = patients.withColumn("_reached", reached)
    per_subject = marked.groupBy(ID).agg(F.max("_reached").alias("_most"), *[F.count_if(F.col("_reached") >= k).alias(f"_r{k}") for k in range(len(names))])
    sums = per_subject.agg(*[F.sum(f"_r{k}").alias(f"_r{k}") for k in range(len(names))], *[F.count_if(F.col("_most") >= k).alias(f"_s{k}") for k in range(len(names))])
    told = [F.struct(F.lit(name).alias("stage"), F.coalesce(f"_r{k}", F.lit(0)).alias("rows"), F.coalesce(f"_s{k}", F.lit(0)).alias("subjects")) for k, name in enumerate(names)]
    counts = sums.select(F.explode(F.array(*told)).alias("c")).select("c.*")
    return marked.where(F.col("_reached") == len(steps)).drop("_reached"), counts
