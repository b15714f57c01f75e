"""Outcomes by code matching and by combinations in time; labels."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import abspos, hours_truncated, match_columns

ID = "subject_id"


MANY_PATTERNS = 64


def match_codes(ev: DataFrame, column: str, patterns: list[str], how: str = "startswith", case_sensitive: bool = True) -> DataFrame:
    """Rows whose text matches one of very many patterns: the distinct texts are matched once, and
    the rows joined to those that do."""
    known = ev.select(F.col(column).alias("_known")).where("_known is not null").distinct()
    hit = known.where(match_columns(["_known"], [patterns], how, case_sensitive))
    return ev.join(hit, F.col(column) == F.col("_known"), "left_semi")


def match_events(ev: DataFrame, types: list[str], patterns: list[list[str]], how: str = "startswith", case_sensitive: bool = True, exclude: list[str] | None = None, negation: bool | None = None) -> DataFrame:
    """Rows that match; ``exclude`` drops exact codes first, a given ``negation`` inverts."""
    if exclude:
        ev = ev.where(F.col("code").isNull() | ~F.col("code").isin(exclude))
    if negation is None and how == "contains" and any(len(p) > MANY_PATTERNS for p in patterns):
        for column, some in zip(types, patterns, strict=True):
            ev = match_codes(ev, column, some, how, case_sensitive)
        return ev
    mask = match_columns(types, patterns, how, case_sensitive)
    return ev.where(~mask if negation is not None else mask)


def with_position(ev: DataFrame) -> DataFrame:
    return ev.where("time is not null").withColumn("abspos", abspos(F.col("time")))


def _binned(primary: DataFrame, secondary: DataFrame, min_hours: float, max_hours: float) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_bin``, a stretch of time as wide as the window: a primary row has one,
    a secondary row those of all primary rows that it may match, two or three.  Joined by subject
    and bin, the rows of a subject with very many events spread, and most pairs out of reach
    never meet; a pair in reach meets once."""
    width = max(max_hours - min_hours, 1.0)
    if not math.isfinite(width):
        return primary.withColumn("_bin", F.lit(0)), secondary.withColumn("_bin", F.lit(0))
    at, slack = F.col("abspos"), 1e-6  # rounding may move a row over the edge of a bin
    low, high = F.floor((at - max_hours - slack) / width), F.floor((at - min_hours + slack) / width)
    return primary.withColumn("_bin", F.floor(at / width)), secondary.where(at.isNotNull() & (low <= high)).withColumn("_bin", F.explode(F.sequence(low, high)))


def match_combinations(primary: DataFrame, secondary: DataFrame, min_hours: float, max_hours: float) -> DataFrame:
    """Primary rows with a secondary event of their subject within the hours, ends included."""
    p, s = _binned(primary, secondary.select(ID, "abspos").distinct(), min_hours, max_hours)
    s = s.select(F.col(ID).alias("_id"), F.col("_bin").alias("_sbin"), F.col("abspos").alias("_at"))
    near = (F.col(ID) == F.col("_id")) & (F.col("_bin") == F.col("_sbin")) & F.col("_at").between(F.col("abspos") + min_hours, F.col("abspos") + max_hours)
    return p.join(s, near, "left_semi").drop("_bin")


def closest_secondary(primary: DataFrame, secondary: DataFrame, min_hours: float, max_hours: float) -> DataFrame:
    """For each matched primary row the secondary event nearest in time, the first on ties."""
    p, s = _binned(primary, secondary, min_hours, max_hours)
    p = p.select(F.col(ID).alias("_id"), F.col("_bin").alias("_pbin"), F.col("row_id").alias("primary_row"), F.col("abspos").alias("_at"))
    near = (F.col(ID) == F.col("_id")) & (F.col("_bin") == F.col("_pbin")) & F.col("abspos").between(F.col("_at") + min_hours, F.col("_at") + max_hours)
    gap = F.struct(F.abs(F.col("abspos") - F.col("_at")), "row_id")
    pick = F.min_by(F.struct(*secondary.columns), gap).alias("s")
    return s.join(p, near).groupBy("_id", "primary_row").agg(pick).select("primary_row", "s.*")


def first_events(ev: DataFrame) -> DataFrame:
    """``(subject_id, time)``: the earliest event of each subject that has one with a time."""
    return ev.where("time is not null").groupBy(ID).agg(F.min("time").alias("time"))


def outcome_table(matched: DataFrame) -> DataFrame:
    return matched.select(ID, "time", hours_truncated(F.col("abspos")).alias("abspos"))


def build_outcomes(ev: DataFrame, specs: dict[str, dict]) -> DataFrame:
    """All named outcomes in one table with an ``outcome`` column.

    A spec has ``type``, ``match`` and options of ``match_events``; or ``combinations`` with
    ``primary``, ``secondary``, ``window_hours_min``, ``window_hours_max`` and
    ``timestamp_source``.
    """
    ev, parts = with_position(ev), []

    def matched(spec: dict) -> DataFrame:
        options = {k: spec[k] for k in ("case_sensitive", "exclude", "negation") if k in spec}
        return match_events(ev, spec["type"], spec["match"], spec.get("match_how", "startswith"), **options)

    for name, spec in specs.items():
        if "combinations" in spec:
            c = spec["combinations"]
            args = matched(c["primary"]), matched(c["secondary"]), c["window_hours_min"], c["window_hours_max"]
            rows = closest_secondary(*args) if c.get("timestamp_source") == "secondary" else match_combinations(*args)
        else:
            rows = matched(spec)
        parts.append(outcome_table(rows).withColumn("outcome", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def label_binary(index_dates: DataFrame, outcomes: DataFrame, start: float, end: float | None = None) -> DataFrame:
    """1 where an outcome falls into the hours after the index date, ends included, else 0."""
    o = outcomes.select(ID, F.col("abspos").alias("_at"))
    after = F.col("_at") - F.col("abspos")
    inside = (after >= start) & (after <= end) if end is not None else after >= start
    label = F.coalesce(F.max(F.when(inside, 1).otherwise(0)), F.lit(0)).cast("int").alias("outcome")
    return index_dates.select(ID, "abspos").join(o, ID, "left").groupBy(ID).agg(label)
