"""Scalar functions on event columns: time, age, codes, values, predicates."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import ADMISSION, ADMISSION_PREFIX, BACKGROUND_PREFIX, DAYS_PER_YEAR, DISCHARGE, VALUE_PREFIX

_EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(time: Column) -> Column:
    """Microseconds since the epoch of a zone-free time, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.expr(_EPOCH), time.cast("timestamp_ntz"))


def abspos(time: Column) -> Column:
    """Hours since the epoch, whole seconds, floored also before it."""
    m = micros(time)
    return ((m - F.pmod(m, F.lit(1_000_000))) / 1_000_000) / F.lit(3600.0)


def hours_truncated(hours: Column) -> Column:
    return hours.cast("bigint")


def age_years(time: Column, birthdate: Column) -> Column:
    """Whole years: floored days over 365.25, floored."""
    days = F.floor((micros(time) - micros(birthdate)) / F.lit(86_400_000_000.0))
    return F.floor(days / F.lit(DAYS_PER_YEAR)).cast("double")


def age_fraction(time: Column, birthdate: Column) -> Column:
    """Fractional years, used for eligibility."""
    return (micros(time) - micros(birthdate)) / F.lit(1e6 * 86_400 * DAYS_PER_YEAR)


def shift_hours(time: Column, hours: float) -> Column:
    return time + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(hours * 3600).cast("decimal(18,6)"))


def promoted_code(code: Column, time: Column) -> Column:
    return F.when(time.isNull(), F.concat(F.lit(BACKGROUND_PREFIX), code)).otherwise(code)


def prefixed_admission(code: Column) -> Column:
    stay = code.contains(ADMISSION) | code.contains(DISCHARGE)
    return F.when(stay, F.concat(F.lit(ADMISSION_PREFIX), code)).otherwise(code)


def value_bin(value: Column, num_bins: int = 100) -> Column:
    """``VAL_n`` for a numeric value expected in [0, 1]; null for text."""
    return F.concat(F.lit(VALUE_PREFIX), (value.try_cast("double") * num_bins).cast("bigint").cast("string"))


def value_prefix(code: Column, regex: str) -> Column:
    """Group 1 of ``regex`` in the code, else UNK."""
    return F.coalesce(F.nullif(F.regexp_extract(code, regex, 1), F.lit("")), F.lit("UNK"))


def limit_code_length(code: Column, limits: dict[str, int]) -> Column:
    """Cut codes that start with a prefix; rules apply in order, each to the result before."""
    for prefix, length in limits.items():
        if length < len(prefix):
            raise ValueError(f"cutoff of {prefix!r} is shorter than the prefix")
        code = F.when(code.startswith(prefix), F.substring(code, 1, length)).otherwise(code)
    return code


def background_name(code: Column) -> Column:
    return F.nullif(F.replace(F.element_at(F.split(code, "//"), 1), F.lit(BACKGROUND_PREFIX), F.lit("")), F.lit(""))


def background_value(code: Column) -> Column:
    return F.try_element_at(F.split(code, "//"), F.lit(2))


def match_startswith(column: Column, patterns: list[str], case_sensitive: bool = True) -> Column:
    """The text begins with one of the patterns: a look-up of its beginning for each length that
    the patterns have, so the work does not grow with their number."""
    text = column.cast("string")
    if not case_sensitive:
        text, patterns = F.lower(text), [p.lower() for p in patterns]
    by_length: dict[int, list[str]] = {}
    for pattern in sorted(set(patterns)):
        by_length.setdefault(len(pattern), []).append(pattern)
    return F.coalesce(reduce(or_, [F.substring(text, 1, n).isin(same) for n, same in by_length.items()]), F.lit(False))


def alternation(patterns: list[str]) -> str | None:
    """One regular expression for all of them; none where one counts its groups or sets flags for
    what follows."""
    if any(re.search(r"\\[1-9]|\\k<|\(\?<[A-Za-z]|\(\?[a-z-]+\)", p) for p in patterns):
        return None
    return "|".join(f"(?:{p})" for p in dict.fromkeys(patterns))


def match_contains(column: Column, patterns: list[str], case_sensitive: bool = True) -> Column:
    """Any of the regular expressions is found."""
    flag = "" if case_sensitive else "(?i)"
    whole = alternation(patterns)
    chosen = patterns if whole is None else [whole]
    return F.coalesce(reduce(or_, [column.cast("string").rlike(flag + p) for p in chosen]), F.lit(False))


def match_columns(types: list[str], patterns: list[list[str]], how: str = "startswith", case_sensitive: bool = True) -> Column:
    """One predicate per column, all of which must hold."""
    match = {"startswith": match_startswith, "contains": match_contains}.get(how)
    if match is None:
        raise ValueError(f"unknown match kind: {how}")
    return reduce(and_, [match(F.col(t), p, case_sensitive) for t, p in zip(types, patterns, strict=True)])


def excluded_by_regex(column: Column, regex: str) -> Column:
    """The regex is found anywhere, in either case; null never matches."""
    return F.coalesce(column.cast("string").rlike("(?i)" + regex), F.lit(False))


def sigmoid(logit: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))
