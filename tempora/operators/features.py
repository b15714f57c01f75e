"""Featurising events: aggregation, values, background, ages, segments, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import abspos, age_years, background_name, background_value, micros, prefixed_admission, promoted_code, value_bin, value_prefix
from ..schema import ADMISSION, ADMISSION_PREFIX, BACKGROUND_PREFIX, BIRTH, DEATH, DISCHARGE, GAP_HOURS

ID = "subject_id"
PER_SUBJECT = ("split", "shard")  # columns of which a subject has one value
AGGREGATES = {"first", "last", "sum", "mean", "min", "max", "median", "count"}


def _aggregate(name: str, column: str, order: str):
    if name not in AGGREGATES:
        raise ValueError(f"unknown aggregate: {name}")
    if name in ("first", "last"):
        pick = F.min_by if name == "first" else F.max_by
        return pick(column, F.when(F.col(column).isNotNull(), F.col(order)))
    return getattr(F, name)(column)


def aggregate_events(ev: DataFrame, agg: str, regex: str = ".*", window_hours: float | None = None, origin=None) -> DataFrame:
    """Merge events of one subject, code and time (or window of hours) whose code matches
    ``regex`` from its start; other rows and rows without time pass through.  A subject's split and
    shard, where the table has them, stay.

    Windows count from the earliest matching time of the whole table, or ``origin``.
    """
    match = F.coalesce(F.col("code").rlike(f"^(?:{regex})"), F.lit(False)) & F.col("time").isNotNull()
    hit, rest = ev.where(match), ev.where(~match)
    same = [c for c in ev.columns if c in PER_SUBJECT]
    rest_columns = [c for c in ev.columns if c not in (ID, "time", "code", "row_id", *same)]
    out = [_aggregate(agg, c, "row_id").cast(ev.schema[c].dataType).alias(c) for c in rest_columns] + [F.min("row_id").alias("row_id")]
    if window_hours is None:
        done = hit.groupBy(ID, "time", "code", *same).agg(*out)
    else:
        width = int(window_hours * 3_600_000_000)
        start = hit.agg(F.min(micros(F.col("time"))).alias("start")) if origin is None else ev.sparkSession.range(1).select(micros(F.lit(origin)).alias("start"))
        bucket = F.floor((micros(F.col("time")) - F.col("start")) / width)
        time = _aggregate(agg if agg in ("first", "last", "min", "max") else "min", "time", "row_id")
        done = hit.crossJoin(F.broadcast(start)).groupBy(ID, bucket.alias("bucket"), "code", *same).agg(time.alias("time"), *out)  # one row
    return done.select(*ev.columns).unionByName(rest)


def append_value_rows(ev: DataFrame, num_bins: int = 100, prefix_regex: str | None = None) -> DataFrame:
    """Every event, and behind it a row with its binned value; the numeric column goes."""
    code = value_bin(F.col("numeric_value"), num_bins)
    if prefix_regex is not None:
        code = F.concat(value_prefix(F.col("code"), prefix_regex), F.lit("/"), code)
    keep = [c for c in ev.columns if c not in ("code", "numeric_value")]
    make = lambda code, nth: F.struct(*keep, code.alias("code"), F.lit(nth).alias("order"))
    rows = F.array_compact(F.array(make(F.col("code"), 0), F.when(code.isNotNull(), make(code, 1))))
    return ev.select(F.explode(rows).alias("r")).select("r.*")


def attach_birthdate(ev: DataFrame, required: bool = False, windowed: bool = True) -> DataFrame:
    """The last birth row of each subject, by ``row_id``; where it is required, a subject without
    one is an error when its rows are read.  Not ``windowed``, the births are joined, so that a
    subject of very many rows need not be in one task."""
    birth = F.col("code") == BIRTH
    if windowed:
        ev = ev.withColumn("birthdate", F.max_by(F.when(birth, F.col("time")), F.when(birth, F.col("row_id"))).over(Window.partitionBy(ID)))
    else:
        ev = ev.join(ev.where(birth).groupBy(ID).agg(F.max_by("time", "row_id").alias("birthdate")), ID, "left")
    if not required:
        return ev
    missing = F.raise_error(F.concat(F.lit("no birth date: subject "), F.col(ID).cast("string"))).cast(ev.schema["birthdate"].dataType)
    return ev.withColumn("birthdate", F.when(F.col("birthdate").isNull(), missing).otherwise(F.col("birthdate")))


def subjects_without_birth(ev: DataFrame) -> DataFrame:
    return ev.groupBy(ID).agg(F.max((F.col("code") == BIRTH).cast("int")).alias("born")).where("born = 0 or born is null").select(ID)


def promote_background(ev: DataFrame) -> DataFrame:
    code = promoted_code(F.col("code"), F.col("time"))
    return ev.withColumn("code", code).withColumn("time", F.coalesce("time", "birthdate"))


def prefix_admissions(ev: DataFrame) -> DataFrame:
    return ev.withColumn("code", prefixed_admission(F.col("code")))


def patient_info(ev: DataFrame, background: list[str] | None = None) -> DataFrame:
    """One row per subject: birthdate, deathdate, first value of every background name.

    Takes events after ``promote_background``.  Of names given each becomes a column; without any,
    all that the data hold are entries of the map ``background``, so no pass over the data has to
    find them first, and there may be any number.
    """
    code, names = F.col("code"), F.col("code").startswith(BACKGROUND_PREFIX)
    latest = lambda kind: F.max_by(F.when(code == kind, F.col("time")), F.when(code == kind, F.col("row_id")))
    name, value = F.when(names, background_name(code)), background_value(code)
    if background is not None:
        rows = ev.select(*ev.columns, F.when(name.isin(background), name).alias("_name"), value.alias("_value"))
        first = lambda n: F.min_by(F.when(F.col("_name") == n, F.col("_value")), F.when((F.col("_name") == n) & F.col("_value").isNotNull(), F.col("row_id")))
        return rows.groupBy(ID).agg(latest(BIRTH).alias("birthdate"), latest(DEATH).alias("deathdate"), *[first(n).alias(n) for n in background])
    # first by subject and name, whose null holds the dates, so that both come from one shuffle of few rows
    parts = ev.select(ID, "code", "time", "row_id", name.alias("_name"), value.alias("_value")).groupBy(ID, "_name").agg(
        latest(BIRTH).alias("birthdate"), latest(DEATH).alias("deathdate"), F.min_by("_value", F.when(F.col("_value").isNotNull(), F.col("row_id"))).alias("_value")
    )
    entry = F.when(F.col("_name").isNotNull(), F.struct("_name", "_value"))
    return parts.groupBy(ID).agg(F.max("birthdate").alias("birthdate"), F.max("deathdate").alias("deathdate"), F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("background"))


def stay_modes(ev: DataFrame, by: str | None = None) -> DataFrame:
    """``(by, stays)`` of every shard, or one row for the whole table: whether it has both an
    admission and a discharge."""
    some = lambda kind: F.coalesce(F.max(F.col("code").startswith(ADMISSION_PREFIX + kind)), F.lit(False))
    return ev.groupBy(*[by] if by else []).agg((some(ADMISSION) & some(DISCHARGE)).alias("stays"))


def has_stays(ev: DataFrame) -> bool:
    """Whether the table has both an admission and a discharge."""
    return bool(stay_modes(ev).first()[0])


def with_stay_mode(ev: DataFrame, by: str | None = None, name: str = "_stays") -> DataFrame:
    """``ev`` with the mode of its shard, or of the whole table, found when the plan runs."""
    modes = stay_modes(ev, by).withColumnRenamed("stays", name)
    return ev.join(modes, by, "left") if by else ev.crossJoin(F.broadcast(modes))  # one row


def _kind() -> Column:
    code = F.coalesce("code", F.lit(""))
    return F.when(code.startswith(ADMISSION_PREFIX + ADMISSION), "A").when(code.startswith(ADMISSION_PREFIX + DISCHARGE), "D")


def _opens(stays: bool | Column, far: Column, kind: Column, kind_before: Column, last_kind: Column) -> Column:
    """Whether a row opens a segment: ``far`` by the gap rule, ``last_kind`` being that of the last
    admission or discharge before it, ``kind_before`` that of the row before."""
    mine = F.coalesce(kind, F.lit("-"))
    after = F.coalesce(kind_before == "D", F.lit(False))
    by_stay = F.when(mine == "A", True).when(F.coalesce(last_kind == "A", F.lit(False)), False).when(mine == "D", True).otherwise(after | far)
    if isinstance(stays, bool):
        return by_stay if stays else far
    return F.when(F.coalesce(stays, F.lit(False)), by_stay).otherwise(far)


def assign_segments(ev: DataFrame, stays: bool | Column, gap_hours: float = GAP_HOURS, order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``segment`` from 0 in order of first appearance.

    Without stays a segment starts where the gap exceeds ``gap_hours``.  With stays an admission
    opens one, everything up to and with the discharge belongs to it, a lone discharge is one by
    itself, and between stays the gap rule holds.  Deaths go to the last segment.  A column may
    tell for each row which rule holds.
    """
    w = Window.partitionBy(ID).orderBy(F.col("time").asc_nulls_last(), *order)
    gap = (micros(F.col("time")) - micros(F.lag("time").over(w))) > int(gap_hours * 3_600_000_000)
    far = F.lag(F.lit(1)).over(w).isNull() | F.coalesce(gap, F.lit(True))
    ev = ev.withColumn("_kind", _kind())
    before = F.last("_kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    ev = ev.withColumn("_opens", _opens(stays, far, F.col("_kind"), F.lag("_kind").over(w), before).cast("int"))
    ev = ev.withColumn("segment", (F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    last = F.max("segment").over(Window.partitionBy(ID))
    return ev.withColumn("segment", F.when(F.col("code") == DEATH, last).otherwise(F.col("segment"))).drop("_opens", "_kind")


def assign_segments_sliced(ev: DataFrame, stays: bool | Column, slice_hours: float, gap_hours: float = GAP_HOURS, order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    """``segment`` as ``assign_segments`` gives it and ``seq`` as ``order_features`` does, by a scan
    in two levels: no task holds more of a subject than a slice of ``slice_hours``.

    A slice hands on its last time, the kind of its last row and its last admission or discharge;
    what comes before a slice is put together from these, of which a subject has as many as slices.
    A second summary of counts then gives every slice its first number.  ``ev`` is read three times,
    so it should be a stored table.
    """
    key = [ID, "_slice"]
    width = int(slice_hours * 3_600_000_000)
    ev = ev.withColumn("_slice", F.coalesce(F.floor(micros(F.col("time")) / width), F.lit((1 << 63) - 1))).withColumn("_kind", _kind())
    ranked = F.struct(F.col("time").isNull(), "time", *order)
    ends = ev.groupBy(*key).agg(F.max("time").alias("t"), F.max_by("_kind", ranked).alias("k"), F.max_by("_kind", F.when(F.col("_kind").isNotNull(), ranked)).alias("s"))
    slices = Window.partitionBy(ID).orderBy("_slice")
    earlier = slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*key, F.lag(F.lit(1)).over(slices).isNull().alias("_first"), F.lag("t").over(slices).alias("_t"), F.lag("k").over(slices).alias("_k"), F.last("s", ignorenulls=True).over(earlier).alias("_s"))
    w = Window.partitionBy(*key).orderBy(F.col("time").asc_nulls_last(), *order)
    rows = ev.join(carried, key)
    starts = F.lag(F.lit(1)).over(w).isNull()
    time_before = F.when(starts, F.col("_t")).otherwise(F.lag("time").over(w))
    gap = (micros(F.col("time")) - micros(time_before)) > int(gap_hours * 3_600_000_000)
    far = (starts & F.col("_first")) | F.coalesce(gap, F.lit(True))
    kind_before = F.when(starts, F.col("_k")).otherwise(F.lag("_kind").over(w))
    last_kind = F.coalesce(F.last("_kind", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("_s"))
    rows = rows.withColumn("_opens", _opens(stays, far, F.col("_kind"), kind_before, last_kind).cast("int"))
    rows = rows.withColumn("_nth", F.row_number().over(w)).withColumn("_upto", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    sums = rows.groupBy(*key).agg(F.sum("_opens").alias("o"), F.count("*").alias("n"))
    all_slices = Window.partitionBy(ID)
    offsets = sums.select(*key, (F.sum("o").over(slices) - F.col("o")).alias("_o"), (F.sum("n").over(slices) - F.col("n")).alias("_n"), F.sum("o").over(all_slices).alias("_all"))
    rows = rows.join(offsets, key)
    segment = F.when(F.col("code") == DEATH, F.col("_all")).otherwise(F.col("_o") + F.col("_upto")) - 1
    return rows.withColumn("segment", segment.cast("int")).withColumn("seq", (F.col("_n") + F.col("_nth")).cast("int")).drop("_slice", "_kind", "_first", "_t", "_k", "_s", "_opens", "_nth", "_upto", "_o", "_n", "_all")


def order_features(ev: DataFrame, order: tuple[str, ...] = ("row_id",)) -> DataFrame:
    w = Window.partitionBy(ID).orderBy(F.col("time").asc_nulls_last(), *order)
    return ev.withColumn("seq", F.row_number().over(w))


def featurise(ev: DataFrame, birth_required: bool = False, windowed: bool = True) -> DataFrame:
    """Events with birthdate, background and admission prefixes, age and position."""
    ev = prefix_admissions(promote_background(attach_birthdate(ev, birth_required, windowed)))
    ev = ev.withColumn("age", age_years(F.col("time"), F.col("birthdate")))
    return ev.withColumn("abspos", abspos(F.col("time")))
