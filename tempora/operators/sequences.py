"""Per-subject sequences as arrays: building, censoring, truncation, masking, padding."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import DAYS_PER_YEAR, SPECIAL_TOKENS

ID = "subject_id"
SEP, CLS, MASK = SPECIAL_TOKENS["[SEP]"], SPECIAL_TOKENS["[CLS]"], SPECIAL_TOKENS["[MASK]"]
IGNORED = -100


def event(code: Column, position: Column, segment: Column, age: Column) -> Column:
    return F.struct(code.cast("int").alias("code"), position.cast("double").alias("abspos"), segment.cast("int").alias("segment"), age.cast("double").alias("age"))


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once.

    A column that is computed from others and named in a lambda is put in its place there when Spark
    merges projections or moves a filter below them, and then computed again for every element;
    named several times outside, it is multiplied by every filter that passes it.  The operators
    here name their ``events`` once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def to_sequences(tokens: DataFrame) -> DataFrame:
    """One row per subject with ``events`` in ``seq`` order: the one shuffle of the stage."""
    rows = F.sort_array(F.collect_list(F.struct("seq", event(F.col("code"), F.col("abspos"), F.col("segment"), F.col("age")).alias("e"))))
    return tokens.groupBy(ID).agg(F.transform(rows, lambda r: r["e"]).alias("events"))


def to_truncated_sequences(tokens: DataFrame, max_len: int, background: int, sep: int = SEP) -> DataFrame:
    """``truncate()`` of ``to_sequences()`` that gathers of a subject only the rows which may stay:
    the first ``background`` and, counted from its end, ``max_len`` and one more, which tells that
    there are more."""
    front, back = (F.row_number().over(Window.partitionBy(ID).orderBy(o)) for o in (F.asc("seq"), F.desc("seq")))
    rows = tokens.select(ID, "seq", "code", "abspos", "segment", "age")
    rows = rows.withColumn("_front", front).withColumn("_back", back).where((F.col("_front") <= background) | (F.col("_back") <= max_len + 1))
    item = F.struct("seq", event(F.col("code"), F.col("abspos"), F.col("segment"), F.col("age")).alias("e"), (F.col("_front") <= background).alias("head"), F.col("_back").alias("back"))
    tail = max_len - background
    cut = F.coalesce(F.max((F.col("_back") == tail) & (F.col("code") == sep)), F.lit(False)) if tail else F.lit(False)
    held = rows.groupBy(ID).agg(F.sort_array(F.collect_list(item)).alias("r"), cut.alias("_cut"), (F.max("_back") > max_len).alias("_long"))
    kept = F.filter("r", lambda r: r["head"] | (r["back"] <= F.lit(tail) - F.col("_cut").cast("int")) | ~F.col("_long"))
    return held.select(ID, F.transform(kept, lambda r: r["e"]).alias("events"))


def background_rows(tokens: DataFrame, background_ids: list[int]) -> int:
    """``background_length()`` of rows: only those of one subject are looked at."""
    least = tokens.agg(F.min(ID)).first()[0]
    if least is None:
        return 2
    mine = tokens.where((F.col(ID) == least) & is_one_of(F.col("code"), background_ids))
    return mine.select("code").distinct().count() + 2


def explode_sequences(seqs: DataFrame) -> DataFrame:
    keep = [c for c in seqs.columns if c != "events"]
    return seqs.select(*keep, F.posexplode("events").alias("pos", "e")).select(*keep, "pos", "e.*")


def lengths(seqs: DataFrame) -> DataFrame:
    """``(subject_id, n, max_segment)``."""
    return seqs.select(ID, F.size("events").cast("bigint").alias("n"), F.array_max(F.transform("events", lambda e: e["segment"])).alias("max_segment"))


def totals(seqs: DataFrame) -> DataFrame:
    """One row: subjects, events and the greatest segment of all."""
    return lengths(seqs).agg(F.count("*").alias("subjects"), F.sum("n").alias("events"), F.max("max_segment").alias("max_segment"))


def check_sorted(tokens: DataFrame) -> DataFrame:
    """Subjects with a position below the one before, and how many such."""
    w = Window.partitionBy(ID).orderBy("seq")
    return tokens.withColumn("_d", F.col("abspos") < F.lag("abspos").over(w)).groupBy(ID).agg(F.count_if("_d").alias("violations")).where("violations > 0")


def require_sorted(seqs: DataFrame) -> DataFrame:
    """``seqs``; a position below the one before is an error when the sequence is read."""
    steps = lambda ev: F.transform(ev, lambda e, i: F.coalesce(e["abspos"] < F.get(ev, i - 1)["abspos"], F.lit(False)))
    wrong = F.raise_error(F.concat(F.lit("positions not in order: subject "), F.col(ID).cast("string"))).cast(seqs.schema["events"].dataType)
    return seqs.withColumn("events", bound(F.col("events"), lambda ev: F.when(F.exists(steps(ev), lambda x: x), wrong).otherwise(ev)))


def combine(*sets: DataFrame) -> DataFrame:
    """The rows of several sequence sets, all kept."""
    return reduce(DataFrame.unionByName, sets)


def strip_last_sep(events: Column, sep: int = SEP) -> Column:
    ends = lambda ev: F.coalesce(F.try_element_at(ev, F.lit(-1))["code"] == sep, F.lit(False))
    return bound(events, lambda ev: F.when(ends(ev), F.slice(ev, 1, F.greatest(F.size(ev) - 1, F.lit(0)))).otherwise(ev))


def append_predict(events: Column, date: Column, token: int = CLS) -> Column:
    """The prediction token: segment after the last, age since the first position in years."""
    segment = lambda ev: F.coalesce(F.try_element_at(ev, F.lit(-1))["segment"] + 1, F.lit(0))
    age = lambda ev: F.coalesce((date - F.try_element_at(ev, F.lit(1))["abspos"]) / F.lit(DAYS_PER_YEAR * 24), F.lit(0.0))
    return bound(events, lambda ev: F.concat(ev, F.array(event(F.lit(token), date, segment(ev), age(ev)))))


def censor(seqs: DataFrame, date: str = "censor_date", token: int = CLS) -> DataFrame:
    """Keep events up to the date, drop one separator at the end, append the prediction token."""
    kept = F.filter("events", lambda e: e["abspos"] <= F.col(date))
    seqs = seqs.withColumn("events", strip_last_sep(kept))
    return seqs.withColumn("events", append_predict(F.col("events"), F.col(date), token))


def censor_with_delays(seqs: DataFrame, delays: dict[int, float], date: str = "censor_date", token: int = CLS) -> DataFrame:
    """As ``censor`` with a delay in hours per token id; a separator at the end stays."""
    late = F.create_map(*[F.lit(x) for kv in delays.items() for x in (kv[0], float(kv[1]))]) if delays else None
    delay = (lambda e: F.coalesce(F.try_element_at(late, e["code"]), F.lit(0.0))) if delays else (lambda e: F.lit(0.0))
    seqs = seqs.withColumn("events", F.filter("events", lambda e: e["abspos"] <= F.col(date) + delay(e)))
    return seqs.withColumn("events", append_predict(F.col("events"), F.col(date), token))


def truncate(seqs: DataFrame, max_len: int, background: int, sep: int = SEP) -> DataFrame:
    """Keep the first ``background`` and the last events; a separator at the cut goes."""
    tail = max_len - background

    def short(ev: Column) -> Column:
        cut = F.try_element_at(ev, F.greatest(F.size(ev) - tail + 1, F.lit(1)))["code"] == sep if tail else F.lit(False)
        n = F.lit(tail) - F.coalesce(cut, F.lit(False)).cast("int")
        return F.concat(F.slice(ev, 1, background), F.slice(ev, F.size(ev) - n + 1, n))

    return seqs.withColumn("events", bound(F.col("events"), lambda ev: F.when(F.size(ev) > max_len, short(ev)).otherwise(ev)))


def is_one_of(code: Column, ids: list[int]) -> Column:
    """Whether a token id is one of ``ids``, of which there are at most a vocabulary: a look-up in
    a hash set, so its cost does not grow with their number."""
    return code.isin(ids) if ids else F.lit(False)


def truncate_prioritized(seqs: DataFrame, max_len: int, background: int, non_priority: list[int], sep: int = SEP) -> DataFrame:
    """Where too long, keep the background and the first other tokens of priority, then truncate."""

    def short(ev: Column) -> Column:
        rest = F.slice(ev, background + 1, F.greatest(F.size(ev) - background, F.lit(0)))
        wanted = F.filter(rest, lambda e: ~is_one_of(e["code"], non_priority))
        return F.concat(F.slice(ev, 1, background), F.slice(wanted, 1, max_len - background))

    seqs = seqs.withColumn("events", bound(F.col("events"), lambda ev: F.when(F.size(ev) > max_len, short(ev)).otherwise(ev)))
    return truncate(seqs, max_len, background, sep)


def drop_incomplete_units(seqs: DataFrame, non_priority: list[int], parts: int) -> DataFrame:
    """Drop low-priority tokens at a position that does not hold all ``parts`` of their unit.

    The positions of low-priority tokens are sorted once; a position of a whole unit has exactly
    ``parts`` neighbours, so the work grows with the sequence times its logarithm.
    """
    low = lambda e: is_one_of(e["code"], non_priority)
    places = lambda ev: F.sort_array(F.transform(F.filter(ev, low), lambda e: e["abspos"]))
    is_at = lambda at, i, p: F.coalesce(F.get(at, i) == p, F.lit(False))
    whole = lambda at: F.filter(at, lambda p, i: ~is_at(at, i - 1, p) & is_at(at, i + parts - 1, p) & ~is_at(at, i + parts, p))
    by_name = lambda at: F.map_from_arrays(F.transform(at, lambda p: p.cast("string")), at)
    known = lambda ev: bound(bound(places(ev), whole), by_name)
    kept = lambda ev, known: F.filter(ev, lambda e: ~low(e) | F.map_contains_key(known, e["abspos"].cast("string")))
    return seqs.withColumn("events", bound(F.col("events"), lambda ev: bound(known(ev), lambda k: kept(ev, k))))


def normalize_segments(seqs: DataFrame) -> DataFrame:
    """Segments renumbered densely from 0 in their own order."""
    known = lambda ev: F.array_sort(F.array_distinct(F.transform(ev, lambda e: e["segment"])))
    dense = lambda ev, known: F.transform(ev, lambda e: event(e["code"], e["abspos"], F.array_position(known, e["segment"]) - 1, e["age"]))
    return seqs.withColumn("events", bound(F.col("events"), lambda ev: bound(known(ev), lambda k: dense(ev, k))))


def background_length(seqs: DataFrame, background_ids: list[int]) -> int:
    """Distinct background tokens of the subject with the least id, plus leading and separator."""
    codes = F.transform("events", lambda e: e["code"])
    n = F.size(F.array_distinct(F.filter(codes, lambda c: c.isin(background_ids))))
    return int(seqs.agg(F.min_by(n, ID)).first()[0] or 0) + 2


def token_ids(vocabulary: DataFrame, prefixes: list[str]) -> DataFrame:
    from ..functions.scalars import match_startswith

    return vocabulary.where(match_startswith(F.col("code"), prefixes)).select("code", "token_id")


def concept_delays(vocabulary: DataFrame, delays: dict[str, float]) -> DataFrame:
    """``(token_id, delay)`` of codes in which a pattern is found; a later pattern wins."""
    delay = F.lit(None).cast("double")
    for pattern, hours in delays.items():
        delay = F.when(F.col("code").rlike(pattern), F.lit(float(hours))).otherwise(delay)
    return vocabulary.select("token_id", delay.alias("delay")).where("delay is not null")


def subset(seqs: DataFrame, positions: Column) -> DataFrame:
    return seqs.withColumn("events", bound(F.col("events"), lambda ev: F.transform(positions, lambda i: F.get(ev, i))))


def mask_tokens(seqs: DataFrame, vocabulary_size: int, select: float = 0.2, mask: float = 0.8, replace: float = 0.1, seed: int = 0) -> DataFrame:
    """Adds ``input`` and ``target``: of the ordinary tokens a share is selected; of these most
    become the mask, some a random ordinary token; targets elsewhere are ignored.

    Draws hash subject, position and seed, so a task that runs again masks the same tokens.
    """
    special = len(SPECIAL_TOKENS)
    draw = lambda i, salt: F.pmod(F.xxhash64(F.col(ID), i, F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1_000_000
    chosen = lambda e, i: (e["code"] >= special) & (draw(i, 1) < select)
    other = lambda i: (special + F.floor(draw(i, 3) * (vocabulary_size - special))).cast("int")
    new = lambda e, i: F.when(~chosen(e, i) | (draw(i, 2) >= mask + replace), e["code"]).when(draw(i, 2) < mask, MASK).otherwise(other(i))
    target = lambda e, i: F.when(chosen(e, i), e["code"]).otherwise(IGNORED)
    return seqs.withColumn("input", F.transform("events", new)).withColumn("target", F.transform("events", target))


def pad(seqs: DataFrame, group: str) -> DataFrame:
    """Codes, positions, segments and ages padded with 0 to the longest of each ``group``, the
    attention mask, and ``target``, where there is one, padded with the ignored value."""
    seqs = seqs.withColumn("_n", F.max(F.size("events")).over(Window.partitionBy(group)))
    missing = F.col("_n") - F.size("events")
    fill = lambda values, x, kind: F.concat(values, F.array_repeat(F.lit(x).cast(kind), missing))
    field = lambda name: F.transform("events", lambda e: e[name])
    made = {"codes": fill(field("code"), 0, "int"), "positions": fill(field("abspos"), 0, "double"), "segments": fill(field("segment"), 0, "int"), "ages": fill(field("age"), 0, "double"), "attention": fill(F.transform("events", lambda e: F.lit(1)), 0, "int")}
    if "target" in seqs.columns:
        made["target"] = fill(F.col("target"), IGNORED, "int")
    return seqs.withColumns(made).drop("_n")


def one_hot(seqs: DataFrame) -> DataFrame:
    """``(subject_id, token_id)`` once per ordinary token, and the last age in ``last_age``."""
    codes = F.array_distinct(F.filter(F.transform("events", lambda e: e["code"]), lambda c: c >= len(SPECIAL_TOKENS)))
    age = F.coalesce(F.try_element_at("events", F.lit(-1))["age"], F.lit(0.0))
    return seqs.select(ID, F.explode(codes).alias("token_id"), age.alias("last_age"))


def map_patients(seqs: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """A user's function on batches of subjects as pandas frames."""
    return seqs.mapInPandas(fn, schema)
