"""Splits, folds and index dates, on exact distributed ranks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import shift_hours
from .outcomes import first_events

ID = "subject_id"


def exact_rank(df: DataFrame, column: str, order: list[Column], buckets: int = 256) -> DataFrame:
    """``(column, rank)``, rank from 0 in ``order``, without gathering the rows in one task.

    The first order column, a number, is cut at approximate quantiles.  Rows are numbered inside
    their bucket and shifted by the sizes of the buckets before; only those sizes, at most
    ``buckets`` + 1 of them, meet in one place.
    """
    names = [f"_o{k}" for k in range(len(order))]
    rows = df.select(column, *[o.alias(n) for o, n in zip(order, names, strict=True)])
    cuts = rows.agg(F.percentile_approx("_o0", [k / buckets for k in range(1, buckets)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<bigint>")
    rows = rows.withColumn("_b", F.size(F.filter(bounds, lambda c: c < F.col("_o0"))))
    before = rows.groupBy("_b").count().select("_b", (F.sum("count").over(Window.orderBy("_b")) - F.col("count")).alias("_before"))
    local = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_b").orderBy(*names)))
    return local.join(F.broadcast(before), "_b").select(column, (F.col("_before") + F.col("_n") - 1).alias("rank"))


def hash_order(column: str, seed: int) -> list[Column]:
    """Order of a shuffle: by a seeded hash made non-negative, then by the value."""
    return [F.shiftrightunsigned(F.xxhash64(F.col(column), F.lit(seed)), 1), F.col(column)]


def shuffled_rank(ids: DataFrame, seed: int) -> DataFrame:
    return exact_rank(ids.select(ID).distinct(), ID, hash_order(ID, seed))


def _count(ids: DataFrame) -> int:
    return ids.select(ID).distinct().count()


def split_sequential(ids: DataFrame, shares: tuple[float, float, float]) -> DataFrame:
    """Three consecutive shares by id order."""
    if not math.isclose(sum(shares), 1.0):
        raise ValueError("shares must sum to 1")
    n = _count(ids)
    a, b = int(n * shares[0]), int(n * (shares[0] + shares[1]))
    rank = exact_rank(ids.select(ID).distinct(), ID, [F.col(ID).cast("bigint")])
    return rank.select(ID, F.when(F.col("rank") < a, "pretrain").when(F.col("rank") < b, "finetune").otherwise("test").alias("part"))


def split_share(ids: DataFrame, share: float, seed: int = 42, names: tuple[str, str] = ("test", "train_val")) -> DataFrame:
    """A shuffled first share of int(n * share) ids, and the rest."""
    if not 0 <= share <= 1:
        raise ValueError("share must lie in [0, 1]")
    cut = int(_count(ids) * share)
    return shuffled_rank(ids, seed).select(ID, F.when(F.col("rank") < cut, names[0]).otherwise(names[1]).alias("part"))


def split_train_val(ids: DataFrame, val: float, seed: int = 42) -> DataFrame:
    if not 0 < val < 1:
        raise ValueError("the validation share must lie between 0 and 1")
    return split_share(ids, 1 - val, seed, ("train", "val"))


def sample_test(ids: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """A random share of the ids, without replacement, as ``test``; the rest is ``train_val``."""
    if not 0 < share < 1:
        raise ValueError("the share must lie between 0 and 1")
    return split_share(ids, share, seed)


def apply_predefined_split(df: DataFrame, folds: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows of ``df`` by the first of stored folds."""
    if folds is None:
        raise ValueError("a predefined split needs stored folds")
    part = lambda name: df.join(folds.where((F.col("fold") == 0) & (F.col("part") == name)).select(ID), ID, "left_semi")
    return part("train"), part("val")


def create_folds(ids: DataFrame, k: int, seed: int = 42, val_share: float = 0.1) -> DataFrame:
    """``(fold, part, subject_id)``: one split for k = 1, else every id validates one fold."""
    if k < 1:
        raise ValueError("k must be at least 1")
    if k == 1:
        return split_train_val(ids, val_share, seed).select(F.lit(0).alias("fold"), "part", ID)
    ranked = shuffled_rank(ids, seed).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    return ranked.select("fold", F.when(F.col("rank") % k == F.col("fold"), "val").otherwise("train").alias("part"), ID)


def require_disjoint(folds: DataFrame, test: DataFrame) -> None:
    """An error if a test subject is in a fold."""
    shared = overlap(folds, test)
    if not shared.isEmpty():
        raise ValueError(f"{shared.count()} test subjects are in the folds")


def overlap(folds: DataFrame, test: DataFrame) -> DataFrame:
    return folds.select(ID).distinct().join(test.select(ID), ID, "left_semi")


def index_dates_absolute(pids: DataFrame, time: Column) -> DataFrame:
    return pids.select(ID, time.cast("timestamp_ntz").alias("time"))


def index_dates_exposed(exposures: DataFrame, hours: float) -> DataFrame:
    return first_events(exposures).select(ID, shift_hours(F.col("time"), hours).alias("time"))


def index_dates_unexposed(pids: DataFrame, exposed: DataFrame, seed: int = 42) -> DataFrame:
    """Every unexposed patient draws the date of one exposed patient, with replacement."""
    n = exposed.count()
    numbered = exposed.join(exact_rank(exposed.select(ID), ID, [F.col(ID).cast("bigint")]), ID).select("time", "rank")
    rest = pids.select(ID).distinct().join(exposed.select(ID), ID, "left_anti")
    draw = F.pmod(F.xxhash64(ID, F.lit(seed)), F.lit(max(n, 1)))
    return rest.withColumn("rank", draw).join(numbered, "rank").select(ID, "time")
