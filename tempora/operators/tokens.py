"""Mapping codes to tokens: cutoffs, vocabulary, special tokens, order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import limit_code_length
from ..schema import CLS_SHIFT, SEP_SHIFT, SPECIAL_TOKENS
from .features import PER_SUBJECT

ID = "subject_id"


def map_codes(df: DataFrame, mapping: DataFrame) -> DataFrame:
    """Replace codes that ``mapping(code, new_code)`` knows."""
    return df.join(mapping.select("code", "new_code"), "code", "left").withColumn("code", F.coalesce("new_code", "code")).drop("new_code")


def cut_codes(df: DataFrame, limits: dict[str, int]) -> DataFrame:
    return df.withColumn("code", limit_code_length(F.col("code"), limits))


def build_vocabulary(df: DataFrame, base: dict[str, int] | None = None) -> DataFrame:
    """``(code, token_id)``: the base tokens, then the codes of ``df`` in order.

    The vocabulary is the one table that is numbered in one task: it holds distinct codes only.
    """
    base = dict(SPECIAL_TOKENS if base is None else base)
    fixed = df.sparkSession.createDataFrame(sorted(base.items(), key=lambda kv: kv[1]), "code string, token_id int")
    new = df.where("code is not null").select("code").distinct().join(F.broadcast(fixed), "code", "left_anti")
    start = max(base.values(), default=-1)
    return fixed.unionByName(new.select("code", (F.row_number().over(Window.orderBy("code")) + start).alias("token_id")))


def add_special_tokens(df: DataFrame) -> DataFrame:
    """A leading row per subject, and a separator behind each row whose successor has another
    segment; ``seq`` orders the result.

    The leading row takes the first value that is not null of every column, at a position a
    little before it, in segment 0; a subject's split, where the table has it, stays.  On equal positions rows come before leading rows, and these
    before separators.
    """
    w = Window.partitionBy(ID).orderBy("abspos", "segment", "seq")
    columns, same = ["age", "abspos", "segment", "code"], [c for c in PER_SUBJECT if c in df.columns]
    nth = F.row_number().over(Window.partitionBy(ID).orderBy("seq"))
    whole = Window.partitionBy(ID)
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).over(whole)
    row = lambda age, pos, segment, code, rank: F.struct(age.alias("age"), pos.alias("abspos"), segment.alias("segment"), code.alias("code"), F.lit(rank).alias("rank"))
    df = df.withColumn("_next", F.lead("segment").over(w)).withColumn("_nth", nth).withColumn("_age", first("age")).withColumn("_pos", first("abspos"))
    plain = row(*map(F.col, columns), 0)
    cls = F.when(F.col("_nth") == 1, row(F.col("_age"), F.col("_pos") + CLS_SHIFT, F.lit(0), F.lit("[CLS]"), 1))
    sep = F.when(F.col("_next") != F.col("segment"), row(F.col("age"), F.col("abspos") + SEP_SHIFT, F.col("segment"), F.lit("[SEP]"), 2))
    out = df.select(ID, *same, F.col("seq").alias("_seq"), F.explode(F.array_compact(F.array(plain, cls, sep))).alias("r")).select(ID, *same, "_seq", "r.*")
    order = Window.partitionBy(ID).orderBy("abspos", "rank", "segment", "_seq")
    return out.withColumn("seq", F.row_number().over(order)).drop("_seq", "rank")


def tokenize(df: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Codes to ids; unknown codes become [UNK]."""
    ids = vocabulary.select("code", "token_id")
    return df.join(ids, "code", "left").withColumn("code", F.coalesce("token_id", F.lit(SPECIAL_TOKENS["[UNK]"])).cast("int")).drop("token_id")
