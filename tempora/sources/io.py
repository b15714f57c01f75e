"""Readers and writers: events by split, concept files, vocabularies, ids, tables of a run."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import EVENTS, FEATURES


def require_columns(df: DataFrame, columns: list[str], name: str = "table") -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{name} lacks the columns {missing}")
    return df


def cast_schema(df: DataFrame) -> DataFrame:
    """Cast the known columns; what cannot be read as its type becomes null."""
    kinds = {f.name: f.dataType for f in EVENTS}
    return df.select(*[F.col(c).try_cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def read_meds(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Events from parquet or csv, without time zone.  Where the files do not number their rows,
    ``row_id`` does, in the order in which they are read; so write what is read before it is read
    again, if ties in time matter."""
    if kind not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {kind}")
    rows = cast_schema(spark.read.parquet(path) if kind == "parquet" else spark.read.csv(path, header=True))
    return rows if "row_id" in rows.columns else rows.withColumn("row_id", F.monotonically_increasing_id())


def entries(spark: SparkSession, root: str) -> list[str]:
    """Names under ``root``, hidden and marker files left out."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(where)
    return sorted(name for name in (f.getPath().getName() for f in found) if name[:1] not in "._")


def split_names(spark: SparkSession, root: str, splits: list[str] | None = None, optional: tuple[str, ...] = ("held_out",)) -> list[str]:
    """The splits under ``root``: folders that hold parquet files; or those listed, of which an
    optional one may be absent."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    is_folder = lambda name: files.getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(where, name)).isDirectory()
    there = [name for name in entries(spark, root) if is_folder(name) and any(f.endswith(".parquet") for f in entries(spark, f"{root}/{name}"))]
    missing = [s for s in splits or [] if s not in there and s not in optional]
    if missing:
        raise ValueError(f"no split {missing[0]!r} under {root}")
    found = [s for s in splits or there if s in there]
    if not found:
        raise ValueError(f"no split under {root}")
    return found


def names_of(spark: SparkSession, path: str, column: str) -> list[str]:
    """Values of the column by which a table was written into folders."""
    return [name.removeprefix(f"{column}=") for name in entries(spark, path) if name.startswith(f"{column}=")]


def read_splits(spark: SparkSession, root: str, splits: list[str] | None = None, optional: tuple[str, ...] = ("held_out",), pids: DataFrame | None = None, shard: bool = False) -> DataFrame:
    """All shards of the splits of ``split_names()``, with a ``split`` column; with ``shard`` also the
    file that a row comes from, with ``pids`` only the rows of these subjects."""
    parts = [read_meds(spark, f"{root}/{s}").withColumn("split", F.lit(s)) for s in split_names(spark, root, splits, optional)]
    if shard:
        parts = [p.withColumn("shard", F.input_file_name()) for p in parts]
    rows = reduce(DataFrame.unionByName, parts)
    return rows if pids is None else rows.join(pids.select("subject_id").distinct(), "subject_id", "left_semi")


def read_clinical(spark: SparkSession, root: str, types: list[str] | None = None, ordered: bool = False) -> tuple[DataFrame, DataFrame]:
    """``(patients, concepts)`` of a folder with ``patients_info.<format>`` and ``concept.<type>.<format>``,
    parquet or csv, of all types or those listed; exact duplicates among the concepts count once.
    ``ordered`` sorts them by time, which costs a shuffle that nothing here needs."""
    there = entries(spark, root)

    def load(name: str) -> DataFrame:
        return spark.read.parquet(f"{root}/{name}") if name.endswith(".parquet") else spark.read.csv(f"{root}/{name}", header=True, inferSchema=True)

    concepts, patients = [n for n in there if n.startswith("concept.")], [n for n in there if n.startswith("patients_info.")]
    if not concepts or not patients:
        raise ValueError(f"{root} lacks patients_info or concept tables")
    if types is not None:
        missing = sorted(set(types) - {n.split(".")[1] for n in concepts})
        if missing:
            raise ValueError(f"no concept table of type {missing[0]!r} under {root}")
        concepts = [n for n in concepts if n.split(".")[1] in types]
    rows = read_concept_files([load(n) for n in concepts])
    return load(patients[0]), rows.orderBy("TIMESTAMP") if ordered else rows


def read_concept_files(tables: list[DataFrame]) -> DataFrame:
    """Concept tables together, exact duplicates once."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables).dropDuplicates()


def write_by_split(df: DataFrame, path: str, order: tuple[str, ...] = ("subject_id", "seq")) -> None:
    df.repartition("split", "subject_id").sortWithinPartitions(*order).write.mode("overwrite").partitionBy("split").parquet(path)


def write_features(feats: DataFrame, path: str) -> None:
    """Features by split, in the types of ``FEATURES``; a missing column or a value that its type
    cannot hold is an error."""
    require_columns(feats, [*(f.name for f in FEATURES), "split"], "features")
    write_by_split(feats.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in FEATURES], "split"), path)


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Tokens by split; their codes are numbers."""
    require_columns(tokens, [*(f.name for f in FEATURES), "split"], "tokens")
    kinds = {f.name: f.dataType for f in FEATURES} | {"code": T.IntegerType()}
    write_by_split(tokens.select(*[F.col(c).cast(k).alias(c) for c, k in kinds.items()], "split"), path)


def read_split_pids(spark: SparkSession, path: str) -> DataFrame:
    """``(split, subject_id)`` of a table written by split: of its files only that column is read."""
    return spark.read.parquet(path).select("split", "subject_id").distinct()


def write_split_pids(table: DataFrame, path: str) -> None:
    """Distinct ids, a folder for each split."""
    table.select("split", "subject_id").distinct().write.mode("overwrite").partitionBy("split").parquet(path)


def write_patient_info(info: DataFrame, path: str) -> None:
    """One table of the patients of all splits."""
    require_columns(info, ["subject_id", "birthdate", "deathdate"], "patient info").write.mode("overwrite").parquet(path)


def write_outcomes(outcomes: DataFrame, path: str, names: list[str] | None = None, kind: str = "parquet") -> None:
    """Outcome tables, one folder per outcome, parquet or csv; of those named, one without rows gives
    a warning."""
    options = {"header": True} if kind == "csv" else {}
    outcomes.write.mode("overwrite").partitionBy("outcome").format(kind).options(**options).save(path)
    if names:
        there = entries(outcomes.sparkSession, path)
        for name in names:
            if f"outcome={name}" not in there:
                warnings.warn(f"outcome {name!r} has no rows", stacklevel=2)


def write_cohort(cohort: dict[str, DataFrame], path: str) -> None:
    """Ids, index dates and, where there are any, test ids and folds."""
    cohort["pids"].select("subject_id").distinct().write.mode("overwrite").parquet(f"{path}/pids")
    cohort["index_dates"].select("subject_id", "time").write.mode("overwrite").parquet(f"{path}/index_dates")
    for name in ("test_pids", "folds"):
        if not cohort[name].isEmpty():
            cohort[name].write.mode("overwrite").parquet(f"{path}/{name}")


def read_cohort(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in entries(spark, path)}


def write_sequences(seqs: DataFrame, path: str, vocabulary: DataFrame, outcomes: DataFrame | None = None, index: DataFrame | None = None) -> None:
    """Prepared sequences with what they were made from."""
    parts = {"sequences": seqs, "vocabulary": vocabulary, "outcomes": outcomes, "index_dates": index}
    for name, df in parts.items():
        if df is not None:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def write_evaluation(tables: dict[str, DataFrame], path: str) -> None:
    """Predictions, metrics, curves and importances as csv, a folder each."""
    for name, df in tables.items():
        df.write.mode("overwrite").csv(f"{path}/{name}", header=True)


def write_pids(df: DataFrame, path: str) -> None:
    df.select("subject_id").distinct().write.mode("overwrite").parquet(path)


def read_pids(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths).select("subject_id").distinct()


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    vocabulary.select("code", "token_id").coalesce(1).write.mode("overwrite").parquet(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), ["code", "token_id"], "vocabulary").select("code", "token_id")


def read_code_mapping(spark: SparkSession, path: str | None) -> DataFrame | None:
    """``(code, new_code)``; without a path there is no mapping."""
    return None if path is None else require_columns(spark.read.parquet(path), ["code", "new_code"], "code mapping").select("code", "new_code")


def to_meds(patients: DataFrame, concepts: DataFrame, background: list[str]) -> DataFrame:
    """Wide clinical tables to events.

    ``patients(PID, BIRTHDATE, DEATHDATE, ...)``; ``concepts(PID, TIMESTAMP, CONCEPT[, RESULT])``.
    String ids become dense numbers, in the order of a hash.
    """
    from ..operators.splits import exact_rank, hash_order

    ids = exact_rank(patients.select("PID").distinct(), "PID", hash_order("PID", 0)).select("PID", F.col("rank").alias("subject_id"))
    row = lambda time, code: F.struct(time.cast("timestamp_ntz").alias("time"), code.alias("code"))
    facts = [row(F.col("BIRTHDATE"), F.lit("DOB"))] + [row(F.lit(None), F.concat(F.lit(f"{c}//"), F.col(c).cast("string"))) for c in background]
    facts.append(F.when(F.col("DEATHDATE").isNotNull(), row(F.col("DEATHDATE"), F.lit("DOD"))))
    fixed = patients.join(ids, "PID").select("subject_id", F.explode(F.array_compact(F.array(*facts))).alias("r")).select("subject_id", "r.*", F.lit(None).cast("double").alias("numeric_value"))
    value = F.round(F.col("RESULT").try_cast("double"), 2) if "RESULT" in concepts.columns else F.lit(None).cast("double")
    dated = concepts.join(ids, "PID").select("subject_id", F.col("TIMESTAMP").cast("timestamp_ntz").alias("time"), F.col("CONCEPT").alias("code"), value.alias("numeric_value"))
    return fixed.unionByName(dated)
