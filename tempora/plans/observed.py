"""Counts that are observed while a plan runs, instead of by running it again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class StageCounts:
    """Rows of each stage of a pipeline, for each of ``splits`` where these are given.

    ``mark`` counts the rows that pass it in the one run that writes the result; ``table`` has them
    after that.  Filters behind a mark are not moved before it.
    """

    def __init__(self, splits: list[str] | None = None):
        self.splits = splits
        self.seen: dict[str, Observation] = {}

    def mark(self, name: str, df: DataFrame) -> DataFrame:
        self.seen[name] = Observation()
        parts = [F.count_if(F.col("split") == s).alias(s) for s in self.splits] if self.splits else [F.count(F.lit(1)).alias("all")]
        return df.observe(self.seen[name], *parts)

    def table(self, spark: SparkSession) -> DataFrame:
        """``(stage, split, rows)``; waits for the run."""
        rows = [(name, split, n) for name, seen in self.seen.items() for split, n in seen.get.items()]
        return spark.createDataFrame(rows, "stage string, split string, rows long")
