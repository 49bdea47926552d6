"""Topology facts: thresholds, comparison of issues before and after a repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upper_median(df: DataFrame, value: str) -> DataFrame:
    """One row: the value at place n // 2 (from 0) of the sorted positive values."""
    return df.filter(F.col(value) > 0).agg((-F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -{value})")).alias("median"))


def compare_issues(facts: DataFrame) -> DataFrame:
    """facts (phase, kind), a row an issue -> kind, before_n, after_n, resolved."""
    n = lambda p: F.count_if(F.col("phase") == p)
    out = facts.groupBy("kind").agg(n("before").alias("before_n"), n("after").alias("after_n"))
    return out.withColumn("resolved", F.greatest(F.lit(0).cast("long"), F.col("before_n") - F.col("after_n")))
