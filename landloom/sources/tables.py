"""Delimited text: header row, all values strings; comma or tab by extension; byte order mark dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.num import rnd


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV or TSV file; types are not inferred, so no value is read twice or changed."""
    df = spark.read.option("header", True).option("sep", "\t" if path.lower().endswith((".tsv", ".tab")) else ",").option("encoding", "UTF-8").option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def numeric_ratio(df: DataFrame) -> DataFrame:
    """Share of cells that are numbers, 3 places, and the number of cells."""
    cells = df.select(F.explode(F.array(*[F.col(f"`{c}`").cast("string") for c in df.columns])).alias("v"))
    n = F.count(F.lit(1))
    return cells.agg(rnd(F.count(F.col("v").try_cast("double")) / n, 3).alias("numeric_ratio"), n.alias("cells"))
