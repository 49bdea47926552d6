"""Deterministic parcel layers by closed formulas: the sector generator and the demonstration cadastre with known defects."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions.num import rnd

DEGREE_M = 111_000.0


def sector(spark: SparkSession, total: int, rate: float) -> DataFrame:
    """i from 1 to total with row r, column c, outline in degrees, surveyed and legal area, encroaching, confidence, status."""
    side = math.isqrt(total - 1) + 1
    count = int(total * rate + 0.5)
    step = max(1, total // (count + 2))
    i = F.col("i")
    base = spark.range(1, total + 1).select(F.col("id").alias("i"))
    marked = spark.range(count).select(F.least(F.lit(total - 2), (F.col("id") + 1) * step + (F.col("id") * 7) % 5).alias("i")).distinct().withColumn("encroaching", F.lit(True))
    w, h = (F.sin(i * 3.1) * 0.06 + 0.86) * 0.00026, (F.cos(i * 4.2) * 0.06 + 0.86) * 0.00022
    df = base.join(F.broadcast(marked), "i", "left").withColumn("encroaching", F.coalesce("encroaching", F.lit(False)))  # count rows, fixed by the parameters
    df = df.withColumn("r", F.floor((i - 1) / side)).withColumn("c", (i - 1) % side).withColumn("surveyed", rnd(w * h * DEGREE_M * DEGREE_M, 1))
    share = (i % 8) * 0.012 + 0.065
    legal = F.when(F.col("encroaching"), F.col("surveyed") * (1 - share)).otherwise(F.col("surveyed") * (((i * 13) % 45) * 0.0014 + 0.968))
    delta = F.abs(F.col("legal") - F.col("surveyed")) / F.col("legal")
    status = F.when(F.col("encroaching"), "Encroachment").when((delta > 0.028) | (i % 19 == 0), "Review").otherwise("Approved")
    sure = F.when(F.col("status") == "Encroachment", (i % 18) + 41.0).when(F.col("status") == "Review", (i % 10) + 78.0).otherwise(F.sin(i) * 4.5 + 94)
    x0, y0 = F.col("c") * 0.00026 + F.sin(i * 12.3) * 1.5e-5, F.col("r") * 0.00022 + F.cos(i * 9.7) * 1.5e-5
    return df.withColumn("legal", legal).withColumn("status", status).withColumn("confidence", rnd(sure, 1)).withColumn("x0", x0).withColumn("y0", y0).withColumn("x1", x0 + w).withColumn("y1", y0 + h)


def cadastre(spark: SparkSession, columns: int = 21, rows: int = 20) -> DataFrame:
    """A grid of 26 x 22 m cells without its road columns (every seventh) and lanes (every sixth row): idx, r, c, parcel_id, box, defect.

    Some cells are missing (gap), inflated (overlap), crossed (bow_tie), and a few thin slivers are added, chosen by
    position, so the counts of each defect are known.
    """
    cells = spark.range(columns * rows).select((F.col("id") % columns).alias("c"), F.floor(F.col("id") / columns).alias("r")).filter("c % 7 <> 3 AND r % 6 <> 4")
    n = F.col("r") * columns + F.col("c")
    defect = F.when(n % 61 == 7, "gap").when(n % 97 == 11, "overlap").when(n % 131 == 5, "bow_tie")
    grow = F.when(F.col("defect") == "overlap", 1.8).otherwise(0.0)
    base = cells.withColumn("idx", n).withColumn("defect", defect).filter("defect IS NULL OR defect <> 'gap'")
    base = base.withColumn("x0", F.col("c") * 26.0 - grow).withColumn("y0", F.col("r") * 22.0 - grow).withColumn("x1", F.col("c") * 26.0 + 26.0 + grow).withColumn("y1", F.col("r") * 22.0 + 22.0 + grow)
    thin = base.filter("defect IS NULL AND idx % 149 = 2").withColumn("idx", F.col("idx") + columns * rows).withColumn("defect", F.lit("sliver")).withColumn("x1", F.col("x0") + 0.05)
    return base.unionByName(thin).withColumn("parcel_id", F.format_string("P-%04d", F.col("idx")))
