"""Validation of datasets, the quality gate, reference systems, counts of issues, latest versions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions.num import rnd

SEVERITIES = ("critical", "error", "warning", "info")


def latest(df: DataFrame, key: str, version: Sequence[str], seq: str) -> DataFrame:
    """The last version of each key, in the order in which keys were first seen (column first_seen)."""
    newest = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct(*version)).alias("_n"), F.min(seq).alias("first_seen"))
    return newest.select(key, *[F.col(f"_n.{c}").alias(c) for c in df.columns if c != key], "first_seen")


def issues(ds: DataFrame) -> DataFrame:
    """One row an issue: id columns of ds, code, severity. ds: parse_ok, crs_status, record_count, kind, nulls, invalid."""
    one = lambda cond, code, severity: F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity")))
    shape = F.col("kind").isin("vector", "point")
    found = F.array_compact(
        F.array(
            one(~F.col("parse_ok"), "PARSE_FAILED", "critical"), one(F.col("crs_status") == "missing", "CRS_MISSING", "critical"), one(F.col("crs_status") == "inferred", "CRS_INFERRED", "warning"), one(F.col("crs_status") == "blocked", "CRS_UNRESOLVED", "critical"),
            one(F.col("record_count").isNull(), "RECORD_COUNT_UNKNOWN", "warning"), one(F.col("record_count") == 0, "EMPTY_DATASET", "error"), one(shape & (F.col("nulls") > 0), "NULL_GEOMETRY", "error"), one(shape & (F.col("invalid") > 0), "INVALID_GEOMETRY", "error"),
        )
    )
    return ds.select("*", F.explode(found).alias("_i")).select(*ds.columns, "_i.code", "_i.severity")


def severity_counts(found: DataFrame, *keys: str) -> DataFrame:
    """Issues by severity, four columns filled with zeros."""
    return found.groupBy(*keys).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES])


def status(critical: Column, error: Column, warning: Column) -> Column:
    return F.when(critical > 0, "failed").when((error > 0) | (warning > 0), "warning").otherwise("passed")


def gate(ds: DataFrame) -> DataFrame:
    """ds with score_pct and verdict: .28 geometry, .22 CRS, .22 attributes, .14 duplicates, .14 coverage.

    Tables have neither reference system nor extent and get both parts whole. A dataset that does not parse
    or has no rows is blocked.
    """
    n, spatial = F.coalesce("record_count", F.lit(0)), F.col("kind") != "table"
    geometry = F.when(n > 0, F.greatest(F.lit(0.0), 1 - F.col("invalid") / n)).otherwise(0.0)
    crs = F.when(~spatial | (F.col("crs_status") != "missing"), 1.0).otherwise(0.0)
    cover = F.when(~spatial | F.col("has_bounds"), 1.0).otherwise(0.0)
    filled = F.when(F.col("fill") > 0, F.col("fill")).when(n > 0, 1.0).otherwise(0.0)
    unique = F.greatest(F.lit(0.0), 1 - F.col("duplicates") / 10.0)
    score = rnd((geometry * 0.28 + crs * 0.22 + filled * 0.22 + unique * 0.14 + cover * 0.14) * 100.0, 1)
    verdict = F.when(~F.col("parse_ok") | (n <= 0), "BLOCKED").when(F.col("score_pct") >= 85, "PASS").when(F.col("score_pct") >= 65, "PASS_WITH_WARNINGS").otherwise("BLOCKED")
    return ds.withColumn("score_pct", score).withColumn("verdict", verdict)


def detect_crs(header: Column, declared: Column, x: Column, y: Column) -> Column:
    """struct(srid, confidence, status): the file's header, the declaration, else a guess from the range of coordinates."""
    of = lambda srid, sure, state: F.struct(srid.cast("int").alias("srid"), F.lit(sure).alias("confidence"), F.lit(state).alias("status"))
    degrees = (x <= 180) & (y <= 90)
    return (
        F.when(header.isNotNull(), of(header, 1.0, "detected")).when(declared.isNotNull(), of(declared, 0.9, "declared")).when(degrees, of(F.lit(4326), 0.55, "inferred"))
        .when(F.greatest(x, y) > 180, of(F.lit(32643), 0.35, "inferred")).otherwise(of(F.lit(None), 0.0, "missing"))
    )


def layer_report(df: DataFrame, kind: Column, box: Sequence[Column], valid: Column) -> DataFrame:
    """One row: features, sorted kinds, bounds, valid and null counts."""
    x0, y0, x1, y1 = box
    return df.agg(
        F.count(F.lit(1)).alias("features"), F.array_join(F.array_sort(F.collect_set(kind)), ",").alias("kinds"), F.min(x0).alias("min_x"), F.min(y0).alias("min_y"), F.max(x1).alias("max_x"), F.max(y1).alias("max_y"),
        F.count_if(valid).alias("valid"), F.count_if(x0.isNull()).alias("nulls"),
    )


def numbered(df: DataFrame, pattern: str, *order: str) -> DataFrame:
    """Sequential ids by a total order."""
    return df.withColumn("seq_id", F.format_string(pattern, F.row_number().over(Window.orderBy(*order))))
