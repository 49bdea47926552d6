"""Read queries: searches, pages, summaries, dossiers, reviews and audit trails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The states of a conflict and where they may lead.
TRANSITIONS = {
    "OPEN": ("UNDER_REVIEW", "VERIFIED", "RESOLVED", "REQUIRES_FIELD_SURVEY"),
    "UNDER_REVIEW": ("VERIFIED", "RESOLVED", "REQUIRES_FIELD_SURVEY", "OPEN"),
    "VERIFIED": ("RESOLVED", "REQUIRES_FIELD_SURVEY", "UNDER_REVIEW"),
    "REQUIRES_FIELD_SURVEY": ("UNDER_REVIEW", "VERIFIED", "RESOLVED"),
    "RESOLVED": ("UNDER_REVIEW",),
}


def allowed(current: Column, target: Column) -> Column:
    """Whether a conflict may go from one state to another."""
    table = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.element_at(table, current), target), F.lit(False))


def search(parcels: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows with the needle, whatever its case, in any of the columns."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(needle.lower())), F.lit(False))
    return parcels.filter(hit)


def page(df: DataFrame, offset: int, limit: int, *order: Column) -> DataFrame:
    """A page of a total order: the limit is the feature."""
    return df.orderBy(*order).offset(offset).limit(limit)


def grouped_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Counts by each column and in all: dimension, value, n; one pass by grouping sets."""
    sets = df.groupingSets([[c] for c in columns] + [[]], *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    width = len(columns)
    dimension = F.lit("all")
    value = F.lit("all")
    for i, c in enumerate(columns):
        here = F.col("_g") == ((1 << width) - 1) ^ (1 << (width - 1 - i))
        dimension, value = F.when(here, c).otherwise(dimension), F.when(here, F.col(c)).otherwise(value)
    return sets.select(dimension.alias("dimension"), value.alias("value"), "n")


def presence_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys of one epoch only: NEW and REMOVED, each once."""
    one, two = before.select(key).distinct(), after.select(key).distinct()
    new = two.join(one, key, "left_anti").withColumn("change_type", F.lit("NEW"))
    return new.unionByName(one.join(two, key, "left_anti").withColumn("change_type", F.lit("REMOVED")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of old with those of new put in their place; columns unknown to old are dropped, missing ones are null."""
    known = [F.col(c) if c in new.columns else F.lit(None).cast(old.schema[c].dataType).alias(c) for c in old.columns]
    return old.join(new.select(key), key, "left_anti").unionByName(new.select(*known))


def lineage(df: DataFrame, key: str, fields: dict[str, str]) -> DataFrame:
    """Long form of the fields that hold a value: key, field, value, source. Zero and empty count as none."""
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value"), F.lit(s).alias("source")) for f, s in fields.items()])).alias("x")
    return df.select(key, cells).select(key, "x.*").filter("value IS NOT NULL AND value NOT IN ('', '0', '0.0')")
