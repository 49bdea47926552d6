"""Reconciliation of owners, areas and identifiers, lookup in registers, confidence and routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions import text as T
from landloom.functions.num import clamp, ratio, rnd

MATCH, PROBABLE, CONFLICT, MISSING = "MATCH", "PROBABLE", "CONFLICT", "MISSING"


def blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def owner_check(local_a: Column, english_a: Column, local_b: Column, english_b: Column, match: float = 0.92, probable: float = 0.75) -> Column:
    """struct(status, confidence): equal names, else the best score over the scripts that both sides have."""
    both_local = ~blank(local_a) & ~blank(local_b)
    lone = F.when(~blank(local_a), T.name_score(local_a, english_b)).when(~blank(local_b), T.name_score(local_b, english_a)).otherwise(0.0)
    local = F.when(both_local, T.name_score(local_a, local_b)).otherwise(lone)
    best = F.greatest(F.lit(0.0), local, T.name_score(english_a, english_b))
    status = lambda s: F.when(s >= match, MATCH).when(s >= probable, PROBABLE).otherwise(CONFLICT)
    same = F.lower(F.trim(english_a)) == F.lower(F.trim(english_b))
    missing = blank(english_a) | blank(english_b)
    of = lambda s, c: F.struct(s.alias("status"), c.alias("confidence"))
    return F.when(missing, of(F.lit(MISSING), F.lit(0.0))).when(same, of(F.lit(MATCH), F.lit(1.0))).otherwise(T.let(best, lambda s: of(status(s), s)))


def area_check(recorded: Column, surveyed: Column, tolerance: float = 3.5) -> Column:
    """struct(status, difference, difference_pct): the rounded difference as percent of the recorded area, within a tolerance; 0 % of an area that isn't positive."""
    gap = rnd(F.abs(recorded - surveyed), 2)
    pct = F.when(recorded > 0, rnd(gap / recorded * 100.0, 2)).when(gap.isNotNull(), 0.0)
    status = F.when(recorded.isNull() | surveyed.isNull(), MISSING).when(pct <= tolerance, MATCH).otherwise(CONFLICT)
    return F.struct(status.alias("status"), gap.alias("difference"), pct.alias("difference_pct"))


def identifier_check(a: Column, b: Column) -> Column:
    """struct(status, confidence): equal letters and digits, else the share of the common prefix."""
    x, y = T.bare_identifier(a), T.bare_identifier(b)
    share = rnd(T.shared_prefix(x, y) / F.greatest(F.length(x), F.length(y), F.lit(1)), 4)
    of = lambda s, c: F.struct(F.lit(s).alias("status"), c.alias("confidence"))
    return F.when(blank(a) | blank(b), of(MISSING, F.lit(None).cast("double"))).when(x == y, of(MATCH, F.lit(1.0))).otherwise(of(CONFLICT, share))


def overall(*statuses: Column) -> Column:
    """Any conflict; all missing; some missing or probable; else a match."""
    s = F.array(*statuses)
    missing = F.size(F.filter(s, lambda x: x == MISSING))
    return F.when(F.array_contains(s, CONFLICT), CONFLICT).when(missing == len(statuses), MISSING).when((missing > 0) | F.array_contains(s, PROBABLE), PROBABLE).otherwise(MATCH)


def attribute_score(owner_confidence: Column, area_status: Column, area_pct: Column) -> Column:
    """Mean of what is known: the owner's confidence; 1 for a matching area, else 1 less its difference by 14 percent."""
    area = F.when(area_status == MATCH, 1.0).when(area_pct.isNotNull(), F.greatest(F.lit(0.0), 1 - area_pct / 14.0))
    terms = F.array_compact(F.array(owner_confidence, area))
    return F.when(F.size(terms) > 0, rnd(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.size(terms), 4)).otherwise(0.0)


def register_lookup(parcels: DataFrame, register: DataFrame, keys: Sequence[str], parcel_id: str, parcel_number: str, order: str) -> DataFrame:
    """Left join to the first register row that claims a key: by the parcel's id, else by its number.

    Register rows claim the values of their key columns in row order, then in the order of keys. Both
    joins are equi-joins on the claimed value, so they hash-partition, and few-row registers broadcast by size.
    """
    claims = register.select(F.struct(*register.columns).alias("row"), F.col(order).alias("_o"), F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("_k", "_v")).filter("_v <> ''")
    first = claims.groupBy("_v").agg(F.min_by("row", F.struct("_o", "_k")).alias("row"))
    by_id = first.select(F.col("_v").alias("_a"), F.col("row").alias("_ra"))
    by_no = first.select(F.col("_v").alias("_b"), F.col("row").alias("_rb"))
    out = parcels.join(by_id, F.col(parcel_id).cast("string") == F.col("_a"), "left").join(by_no, F.col(parcel_number).cast("string") == F.col("_b"), "left")
    hit = F.coalesce("_ra", "_rb")
    return out.select(*parcels.columns, hit.alias("register"), F.when(F.col("_ra").isNotNull(), "id").when(F.col("_rb").isNotNull(), "number").alias("found_by"))


def route(score: Column) -> Column:
    return F.when(score >= 0.92, "AUTO_ACCEPTED").when(score >= 0.75, "REVIEW_RECOMMENDED").otherwise("FIELD_VERIFICATION_REQUIRED")


def confidence(iou: Column, likeness: Column, attribute: Column, recorded: Column, surveyed: Column, issues: Column, distance: Column, tolerance: float = 3.5, radius: float = 3.0) -> Column:
    """struct(overall, route, five components): weighted .30 geometry, .25 attributes, .20 area, .15 topology, .10 survey."""
    terms = F.array_compact(F.array(iou, likeness))
    geometry = F.when(F.size(terms) > 0, rnd(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / F.size(terms), 4)).otherwise(0.0)
    attr = F.coalesce(rnd(clamp(attribute, 0.0, 1.0), 4), F.lit(0.0))
    known = (recorded > 0) & surveyed.isNotNull() & (surveyed != 0)
    pct = F.abs(recorded - surveyed) / recorded * 100.0
    area = F.when(known, rnd(F.greatest(F.lit(0.0), 1 - pct / (tolerance * 2)), 4)).otherwise(0.0)
    topology = rnd(F.greatest(F.lit(0.0), 1 - issues / 3.0), 4)
    support = F.coalesce(rnd(F.greatest(F.lit(0.0), 1 - distance / radius), 4), F.lit(0.0))
    total = rnd(clamp(geometry * 0.30 + attr * 0.25 + area * 0.20 + topology * 0.15 + support * 0.10, 0.0, 1.0), 4)
    return F.struct(total.alias("overall"), route(total).alias("route"), geometry.alias("geometry"), attr.alias("attribute"), area.alias("area"), topology.alias("topology"), support.alias("support"))


def evidence(iou: Column, likeness: Column, attribute: Column, recorded: Column, surveyed: Column, issues: Column, distance: Column, tolerance: float = 3.5, radius: float = 3.0) -> tuple[Column, Column]:
    """Names of the signals that speak for a parcel, and of the concerns, each in a fixed order."""
    pct = F.when((recorded > 0) & surveyed.isNotNull() & (surveyed != 0), F.abs(recorded - surveyed) / recorded * 100.0)
    named = lambda cond, name: F.when(cond, F.lit(name))
    passed = [named(iou >= 0.75, "Boundary similarity"), named(likeness >= 0.70, "Boundary shape similarity"), named(attribute >= 0.80, "Attribute match"), named(pct <= tolerance, "Area difference"), named(issues == 0, "Valid topology"), named(distance <= radius, "Survey point support")]
    concerns = [
        named(iou < 0.55, "Low boundary overlap"), named(iou.isNull() & likeness.isNull(), "No comparable geometry"), named(attribute < 0.80, "Attribute disagreement"), named(pct > tolerance, "Area difference"),
        named(pct.isNull(), "Area comparison unavailable"), named(issues != 0, "Topology issues"), named(distance > radius, "Weak survey support"),
    ]
    return F.array_compact(F.array(*passed)), F.array_compact(F.array(*concerns))


def explanation(total: Column, passed: Column, concerns: Column) -> Column:
    """One sentence for the score and one for each list that isn't empty."""
    s = F.concat(F.lit("Overall confidence "), F.format_number(total * 100, 1), F.lit("%."))
    return F.concat_ws(" ", s, F.when(F.size(passed) > 0, F.concat(F.lit("Supported by: "), F.array_join(passed, ", "), F.lit("."))), F.when(F.size(concerns) > 0, F.concat(F.lit("Concerns: "), F.array_join(concerns, ", "), F.lit("."))))


def distribution(scores: DataFrame, score: str, route_col: str) -> DataFrame:
    """One row: count, least, largest and mean score, four bands, three routes."""
    s = F.col(score)
    return scores.agg(
        F.count(s).alias("n"), F.min(s).alias("least"), F.max(s).alias("largest"), rnd(F.sum(s.cast("decimal(28,6)")).cast("double") / F.count(s), 4).alias("mean"),
        F.count_if(s >= 0.90).alias("band_90"), F.count_if((s >= 0.75) & (s < 0.90)).alias("band_75"), F.count_if((s >= 0.50) & (s < 0.75)).alias("band_50"), F.count_if(s < 0.50).alias("band_0"),
        *[F.count_if(F.col(route_col) == r).alias(r.lower()) for r in ("AUTO_ACCEPTED", "REVIEW_RECOMMENDED", "FIELD_VERIFICATION_REQUIRED")],
    )


def first_by(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")
