"""Spatial correspondence: scores of candidates, greedy assignment, relations and changes of outlines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions.num import clamp, ratio, rnd
from landloom.operators.area_match import best_by_area, support
from landloom.operators.cut import cut
from landloom.operators.spatial import grid_join, within_reach


def match_score(iou: Column, likeness: Column, outline: Column, shift: Column, distance: Column, far: float = 25.0, radius: float = 3.0) -> Column:
    """0.42 overlap, 0.18 area, 0.16 outline, 0.14 shift, 0.10 survey support; what is unknown adds nothing; 4 places."""
    zero = F.lit(0.0)
    part = lambda c: F.coalesce(F.greatest(zero, c), zero)
    total = iou * 0.42 + F.coalesce(likeness, zero) * 0.18 + F.coalesce(outline, zero) * 0.16 + part(1 - shift / far) * 0.14 + part(1 - distance / radius) * 0.10
    return rnd(F.least(F.lit(1.0), total), 4)


def verdict(score: Column, iou: Column, least_iou: float = 0.55) -> Column:
    return F.when((iou >= least_iou) & (score >= 0.85), "MATCHED").when(score >= 0.65, "PROBABLE").when(score >= 0.35, "REVIEW_REQUIRED").otherwise("UNMATCHED")


#: The most that a candidate can score that shares no area and lies beyond the reach of the shift term: area, outline, survey support.
FAR_SCORE = 0.18 + 0.16 + 0.10


#: Rows of one task before boxes are expanded to cells: a task's exchange holds some ten copies of each.
TASK_ROWS = 50_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over tasks of about TASK_ROWS rows, to be merged, not broadcast: files of few bytes would give a task any number of rows, and each task the cells of all."""
    return df.repartition(max(1, -(-df.count() // TASK_ROWS)), key).hint("merge")


def best_matches(legacy: DataFrame, candidates: DataFrame, far: float = 25.0, size: float = 64.0) -> DataFrame:
    """The best candidate of each legacy box: a_ columns, b_ columns, iou, shift, likeness, outline, score, verdict.

    legacy has a_idx and box; candidates have b_order, b_distance (to the nearest survey point, may be null) and box.
    Every candidate counts, however far. Those within far are found by cells; the cheap terms of a pair
    bound its score, and outlines are compared only where a pair can still win. Beyond far a pair
    scores FAR_SCORE at most, so only rows whose best is no better go on: to the candidates within the outline's reach, found by
    cells of the size of the larger one, and to the best of all others by area and survey support alone (best_by_area).
    Equal scores go to the candidate that comes first. Without candidates a row is UNMATCHED with score 0.
    """
    a, b = G.box("a_"), G.box("b_")

    def with_terms(pairs: DataFrame) -> DataFrame:
        out = pairs.withColumn("iou", G.box_iou(a, b)).withColumn("shift", G.box_shift(a, b)).withColumn("likeness", G.area_likeness(G.box_area(a), G.box_area(b)))
        known = match_score(F.col("iou"), F.col("likeness"), F.lit(0.0), F.col("shift"), F.col("b_distance"), far)
        # Outlines further apart than the root of the larger area have a likeness of 0.
        apart = lambda lo, hi: F.greatest(a[lo] - b[hi], b[lo] - a[hi], F.lit(0.0))
        gap = F.sqrt(apart(0, 2) * apart(0, 2) + apart(1, 3) * apart(1, 3))
        out = out.withColumn("met", gap <= F.sqrt(F.greatest(G.box_area(a), G.box_area(b))))
        # The samples' mean distance is at least that of their means, and a ring's samples have their mean within half a step of its centre.
        step = lambda c: ((c[2] - c[0]) + (c[3] - c[1])) * 2 / G.SAMPLES
        likest = clamp(1 - (F.col("shift") - (step(a) + step(b)) / 2) / F.sqrt(F.greatest(G.box_area(a), G.box_area(b))), 0.0, 1.0)
        return out.withColumn("known", known).withColumn("most", F.col("known") + F.when(F.col("met"), F.coalesce(likest, F.lit(1.0)) * 0.16).otherwise(0.0) + 2e-4)

    own = [c for c in candidates.columns] + ["iou", "shift", "likeness", "outline", "score"]

    def winners(pairs: DataFrame, least: Column | None = None) -> DataFrame:
        """The best pair of each row; pairs that can't reach the row's best cheap score, or least, are dropped before outlines are compared."""
        top = F.max("known").over(Window.partitionBy("a_idx"))
        left = with_terms(pairs).withColumn("top", top if least is None else F.greatest(top, least)).filter(F.col("most") >= F.col("top"))
        outline = F.when(F.col("met"), G.box_outline_likeness(a, b)).otherwise(0.0)
        shaped = left.withColumn("outline", outline).withColumn("score", match_score(F.col("iou"), F.col("likeness"), F.col("outline"), F.col("shift"), F.col("b_distance"), far))
        return shaped.groupBy("a_idx").agg(F.max_by(F.struct(*own), F.struct("score", -F.col("b_order"))).alias("m"))

    legacy, candidates = cut(legacy), cut(candidates)  # both are read several times
    near = cut(winners(grid_join(spread(legacy, "a_idx"), spread(candidates, "b_order"), size, margin=far)))
    weak = cut(legacy.join(near.filter(F.col("m.score") > FAR_SCORE), "a_idx", "left_anti").withColumn("a_area", G.box_area(a)))
    best = near
    if weak.limit(1).count():
        known = candidates.select("b_order", G.box_area(b).alias("b_area"), support(F.col("b_distance")).alias("b_support"))
        alike = cut(best_by_area(weak, known))
        alike = cut(weak.join(alike, "a_area"))
        alone = winners(alike.drop("a_area", "value").join(candidates, "b_order"))
        floor = alike.select("a_idx", F.col("value").alias("floor"))
        reached = within_reach(spread(weak.drop("a_area"), "a_idx"), spread(candidates, "b_order"), F.sqrt(G.box_area(a)), F.sqrt(G.box_area(b))).join(floor, "a_idx")
        best = near.union(cut(winners(reached, F.col("floor")))).union(cut(alone))
        best = best.groupBy("a_idx").agg(F.max_by("m", F.struct("m.score", -F.col("m.b_order"))).alias("m"))
    out = legacy.join(best, "a_idx", "left")
    return out.select(*legacy.columns, *[F.col(f"m.{c}").alias(c) for c in own]).withColumn("score", F.coalesce("score", F.lit(0.0))).withColumn("verdict", verdict(F.col("score"), F.coalesce("iou", F.lit(0.0))))


def assign_once(matches: DataFrame, candidate: str, legacy_id: str) -> DataFrame:
    """Greedy one-to-one assignment: the best score keeps a candidate (ties: smallest legacy id), later claimants go to review."""
    rank = F.row_number().over(Window.partitionBy(candidate).orderBy(F.col("score").desc(), legacy_id))
    late = F.col(candidate).isNotNull() & (rank > 1)
    return matches.withColumn("late", late).withColumn("verdict", F.when(F.col("late"), "REVIEW_REQUIRED").otherwise(F.col("verdict")))


def severity(area: Column, share: Column) -> Column:
    return F.when((area >= 50) | (share >= 0.25), "HIGH").when((area >= 10) | (share >= 0.05), "MEDIUM").otherwise("LOW")


def encroachment(overlap: Column, parcel_area: Column) -> Column:
    """struct(overlap_sqm, overlap_ratio, severity, confidence) of a corridor on a parcel."""
    area = rnd(overlap, 2)
    share = F.coalesce(rnd(ratio(area, parcel_area), 4), F.lit(0.0))
    return F.struct(area.alias("overlap_sqm"), share.alias("overlap_ratio"), severity(area, share).alias("severity"), rnd(F.least(F.lit(0.99), F.least(F.lit(1.0), share * 3) * 0.4 + 0.55), 4).alias("confidence"))


def building_relation(common: Column, building_area: Column, tolerance: float = 0.02) -> Column:
    """struct(relation, coverage): how much of a building lies on its parcel."""
    c = ratio(common, building_area)
    relation = F.when(c >= 1 - tolerance, "INSIDE").when(c <= tolerance, "OUTSIDE").otherwise("CROSSES_BOUNDARY")
    return F.struct(relation.alias("relation"), rnd(c, 4).alias("coverage"))


def shifted(shift: Column, likeness: Column, far: float = 0.5, pct: float = 2.0) -> tuple[Column, Column]:
    """Whether a boundary moved between two epochs, and the area's change in percent."""
    delta = rnd((1 - F.coalesce(likeness, F.lit(0.0))) * 100.0, 2)
    return (F.coalesce(shift > far, F.lit(False))) | (delta > pct), delta


def footprint_change(before: Column, after: Column, iou: Column, shift: Column, likeness: Column) -> Column:
    """NEW, REMOVED, null (within tolerance), MODIFIED or BOUNDARY_SHIFT; before and after tell which epoch has the footprint."""
    moved, _ = shifted(shift, likeness)
    return F.when(~before & after, "NEW").when(before & ~after, "REMOVED").when((iou >= 0.98) & ~moved, F.lit(None)).when(iou >= 0.5, "MODIFIED").otherwise("BOUNDARY_SHIFT")


def first_generation_score(iou: Column, delta: Column, text: Column, survey: Column) -> Column:
    """The older composite of 100: .40 overlap, .35 area, .15 names, .10 survey, clamped; 2 places."""
    c = lambda x: clamp(x, 0.0, 1.0)
    return rnd((c(iou) * 0.40 + (1 - c(delta)) * 0.35 + c(text) * 0.15 + c(survey) * 0.10) * 100, 2)


def reasons(iou: Column, likeness: Column, shift: Column, distance: Column, verdict_: Column) -> Column:
    """Sentences for what speaks for and against a match, in a fixed order."""
    # Two places of the number itself, half to even, as printf of other languages; format_string rounds its shortest decimal form.
    two = lambda c: F.regexp_replace(F.format_number(c, 2), ",", "")
    f = lambda s, c: F.concat(F.lit(s.split("%.2f")[0]), two(c), F.lit(s.split("%.2f")[1]))
    overlap = F.when(iou >= 0.9, f("Boundary overlap IoU %.2f - near-identical footprint", iou)).when(iou >= 0.6, f("Boundary overlap IoU %.2f - substantial shared area", iou)).when(iou > 0, f("Partial boundary overlap IoU %.2f", iou))
    area = F.when(likeness >= 0.95, f("Area similarity %.2f - extents agree", likeness)).when(likeness < 0.85, f("Area similarity only %.2f - extents differ", likeness))
    moved = F.when(shift <= 0.5, f("Centroid displacement %.2f m", shift)).when(shift <= 2, f("Centroid displaced %.2f m - plausible legacy shift", shift)).when(shift > 2, f("Centroid displaced %.2f m - large offset", shift))
    survey = F.when(distance <= 1, f("A survey point supports this parcel (%.2f m)", distance))
    found = F.array_compact(F.array(overlap, area, moved, survey))
    some = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("No shared geometry between candidate and reference")))
    return F.when(verdict_ == "UNMATCHED", F.array_append(some, F.lit("Below the correspondence threshold"))).otherwise(some)
