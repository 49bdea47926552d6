"""Single shapes: distance, differences, polygonal parts, dissolving, nearest boxes, and a parcel's harmonization from stage to stage."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions import batch as B
from landloom.functions import geom as G
from landloom.functions import kernel as K
from landloom.functions.num import let, ratio, rnd
from landloom.operators import repair as R
from landloom.operators.cut import cut
from landloom.operators.spatial import _cell, grid_join

#: Metres of a degree and degrees of a metre, as the first generation took them.
METRES_A_DEGREE, DEGREES_A_METRE = 111000.0, 0.000009


def square_degrees_to_metres(area: Column) -> Column:
    return area * METRES_A_DEGREE * METRES_A_DEGREE


def metres_to_degrees(distance: Column) -> Column:
    return distance * DEGREES_A_METRE


def rings_area(rings: Column) -> Column:
    """Area of rings that don't overlap; null for null."""
    return F.when(rings.isNotNull(), F.aggregate(rings, F.lit(0.0), lambda s, r: s + G.ring_area(r)))


def sides(ring: Column) -> Column:
    return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring) - 1), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))


def inside(p: Column, ring: Column) -> Column:
    """Whether a point lies in a ring, by the crossings of a ray."""
    hit = lambda s: ((s["p"]["y"] > p["y"]) != (s["q"]["y"] > p["y"])) & (p["x"] < (s["q"]["x"] - s["p"]["x"]) * (p["y"] - s["p"]["y"]) / (s["q"]["y"] - s["p"]["y"]) + s["p"]["x"])
    return F.size(F.filter(sides(ring), lambda s: F.coalesce(hit(s), F.lit(False)))) % 2 == 1


def ring_distance(a: Column, b: Column) -> Column:
    """The distance of two rings as areas: 0 where they touch, cross or hold each other."""

    def to_side(p: Column, s: Column) -> Column:
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        t = F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio((p["x"] - s["p"]["x"]) * dx + (p["y"] - s["p"]["y"]) * dy, dx * dx + dy * dy))), F.lit(0.0))
        ex, ey = p["x"] - s["p"]["x"] - t * dx, p["y"] - s["p"]["y"] - t * dy
        return F.sqrt(ex * ex + ey * ey)

    def turn(s: Column, p: Column) -> Column:
        return (s["q"]["x"] - s["p"]["x"]) * (p["y"] - s["p"]["y"]) - (s["q"]["y"] - s["p"]["y"]) * (p["x"] - s["p"]["x"])

    cross = lambda s, t: (turn(s, t["p"]) * turn(s, t["q"]) < 0) & (turn(t, s["p"]) * turn(t, s["q"]) < 0)
    far = lambda ring, other: F.array_min(F.transform(ring, lambda p: F.array_min(F.transform(sides(other), lambda s: to_side(p, s)))))
    meets = F.exists(sides(a), lambda s: F.exists(sides(b), lambda t: cross(s, t))) | inside(a[0], b) | inside(b[0], a)
    return F.when(meets, 0.0).otherwise(F.least(far(a, b), far(b, a)))


def difference_stats(a: Column, b: Column) -> Column:
    """struct(overlap_sqm, only_a_sqm, only_b_sqm, shift_m) of two convex rings; zeros where one is missing."""
    of = lambda c: F.coalesce(c, F.lit(0.0))

    def told(v: Column) -> Column:
        shift = F.sqrt((v["p"]["x"] - v["q"]["x"]) * (v["p"]["x"] - v["q"]["x"]) + (v["p"]["y"] - v["q"]["y"]) * (v["p"]["y"] - v["q"]["y"]))
        return F.struct(of(v["common"]).alias("overlap_sqm"), of(v["a"] - v["common"]).alias("only_a_sqm"), of(v["b"] - v["common"]).alias("only_b_sqm"), of(shift).alias("shift_m"))

    measures = F.struct(G.ring_area(G.clip_convex(a, b)).alias("common"), G.ring_area(a).alias("a"), G.ring_area(b).alias("b"), G.ring_centroid(a).alias("p"), G.ring_centroid(b).alias("q"))
    return let(measures, told)


def polygonal(shapes: DataFrame, key: str) -> DataFrame:
    """shapes (key, kind, parts of kind and rings) -> key, rings, area of what is polygonal; null if nothing is.

    Polygons and multipolygons stay as they are; the polygons of a collection are united, so ground under several counts once. Holes
    are rings of their part, counted even-odd.
    """

    def run(batches):
        for part in batches:
            out = []
            for i, kind, v in zip(part[key], part["kind"], part["parts"], strict=True):
                own = [R.to_rings(p["rings"]) for p in (v if v is not None else []) if p["kind"] == "Polygon"]
                rings = None
                if kind in ("Polygon", "MultiPolygon") or len(own) == 1:
                    rings = [r for p in own for r in p]
                elif own and kind == "GeometryCollection":
                    rings = own[0]
                    for p in own[1:]:
                        rings = K.union(rings, p)
                out.append((i, R.from_rings(rings) if rings else None, sum(K.area(p) for p in own) if rings and kind != "GeometryCollection" else K.area(rings) if rings else None))
            yield pd.DataFrame(out, columns=[key, "rings", "area"])

    told = shapes.select(key, "kind", F.transform("parts", lambda p: F.struct(p["kind"].alias("kind"), R.boxed(p["rings"]).alias("rings"))).alias("parts"))
    return told.mapInPandas(run, f"{key} {shapes.schema[key].dataType.simpleString()}, rings {R.RINGS}, area double")


def dissolve(shapes: DataFrame, key: str) -> DataFrame:
    """shapes (key, ord, rings) -> key, rings of the union of each key's shapes. A key's shapes lie in one task."""

    def look(part: pa.RecordBatch) -> list:
        own, row = R.members(part["own"])
        return [part[key], B.overlay(B.none(part.num_rows), own, B.EITHER, of=row).arrow()]

    return R.batched(R.listed(shapes, key), look, f"{key} {shapes.schema[key].dataType.simpleString()}, rings {R.RINGS}")


def first_within(spots: DataFrame, centres: DataFrame, reach: float) -> DataFrame:
    """spots (pick, x, y) -> pick, idx: the smallest idx of centres (idx, cx, cy) nearer than reach. Cells of that size, 3 x 3 of them."""
    probe = spots.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(9)])))
    probe = probe.withColumn("_cx", _cell(F.col("x"), reach) + F.col("_i") % 3 - 1).withColumn("_cy", _cell(F.col("y"), reach) + F.floor(F.col("_i") / 3) - 1)
    placed = centres.withColumn("_cx", _cell(F.col("cx"), reach)).withColumn("_cy", _cell(F.col("cy"), reach))
    dx, dy = F.col("cx") - F.col("x"), F.col("cy") - F.col("y")
    return probe.join(placed, ["_cx", "_cy"]).filter(F.sqrt(dx * dx + dy * dy) < reach).groupBy("pick").agg(F.min("idx").alias("idx"))


def nearest_box(left: DataFrame, right: DataFrame, size: float = 32.0, rounds: int = 40) -> DataFrame:
    """left (a_id, a_ box) with the nearest box of right (b_id, b_ box) and its distance; ties to the smallest b_id.

    Rows look within a margin that doubles, with cells as large, for those that found nothing within it: each row
    stops as soon as a box lies within its margin, so nothing nearer was missed.
    """
    a, b = G.box("a_"), G.box("b_")
    apart = lambda lo, hi: F.greatest(a[lo] - b[hi], b[lo] - a[hi], F.lit(0.0))
    gap = F.sqrt(apart(0, 2) * apart(0, 2) + apart(1, 3) * apart(1, 3))
    if not right.limit(1).count():
        return left.select("a_id", F.lit(None).cast("long").alias("b_id"), F.lit(None).cast("double").alias("distance"))
    done, rest, margin = None, left, size / 4
    for _ in range(rounds):
        pairs = grid_join(rest, right, max(size, margin), margin=margin).withColumn("d", gap).filter(F.col("d") <= margin)
        found = cut(pairs.groupBy("a_id").agg(F.min(F.struct("d", "b_id")).alias("m")).select("a_id", F.col("m.b_id").alias("b_id"), F.col("m.d").alias("distance")))
        done = found if done is None else done.union(found)
        rest = cut(rest.join(found, "a_id", "left_anti"))
        if not rest.limit(1).count():
            return done
        margin *= 2
    raise RuntimeError("boxes beyond all reach")


def harmonise(legacy: DataFrame, modern: DataFrame, structures: DataFrame | None, corridors: DataFrame, least_iou: float = 0.30) -> DataFrame:
    """idx, rings, fused, included, before_sqm, after_sqm, delta_sqm, delta_pct of each legacy outline (idx, rings).

    Stage by stage: united with the modern outline (idx, rings) where their IoU suffices, then with footprints (idx, ord, rings)
    that lie inside, then less the corridors (ord, rings, box) that reach it. Without a legacy outline there is no row.
    """
    both = legacy.filter(F.size("rings") > 0).join(modern.select(F.col("idx").alias("_m"), F.col("rings").alias("modern")), F.col("idx") == F.col("_m"), "left").drop("_m")

    def fuse(part: pa.RecordBatch) -> list:
        one, two = B.Shapes.of(part["rings"]), B.Shapes.of(part["modern"])
        before, (common, whole) = B.area(one), B.areas(one, two, B.BOTH, B.EITHER)
        ok = (np.diff(two.shapes) > 0) & (whole > 0) & (common >= least_iou * whole)
        at = np.flatnonzero(ok)
        return [part["idx"], one.replaced(at, B.overlay(one.take(at), two.take(at), B.EITHER)).arrow(), ok, before]

    fused = R.batched(both.select("idx", "rings", "modern"), fuse, f"idx long, rings {R.RINGS}, fused boolean, before double")
    if structures is not None:
        grown = R.conflate(fused.select("idx", "rings"), structures).select("idx", "rings", "included")
        fused = fused.drop("rings").join(grown, "idx")
    else:
        fused = fused.withColumn("included", F.lit(0))
    fused = cut(fused)
    ring = F.explode("rings").alias("r")
    box = fused.select("idx", ring).select("idx", G.ring_bounds(F.col("r")).alias("b")).groupBy("idx").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    less = R.subtract(fused.select("idx", "rings").join(box, "idx"), corridors).select("idx", "rings")
    out = fused.drop("rings").join(less, "idx").withColumn("before_sqm", rnd(rnd(F.col("before"), 6), 2)).withColumn("after_sqm", rnd(rnd(rings_area(F.col("rings")), 6), 2))
    delta = rnd(F.col("after_sqm") - F.col("before_sqm"), 2)
    return out.select("idx", "rings", "fused", "included", "before_sqm", "after_sqm", delta.alias("delta_sqm"), F.coalesce(rnd(ratio(delta, F.col("before_sqm")) * 100.0, 2), F.lit(0.0)).alias("delta_pct"))


def overlays(pairs: DataFrame) -> DataFrame:
    """pairs (idx, a, b: rings) -> idx and the areas common, united, only_a, either (one without the other)."""

    def look(part: pa.RecordBatch) -> list:
        return [part["idx"], *B.areas(B.Shapes.of(part["a"]), B.Shapes.of(part["b"]), B.BOTH, B.EITHER, B.FIRST, B.ONE)]

    return R.batched(pairs.select("idx", "a", "b"), look, "idx long, common double, united double, only_a double, either double")


def buffered(lines: DataFrame, key: str, distance: float) -> DataFrame:
    """lines (key, line: points) -> key, rings of their surroundings within a distance, area."""

    def run(batches):
        for part in batches:
            shapes = [K.buffer_line(R.to_rings(v)[0], distance) if v is not None else [] for v in part["line"]]
            yield pd.DataFrame({key: part[key], "rings": [R.from_rings(s) for s in shapes], "area": [K.area(s) for s in shapes]})

    kind = lines.schema[key].dataType.simpleString()
    return lines.select(key, R.boxed(F.array("line")).alias("line")).mapInPandas(run, f"{key} {kind}, rings {R.RINGS}, area double")


def snapped(shapes: DataFrame, grid: float) -> DataFrame:
    """shapes (idx, rings) with vertices on a grid (a ring that would become invalid stays), and changed: whether the area moved."""

    def look(part: pa.RecordBatch) -> list:
        rings = B.Shapes.of(part["rings"])
        new = B.snap(rings, grid)
        return [part["idx"], new.arrow(), np.abs(B.area(new) - B.area(rings)) > 1e-9]

    return R.batched(R.dealt(shapes.select("idx", "rings")), look, f"idx long, rings {R.RINGS}, changed boolean")
