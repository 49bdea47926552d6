"""Geometry as column expressions: boxes, rings (arrays of points x, y, first point not repeated), convex clipping.

All of it stays inside the JVM. General polygons, which may be concave or have holes, are in kernel.py.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions.num import clamp, let, ratio, rnd


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    """x0, y0, x1, y1 of a relation's columns, possibly prefixed."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def box_area(b: tuple) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def box_overlap(a: tuple, b: tuple) -> Column:
    """Area common to two boxes."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_iou(a: tuple, b: tuple) -> Column:
    common = box_overlap(a, b)
    return F.coalesce(clamp(ratio(common, box_area(a) + box_area(b) - common), 0.0, 1.0), F.lit(0.0))


def box_shift(a: tuple, b: tuple) -> Column:
    """Distance of the centres, 4 places."""
    dx, dy = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2, (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
    return rnd(F.sqrt(dx * dx + dy * dy), 4)


def area_likeness(a: Column, b: Column) -> Column:
    """Smaller area by larger, 4 places; null if the larger is not positive."""
    return rnd(ratio(F.least(a, b), F.greatest(a, b)), 4)


def compactness(perimeter: Column, area: Column) -> Column:
    """Squared perimeter by area: 16 for a square."""
    return ratio(perimeter * perimeter, area)


def is_sliver(area: Column, perimeter: Column, floor: Column | float) -> Column:
    floor = F.lit(floor) if isinstance(floor, float) else floor
    return (area < floor) | ((F.coalesce(compactness(perimeter, area), F.lit(float("inf"))) > 25) & (area < floor * 20))


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def ring_of_box(b: tuple) -> Column:
    return F.array(point(b[0], b[1]), point(b[2], b[1]), point(b[2], b[3]), point(b[0], b[3]))


def _next(ring: Column) -> Column:
    """The ring turned by one point: the successor of each."""
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def ring_signed_area(ring: Column) -> Column:
    return let(ring, lambda r: _total(F.zip_with(r, _next(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2)


def ring_area(ring: Column) -> Column:
    return F.abs(ring_signed_area(ring))


def ring_perimeter(ring: Column) -> Column:
    return _total(F.zip_with(ring, _next(ring), lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))))


def ring_centroid(ring: Column) -> Column:
    """Centre of area; the mean of the points where the area is 0."""
    cross = lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]

    def centre(v: Column) -> Column:
        ring, a = v["r"], v["a"]
        x = _total(F.zip_with(ring, _next(ring), lambda p, q: (p["x"] + q["x"]) * cross(p, q)))
        y = _total(F.zip_with(ring, _next(ring), lambda p, q: (p["y"] + q["y"]) * cross(p, q)))
        mean = lambda f: _total(F.transform(ring, lambda p: p[f])) / F.size(ring)
        return F.when(a != 0, point(x / a, y / a)).otherwise(point(mean("x"), mean("y")))

    return let(F.struct(ring.alias("r"), (ring_signed_area(ring) * 6).alias("a")), centre)


def ring_bounds(ring: Column) -> Column:
    of = lambda f, g: g(F.transform(ring, lambda p: p[f]))
    return F.struct(of("x", F.array_min).alias("x0"), of("y", F.array_min).alias("y0"), of("x", F.array_max).alias("x1"), of("y", F.array_max).alias("y1"))


SAMPLES = 24


def with_samples(df: DataFrame, ring: str, out: str, n: int = SAMPLES) -> DataFrame:
    """df with n points at equal steps along the outline of a ring column, from its first point on.

    The steps are columns of their own, so that no part is evaluated once for each point.
    """
    r, after = F.col(ring), _next(F.col(ring))
    length = lambda p, q: F.sqrt((q["x"] - p["x"]) * (q["x"] - p["x"]) + (q["y"] - p["y"]) * (q["y"] - p["y"]))
    sides = F.zip_with(r, after, lambda p, q: F.struct(p.alias("p"), q.alias("q"), length(p, q).alias("d")))
    kind = "array<struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>,d:double,at:double>>"
    start = F.struct(F.lit(0.0).alias("at"), F.array().cast(kind).alias("s"))

    def along(acc: Column, s: Column) -> Column:
        own = F.array(F.struct(s["p"].alias("p"), s["q"].alias("q"), s["d"].alias("d"), acc["at"].alias("at")))
        return F.struct((acc["at"] + s["d"]).alias("at"), F.concat(acc["s"], own).alias("s"))

    def at(pick: Column) -> Column:
        s = pick["s"]
        t = F.when(s["d"] > 0, F.least((pick["far"] - s["at"]) / s["d"], F.lit(1.0))).otherwise(0.0)
        return point(s["p"]["x"] + (s["q"]["x"] - s["p"]["x"]) * t, s["p"]["y"] + (s["q"]["y"] - s["p"]["y"]) * t)

    placed = df.withColumn("_placed", F.aggregate(sides, start, along))
    far = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.col("_placed")["at"] * i / n)
    picks = F.transform(far, lambda f: F.struct(f.alias("far"), F.element_at(F.filter(F.col("_placed")["s"], lambda s: s["at"] <= f), -1).alias("s")))
    return placed.withColumn("_picks", picks).withColumn(out, F.transform("_picks", at)).drop("_placed", "_picks")


def outline_likeness(samples_a: Column, samples_b: Column, area_a: Column, area_b: Column) -> Column:
    """1 less the mean distance of paired samples by the root of the larger area, at least 0, 4 places."""
    far = F.zip_with(samples_a, samples_b, lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return rnd(F.greatest(F.lit(0.0), 1 - ratio(_total(far) / F.size(far), F.sqrt(F.greatest(area_a, area_b)))), 4)


def box_outline_likeness(a: tuple, b: tuple) -> Column:
    """outline_likeness() of two boxes, whose points at equal steps from the lower left corner on have a closed form."""

    def at(c: tuple, i: Column) -> tuple[Column, Column]:
        w, h = c[2] - c[0], c[3] - c[1]
        far = (w + h + w + h) * i / SAMPLES
        x = F.when(far < w, c[0] + far).when(far < w + h, c[2]).when(far < w + h + w, c[2] - (far - w - h)).otherwise(c[0])
        y = F.when(far < w, c[1]).when(far < w + h, c[1] + (far - w)).when(far < w + h + w, c[3]).otherwise(c[3] - (far - w - h - w))
        return x, y

    def distance(i: Column) -> Column:
        (x, y), (u, v) = at(a, i), at(b, i)
        return F.sqrt((x - u) * (x - u) + (y - v) * (y - v))

    total = F.aggregate(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), F.lit(0.0), lambda s, i: s + distance(i))
    return rnd(F.greatest(F.lit(0.0), 1 - ratio(total / SAMPLES, F.sqrt(F.greatest(box_area(a), box_area(b))))), 4)


def clip_convex(subject: Column, clip: Column) -> Column:
    """The part of subject inside a convex, counter-clockwise clip ring: one half plane after the other."""

    def half(poly: Column, side: Column) -> Column:
        a, b = side["a"], side["b"]
        where = lambda p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])

        none = F.array().cast("array<struct<x:double,y:double>>")

        def edge(s: Column) -> Column:
            p, q, sp, sq = (s[c] for c in ("p", "q", "sp", "sq"))
            t = sp / (sp - sq)
            cut = F.array(point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t))
            return F.concat(F.when(sp >= 0, F.array(p)).otherwise(none), F.when(((sp > 0) & (sq < 0)) | ((sp < 0) & (sq > 0)), cut).otherwise(none))

        placed = lambda poly: F.zip_with(poly, _next(poly), lambda p, q: F.struct(p.alias("p"), q.alias("q"), where(p).alias("sp"), where(q).alias("sq")))
        return F.flatten(F.transform(let(poly, placed), edge))

    return F.aggregate(let(clip, lambda c: F.zip_with(c, _next(c), lambda a, b: F.struct(a.alias("a"), b.alias("b")))), subject.cast("array<struct<x:double,y:double>>"), half)


def convex_iou(a: Column, b: Column) -> Column:
    common = ring_area(clip_convex(a, b))
    return F.coalesce(clamp(ratio(common, ring_area(a) + ring_area(b) - common), 0.0, 1.0), F.lit(0.0))
