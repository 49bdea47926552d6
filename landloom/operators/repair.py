"""Geometry that needs the general kernel: conflation, subtraction, planarising, georeferencing.

Outlines are arrays of rings of points (x, y). Parcels that dispute area form components, found by a
grid join and settled some whole components at a time; a component is a set of parcels that overlap each other, not
a whole layer, for touching is no dispute.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.functions import batch as B
from landloom.functions import geom as G
from landloom.functions import kernel as K
from landloom.operators.cut import cut
from landloom.operators.spatial import grid_join

RINGS = "array<array<struct<x:double,y:double>>>"
NOISE = 0.05
HAIR = 1e-6  # square metres: pieces below it are rounding of the overlay


def boxed(rings: Column | str) -> Column:
    """Rings on their way to pandas, each in a struct: nested arrays of different lengths can't be converted there."""
    return F.transform(rings, lambda r: F.struct(r.alias("r")))


def to_rings(value) -> list[np.ndarray]:
    """Rings of a row, or boxed() ones of a data frame, as arrays."""
    return [np.array([(p["x"], p["y"]) for p in (r if isinstance(r, list) else r["r"])]) for r in value] if value is not None else []


def from_rings(rings: list[np.ndarray]) -> list[list[dict]]:
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def batched(df: DataFrame, look: Callable, schema: str) -> DataFrame:
    """look(an Arrow batch of df), a list of columns, as a frame of a schema."""
    names = [c.split()[0].strip("`") for c in re.split(r",\s*(?![^<]*>)", schema)]

    def run(batches):
        for part in batches:
            if part.num_rows:
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in look(part)], names=names)

    return df.mapInArrow(run, schema)


def grouped(df: DataFrame, keys: list[str], look: Callable, schema: str, *order: str) -> DataFrame:
    """batched() over df dealt and sorted by keys (whole numbers) and then an order, so that the rows of a key lie in one batch; a batch has some keys."""

    def whole(batches):
        held: list[pa.RecordBatch] = []  # rows of one key, of which more may come
        for part in batches:
            if not part.num_rows:
                continue
            other = np.zeros(part.num_rows, bool)
            for k in keys:
                v = part[k].to_numpy(zero_copy_only=False)
                other |= v != v[-1]
            last = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            done = [*held, part.slice(0, last)] if last else held if held and any(held[0][k][0] != part[k][0] for k in keys) else []
            if done:
                yield pa.concat_batches(done)
                held = []
            held.append(part.slice(last))
        if held:
            yield pa.concat_batches(held)

    def run(batches):
        for part in whole(batches):
            yield from (pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names) for columns in look(part))

    names = [c.split()[0].strip("`") for c in re.split(r",\s*(?![^<]*>)", schema)]
    return dealt(df, *keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def members(column: pa.Array) -> tuple[B.Shapes, np.ndarray]:
    """The shapes of a column of lists of (ord, rings), and the row of each."""
    n = B.lengths(column)
    return B.Shapes.of(pc.struct_field(column.flatten(), "rings")), np.repeat(np.arange(len(n)), n)


def listed(shapes: DataFrame, key: str, ord: str = "ord", rings: str = "rings") -> DataFrame:
    """key, own: the shapes of a key in their order."""
    return shapes.groupBy(F.col(key)).agg(F.array_sort(F.collect_list(F.struct(F.col(ord).alias("ord"), F.col(rings).alias("rings")))).alias("own"))


def valid_rings(df: DataFrame, col: str = "rings") -> DataFrame:
    """df with every outline replaced by its even-odd parts, and repaired: whether that changed it."""

    def run(batches):
        for part in batches:
            fixed, bad = B.repaired(B.Shapes.of(part[col]))
            yield pa.RecordBatch.from_arrays([*[fixed.arrow() if c == col else part[c] for c in part.schema.names], pa.array(bad)], names=[*part.schema.names, "repaired"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, repaired boolean")


def conflate(parcels: DataFrame, structures: DataFrame, least_inside: float = 0.55) -> DataFrame:
    """parcels (idx, rings) with the footprints (idx, ord, rings) that lie to a share inside: united in order.

    idx, rings, included, added (area). Order matters, for each step looks at the outline as it is by then: the first footprints of all
    parcels of a batch are looked at together, then the second ones, and so on.
    """

    def look(part: pa.RecordBatch) -> list:
        rings = B.Shapes.of(part["rings"])
        (own, row), before, n = members(part["own"]), B.area(rings), np.zeros(len(rings), np.int32)
        size = B.area(own)
        count = np.bincount(row, minlength=len(rings))
        start = np.cumsum(count) - count
        for k in range(count.max(initial=0)):
            at = np.flatnonzero(count > k)
            at = at[size[start[at] + k] > 0]
            common, united = B.common_and_union(rings.take(at), own.take(start[at] + k))
            fits = np.flatnonzero(common / size[start[at] + k] >= least_inside)
            rings = rings.replaced(at[fits], united.take(fits))
            n[at[fits]] += 1
        return [part["idx"], rings.arrow(), n, B.area(rings) - before]

    both = parcels.select("idx", "rings").join(listed(structures, "idx"), "idx", "left")
    return batched(dealt(both), look, f"idx long, rings {RINGS}, included int, added double")


def subtract(parcels: DataFrame, corridors: DataFrame, size: float = 32.0) -> DataFrame:
    """parcels (idx, rings, box) without the corridors (ord, rings, box) that reach them: idx, rings, removed (area)."""
    a = parcels.select(F.col("idx").alias("a_idx"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = corridors.select(F.col("ord").alias("b_ord"), F.col("rings").alias("b_rings"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    lists = listed(grid_join(a, b, size), "a_idx", "b_ord", "b_rings").withColumnRenamed("a_idx", "idx")

    def look(part: pa.RecordBatch) -> list:
        rings = B.Shapes.of(part["rings"])
        own, row = members(part["own"])
        at = np.unique(row)
        rest = B.overlay(rings.take(at), own, B.FIRST, of=np.searchsorted(at, row))
        removed = np.zeros(len(rings))
        removed[at] = B.area(rings.take(at)) - B.area(rest)
        return [part["idx"], rings.replaced(at, rest).arrow(), removed]

    return batched(parcels.select("idx", "rings").join(lists, "idx", "left"), look, f"idx long, rings {RINGS}, removed double")


def groups(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node and the smallest node of its component: labels spread and jump until none moves."""
    both = cut(edges.union(edges.select(F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = cut(labels.join(near, "node").select("node", "label", F.least("label", "near").alias("near")))
        jump = step.select(F.col("node").alias("near"), F.col("near").alias("far"))
        new = cut(step.join(jump, "near").select("node", F.least("near", "far").alias("new"), "label"))
        labels = new.select("node", F.col("new").alias("label"))
        if not new.filter("new < label").limit(1).count():
            return labels


def planarise(parcels: DataFrame, size: float = 32.0, passes: int = 12) -> DataFrame:
    """parcels (idx, rings, box) -> idx, rings, repaired, lost (area), resolved (disputes won), settled: no two outlines share more than noise.

    Invalid outlines are repaired; then, in each component of disputes, the largest dispute is settled first and the
    smaller parcel (the first of the pair on ties) gives up the common area, until none is left or after some passes.
    A parcel of which no more than noise is left is emptied. settled is false where the passes did not suffice. Outlines only shrink, so the
    disputes of a pass are among the first ones; those that share no parcel are settled at once, whatever their component.
    """
    fixed = cut(valid_rings(dealt(parcels.select("idx", "rings"))))
    bounds = F.col("ring")
    corner = fixed.select("idx", F.explode("rings").alias("ring")).select("idx", G.ring_bounds(bounds).alias("b")).groupBy("idx").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))
    side = lambda p: corner.join(fixed.select("idx", "rings"), "idx").select(*[F.col(c).alias(p + c) for c in ("idx", "rings", "x0", "y0", "x1", "y1")])
    near = grid_join(side("a_"), side("b_"), size).filter("a_idx < b_idx")

    def disputed(part: pa.RecordBatch) -> list:
        keep = pa.array(B.areas(B.Shapes.of(part["a_rings"]), B.Shapes.of(part["b_rings"]), B.BOTH)[0] > NOISE)
        return [part[c].filter(keep) for c in ("a_idx", "b_idx")]

    edges = cut(batched(near.select("a_idx", "b_idx", "a_rings", "b_rings"), disputed, "a long, b long"))
    member = groups(edges)

    foes = edges.groupBy(F.col("a").alias("idx")).agg(F.collect_list("b").alias("foes"))
    joined = fixed.join(member.withColumnRenamed("node", "idx"), "idx", "left")
    quiet = joined.filter("label IS NULL").select("idx", "rings", "repaired", F.lit(0.0).alias("lost"), F.lit(0).alias("resolved"), F.lit(True).alias("settled"))
    members = joined.filter("label IS NOT NULL").join(foes, "idx", "left").select("label", "idx", "rings", "repaired", F.coalesce("foes", F.array().cast("array<long>")).alias("foes"))
    return grouped(members, ["label"], lambda part: settle(part, passes), f"idx long, rings {RINGS}, repaired boolean, lost double, resolved int, settled boolean", "idx").unionByName(quiet)


def settle(part: pa.RecordBatch, passes: int) -> Iterator[list]:
    """Whole components (label, idx, rings, repaired, foes: the idx of later parcels in dispute) -> idx, rings, repaired, lost, resolved, settled."""
    idx, label = (part[c].to_numpy(zero_copy_only=False) for c in ("idx", "label"))
    rings = B.Shapes.of(part["rings"])
    area, shapes = B.area(rings), B.unpacked(rings)
    first, resolved, calm = area.copy(), np.zeros(len(idx), np.int32), np.ones(len(idx), bool)
    by = np.argsort(idx)
    one = np.repeat(np.arange(len(idx)), B.lengths(part["foes"]))
    two = by[np.searchsorted(idx[by], part["foes"].flatten().to_numpy())]
    some = lambda which: B.packed([shapes[i] for i in which])
    fresh = np.ones(len(idx), bool)  # only pairs with a shape that has changed are looked at again
    for _ in range(passes):
        close = np.flatnonzero(fresh[one] | fresh[two])
        a, b = one[close], two[close]
        common = B.areas(some(a), some(b), B.BOTH)[0]
        much = common > NOISE
        a, b, common = a[much], b[much], common[much]
        calm, fresh = ~np.isin(label, label[a]), np.zeros(len(idx), bool)
        if calm.all():
            break
        order = np.lexsort((idx[b], idx[a], -common))
        a, b = a[order], b[order]
        for at in waves(a, b):
            lost = area[a[at]] <= area[b[at]]
            loser, winner = np.where(lost, a[at], b[at]), np.where(lost, b[at], a[at])
            meet = B.areas(some(loser), some(winner), B.BOTH)[0] > 0
            loser, winner = loser[meet], winner[meet]
            left = B.overlay(some(loser), some(winner), B.FIRST)
            left = B.only(left, B.area(left.single()) > HAIR)
            # What is left of a parcel that its neighbour covers is noise: it was a duplicate.
            for i, rest, size in zip(loser.tolist(), B.unpacked(left), B.area(left).tolist(), strict=True):
                shapes[i], area[i] = (rest, size) if size > NOISE else ([], 0.0)
            resolved[winner] += 1
            fresh[loser] = True
    yield [part["idx"], B.packed(shapes).arrow(), part["repaired"], first - area, resolved, calm]


def waves(a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Pairs (a, b) in turn, as lists of places: pairs of one list have no member in common, and of two pairs that have, the first lies in an earlier list."""
    last: dict[int, int] = {}
    turn = np.empty(len(a), np.int64)
    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        turn[k] = last[i] = last[j] = max(last.get(i, -1), last.get(j, -1)) + 1
    order = np.argsort(turn, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(turn[order])) + 1) if len(a) else []


def dealt(shapes: DataFrame, *keys: str) -> DataFrame:
    """Shapes dealt to all cores, by idx or other keys: the work is in each shape, so partitions aren't merged by their few bytes."""
    return shapes.repartition(max(shapes.sparkSession.sparkContext.defaultParallelism, int(shapes.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *(keys or ("idx",)))


def with_box(shapes: DataFrame) -> DataFrame:
    """Shapes (idx, rings) that have a ring, with their box."""
    b = shapes.select("idx", F.explode("rings").alias("r")).select("idx", G.ring_bounds(F.col("r")).alias("b")).groupBy("idx")
    return shapes.join(b.agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1")), "idx")


def issue_counts(shapes: DataFrame, least: float = 2.0, size: float = 32.0) -> DataFrame:
    """kind, n: pairs of outlines (idx, rings) that share more than noise, slivers under a least area, invalid outlines, empty ones."""

    def look(part: pa.RecordBatch) -> list:
        rings = B.Shapes.of(part["rings"])
        size = B.area(rings)
        return [(size > 0) & (size < least), np.bincount(rings.owner()[~B.valid(rings)], minlength=len(rings)) > 0, np.diff(rings.shapes) == 0]

    one = batched(dealt(shapes).select("rings"), look, "sliver boolean, invalid boolean, empty boolean").agg(*[F.count_if(k).alias(k) for k in ("sliver", "invalid", "empty")])
    side = lambda p: with_box(shapes).select(*[F.col(c).alias(p + c) for c in ("idx", "rings", "x0", "y0", "x1", "y1")])
    near = grid_join(side("a_"), side("b_"), size).filter("a_idx < b_idx")

    def disputed(part: pa.RecordBatch) -> list:
        return [B.areas(B.Shapes.of(part["a_rings"]), B.Shapes.of(part["b_rings"]), B.BOTH)[0] > NOISE]

    two = batched(near.select("a_rings", "b_rings"), disputed, "overlap boolean").agg(F.count_if("overlap").alias("overlap"))
    return one.join(two, F.lit(True)).select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in ("overlap", "sliver", "invalid", "empty")])).alias("x")).select("x.*")  # one row each


def georeference(points: DataFrame, smoothing: float = 0.01) -> DataFrame:
    """Fits a spline per sheet to tie points (sheet, sx, sy, tx, ty): status, points, mean_error, largest_error, baseline.

    Fewer than four complete points: SKIPPED; points in one line: FAILED.
    """

    def fit(part: pd.DataFrame) -> pd.DataFrame:
        name = part["sheet"].iloc[0]
        ties = part.dropna().drop_duplicates(["sx", "sy"])
        if len(ties) < 4:
            return pd.DataFrame([(name, "SKIPPED", len(ties), None, None, None)], columns=cols)
        s, t = ties[["sx", "sy"]].to_numpy(float), ties[["tx", "ty"]].to_numpy(float)
        try:
            off = np.hypot(*(K.thin_plate(s, t, smoothing)[1](s) - t).T)
        except np.linalg.LinAlgError:
            return pd.DataFrame([(name, "FAILED", len(ties), None, None, None)], columns=cols)
        return pd.DataFrame([(name, "SUCCESS", len(ties), off.mean(), off.max(), float(np.sqrt((((t - s) ** 2).sum(1)).mean())))], columns=cols)

    cols = ["sheet", "status", "points", "mean_error", "largest_error", "baseline"]
    return dealt(points, "sheet").groupBy("sheet").applyInPandas(fit, "sheet string, status string, points int, mean_error double, largest_error double, baseline double")


def gaps(parcels: DataFrame, extent: tuple[float, float, float, float], tile: float = 128.0, ignore: float = 0.05, material: float = 25.0, exclusions: DataFrame | None = None) -> DataFrame:
    """Area of an extent that no outline and no exclusion covers, by tile: tx, ty, gap_area, kind (covered, residual or gap).

    parcels and exclusions (roads, drains, water) have idx, rings and box. Tiles are independent, so no union of the whole layer is ever made.
    """
    x0, y0, x1, y1 = extent
    spark = parcels.sparkSession
    if exclusions is not None:
        parcels = parcels.unionByName(exclusions)
    nx, ny = int(np.ceil((x1 - x0) / tile)), int(np.ceil((y1 - y0) / tile))
    tiles = spark.range(nx * ny).select((F.col("id") % nx).alias("tx"), F.floor(F.col("id") / nx).alias("ty"))
    tx = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("x0") - x0) / tile)).cast("long"), F.least(F.lit(nx - 1), F.floor((F.col("x1") - x0) / tile)).cast("long")))
    ty = F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("y0") - y0) / tile)).cast("long"), F.least(F.lit(ny - 1), F.floor((F.col("y1") - y0) / tile)).cast("long")))
    inside = parcels.filter((F.col("x1") >= x0) & (F.col("x0") <= x1) & (F.col("y1") >= y0) & (F.col("y0") <= y1))
    placed = inside.withColumn("tx", tx).withColumn("ty", ty).groupBy("tx", "ty").agg(F.collect_list(F.struct("rings")).alias("own"))

    def uncovered(part: pa.RecordBatch) -> list:
        i, j = (part[c].to_numpy(zero_copy_only=False) for c in ("tx", "ty"))
        a, b = x0 + i * tile, y0 + j * tile
        c, d = np.minimum(a + tile, x1), np.minimum(b + tile, y1)
        n = np.arange(len(i) + 1)
        ground = B.Shapes(np.stack([a, b, c, b, c, d, a, d], 1).reshape(-1, 2), 4 * n, n)
        own, row = members(part["own"])
        return [part["tx"], part["ty"], B.areas(ground, own, B.FIRST, of=row)[0]]

    out = batched(tiles.join(placed, ["tx", "ty"], "left"), uncovered, "tx long, ty long, gap_area double")
    return out.withColumn("kind", F.when(F.col("gap_area") <= ignore, "covered").when(F.col("gap_area") <= material, "residual").otherwise("gap"))


def eave_correction(footprints: DataFrame, trigger: float = 2.5, inset: float = 0.4) -> DataFrame:
    """footprints (idx, height, rings), convex: those at least trigger high move inwards; one that collapses stays. idx, rings, corrected, removed."""

    def look(part: pa.RecordBatch) -> list:
        rings, height = B.Shapes.of(part["rings"]), part["height"].to_numpy(zero_copy_only=False).astype(float)
        high = np.flatnonzero(height >= trigger)
        small = B.shrink_convex(rings.take(high), inset)
        size, own = B.area(small.single()), small.owner()
        order = np.lexsort((np.arange(len(size)), -size, own))
        best = order[np.r_[True, np.diff(own[order]) != 0][: len(order)]]  # the largest part of each
        at = high[own[best]]
        done = rings.replaced(at, small.single().take(best))
        corrected = np.zeros(len(rings), bool)
        corrected[at] = True
        return [part["idx"], done.arrow(), corrected, B.area(rings) - B.area(done)]

    return batched(dealt(footprints.select("idx", "height", "rings")), look, f"idx long, rings {RINGS}, corrected boolean, removed double")


def sliver_hosts(boxes: DataFrame, floor: float, size: float = 32.0) -> DataFrame:
    """Boxes (idx, x0...) whose area is under a floor, with the neighbour that shares the longest side (ties: larger area, smaller idx): idx, host, shared.

    A sliver without neighbour has none. Slivers are no hosts.
    """
    b = G.box()
    sized = boxes.withColumn("area", G.box_area(b)).withColumn("thin", G.is_sliver(F.col("area"), ((b[2] - b[0]) + (b[3] - b[1])) * 2, floor))
    of = lambda df, p: df.select(*[F.col(c).alias(p + c) for c in ("idx", "x0", "y0", "x1", "y1", "area")])
    thin = sized.filter("thin")
    pairs = grid_join(of(thin, "a_"), of(sized.filter("NOT thin"), "b_"), size, margin=0.001)
    a, c = G.box("a_"), G.box("b_")
    along = F.greatest(F.least(a[2], c[2]) - F.greatest(a[0], c[0]), F.least(a[3], c[3]) - F.greatest(a[1], c[1]))
    best = pairs.withColumn("shared", F.greatest(along, F.lit(0.0))).groupBy(F.col("a_idx").alias("idx")).agg(F.max_by(F.struct(F.col("b_idx").alias("host"), "shared"), F.struct("shared", "b_area", -F.col("b_idx"))).alias("h"))
    return thin.select("idx").join(best, "idx", "left").select("idx", "h.host", "h.shared")
