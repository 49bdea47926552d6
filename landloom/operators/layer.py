"""A land layer as shared edges: faces of all outlines, each with what covers it, and edges with a face on either side.

The plane is cut at every outline, some tiles in one pass (functions.arrangement), and tiles are sewn together along their borders by joins; from
then on repair is relational and never touches a coordinate. A disputed face goes to the largest parcel that covers it; a sliver is
contracted into the neighbour with the longest common edge, chains of slivers in one round; of a parcel in several parts the largest
stays; what nothing covers is labelled across tiles, judged by whole parts, and closed. Outlines are walked from the edges between
different owners at the end, so neighbours share their corners exactly. No component, and no layer, lies in one task: a task
holds a tile, or the outline of one parcel.

Limits: an outline is sent whole to each tile that its box touches, and all lines of a tile meet each other, so the tile should hold
tens of outlines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from landloom.functions import arrangement as A
from landloom.functions import batch as B
from landloom.operators import repair as R
from landloom.operators.cut import cut
from landloom.operators.topology import upper_median

EXTENT, EXCLUDED = -1, -2  # keys of the ground to be covered and of what is left out of it
NOISE, MATERIAL, COMPACT = 0.05, 25.0, 25.0
BEYOND = "coordinates or faces beyond the numbers of faces: choose a larger or a smaller tile"
CREATED = 1 << 52  # added to a face's number it is the key of a record made from a gap
ROW = "kind string, face long, cover array<long>, area double, other long, ax double, ay double, bx double, by double, line long, beside long"
HALF = 1 << 17  # tiles on each side of the origin; 18 bits a direction and 16 for the faces of a tile, so a number is exact as a double too


def prepared(shapes: DataFrame, snap: float) -> DataFrame:
    """shapes (idx, rings) -> idx, rings on a grid (0: as they are), their box, invalid, snapped. A shape without area has no rings."""

    def look(part: pa.RecordBatch) -> list:
        old = B.Shapes.of(part["rings"])
        bad = np.bincount(old.owner()[~B.valid(old)], minlength=len(old)) > 0
        new = B.without_repeats(B.Shapes(np.round(np.round(old.xy / snap) * snap, 9) if snap else old.xy, old.rings, old.shapes))
        new = B.only(new, np.diff(new.rings) >= 3)
        moved = np.abs(B.ring_areas(old) - B.ring_areas(new)) > 1e-9
        at = np.flatnonzero(np.diff(new.shapes) > 0)
        first = new.rings[new.shapes[at]]
        box = np.full((len(new), 4), np.nan)
        if len(at):
            box[at] = np.column_stack([np.minimum.reduceat(new.xy, first), np.maximum.reduceat(new.xy, first)])
        return [part["idx"], new.arrow(), *[pa.array(box[:, k], mask=np.isnan(box[:, k])) for k in range(4)], bad, moved]

    return R.batched(R.dealt(shapes.select("idx", "rings")), look, f"idx long, rings {R.RINGS}, x0 double, y0 double, x1 double, y1 double, invalid boolean, snapped boolean")


def overlay(shapes: DataFrame, tile: float) -> tuple[DataFrame, DataFrame]:
    """faces (face, cover, area) and edges (left, right, ax, ay, bx, by, length) of prepared shapes."""
    cells = lambda lo, hi: F.explode(F.sequence(*(F.floor(c / tile).cast("long") for c in (F.col(lo) - 1e-3, F.col(hi) + 1e-3))))
    placed = shapes.filter(F.size("rings") > 0).withColumn("tx", cells("x0", "x1")).withColumn("ty", cells("y0", "y1"))

    def look(part: pa.RecordBatch) -> Iterator[list]:
        tx, ty = (part[c].to_numpy(zero_copy_only=False) for c in ("tx", "ty"))
        if not (min(tx.min(), ty.min()) >= -HALF and max(tx.max(), ty.max()) < HALF):
            raise ValueError(BEYOND)
        begin = np.flatnonzero(A.leading(tx) | A.leading(ty))
        number = np.repeat(np.arange(len(begin)), np.diff(np.r_[begin, len(tx)]))
        tx, ty = tx[begin], ty[begin]
        first = (tx + HALF << 34) + (ty + HALF << 16)
        at = lambda v: np.round(v, 6) + 0.0
        for a in A.arranged(B.Shapes.of(part["rings"]), part["idx"].to_numpy(zero_copy_only=False), number, np.column_stack([tx * tile, ty * tile, (tx + 1) * tile, (ty + 1) * tile])):
            if a.number.max(initial=0) >= 1 << 16:
                raise ValueError(BEYOND)
            (et, f, g, ends), (bt, side, span, h) = a.edges, a.border
            counts = len(a.tile), len(et), len(bt)
            void = [pa.nulls(n, pa.float64()) for n in counts]
            none = [pa.nulls(n, pa.int64()) for n in counts]
            kinds = np.r_[np.zeros(counts[0], np.int64), np.ones(counts[1], np.int64), 2 + side]
            upright = side < 2
            line, beside = np.where(upright, tx[bt], ty[bt]) + (side % 2), np.where(upright, ty[bt], tx[bt])
            column = lambda *parts: pa.concat_arrays([p if isinstance(p, pa.Array) else pa.array(p) for p in parts])
            covers = column(pa.ListArray.from_arrays(pa.array(a.starts, pa.int32()), pa.array(a.cover, pa.int64())), pa.nulls(counts[1] + counts[2], pa.list_(pa.int64())))
            kind = pa.array(["face", "edge", "v high", "v low", "h high", "h low"]).take(pa.array(kinds))
            ends = [column(void[0], at(ends[:, k]), at(span[:, k]) if k < 2 else void[2]) for k in range(4)]
            yield [kind, column(first[a.tile] + a.number, first[et] + f, first[bt] + h), covers, column(a.area, *void[1:]), column(none[0], first[et] + g, none[2]), *ends, *[column(*none[:2], v) for v in (line, beside)]]

    out = cut(R.grouped(placed.select("tx", "ty", "idx", "rings"), ["tx", "ty"], look, ROW, "idx"))
    edges = out.filter("kind = 'edge'").select(F.col("face").alias("left"), F.col("other").alias("right"), "ax", "ay", "bx", "by")
    lo, hi, spot = F.greatest("a0", "b0"), F.least("a1", "b1"), F.round(F.col("line") * tile, 6)
    for way in "vh":
        side = lambda which, p: out.filter(F.col("kind") == f"{way} {which}").select("line", "beside", F.col("face").alias(f"{p}f"), F.col("ax").alias(f"{p}0"), F.col("ay").alias(f"{p}1"))  # noqa: B023, E731
        seam = side("low", "a").join(side("high", "b"), ["line", "beside"]).filter(hi - lo > 2 * A.HAIR)
        ends = (spot, lo, spot, hi) if way == "v" else (lo, spot, hi, spot)
        left, right = ("af", "bf") if way == "v" else ("bf", "af")
        edges = edges.union(seam.select(F.col(left).alias("left"), F.col(right).alias("right"), *ends))
    length = F.sqrt((F.col("bx") - F.col("ax")) * (F.col("bx") - F.col("ax")) + (F.col("by") - F.col("ay")) * (F.col("by") - F.col("ay")))
    return out.filter("kind = 'face'").select("face", "cover", "area"), cut(edges.withColumn("length", length))


def parcels_of(faces: DataFrame) -> DataFrame:
    """face, area, idx for each parcel that covers a face."""
    return faces.select("face", "area", F.explode(F.filter("cover", lambda k: k >= 0)).alias("idx"))


def disputes(faces: DataFrame) -> DataFrame:
    """a, b, area: pairs of parcels that share more than noise."""
    mine = parcels_of(faces.filter(F.size(F.filter("cover", lambda k: k >= 0)) > 1))
    pairs = mine.select("face", "area", F.col("idx").alias("a")).join(mine.select("face", F.col("idx").alias("b")), "face").filter("a < b")
    return pairs.groupBy("a", "b").agg(F.sum("area").alias("area")).filter(F.col("area") > NOISE)


def settled(faces: DataFrame) -> tuple[DataFrame, dict]:
    """faces with owner: the largest parcel over a face (ties, to a millionth: the later one). A parcel of which no more than noise is left goes whole."""
    over = parcels_of(faces)
    first = cut(over.groupBy("idx").agg(F.round(F.sum("area"), 6).alias("whole")))
    best = over.join(first, "idx").groupBy("face").agg(F.max_by("idx", F.struct("whole", "idx")).alias("owner"))
    won = cut(faces.join(best, "face", "left"))
    kept = won.filter("owner IS NOT NULL").groupBy(F.col("owner").alias("idx")).agg(F.sum("area").alias("kept"))
    gone = cut(first.join(kept, "idx", "left").filter(F.coalesce("kept", F.lit(0.0)) <= NOISE).select("idx"))
    pairs = disputes(faces)
    found = pairs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area")).first()
    won = won.join(gone.withColumnRenamed("idx", "owner"), "owner", "left_anti").unionByName(won.join(gone.withColumnRenamed("idx", "owner"), "owner", "left_semi").withColumn("owner", F.lit(None).cast("long")))
    return cut(won.select("face", "cover", "area", "owner")), {"overlaps_resolved": found["n"], "overlap_area_removed_sqm": found["area"], "parcels_absorbed": gone.count()}


def beside(faces: DataFrame, edges: DataFrame, label: str = "owner") -> DataFrame:
    """a, b, length: how long the labels of faces lie beside each other, both ways; null where there is none."""
    of = faces.select("face", F.col(label).alias("_l"))
    ends = edges.join(of.select(F.col("face").alias("left"), F.col("_l").alias("a")), "left", "left").join(of.select(F.col("face").alias("right"), F.col("_l").alias("b")), "right", "left")
    both = ends.filter(~F.col("a").eqNullSafe(F.col("b"))).groupBy("a", "b").agg(F.sum("length").alias("length"))
    return both.union(both.select(F.col("b"), F.col("a"), "length")).groupBy("a", "b").agg(F.sum("length").alias("length")).filter("a IS NOT NULL")


def contracted(areas: DataFrame, near: DataFrame, floor: float) -> tuple[DataFrame, int, int, float]:
    """Slivers of a layer, by areas (idx, area) and near (beside): idx -> host for each that goes (null: no neighbour), their number, isolated ones, area.

    A round hands every sliver to the neighbour of longest common edge (ties: the larger, then the smaller idx); one whose host is a smaller
    sliver waits for it. Hosts only grow in (no sliver, area, idx), so chains are followed to their end in the round and every round makes progress.
    """
    spark = areas.sparkSession
    moved = spark.createDataFrame([], "idx long, host long")
    n = isolated = 0
    taken = 0.0
    while True:
        around = near.groupBy(F.col("a").alias("idx")).agg(F.sum("length").alias("length"))
        sized = areas.join(around, "idx", "left")
        thin = (F.col("area") < floor) | ((F.col("length") * F.col("length") / F.col("area") > COMPACT) & (F.col("area") < floor * 20))
        sized = cut(sized.withColumn("thin", F.coalesce(thin, F.lit(False))))
        slivers = sized.filter("thin").select("idx", "area")
        if not slivers.limit(1).count():
            return moved, n, isolated, taken
        options = near.filter("b IS NOT NULL").join(slivers.select(F.col("idx").alias("a"), F.col("area").alias("own")), "a")
        options = options.join(sized.select(F.col("idx").alias("b"), F.col("area").alias("host_area"), "thin"), "b")
        host = options.groupBy(F.col("a").alias("idx")).agg(F.max_by(F.struct("b", "host_area", "thin", "own"), F.struct("length", "host_area", -F.col("b"))).alias("h"))
        step = slivers.join(host, "idx", "left").select("idx", "area", F.col("h.b").alias("host"), (F.col("h").isNull() | ~F.col("h.thin") | (F.struct("h.host_area", "h.b") > F.struct("h.own", "idx"))).alias("goes"))
        step = cut(step.filter("goes").select("idx", "area", "host"))
        told = step.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("host").isNull()).alias("alone"), F.sum("area").alias("area")).first()
        n, isolated, taken = n + told["n"], isolated + told["alone"], taken + told["area"]
        ends = step.select("idx", "host")
        while True:  # hosts that go themselves are followed, at double the distance each time
            far = ends.select(F.col("idx").alias("host"), F.col("host").alias("next"), F.lit(True).alias("on"))
            ends = cut(ends.join(far, "host", "left").select("idx", F.when(F.col("on"), F.col("next")).otherwise(F.col("host")).alias("host"), F.coalesce("on", F.lit(False)).alias("on")))
            if not ends.filter("on AND host IS NOT NULL").limit(1).count():
                break
            ends = ends.select("idx", "host")
        moved = cut(renamed(moved, ends, "host").unionByName(ends.select("idx", "host")))
        areas = cut(renamed(areas, ends, "idx").filter("idx IS NOT NULL").groupBy("idx").agg(F.sum("area").alias("area")))
        near = renamed(renamed(near, ends, "a"), ends, "b").filter("a IS NOT NULL AND NOT a <=> b")
        near = cut(near.groupBy("a", "b").agg(F.sum("length").alias("length")))


def renamed(df: DataFrame, ends: DataFrame, col: str) -> DataFrame:
    """df with the values of a column that are in ends (idx, host) replaced by their hosts."""
    m = ends.select(F.col("idx").alias(col), F.col("host").alias("_to"), F.lit(True).alias("_on"))
    out = df.join(m, col, "left").withColumn(col, F.when(F.col("_on"), F.col("_to")).otherwise(F.col(col)))
    return out.select(*df.columns)


def alike(faces: DataFrame, edges: DataFrame, label: str) -> DataFrame:
    """l, a, b: pairs of faces with the same label on both sides of an edge."""
    own = faces.filter(F.col(label).isNotNull()).select("face", F.col(label).alias("_l"))
    met = edges.join(own.select(F.col("face").alias("left"), F.col("_l").alias("l")), "left").join(own.select(F.col("face").alias("right"), F.col("_l").alias("m")), "right")
    return met.filter("l = m").select("l", F.col("left").alias("a"), F.col("right").alias("b"))


def parts_of(faces: DataFrame, edges: DataFrame, label: str, large: bool = False) -> DataFrame:
    """face, part for faces with a label: the smallest face of those of equal label that meet along edges.

    The faces of a parcel are joined in one task, as its outline is walked in one; large: labels may spread over the whole layer, so parts are found in rounds.
    """
    met = alike(faces, edges, label)
    if large:
        named = R.groups(met.select("a", "b")).select(F.col("node").alias("face"), F.col("label").alias("part"))
    else:

        def joined(part: pa.RecordBatch) -> Iterator[list]:
            nodes, at = np.unique(np.column_stack([part["a"].to_numpy(), part["b"].to_numpy()]), return_inverse=True)
            yield [nodes, nodes[A.components(len(nodes), *at.reshape(-1, 2).T)]]

        named = R.grouped(met, ["l"], joined, "face long, part long")
    return faces.filter(F.col(label).isNotNull()).select("face").join(named, "face", "left").select("face", F.coalesce("part", "face").alias("part"))


@dataclass
class Layer:
    """faces (face, cover, area, owner), edges, and the log of the repair."""

    faces: DataFrame
    edges: DataFrame
    log: dict

    def areas(self) -> DataFrame:
        return self.faces.filter("owner IS NOT NULL").groupBy(F.col("owner").alias("idx")).agg(F.sum("area").alias("area"))

    def gaps(self) -> DataFrame:
        return gap_parts(self.faces, self.edges)

    def outlines(self) -> DataFrame:
        """idx, rings: outlines (outer rings against the clock, holes with it) walked from the edges between different owners."""
        of = self.faces.select("face", "owner")
        lined = self.edges.join(of.select(F.col("face").alias("left"), F.col("owner").alias("a")), "left", "left").join(of.select(F.col("face").alias("right"), F.col("owner").alias("b")), "right", "left").filter(~F.col("a").eqNullSafe(F.col("b")))
        lined = cut(lined.select("a", "b", "ax", "ay", "bx", "by"))
        node = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        ends = lined.select(F.explode(F.array(node("ax", "ay"), node("bx", "by"))).alias("p"))
        plain = ends.groupBy("p").agg(F.count(F.lit(1)).alias("n")).filter("n = 2").select(F.col("p.x").alias("ax"), F.col("p.y").alias("ay"), F.lit(True).alias("plain"))
        one = lined.filter("a IS NOT NULL").select(F.col("a").alias("idx"), "ax", "ay", "bx", "by")
        two = lined.filter("b IS NOT NULL").select(F.col("b").alias("idx"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
        directed = one.union(two).join(plain, ["ax", "ay"], "left").select("idx", "ax", "ay", "bx", "by", F.coalesce("plain", F.lit(False)).alias("plain"))

        def look(part: pa.RecordBatch) -> Iterator[list]:
            of = lambda c: part[c].to_numpy(zero_copy_only=False)
            idx, rings = A.rings_walked(of("idx"), np.column_stack([of(c) for c in ("ax", "ay", "bx", "by")]), of("plain").astype(bool))
            yield [idx, rings.arrow()]

        return R.grouped(directed, ["idx"], look, f"idx long, rings {R.RINGS}", "ax", "ay", "bx", "by")


def gap_parts(faces: DataFrame, edges: DataFrame, floor: float = 0.0) -> DataFrame:
    """part, area, kind of the connected ground of the extent that has no owner and is not left out: covered (noise), residual or gap, each judged whole."""
    open_ = faces.filter(F.col("owner").isNull() & F.array_contains("cover", F.lit(EXTENT)) & ~F.array_contains("cover", F.lit(EXCLUDED))).withColumn("open", F.lit(0))
    part = parts_of(open_, edges, "open", large=True)
    whole = open_.join(part, "face").groupBy("part").agg(F.sum("area").alias("area"))
    return whole.withColumn("kind", F.when(F.col("area") <= NOISE, "covered").when(F.col("area") <= max(MATERIAL, floor), "residual").otherwise("gap"))


def with_ground(shapes: DataFrame, extent: DataFrame | None, exclusions: DataFrame | None) -> DataFrame:
    """shapes (idx, rings) together with the rings of the extent and of what is left out of it; overlapping exclusions are one key each, counted down."""
    out = shapes.select("idx", "rings")
    if extent is not None:
        out = out.unionByName(extent.select(F.lit(EXTENT).cast("long").alias("idx"), "rings"))
    if exclusions is not None:
        place = F.monotonically_increasing_id() + 1
        out = out.unionByName(exclusions.select((F.lit(EXCLUDED) - place).alias("idx"), "rings"))
    return out


def planar_layer(shapes: DataFrame, extent: DataFrame | None = None, exclusions: DataFrame | None = None, snap: float = 0.15, min_sliver: float = 2.0, tile: float = 64.0, max_iterations: int = 6) -> Layer:
    """shapes (idx >= 0, rings; a key once) as a planar layer: no ground twice, no slivers, one part a parcel, no material gap within the extent.

    Rings count even-odd, so crossed outlines become their lobes. extent and exclusions have rings. The passes go on until none changes
    anything or max_iterations is reached (log: converged). The log has the 19 figures of the repair. A gap between MATERIAL and 50 times the sliver floor goes to
    the neighbour of longest common edge; a larger one becomes a record of its own (idx from CREATED on). An empty table gives an empty layer.
    """
    fixed = cut(prepared(with_ground(shapes, extent, exclusions), snap))
    mine = fixed.filter("idx >= 0")
    told = mine.agg(F.count_if("invalid").alias("bad"), F.count_if("snapped").alias("moved"), F.count_if(F.size("rings") == 0).alias("flat")).first()
    faces, edges = overlay(fixed, tile)
    faces = faces.withColumn("cover", F.array_distinct(F.transform("cover", lambda k: F.greatest(k, F.lit(EXCLUDED)))))
    faces, settlement = settled(cut(faces))
    median = upper_median(parcels_of(faces).groupBy("idx").agg(F.sum("area").alias("area")), "area").first()["median"] or 0.0
    floor = min(min_sliver, 0.25 * median) if median else min_sliver
    log = {
        "snap_tolerance_m": snap, "min_sliver_area_sqm": min_sliver, "iterations": 0, "converged": False, "repaired_invalid": told["bad"], "snapped_features": told["moved"], **settlement, "slivers_dissolved": 0, "sliver_area_absorbed_sqm": 0.0,
        "slivers_isolated": 0, "area_floor_sqm": floor, "median_holding_sqm": median, "gaps_closed": 0, "gap_area_closed_sqm": 0.0, "parcels_created_from_gap": 0, "multi_parts_reduced": 0, "features_dropped": told["flat"],
    }
    while log["iterations"] < max_iterations and not log["converged"]:
        log["iterations"] += 1
        areas = faces.filter("owner IS NOT NULL").groupBy(F.col("owner").alias("idx")).agg(F.sum("area").alias("area"))
        moved, n, alone, area = contracted(cut(areas), cut(beside(faces, edges)), floor) if floor > 0 else (None, 0, 0, 0.0)
        if n:
            faces = cut(renamed(faces, moved, "owner"))
        log["slivers_dissolved"], log["slivers_isolated"], log["sliver_area_absorbed_sqm"] = log["slivers_dissolved"] + n, log["slivers_isolated"] + alone, log["sliver_area_absorbed_sqm"] + area
        part = cut(parts_of(faces, edges, "owner"))
        split = cut(faces.join(part, "face").groupBy("owner", "part").agg(F.sum("area").alias("area")))
        best = split.groupBy("owner").agg(F.max_by("part", F.struct("area", -F.col("part"))).alias("part"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        several = best.count()
        if several:
            keep = best.select("owner", F.col("part").alias("keep"))
            goes = faces.join(keep, "owner").join(part, "face").filter("part <> keep").select("face", F.lit(True).alias("_gone"))
            faces = cut(faces.join(goes, "face", "left").withColumn("owner", F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("owner"))).drop("_gone"))
        log["multi_parts_reduced"] += several
        closed = 0
        if extent is not None:
            faces, closed, area, made = close_gaps(faces, edges, floor)
            log["gaps_closed"], log["gap_area_closed_sqm"], log["parcels_created_from_gap"] = log["gaps_closed"] + closed, log["gap_area_closed_sqm"] + area, log["parcels_created_from_gap"] + made
        log["converged"] = not (n or several or closed)
    return Layer(faces, edges, log)


def close_gaps(faces: DataFrame, edges: DataFrame, floor: float) -> tuple[DataFrame, int, float, int]:
    """faces with the material gaps owned; their number, area, and the records made from them."""
    open_ = faces.filter(F.col("owner").isNull() & F.array_contains("cover", F.lit(EXTENT)) & ~F.array_contains("cover", F.lit(EXCLUDED))).withColumn("open", F.lit(0))
    part = cut(parts_of(open_, edges, "open", large=True))
    whole = part.join(open_.select("face", "area"), "face").groupBy("part").agg(F.sum("area").alias("area"))
    gaps = cut(whole.filter(F.col("area") > max(MATERIAL, NOISE, floor)))
    if not gaps.limit(1).count():
        return faces, 0, 0.0, 0
    labelled = faces.join(part.join(gaps, "part").select("face", (-F.col("part") - 1).alias("gap")), "face", "left").withColumn("label", F.coalesce("gap", "owner"))
    labelled = cut(labelled)
    near = beside(labelled, edges, "label").filter("a < 0 AND b >= 0")
    host = near.groupBy("a").agg(F.max_by("b", F.struct("length", -F.col("b"))).alias("host"))
    small = F.col("area") < floor * 50
    to = gaps.withColumn("a", -F.col("part") - 1).join(host, "a", "left").withColumn("to", F.when(small, F.col("host")).otherwise(F.col("part") + CREATED))
    to = cut(to.filter("to IS NOT NULL").select("a", "to", "area"))
    told = to.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("area"), F.lit(0.0)).alias("area"), F.count_if(F.col("to") >= CREATED).alias("made")).first()
    out = labelled.join(to.select(F.col("a").alias("gap"), "to"), "gap", "left").withColumn("owner", F.coalesce("owner", "to"))
    return cut(out.select("face", "cover", "area", "owner")), told["n"], told["area"], told["made"]
