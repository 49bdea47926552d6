"""Spatial joins as equi-joins on grid cells with an exact test: no tree, no cross product.

Both sides are expanded to the cells their boxes touch and meet by cell, so the join hash-partitions and Spark's
skew handling applies. A pair that shares several cells is kept only in the cell that holds the lower
left corner of its common box, so no distinct is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landloom.operators.cut import cut


def _cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def with_cells(df: DataFrame, size: float, b: tuple[Column, Column, Column, Column], margin: float = 0.0) -> DataFrame:
    """A row for each cell that a box, grown by a margin, touches: columns _cx, _cy."""
    xs = F.sequence(_cell(b[0] - margin, size), _cell(b[2] + margin, size))
    ys = F.sequence(_cell(b[1] - margin, size), _cell(b[3] + margin, size))
    return df.withColumn("_cx", F.explode(xs)).withColumn("_cy", F.explode(ys))


def grid_join(left: DataFrame, right: DataFrame, size: float, on: Callable[[tuple, tuple], Column] | None = None, margin: float = 0.0) -> DataFrame:
    """Pairs whose boxes (a_x0, a_y0, a_x1, a_y1 and b_...) come within the margin of each other, and pass on().

    left has columns with prefix a_, right with b_; size is about the usual side of a box.
    """
    a, b = tuple(F.col(f"a_{c}") for c in ("x0", "y0", "x1", "y1")), tuple(F.col(f"b_{c}") for c in ("x0", "y0", "x1", "y1"))
    one, two = with_cells(left, size, a, margin), with_cells(right, size, b)
    # The corner of the common box of a, grown, and b.
    home = (F.col("_cx") == _cell(F.greatest(a[0] - margin, b[0]), size)) & (F.col("_cy") == _cell(F.greatest(a[1] - margin, b[1]), size))
    near = (a[0] - margin <= b[2]) & (b[0] <= a[2] + margin) & (a[1] - margin <= b[3]) & (b[1] <= a[3] + margin)
    out = one.join(two, ["_cx", "_cy"]).filter(home & near)
    return (out.filter(on(a, b)) if on else out).drop("_cx", "_cy")


def within_reach(left: DataFrame, right: DataFrame, reach_a: Column, reach_b: Column) -> DataFrame:
    """Pairs of boxes (a_..., b_...) whose distance along each axis is at most the larger of their two reaches.

    A box, grown by its reach, stands on the level whose cells are as large as it, so it touches four of them at most; it
    also looks at the coarser levels on which the other side has boxes. A pair is kept on the level of its larger box,
    in the cell of the corner of what the grown boxes have in common.
    """
    a, b = (tuple(F.col(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")) for p in "a_ b_".split())

    def grown(df: DataFrame, p: str, box: tuple, reach: Column) -> DataFrame:
        r = F.col(f"_r{p}")
        side = F.greatest(box[2] - box[0], box[3] - box[1]) + 2 * r
        level = F.when(side > 0, F.ceil(F.log2(side))).otherwise(0).cast("int")
        return df.withColumn(f"_r{p}", reach).withColumn(f"_l{p}", level)

    one, two = grown(left, "a", a, reach_a), grown(right, "b", b, reach_b)
    levels = {p: sorted(r[0] for r in df.select(f"_l{p}").distinct().collect()) for p, df in (("a", one), ("b", two))}  # exponents: a few

    def placed(df: DataFrame, p: str, box: tuple, others: list[int]) -> DataFrame:
        r, own = F.col(f"_r{p}"), F.col(f"_l{p}")
        known = F.array(*[F.lit(x) for x in others]) if others else F.array().cast("array<int>")
        out = df.withColumn("_l", F.explode(F.array_union(F.array(own), F.filter(known, lambda x: x > own))))
        cells = lambda lo, hi: F.explode(F.sequence(*(F.floor(v / F.pow(2.0, "_l")).cast("long") for v in (lo - r, hi + r))))
        return out.withColumn("_cx", cells(box[0], box[2])).withColumn("_cy", cells(box[1], box[3]))

    out = placed(one, "a", a, levels["b"]).join(placed(two, "b", b, levels["a"]), ["_l", "_cx", "_cy"]).filter(F.col("_l") == F.greatest("_la", "_lb"))
    corner = [F.floor(F.greatest(a[k] - F.col("_ra"), b[k] - F.col("_rb")) / F.pow(2.0, "_l")).cast("long") for k in (0, 1)]
    reach = F.greatest("_ra", "_rb")
    near = (a[0] - reach <= b[2]) & (b[0] - reach <= a[2]) & (a[1] - reach <= b[3]) & (b[1] - reach <= a[3])
    return out.filter(near & (F.col("_cx") == corner[0]) & (F.col("_cy") == corner[1])).drop("_l", "_la", "_lb", "_ra", "_rb", "_cx", "_cy")


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def nearest(left: DataFrame, points: DataFrame, size: float) -> DataFrame:
    """The nearest point (b_x, b_y, tie: smallest b_order) of each left row (a_x, a_y): left columns, b (its columns), distance.

    Rows look at the 3 x 3 cells around them; a hit within one cell's side is exact. The others descend a pyramid of
    occupied cells, each level four times as fine: a cell stays while the least distance to the box of its
    points does not exceed the distance to the nearest of the points that touch the boxes' sides. These are real points, so a far row
    keeps few cells on each level, however many face it, and never meets all points. Without points the result is empty.
    """
    x, y = F.col("a_x"), F.col("a_y")
    far = points.agg(F.max(F.abs("b_x")).alias("x"), F.max(F.abs("b_y")).alias("y")).first()
    if far["x"] is None:
        return left.withColumn("b", F.lit(None)).withColumn("distance", F.lit(None).cast("double")).limit(0)
    cols = left.columns
    d = F.sqrt((x - F.col("b_x")) * (x - F.col("b_x")) + (y - F.col("b_y")) * (y - F.col("b_y")))

    def closest(hits: DataFrame) -> DataFrame:
        return hits.withColumn("_d", d).groupBy(*cols).agg(F.min_by(F.struct(*points.columns, F.col("_d")), F.struct("_d", "b_order")).alias("b"))

    placed = points.withColumn("_cx", _cell(F.col("b_x"), size)).withColumn("_cy", _cell(F.col("b_y"), size))
    probe = left.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(9)])))
    probe = probe.withColumn("_cx", _cell(x, size) + F.col("_i") % 3 - 1).withColumn("_cy", _cell(y, size) + F.floor(F.col("_i") / 3) - 1)
    near = cut(closest(probe.join(placed, ["_cx", "_cy"])).filter(F.col("b._d") <= size))
    rest = cut(left.join(near.select(*cols), cols, "left_anti"))
    if rest.limit(1).count():
        x_first, y_first = (lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"))), (lambda s: F.struct(s["y"].alias("y"), s["x"].alias("x")))
        ends = {"w": (F.min, x_first), "s": (F.min, y_first), "e": (F.max, x_first), "n": (F.max, y_first)}  # a cell's points farthest to each side
        point = F.struct(F.col("b_x").alias("x"), F.col("b_y").alias("y"))
        levels = [cut(placed.groupBy("_cx", "_cy").agg(*[best(of(point)).alias(k) for k, (best, of) in ends.items()]))]
        side = size
        while max(far["x"], far["y"]) / side > 2:  # the top level has at most 6 x 6 cells
            up = levels[-1].withColumn("_px", F.floor(F.col("_cx") / 4).cast("long")).withColumn("_py", F.floor(F.col("_cy") / 4).cast("long"))
            levels.append(cut(up.groupBy(F.col("_px").alias("_cx"), F.col("_py").alias("_cy")).agg(*[best(k).alias(k) for k, (best, _) in ends.items()])))
            side *= 4
        rows = rest.select(F.struct(*cols).alias("_row"), "a_x", "a_y")
        out = lambda lo, hi, v: F.greatest(lo - v, v - hi, F.lit(0.0))
        dx, dy = out(F.col("w.x"), F.col("e.x"), x), out(F.col("s.y"), F.col("n.y"), y)
        to = [F.sqrt((x - F.col(f"{k}.x")) * (x - F.col(f"{k}.x")) + (y - F.col(f"{k}.y")) * (y - F.col(f"{k}.y"))) for k in ends]

        def pruned(pairs: DataFrame) -> DataFrame:
            bound = pairs.withColumn("_lo", F.sqrt(dx * dx + dy * dy)).withColumn("_hi", F.min(F.least(*to)).over(Window.partitionBy("_row")))  # few cells a row
            return cut(bound.filter(F.col("_lo") <= F.col("_hi") * (1 + 1e-12)).select("_row", "a_x", "a_y", "_cx", "_cy"))

        pairs = pruned(rows.join(F.broadcast(levels[-1]), F.lit(True)))  # 36 rows at most
        for finer in reversed(levels[:-1]):
            child = finer.withColumn("_px", F.floor(F.col("_cx") / 4).cast("long")).withColumn("_py", F.floor(F.col("_cy") / 4).cast("long"))
            parent = pairs.withColumnRenamed("_cx", "_px").withColumnRenamed("_cy", "_py")
            pairs = pruned(parent.join(child, ["_px", "_py"]))
        hits = pairs.join(placed, ["_cx", "_cy"]).select(*[F.col(f"_row.{c}").alias(c) for c in cols], *points.columns)
        near = near.union(closest(hits))
    return near.select(*cols, "b", F.col("b._d").alias("distance"))


def nearest_within(left: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """nearest() for the left rows that have a point within the radius; the others are left out.

    One equi-join on the cells that the radius touches, four times as large, so mostly one or two. The left side's files tell
    nothing of its size in cells, so it is merged, not broadcast.
    """
    x, y = F.col("a_x"), F.col("a_y")
    reach = radius * (1 + 1e-9)  # the distance is rounded
    probe = with_cells(left, radius * 4, (x, y, x, y), reach).hint("merge")
    placed = points.withColumn("_cx", _cell(F.col("b_x"), radius * 4)).withColumn("_cy", _cell(F.col("b_y"), radius * 4))
    d = F.sqrt((x - F.col("b_x")) * (x - F.col("b_x")) + (y - F.col("b_y")) * (y - F.col("b_y")))
    hits = probe.join(placed, ["_cx", "_cy"]).withColumn("distance", d).filter(F.col("distance") <= radius)
    best = hits.groupBy(*left.columns).agg(F.min_by(F.struct(*points.columns, "distance"), F.struct("distance", "b_order")).alias("b"))
    return best.select(*left.columns, "b", F.col("b.distance").alias("distance"))


def without_neighbour(nodes: DataFrame, tolerance: float) -> DataFrame:
    """Nodes (owner, x, y) for which no node of another owner lies within the tolerance; cells of that size, 3 x 3 of them."""
    own = nodes.withColumn("_id", F.struct(*nodes.columns))
    probe = own.withColumn("_i", F.explode(F.array(*[F.lit(i) for i in range(9)])))
    probe = probe.withColumn("_cx", _cell(F.col("x"), tolerance) + F.col("_i") % 3 - 1).withColumn("_cy", _cell(F.col("y"), tolerance) + F.floor(F.col("_i") / 3) - 1)
    other = nodes.select(F.col("owner").alias("o2"), F.col("x").alias("x2"), F.col("y").alias("y2")).withColumn("_cx", _cell(F.col("x2"), tolerance)).withColumn("_cy", _cell(F.col("y2"), tolerance))
    dx, dy = F.col("x") - F.col("x2"), F.col("y") - F.col("y2")
    met = probe.join(other, ["_cx", "_cy"]).filter((F.col("owner") != F.col("o2")) & (F.sqrt(dx * dx + dy * dy) <= tolerance)).select("_id").distinct()
    return own.join(met, "_id", "left_anti").drop("_id")
