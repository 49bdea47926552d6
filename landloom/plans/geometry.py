"""Queries on outlines: spatial joins, matching, encroachment, topology, projections."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions import proj as P
from landloom.functions.num import exact_sum, ratio, rnd
from landloom.operators import matching as M
from landloom.operators import shapes
from landloom.operators import spatial as S
from landloom.operators.attributes import first_by
from landloom.plans.attributes import s_rnd
from landloom.plans.registry import query

OVER = "greatest(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0), 0.0) * greatest(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0), 0.0)"
AREA = "(({a}.x1 - {a}.x0) * ({a}.y1 - {a}.y0))"
SHIFT = s_rnd("sqrt(((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) * ((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) + ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) * ((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2))", 4)
IOU = f"({OVER.format(a='a', b='b')} / ({AREA.format(a='a')} + {AREA.format(a='b')} - {OVER.format(a='a', b='b')}))"
LIKE = s_rnd(f"least({AREA.format(a='a')}, {AREA.format(a='b')}) / greatest({AREA.format(a='a')}, {AREA.format(a='b')})", 4)
CELL = 32.0
COMMON = lambda: G.box_overlap(G.box("a_"), G.box("b_"))


def boxes(df: DataFrame, p: str, *cols: str) -> DataFrame:
    return S.prefixed(df.select(*cols, "x0", "y0", "x1", "y1"), p)


@query("SELECT b.b_idx, min(p.idx) AS parcel FROM v_structure b JOIN v_parcel p ON b.x0 <= p.x1 AND p.x0 <= b.x1 AND b.y0 <= p.y1 AND p.y0 <= b.y1 GROUP BY b.b_idx", "v_structure", "v_parcel")
def building_first_hit(spark: SparkSession, structures: DataFrame, parcels: DataFrame) -> DataFrame:
    pairs = S.grid_join(boxes(structures, "a_", "b_idx"), boxes(parcels, "b_", "idx"), CELL)
    return pairs.groupBy(F.col("a_b_idx").alias("b_idx")).agg(F.min("b_idx").alias("parcel"))


@query(
    f"""SELECT idx, corridor_id, conflict_type, overlap_sqm, overlap_ratio, CASE WHEN overlap_sqm >= 50 OR overlap_ratio >= 0.25 THEN 'HIGH' WHEN overlap_sqm >= 10 OR overlap_ratio >= 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS severity, {s_rnd('least(0.99, least(1.0, overlap_ratio * 3) * 0.4 + 0.55)', 4)} AS confidence
FROM (SELECT *, {s_rnd('overlap_sqm / area', 4)} AS overlap_ratio FROM (SELECT a.idx, b.corridor_id, b.conflict_type, {AREA.format(a='a')} AS area, {s_rnd(OVER.format(a='a', b='b'), 2)} AS overlap_sqm, {OVER.format(a='a', b='b')} AS raw FROM v_parcel a JOIN v_corridor b ON TRUE) WHERE raw > 0)""",
    "v_parcel", "v_corridor",
)
def corridor_encroachment(spark: SparkSession, parcels: DataFrame, corridors: DataFrame) -> DataFrame:
    pairs = S.grid_join(boxes(parcels, "a_", "idx"), boxes(corridors, "b_", "corridor_id", "conflict_type"), CELL, lambda a, b: G.box_overlap(a, b) > 0)
    return pairs.select(F.col("a_idx").alias("idx"), F.col("b_corridor_id").alias("corridor_id"), F.col("b_conflict_type").alias("conflict_type"), M.encroachment(COMMON(), G.box_area(G.box("a_"))).alias("e")).select("idx", "corridor_id", "conflict_type", "e.*")


PAIRS = f"SELECT a.idx AS a_idx, b.idx AS b_idx, {OVER.format(a='a', b='b')} AS area FROM v_parcel a JOIN v_parcel b ON a.idx < b.idx AND {OVER.format(a='a', b='b')} > 0.05"


def overlaps(parcels: DataFrame, least: float = 0.05) -> DataFrame:
    pairs = S.grid_join(boxes(parcels, "a_", "idx"), boxes(parcels, "b_", "idx"), CELL, lambda a, b: (F.col("a_idx") < F.col("b_idx")) & (G.box_overlap(a, b) > least))
    return pairs.select("a_idx", "b_idx", COMMON().alias("area"))


@query(f"SELECT a_idx, b_idx, {s_rnd('area', 3)} AS area FROM ({PAIRS}) ORDER BY area DESC, a_idx, b_idx LIMIT 200", "v_parcel")
def overlap_pairs_topk(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """The 200 largest overlaps: a report, so the limit is the feature."""
    return overlaps(parcels).orderBy(rnd(F.col("area"), 3).desc(), "a_idx", "b_idx").limit(200).select("a_idx", "b_idx", rnd(F.col("area"), 3).alias("area"))


FEATURES = "(SELECT parcel_id AS id, x0, y0, x1, y1 FROM v_parcel UNION ALL SELECT cand_id, x0, y0, x1, y1 FROM v_candidate)"


def features(parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    return parcels.select(F.col("parcel_id").alias("id"), "x0", "y0", "x1", "y1").union(candidates.select("cand_id", "x0", "y0", "x1", "y1"))


@query(f"SELECT a.id AS a_id, b.id AS b_id, {s_rnd(IOU, 4)} AS iou FROM {FEATURES} a JOIN {FEATURES} b ON a.id < b.id AND {IOU} >= 0.8", "v_parcel", "v_candidate")
def duplicate_iou_pairs(spark: SparkSession, parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    f = features(parcels, candidates)
    iou = lambda a, b: (F.col("a_id") < F.col("b_id")) & (G.box_iou(a, b) >= 0.8)
    return S.grid_join(boxes(f, "a_", "id"), boxes(f, "b_", "id"), CELL, iou).select("a_id", "b_id", rnd(G.box_iou(G.box("a_"), G.box("b_")), 4).alias("iou"))


@query(f"SELECT a.idx AS a_idx, b.cand_idx AS b_idx, {s_rnd(IOU, 4)} AS iou FROM v_parcel a JOIN v_candidate b ON {OVER.format(a='a', b='b')} > 0", "v_parcel", "v_candidate")
def iou_matrix(spark: SparkSession, parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Sparse: only pairs that share area."""
    pairs = S.grid_join(boxes(parcels, "a_", "idx"), boxes(candidates.withColumnRenamed("cand_idx", "idx"), "b_", "idx"), CELL, lambda a, b: G.box_overlap(a, b) > 0)
    return pairs.select("a_idx", "b_idx", rnd(G.box_iou(G.box("a_"), G.box("b_")), 4).alias("iou"))


BAND = f"SELECT a.idx AS a_idx, b.idx AS b_idx, {OVER.format(a='a', b='b')} AS area FROM v_parcel a JOIN v_parcel b ON b.idx BETWEEN a.idx + 1 AND a.idx + 14 WHERE {OVER.format(a='a', b='b')} > 0"


def banded(parcels: DataFrame, width: int = 15) -> DataFrame:
    """Pairs of positions less than width apart that share area: each row meets its block and the next one."""
    bucket = F.floor(F.col("a_idx") / width).cast("long")
    one = boxes(parcels, "a_", "idx").withColumn("k", F.explode(F.array(bucket, bucket + 1)))
    two = boxes(parcels, "b_", "idx").withColumn("k", F.floor(F.col("b_idx") / width).cast("long"))
    pairs = one.join(two, "k").filter((F.col("b_idx") > F.col("a_idx")) & (F.col("b_idx") < F.col("a_idx") + width))
    return pairs.withColumn("area", COMMON()).filter("area > 0").select("a_idx", "b_idx", "area")


@query(f"SELECT a_idx, b_idx, {s_rnd('area', 4)} AS area FROM ({BAND})", "v_parcel")
def banded_neighbor_overlap(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    return banded(parcels).select("a_idx", "b_idx", rnd(F.col("area"), 4).alias("area"))


@query(f"SELECT n AS parcels, o.overlaps, {s_rnd('CAST(total AS DOUBLE)', 3)} AS overlap_area, {s_rnd('greatest(0.0, 1.0 - o.overlaps / n)', 4)} AS validity FROM (SELECT (SELECT count(*) FROM v_parcel) AS n, count(*) AS overlaps, sum(CAST(area AS DECIMAL(28,6))) AS total FROM ({BAND})) o", "v_parcel")
def planar_validity(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    n = parcels.agg(F.count(F.lit(1)).alias("parcels"))
    o = banded(parcels).agg(F.count(F.lit(1)).alias("overlaps"), exact_sum(F.col("area"), 6).alias("total"))
    both = n.crossJoin(F.broadcast(o))  # one row each
    return both.select("parcels", "overlaps", rnd(F.col("total"), 3).alias("overlap_area"), rnd(F.greatest(F.lit(0.0), 1 - F.col("overlaps") / F.col("parcels")), 4).alias("validity"))


CENTRE = "(SELECT cand_idx, (x0 + x1) / 2 AS cx, (y0 + y1) / 2 AS cy FROM v_candidate)"
NEAREST = f"""SELECT cand_idx, obs_idx, d FROM (SELECT c.cand_idx, s.obs_idx, sqrt((c.cx - s.x) * (c.cx - s.x) + (c.cy - s.y) * (c.cy - s.y)) AS d, row_number() OVER (PARTITION BY c.cand_idx ORDER BY sqrt((c.cx - s.x) * (c.cx - s.x) + (c.cy - s.y) * (c.cy - s.y)), s.obs_idx) AS rn FROM {CENTRE} c CROSS JOIN v_survey s) WHERE rn = 1"""


def supported(candidates: DataFrame, survey: DataFrame, radius: float | None = None) -> DataFrame:
    """The nearest observation of each candidate; with a radius only of those that have one within it."""
    left = candidates.select(F.col("cand_idx").alias("a_id"), ((F.col("x0") + F.col("x1")) / 2).alias("a_x"), ((F.col("y0") + F.col("y1")) / 2).alias("a_y"))
    right = survey.select(F.col("obs_idx").alias("b_order"), F.col("x").alias("b_x"), F.col("y").alias("b_y"))
    found = S.nearest_within(left, right, radius) if radius else S.nearest(left, right, 16.0)
    return found.select(F.col("a_id").alias("cand_idx"), F.col("b.b_order").alias("obs_idx"), "distance")


@query(f"SELECT cand_idx, obs_idx, {s_rnd('d', 3)} AS distance FROM ({NEAREST})", "v_candidate", "v_survey")
def nearest_survey(spark: SparkSession, candidates: DataFrame, survey: DataFrame) -> DataFrame:
    return supported(candidates, survey).select("cand_idx", "obs_idx", rnd(F.col("distance"), 3).alias("distance"))


NODES = "(SELECT idx AS owner, x0 AS x, y0 AS y FROM v_parcel UNION ALL SELECT idx, x1, y0 FROM v_parcel UNION ALL SELECT idx, x1, y1 FROM v_parcel UNION ALL SELECT idx, x0, y1 FROM v_parcel)"


@query(f"SELECT owner, count(*) AS nodes FROM {NODES} n WHERE NOT EXISTS (SELECT 1 FROM {NODES} m WHERE m.owner <> n.owner AND abs(n.x - m.x) <= 0.36 AND sqrt((n.x - m.x) * (n.x - m.x) + (n.y - m.y) * (n.y - m.y)) <= 0.35) GROUP BY owner", "v_parcel")
def unmatched_nodes(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    corners = F.explode(G.ring_of_box(G.box())).alias("p")
    nodes = parcels.select(F.col("idx").alias("owner"), corners).select("owner", "p.x", "p.y")
    return S.without_neighbour(nodes, 0.35).groupBy("owner").agg(F.count(F.lit(1)).alias("nodes"))


W, H = "({a}.x1 - {a}.x0)", "({a}.y1 - {a}.y0)"


def s_at(a: str, axis: str) -> str:
    """x or y of the i-th of 24 equal steps around a box, from its lower left corner."""
    w, h = W.format(a=a), H.format(a=a)
    far = f"(({w} + {h} + {w} + {h}) * i / 24)"
    if axis == "x":
        return f"CASE WHEN {far} < {w} THEN {a}.x0 + {far} WHEN {far} < {w} + {h} THEN {a}.x1 WHEN {far} < {w} + {h} + {w} THEN {a}.x1 - ({far} - {w} - {h}) ELSE {a}.x0 END"
    return f"CASE WHEN {far} < {w} THEN {a}.y0 WHEN {far} < {w} + {h} THEN {a}.y0 + ({far} - {w}) WHEN {far} < {w} + {h} + {w} THEN {a}.y1 ELSE {a}.y1 - ({far} - {w} - {h} - {w}) END"


OUTLINE = s_rnd(
    f"greatest(0.0, 1 - list_sum(list_transform(range(0, 24), lambda i: sqrt(power(({s_at('a', 'x')}) - ({s_at('b', 'x')}), 2) + power(({s_at('a', 'y')}) - ({s_at('b', 'y')}), 2)))) / 24 / sqrt(greatest({AREA.format(a='a')}, {AREA.format(a='b')})))", 4
)
#: Squared distance of two boxes: where it exceeds the larger area, the mean distance of samples exceeds its root and the likeness is 0.
APART = "(power(greatest(a.x0 - b.x1, b.x0 - a.x1, 0.0), 2) + power(greatest(a.y0 - b.y1, b.y0 - a.y1, 0.0), 2))"
SCORES = f"""SELECT a_idx, cand_id, iou, shift, likeness, outline, score, CASE WHEN iou >= 0.55 AND score >= 0.85 THEN 'MATCHED' WHEN score >= 0.65 THEN 'PROBABLE' WHEN score >= 0.35 THEN 'REVIEW_REQUIRED' ELSE 'UNMATCHED' END AS verdict FROM (
SELECT p.idx AS a_idx, cand_id, iou, shift, likeness, outline, coalesce(score, 0.0) AS score, row_number() OVER (PARTITION BY p.idx ORDER BY score DESC NULLS LAST, cand_idx) AS rn FROM v_parcel p LEFT JOIN (
SELECT *, {s_rnd('least(1.0, iou * 0.42 + likeness * 0.18 + outline * 0.16 + greatest(0.0, 1 - shift / 25.0) * 0.14 + coalesce(greatest(0.0, 1 - distance / 3.0), 0.0) * 0.10)', 4)} AS score FROM (
SELECT a.idx, b.cand_idx, b.cand_id, {IOU} AS iou, {SHIFT} AS shift, {LIKE} AS likeness, CASE WHEN {APART} <= greatest({AREA.format(a='a')}, {AREA.format(a='b')}) THEN {OUTLINE} ELSE 0.0 END AS outline, {s_rnd('n.d', 3)} AS distance FROM v_parcel a CROSS JOIN v_candidate b JOIN ({NEAREST}) n ON n.cand_idx = b.cand_idx)) s ON s.idx = p.idx) WHERE rn = 1"""


def matches(parcels: DataFrame, candidates: DataFrame, survey: DataFrame) -> DataFrame:
    """The best candidate of each parcel; observations more than 3 m away support nothing and are not looked for."""
    near = supported(candidates, survey, 3.0).select("cand_idx", rnd(F.col("distance"), 3).alias("distance"))
    right = candidates.join(near, "cand_idx", "left").select(F.col("cand_idx").alias("b_order"), F.col("cand_id").alias("b_id"), F.col("distance").alias("b_distance"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    return M.best_matches(boxes(parcels, "a_", "idx"), right)


@query(f"SELECT a_idx, cand_id, {s_rnd('iou', 4)} AS iou, shift, likeness, outline, score, verdict FROM ({SCORES})", "v_parcel", "v_candidate", "v_survey")
def match_scores(spark: SparkSession, parcels: DataFrame, candidates: DataFrame, survey: DataFrame) -> DataFrame:
    m = matches(parcels, candidates, survey)
    return m.select("a_idx", F.col("b_id").alias("cand_id"), rnd(F.col("iou"), 4).alias("iou"), "shift", "likeness", "outline", "score", "verdict")


@query(f"SELECT a_idx, cand_id, score, CASE WHEN cand_id IS NOT NULL AND rn > 1 THEN 'REVIEW_REQUIRED' ELSE verdict END AS verdict, cand_id IS NOT NULL AND rn > 1 AS late FROM (SELECT *, row_number() OVER (PARTITION BY cand_id ORDER BY score DESC, a_idx) AS rn FROM ({SCORES}))", "v_parcel", "v_candidate", "v_survey")
def greedy_assignment(spark: SparkSession, parcels: DataFrame, candidates: DataFrame, survey: DataFrame) -> DataFrame:
    m = matches(parcels, candidates, survey).select("a_idx", F.col("b_id").alias("cand_id"), "score", "verdict")
    return M.assign_once(m, "cand_id", "a_idx")


@query("SELECT a.parcel_id, a.size AS left_size, b.size AS right_size FROM v_epoch1 a JOIN (SELECT * FROM (SELECT parcel_id, size, row_number() OVER (PARTITION BY parcel_id ORDER BY idx) AS rn FROM v_epoch2) WHERE rn = 1) b ON a.parcel_id = b.parcel_id", "v_epoch1", "v_epoch2")
def landmark_pairs(spark: SparkSession, one: DataFrame, two: DataFrame) -> DataFrame:
    first = first_by(two, ["parcel_id"], F.col("idx")).select("parcel_id", F.col("size").alias("right_size"))
    return one.select("parcel_id", F.col("size").alias("left_size")).join(first, "parcel_id")


SHAPE = f"SELECT b_idx, {AREA.format(a='b')} AS area, 2 * ({W.format(a='b')} + {H.format(a='b')}) AS perimeter FROM v_structure b"


@query(f"SELECT b_idx, {s_rnd('perimeter * perimeter / area', 4)} AS compactness, area < 32.0 OR (perimeter * perimeter / area > 25 AND area < 32.0 * 20) AS sliver FROM ({SHAPE})", "v_structure")
def sliver_flags(spark: SparkSession, structures: DataFrame) -> DataFrame:
    b = G.box()
    s = structures.select("b_idx", G.box_area(b).alias("area"), (((b[2] - b[0]) + (b[3] - b[1])) * 2).alias("perimeter"))
    return s.select("b_idx", rnd(G.compactness(F.col("perimeter"), F.col("area")), 4).alias("compactness"), G.is_sliver(F.col("area"), F.col("perimeter"), 32.0).alias("sliver"))


@query(f"SELECT {s_rnd('m', 4)} AS median, {s_rnd('least(2.0, 0.25 * m)', 4)} AS floor FROM (SELECT -quantile_disc(-area, 0.5) AS m FROM ({SHAPE}) WHERE area > 0)", "v_structure")
def sliver_threshold(spark: SparkSession, structures: DataFrame) -> DataFrame:
    """Upper median of the positive areas, and the smaller of 2 and a quarter of it."""
    from landloom.operators.topology import upper_median

    return upper_median(structures.select(G.box_area(G.box()).alias("area")), "area").select(rnd(F.col("median"), 4).alias("median"), rnd(F.least(F.lit(2.0), F.col("median") * 0.25), 4).alias("floor"))


@query("SELECT b_idx, first_idx FROM (SELECT b_idx, min(b_idx) OVER (PARTITION BY x0, y0, x1, y1) AS first_idx FROM v_structure) WHERE b_idx <> first_idx", "v_structure")
def duplicate_geometry(spark: SparkSession, structures: DataFrame) -> DataFrame:
    """Later copies of an outline and the first row that has it; minima are combined before the shuffle, and no window holds a group."""
    box = ["x0", "y0", "x1", "y1"]
    first = structures.groupBy(*box).agg(F.min("b_idx").alias("first_idx"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return structures.join(first, box).filter("b_idx <> first_idx").select("b_idx", "first_idx")


@query(f"SELECT hint AS idx, count(*) AS parts, {s_rnd('max(area)', 4)} AS largest FROM (SELECT b.hint, {AREA.format(a='b')} AS area FROM v_structure b) GROUP BY hint HAVING count(*) > 1", "v_structure")
def disconnected_parts(spark: SparkSession, structures: DataFrame) -> DataFrame:
    return structures.groupBy(F.col("hint").alias("idx")).agg(F.count(F.lit(1)).alias("parts"), rnd(F.max(G.box_area(G.box())), 4).alias("largest")).filter("parts > 1")


MOVED = f"SELECT a.idx, {IOU} AS iou, {SHIFT} AS shift, {s_rnd(f'(1 - {LIKE}) * 100.0', 2)} AS delta FROM v_parcel a JOIN v_candidate b ON b.cand_idx = a.idx"


def epochs(parcels: DataFrame, candidates: DataFrame, how: str = "inner") -> DataFrame:
    both = boxes(parcels, "a_", "idx").join(boxes(candidates, "b_", "cand_idx"), F.col("a_idx") == F.col("b_cand_idx"), how)
    a, b = G.box("a_"), G.box("b_")
    return both.withColumn("iou", G.box_iou(a, b)).withColumn("shift", G.box_shift(a, b)).withColumn("likeness", G.area_likeness(G.box_area(a), G.box_area(b)))


@query(f"SELECT idx, {s_rnd('iou', 4)} AS iou, shift, delta, 'POSSIBLE_CHANGE' AS verdict FROM ({MOVED}) WHERE shift > 0.5 OR delta > 2.0", "v_parcel", "v_candidate")
def boundary_shift(spark: SparkSession, parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    moved, delta = M.shifted(F.col("shift"), F.col("likeness"))
    return epochs(parcels, candidates).filter(moved).select(F.col("a_idx").alias("idx"), rnd(F.col("iou"), 4).alias("iou"), "shift", delta.alias("delta"), F.lit("POSSIBLE_CHANGE").alias("verdict"))


CHANGED = f"""SELECT coalesce(a.idx, b.cand_idx) AS idx, CASE WHEN a.idx IS NULL THEN 'NEW' WHEN b.cand_idx IS NULL THEN 'REMOVED' WHEN {IOU} >= 0.98 AND {SHIFT} <= 0.5 AND {s_rnd(f'(1 - {LIKE}) * 100.0', 2)} <= 2.0 THEN NULL WHEN {IOU} >= 0.5 THEN 'MODIFIED' ELSE 'BOUNDARY_SHIFT' END AS change_type,
 CASE WHEN a.idx IS NULL OR b.cand_idx IS NULL THEN 1.0 ELSE {s_rnd(f'least(0.99, (1 - {IOU}) * 0.5 + 0.5)', 4)} END AS confidence FROM (SELECT * FROM v_parcel WHERE idx % 10 <> 4) a FULL JOIN v_candidate b ON b.cand_idx = a.idx"""


@query(f"SELECT * FROM ({CHANGED}) WHERE change_type IS NOT NULL", "v_parcel", "v_candidate")
def building_change(spark: SparkSession, parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    e = epochs(parcels.filter("idx % 10 <> 4"), candidates, "full")
    before, after = F.col("a_idx").isNotNull(), F.col("b_cand_idx").isNotNull()
    kind = M.footprint_change(before, after, F.col("iou"), F.col("shift"), F.col("likeness"))
    sure = F.when(before & after, rnd(F.least(F.lit(0.99), (1 - F.col("iou")) * 0.5 + 0.5), 4)).otherwise(1.0)
    return e.select(F.coalesce("a_idx", "b_cand_idx").alias("idx"), kind.alias("change_type"), sure.alias("confidence")).filter("change_type IS NOT NULL")


@query(f"SELECT b_idx, CASE WHEN c >= 0.98 THEN 'INSIDE' WHEN c <= 0.02 THEN 'OUTSIDE' ELSE 'CROSSES_BOUNDARY' END AS relation, {s_rnd('c', 4)} AS coverage FROM (SELECT a.b_idx, {OVER.format(a='a', b='b')} / {AREA.format(a='a')} AS c FROM v_structure a JOIN v_parcel b ON b.idx = a.hint)", "v_structure", "v_parcel")
def building_relation(spark: SparkSession, structures: DataFrame, parcels: DataFrame) -> DataFrame:
    both = boxes(structures, "a_", "b_idx", "hint").join(boxes(parcels, "b_", "idx"), F.col("a_hint") == F.col("b_idx"))
    return both.select(F.col("a_b_idx").alias("b_idx"), M.building_relation(COMMON(), G.box_area(G.box("a_"))).alias("r")).select("b_idx", "r.*")


CORNERS = "SELECT parcel, corner, x, y, CAST(right(corner, 1) AS INTEGER) AS ord FROM (SELECT *, row_number() OVER (PARTITION BY parcel, corner ORDER BY accuracy NULLS LAST, obs_idx) AS rn FROM v_survey) WHERE rn = 1 AND corner <> 'C5'"


@query(
    f"""SELECT parcel, count(*) AS corners, {s_rnd('abs(sum(x * ny - nx * y)) / 2', 3)} AS area FROM (SELECT parcel, x, y, coalesce(lead(x) OVER w, first_value(x) OVER w) AS nx, coalesce(lead(y) OVER w, first_value(y) OVER w) AS ny FROM ({CORNERS}) WINDOW w AS (PARTITION BY parcel ORDER BY ord)) GROUP BY parcel HAVING count(*) >= 3""",
    "v_survey",
)
def corner_outline(spark: SparkSession, survey: DataFrame) -> DataFrame:
    """Outlines from at least three corners, each by its most precise observation."""
    order = F.coalesce(F.regexp_replace("corner", "[^0-9]", "").try_cast("int"), F.lit(99))
    best = survey.filter("corner <> 'C5'").groupBy("parcel", "corner").agg(F.min_by(F.struct("x", "y"), F.struct(F.col("accuracy").isNull(), "accuracy", "obs_idx")).alias("p"))
    rings = best.groupBy("parcel").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("corner"), F.col("p")))).getField("p").alias("ring")).filter(F.size("ring") >= 3)
    return rings.select("parcel", F.size("ring").cast("long").alias("corners"), rnd(G.ring_area(F.col("ring")), 3).alias("area"))


@query("SELECT source, count(*) AS observations, count(DISTINCT parcel) AS parcels FROM v_survey GROUP BY source", "v_survey")
def survey_union(spark: SparkSession, survey: DataFrame) -> DataFrame:
    gnss, truth = survey.filter("source = 'gnss_cors'").drop("source"), survey.filter("source = 'ground_truthing'").drop("source", "accuracy")
    both = gnss.withColumn("source", F.lit("gnss_cors")).unionByName(truth.withColumn("source", F.lit("ground_truthing")), allowMissingColumns=True)
    return both.groupBy("source").agg(F.count(F.lit(1)).alias("observations"), F.countDistinct("parcel").alias("parcels"))


GEN1 = s_rnd("(least(1.0, greatest(0.0, f1)) * 0.40 + (1 - least(1.0, greatest(0.0, f2))) * 0.35 + least(1.0, greatest(0.0, f3)) * 0.15 + least(1.0, greatest(0.0, f4)) * 0.10) * 100", 2)


@query(f"SELECT l_orderkey AS idx, l_linenumber AS line, score, CASE WHEN score >= 90 THEN 'Approved' WHEN score >= 70 THEN 'Review' ELSE 'Encroachment' END AS status FROM (SELECT *, {GEN1} AS score FROM (SELECT l_orderkey, l_linenumber, 1 - l_discount * 4 AS f1, l_tax / 2 AS f2, l_quantity / 40.0 AS f3, l_tax * 12 AS f4 FROM lineitem))", "lineitem")
def gen1_confidence(spark: SparkSession, lineitem: DataFrame) -> DataFrame:
    s = M.first_generation_score(1 - F.col("l_discount") * 4, F.col("l_tax") / 2, F.col("l_quantity") / 40.0, F.col("l_tax") * 12)
    scored = lineitem.select(F.col("l_orderkey").alias("idx"), F.col("l_linenumber").alias("line"), s.alias("score"))
    return scored.withColumn("status", F.when(F.col("score") >= 90, "Approved").when(F.col("score") >= 70, "Review").otherwise("Encroachment"))


@query(
    f"""SELECT idx, {s_rnd('CAST(sum(CASE WHEN o >= 1 THEN CAST(o AS DECIMAL(28,6)) ELSE 0 END) AS DOUBLE)', 2)} AS encroached, CASE WHEN bool_or(o >= 1 AND t = 'parcel_vs_drainage') AND bool_or(o >= 1 AND t = 'parcel_vs_road_row') THEN 'Road & drainage' WHEN bool_or(o >= 1 AND t = 'parcel_vs_drainage') THEN 'Drainage' WHEN bool_or(o >= 1 AND t = 'parcel_vs_road_row') THEN 'Road' ELSE 'None' END AS kind
FROM (SELECT a.idx, b.conflict_type AS t, {OVER.format(a='a', b='b')} AS o FROM v_parcel a JOIN v_corridor b ON b.conflict_type <> 'parcel_vs_utility' AND {OVER.format(a='a', b='b')} > 0) GROUP BY idx""",
    "v_parcel", "v_corridor",
)
def encroachment_audit(spark: SparkSession, parcels: DataFrame, corridors: DataFrame) -> DataFrame:
    """Area lost to drains and roads; overlaps under 1 square metre are noise."""
    pairs = S.grid_join(boxes(parcels, "a_", "idx"), boxes(corridors.filter("conflict_type <> 'parcel_vs_utility'"), "b_", "conflict_type"), CELL, lambda a, b: G.box_overlap(a, b) > 0)
    real = F.col("o") >= 1
    has = lambda t: F.bool_or(real & (F.col("b_conflict_type") == t))
    drain, road = has("parcel_vs_drainage"), has("parcel_vs_road_row")
    kind = F.when(drain & road, "Road & drainage").when(drain, "Drainage").when(road, "Road").otherwise("None")
    return pairs.withColumn("o", COMMON()).groupBy(F.col("a_idx").alias("idx")).agg(rnd(exact_sum(F.when(real, F.col("o")).otherwise(0.0), 6), 2).alias("encroached"), kind.alias("kind"))


def s_utm() -> str:
    t = f"sinh(atanh(sin(phi)) - {P.ECC!r} * atanh(sin(phi) * {P.ECC!r}))"
    x = "eta" + "".join(f" + cos(xi * {2 * j}) * sinh(eta * {2 * j}) * {a!r}" for j, a in enumerate(P.ALPHA, 1))
    y = "xi" + "".join(f" + sin(xi * {2 * j}) * cosh(eta * {2 * j}) * {a!r}" for j, a in enumerate(P.ALPHA, 1))
    k = P.K0 * P.RECTIFYING
    return f"""SELECT idx, {s_rnd(f'({x}) * {k!r} + 500000.0', 3)} AS easting, {s_rnd(f'({y}) * {k!r}', 3)} AS northing FROM (SELECT idx, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM (SELECT *, {t} AS t FROM (
SELECT c_custkey AS idx, radians(18.4 + (c_custkey % 97) * 0.001) AS phi, radians(73.7 + (c_custkey % 89) * 0.001 - 75.0) AS lam FROM customer)))"""


@query(s_utm(), "customer")
def utm_forward(spark: SparkSession, customer: DataFrame) -> DataFrame:
    e, n = P.utm_forward(F.lit(73.7) + (F.col("c_custkey") % 89) * 0.001, F.lit(18.4) + (F.col("c_custkey") % 97) * 0.001, 43)
    return customer.select(F.col("c_custkey").alias("idx"), rnd(e, 3).alias("easting"), rnd(n, 3).alias("northing"))


RING = "(SELECT vec_id, list_transform(range(1, 33), lambda i: {'x': CAST(embedding[2 * i - 1] AS DOUBLE), 'y': CAST(embedding[2 * i] AS DOUBLE)}) AS r FROM embeddings)"
CROSS = "(r[i].x * r[i % 32 + 1].y - r[i % 32 + 1].x * r[i].y)"


def rings(vectors: DataFrame) -> DataFrame:
    point = lambda i: G.point(F.get("embedding", i * 2).cast("double"), F.get("embedding", i * 2 + 1).cast("double"))
    return vectors.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(31)), point).alias("ring"))


@query(
    f"""SELECT vec_id, {s_rnd('abs(a)', 6)} AS area, {s_rnd('p', 6)} AS perimeter, {s_rnd('mx', 6)} AS min_x, {s_rnd('my', 6)} AS max_y, CASE WHEN abs(a) > 0.05 THEN {s_rnd('cx / (6 * a)', 4)} END AS cx FROM (SELECT vec_id, list_sum(list_transform(range(1, 33), lambda i: {CROSS})) / 2 AS a,
 list_sum(list_transform(range(1, 33), lambda i: sqrt(power(r[i % 32 + 1].x - r[i].x, 2) + power(r[i % 32 + 1].y - r[i].y, 2)))) AS p, list_min(list_transform(r, lambda q: q.x)) AS mx, list_max(list_transform(r, lambda q: q.y)) AS my,
 list_sum(list_transform(range(1, 33), lambda i: (r[i].x + r[i % 32 + 1].x) * {CROSS})) AS cx FROM {RING})""",
    "embeddings",
)
def ring_area_centroid(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    r = rings(vectors)
    ring, box = F.col("ring"), G.ring_bounds(F.col("ring"))
    cx = F.when(G.ring_area(ring) > 0.05, rnd(G.ring_centroid(ring)["x"], 4))
    return r.select("vec_id", rnd(G.ring_area(ring), 6).alias("area"), rnd(G.ring_perimeter(ring), 6).alias("perimeter"), rnd(box["x0"], 6).alias("min_x"), rnd(box["y1"], 6).alias("max_y"), cx.alias("cx"))


SIDES = f"""sides AS (SELECT vec_id, i, r[i].x AS px, r[i].y AS py, r[i % 32 + 1].x AS qx, r[i % 32 + 1].y AS qy, sqrt(power(r[i % 32 + 1].x - r[i].x, 2) + power(r[i % 32 + 1].y - r[i].y, 2)) AS d FROM {RING} rr, range(1, 33) g(i)),
alongs AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY vec_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS done, sum(d) OVER (PARTITION BY vec_id) AS total FROM sides),
picked AS (SELECT a.vec_id, k.j, arg_max({{'x': px + (qx - px) * CASE WHEN d > 0 THEN least((total * k.j / 24 - done) / d, 1.0) ELSE 0.0 END, 'y': py + (qy - py) * CASE WHEN d > 0 THEN least((total * k.j / 24 - done) / d, 1.0) ELSE 0.0 END}}, a.i) AS s FROM alongs a, range(0, 24) k(j) WHERE a.done <= total * k.j / 24 GROUP BY a.vec_id, k.j),
shoelace AS (SELECT vec_id, abs(list_sum(list_transform(range(1, 33), lambda i: {CROSS})) / 2) AS area FROM {RING})"""


@query(
    f"WITH {SIDES} SELECT a.vec_id, {s_rnd('greatest(0.0, 1 - avg(sqrt(power(a.s.x - b.s.x, 2) + power(a.s.y - b.s.y, 2))) / sqrt(greatest(max(m.area), max(n.area))))', 3)} AS likeness FROM picked a JOIN picked b ON b.vec_id = a.vec_id + 1 AND b.j = a.j JOIN shoelace m ON m.vec_id = a.vec_id JOIN shoelace n ON n.vec_id = b.vec_id GROUP BY a.vec_id",
    "embeddings",
)
def ring_resample_similarity(spark: SparkSession, vectors: DataFrame) -> DataFrame:
    r = G.with_samples(rings(vectors), "ring", "s").select("vec_id", "s", G.ring_area(F.col("ring")).alias("area"))
    other = r.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("t"), F.col("area").alias("area2"))
    far = F.zip_with("s", "t", lambda p, q: F.sqrt(F.pow(p["x"] - q["x"], F.lit(2)) + F.pow(p["y"] - q["y"], F.lit(2))))
    mean = F.aggregate(far, F.lit(0.0), lambda a, x: a + x) / 24
    return r.join(other, "vec_id").select("vec_id", rnd(F.greatest(F.lit(0.0), 1 - mean / F.sqrt(F.greatest("area", "area2"))), 3).alias("likeness"))


ISSUES = f"SELECT 'overlap' AS kind, a_idx AS idx FROM ({PAIRS}) UNION ALL SELECT 'overlap', b_idx FROM ({PAIRS}) UNION ALL SELECT 'sliver', idx FROM (SELECT a.idx, {AREA.format(a='a')} AS ar FROM v_parcel a) WHERE ar < 500.0"


@query(f"SELECT idx, count(*) AS issues FROM ({ISSUES}) GROUP BY idx", "v_parcel")
def issues_per_feature(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Both sides of each overlap and every sliver count for their parcel."""
    o = overlaps(parcels).select(F.explode(F.array("a_idx", "b_idx")).alias("idx"))
    small = parcels.filter(G.box_area(G.box()) < 500.0).select("idx")
    return o.union(small).groupBy("idx").agg(F.count(F.lit(1)).alias("issues"))


def s_counts(v: str, i: str) -> str:
    return f"(SELECT count(*) FROM {v} a JOIN {v} b ON a.{i} < b.{i} AND {OVER.format(a='a', b='b')} > 0.05) AS overlap, (SELECT count(*) FROM {v} a WHERE {AREA.format(a='a')} < 520.0) AS sliver"


@query(
    f"""SELECT kind, before_n, after_n, greatest(0, before_n - after_n) AS resolved FROM (SELECT 'overlap' AS kind, p.overlap AS before_n, c.overlap AS after_n FROM (SELECT {s_counts('v_parcel', 'idx')}) p, (SELECT {s_counts('v_candidate', 'cand_idx')}) c UNION ALL SELECT 'sliver', p.sliver, c.sliver FROM (SELECT {s_counts('v_parcel', 'idx')}) p, (SELECT {s_counts('v_candidate', 'cand_idx')}) c)""",
    "v_parcel", "v_candidate",
)
def topology_before_after(spark: SparkSession, parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    from landloom.operators.topology import compare_issues

    facts = None
    for phase, df in (("before", parcels), ("after", candidates.withColumnRenamed("cand_idx", "idx"))):
        o = overlaps(df).select(F.lit(phase).alias("phase"), F.lit("overlap").alias("kind"))
        s = df.filter(G.box_area(G.box()) < 520.0).select(F.lit(phase).alias("phase"), F.lit("sliver").alias("kind"))
        facts = o.union(s) if facts is None else facts.union(o).union(s)
    return compare_issues(facts)


P2 = "printf('%.2f', {})"
REASONS = f"""SELECT a_idx, verdict, CASE WHEN said = '' THEN 'No shared geometry between candidate and reference' ELSE said END || CASE WHEN verdict = 'UNMATCHED' THEN '; Below the correspondence threshold' ELSE '' END AS reasons FROM (
SELECT m.a_idx, m.verdict, concat_ws('; ', CASE WHEN iou >= 0.9 THEN concat('Boundary overlap IoU ', {P2.format('iou')}, ' - near-identical footprint') WHEN iou >= 0.6 THEN concat('Boundary overlap IoU ', {P2.format('iou')}, ' - substantial shared area') WHEN iou > 0 THEN concat('Partial boundary overlap IoU ', {P2.format('iou')}) END,
 CASE WHEN likeness >= 0.95 THEN concat('Area similarity ', {P2.format('likeness')}, ' - extents agree') WHEN likeness < 0.85 THEN concat('Area similarity only ', {P2.format('likeness')}, ' - extents differ') END,
 CASE WHEN shift <= 0.5 THEN concat('Centroid displacement ', {P2.format('shift')}, ' m') WHEN shift <= 2 THEN concat('Centroid displaced ', {P2.format('shift')}, ' m - plausible legacy shift') WHEN shift > 2 THEN concat('Centroid displaced ', {P2.format('shift')}, ' m - large offset') END,
 CASE WHEN distance <= 1 THEN concat('A survey point supports this parcel (', {P2.format('distance')}, ' m)') END) AS said
FROM ({SCORES}) m LEFT JOIN (SELECT c.cand_id AS support_id, {s_rnd('n.d', 3)} AS distance FROM v_candidate c JOIN ({NEAREST}) n ON n.cand_idx = c.cand_idx) d ON d.support_id = m.cand_id)"""


@query(REASONS, "v_parcel", "v_candidate", "v_survey")
def match_reasons(spark: SparkSession, parcels: DataFrame, candidates: DataFrame, survey: DataFrame) -> DataFrame:
    """Why each parcel got its verdict, as sentences."""
    m = matches(parcels, candidates, survey)
    why = M.reasons(F.col("iou"), F.col("likeness"), F.col("shift"), F.col("b_distance"), F.col("verdict"))
    return m.select("a_idx", "verdict", F.array_join(why, "; ").alias("reasons"))


CHECKED = "SELECT b.b_idx, CASE WHEN b.b_idx % 17 = 0 THEN 'NULL' WHEN b.b_idx % 19 = 0 THEN 'ZERO_AREA' WHEN min(b.b_idx) OVER (PARTITION BY b.b_idx % 17 = 0, b.b_idx % 19 = 0, b.x0, b.y0, b.x1, b.y1) < b.b_idx THEN 'DUPLICATE' ELSE 'VALID' END AS state FROM v_structure b"


@query(f"SELECT state, count(*) AS n FROM ({CHECKED}) GROUP BY state", "v_structure")
def geometry_checks(spark: SparkSession, structures: DataFrame) -> DataFrame:
    """Null, empty and repeated outlines counted; some outlines are made null or flat first."""
    box = ["x0", "y0", "x1", "y1"]
    null, flat = F.col("b_idx") % 17 == 0, F.col("b_idx") % 19 == 0
    df = structures.select("b_idx", *[F.when(~null, F.col(c)).alias(c) for c in box]).withColumn("x1", F.when(flat, F.col("x0")).otherwise(F.col("x1")))
    first = df.filter("x1 > x0").groupBy(*box).agg(F.min("b_idx").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    seen = df.join(first, box, "left")
    state = F.when(F.col("x0").isNull(), "NULL").when(F.col("x1") <= F.col("x0"), "ZERO_AREA").when(F.col("first") < F.col("b_idx"), "DUPLICATE").otherwise("VALID")
    return seen.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""SELECT idx, {s_rnd(s_rnd('o', 7), 4)} AS common, {s_rnd(s_rnd('pa + ca - o', 7), 4)} AS united, {s_rnd(s_rnd('pa - o', 7), 4)} AS only_a, {s_rnd(s_rnd('pa + ca - 2 * o', 7), 4)} AS either FROM (SELECT a.idx, {AREA.format(a='a')} AS pa, {AREA.format(a='b')} AS ca, {OVER.format(a='a', b='b')} AS o FROM v_parcel a JOIN v_candidate b ON b.cand_idx = a.idx)""",
    "v_parcel", "v_candidate",
)
def overlay_areas(spark: SparkSession, parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Intersection, union, difference and symmetric difference of two epochs by the general kernel, on outlines turned by a fifth of a radian."""
    turned = lambda p: F.transform(G.ring_of_box(G.box()), lambda q: G.point(q["x"] * math.cos(0.2) - q["y"] * math.sin(0.2), q["x"] * math.sin(0.2) + q["y"] * math.cos(0.2))).alias(p)
    both = parcels.select("idx", turned("p")).join(candidates.select("cand_idx", turned("q")), F.col("idx") == F.col("cand_idx"))
    out = shapes.overlays(both.select("idx", F.array("p").alias("a"), F.array("q").alias("b")))
    return out.select("idx", *[rnd(rnd(F.col(c), 7), 4).alias(c) for c in ("common", "united", "only_a", "either")])


@query(f"SELECT c_idx, {s_rnd(s_rnd('2 * 2.0 * l + 16 * 2 * 2.0 * 2.0 / 2 * sin(pi() / 16)', 7), 3)} AS area FROM (SELECT c_idx, sqrt(power(x1 - x0, 2) + power(y1 - y0, 2)) AS l FROM v_corridor)", "v_corridor")
def line_buffer(spark: SparkSession, corridors: DataFrame) -> DataFrame:
    """The surroundings of each corridor's diagonal within two metres, with round ends of sixteen sides a half circle."""
    return shapes.buffered(corridors.select("c_idx", F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y1"))).alias("line")), "c_idx", 2.0).select("c_idx", rnd(rnd(F.col("area"), 7), 3).alias("area"))


@query("SELECT idx, floor(x0 / 0.15 + 0.5) * 0.15 AS x0, floor(y1 / 0.15 + 0.5) * 0.15 AS y1, abs((floor(x1 / 0.15 + 0.5) * 0.15 - floor(x0 / 0.15 + 0.5) * 0.15) * (floor(y1 / 0.15 + 0.5) * 0.15 - floor(y0 / 0.15 + 0.5) * 0.15) - (x1 - x0) * (y1 - y0)) > 1e-9 AS changed FROM v_parcel", "v_parcel")
def snap_grid(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Outlines on a grid of 15 centimetres; changed tells whether that moved their area."""
    out = shapes.snapped(parcels.select("idx", F.array(G.ring_of_box(G.box())).alias("rings")), 0.15)
    b = G.ring_bounds(F.get("rings", F.lit(0)))
    return out.select("idx", b["x0"].alias("x0"), b["y1"].alias("y1"), "changed")


@query(f"SELECT idx, idx % 10 = 0 AS repaired, CASE WHEN idx % 10 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN idx % 10 = 0 THEN {s_rnd(s_rnd('(x1 - x0) * (y1 - y0) / 2', 7), 4)} ELSE {s_rnd(s_rnd('(x1 - x0) * (y1 - y0)', 7), 4)} END AS area FROM v_parcel", "v_parcel")
def crossed_repair(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Every tenth outline is crossed like a bow tie and falls into two triangles of a quarter each."""
    from landloom.operators import repair as R

    b = G.box()
    crossed = F.array(G.point(b[0], b[1]), G.point(b[2], b[3]), G.point(b[2], b[1]), G.point(b[0], b[3]))
    fixed = R.valid_rings(R.dealt(parcels.select("idx", F.array(F.when(F.col("idx") % 10 == 0, crossed).otherwise(G.ring_of_box(b))).alias("rings"))))
    return fixed.select("idx", "repaired", F.size("rings").alias("parts"), rnd(rnd(shapes.rings_area(F.col("rings")), 7), 4).alias("area"))
