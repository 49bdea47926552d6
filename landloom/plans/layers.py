"""Queries on a layer of shared edges: outlines turned by a fixed angle, which changes no area, so SQL on the boxes before the turn tells the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions.num import rnd
from landloom.operators import layer as L
from landloom.operators.cut import cut
from landloom.plans.attributes import s_rnd
from landloom.plans.registry import query


def ring(*points: tuple) -> Column:
    """A ring turned by the angle of the triangle 3, 4, 5."""
    turned = lambda x, y: G.point(x * 0.8 - y * 0.6, x * 0.6 + y * 0.8)
    return F.array(*[turned(x, y) for x, y in points])


def shaped(parcels: DataFrame) -> DataFrame:
    """Every parcel as a turned outline: by idx a box, one without its upper right corner, or one with a hole."""
    x0, y0, x1, y1 = G.box()
    w, h = x1 - x0, y1 - y0
    box = ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))
    notched = ring((x0, y0), (x1, y0), (x1, y0 + h * 0.6), (x0 + w * 0.6, y0 + h * 0.6), (x0 + w * 0.6, y1), (x0, y1))
    hole = ring((x0 + w * 0.4, y0 + h * 0.4), (x0 + w * 0.4, y0 + h * 0.6), (x0 + w * 0.6, y0 + h * 0.6), (x0 + w * 0.6, y0 + h * 0.4))
    kind = F.col("idx") % 3
    return parcels.select("idx", F.when(kind == 0, F.array(box)).when(kind == 1, F.array(notched)).otherwise(F.array(box, hole)).alias("rings"))


#: Disjoint boxes of each outline; its area; for each outline the cells between all lines of it and of the neighbours that beat it.
PIECES = """b AS (SELECT idx, x0, y0, x1, y1, x1 - x0 AS w, y1 - y0 AS h, idx % 3 AS k FROM v_parcel),
q AS MATERIALIZED (SELECT idx, x0 AS a, y0 AS b, x1 AS c, y1 AS d FROM b WHERE k = 0
UNION ALL SELECT idx, x0, y0, x1, y0 + h * 0.6 FROM b WHERE k = 1 UNION ALL SELECT idx, x0, y0 + h * 0.6, x0 + w * 0.6, y1 FROM b WHERE k = 1
UNION ALL SELECT idx, x0, y0, x1, y0 + h * 0.4 FROM b WHERE k = 2 UNION ALL SELECT idx, x0, y0 + h * 0.6, x1, y1 FROM b WHERE k = 2
UNION ALL SELECT idx, x0, y0 + h * 0.4, x0 + w * 0.4, y0 + h * 0.6 FROM b WHERE k = 2 UNION ALL SELECT idx, x0 + w * 0.6, y0 + h * 0.4, x1, y0 + h * 0.6 FROM b WHERE k = 2),
m AS MATERIALIZED (SELECT idx, round(sum((c - a) * (d - b)), 6) AS whole FROM q GROUP BY idx),
o AS MATERIALIZED (SELECT p.idx, q.a, q.b, q.c, q.d FROM b p JOIN b r ON r.x0 < p.x1 AND p.x0 < r.x1 AND r.y0 < p.y1 AND p.y0 < r.y1 JOIN m mp ON mp.idx = p.idx JOIN m mr ON mr.idx = r.idx AND (mr.whole > mp.whole OR mr.whole = mp.whole AND r.idx > p.idx) JOIN q ON q.idx = r.idx),
l AS MATERIALIZED (SELECT idx, a, b, c, d FROM q UNION ALL SELECT idx, a, b, c, d FROM o),
xs AS MATERIALIZED (SELECT idx, x, lead(x) OVER (PARTITION BY idx ORDER BY x) AS nx FROM (SELECT idx, a AS x FROM l UNION SELECT idx, c FROM l)),
ys AS MATERIALIZED (SELECT idx, y, lead(y) OVER (PARTITION BY idx ORDER BY y) AS ny FROM (SELECT idx, b AS y FROM l UNION SELECT idx, d FROM l)),
cells AS MATERIALIZED (SELECT xs.idx, x, nx, y, ny FROM xs JOIN ys ON xs.idx = ys.idx JOIN q ON q.idx = xs.idx AND q.a < (x + nx) / 2 AND q.c > (x + nx) / 2 AND q.b < (y + ny) / 2 AND q.d > (y + ny) / 2 WHERE nx IS NOT NULL AND ny IS NOT NULL),
kept AS (SELECT c.idx, sum((nx - x) * (ny - y)) AS kept FROM cells c WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.idx = c.idx AND o.a < (x + nx) / 2 AND o.c > (x + nx) / 2 AND o.b < (y + ny) / 2 AND o.d > (y + ny) / 2) GROUP BY c.idx)"""
THREE = s_rnd(s_rnd("{}", 6), 3)


def three(c: Column) -> Column:
    return rnd(rnd(c, 6), 3)


@query(f"WITH {PIECES} SELECT m.idx, {THREE.format('whole')} AS area_before, {THREE.format('coalesce(kept, 0.0)')} AS area_after FROM m LEFT JOIN kept ON kept.idx = m.idx", "v_parcel")
def disputes_settled(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """What each turned, notched or holed outline keeps when disputed ground goes to the largest parcel."""
    faces, _ = L.overlay(cut(L.prepared(shaped(parcels), 0.0)), 64.0)
    whole = L.parcels_of(faces).groupBy("idx").agg(F.sum("area").alias("whole"))
    owned, _ = L.settled(faces)
    kept = owned.filter("owner IS NOT NULL").groupBy(F.col("owner").alias("idx")).agg(F.sum("area").alias("kept"))
    return whole.join(kept, "idx", "left").select("idx", three(F.col("whole")).alias("area_before"), three(F.coalesce("kept", F.lit(0.0))).alias("area_after"))


PAIRS = "SELECT (least(a.c, b.c) - greatest(a.a, b.a)) * (least(a.d, b.d) - greatest(a.b, b.b)) AS s, a.idx AS i, b.idx AS j FROM q a JOIN q b ON a.idx < b.idx AND a.a < b.c AND b.a < a.c AND a.b < b.d AND b.b < a.d"


@query(f"WITH {PIECES}, p AS (SELECT i, j, sum(s) AS s FROM ({PAIRS}) GROUP BY i, j HAVING sum(s) > 0.05) SELECT (SELECT count(*) FROM p) AS overlaps, (SELECT {s_rnd(s_rnd('sum(s)', 4), 2)} FROM p) AS overlap_area, (SELECT {s_rnd(s_rnd('sum(kept)', 4), 2)} FROM kept) AS covered, 0::BIGINT AS overlaps_after, 0::BIGINT AS split_after, 0::BIGINT AS slivers_after, TRUE AS converged", "v_parcel")
def layer_repair(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """The repair loop over the whole layer; its outlines are walked, laid over each other again, and nothing may be left to repair."""
    done = L.planar_layer(shaped(parcels), snap=0.0, min_sliver=2.0)
    again, edges = L.overlay(cut(L.prepared(done.outlines(), 0.0)), 64.0)
    again = cut(again.withColumn("owner", F.try_element_at("cover", F.lit(1))))
    parts = again.filter("owner IS NOT NULL").join(L.parts_of(again, edges, "owner"), "face").groupBy("owner").agg(F.countDistinct("part").alias("n"), F.sum("area").alias("area"))
    left = parts.agg(F.count_if(F.col("n") > 1).alias("split_after"), F.count_if(F.col("area") < done.log["area_floor_sqm"]).alias("slivers_after"))
    covered = done.faces.filter(F.size("cover") > 0).agg(F.sum("area").alias("c"))
    log = done.log
    out = left.join(covered, F.lit(True)).join(L.disputes(again).agg(F.count(F.lit(1)).alias("overlaps_after")), F.lit(True))  # one row each
    two = lambda c: rnd(rnd(c, 4), 2)
    return out.select(F.lit(log["overlaps_resolved"]).cast("long").alias("overlaps"), two(F.lit(float(log["overlap_area_removed_sqm"]))).alias("overlap_area"), two(F.col("c")).alias("covered"), "overlaps_after", "split_after", "slivers_after", F.lit(log["converged"]).alias("converged"))


@query(
    f"""WITH s AS (SELECT idx, (x1 - x0) * (y1 - y0) AS area, x1 - x0 AS w, y1 - y0 AS h, CASE WHEN idx % 5 = 2 THEN 3 WHEN idx % 5 = 4 THEN 1 ELSE 0 END AS n FROM v_parcel)
SELECT idx, CAST(n AS BIGINT) AS slivers, {THREE.format('area')} AS area FROM s""",
    "v_parcel",
)
def sliver_contraction(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Parcels of a layer without overlaps, from some of which strips of two centimetres were cut off, one beside the other: each strip comes back to its parcel, through the strips between."""
    b = G.box()
    apart = [(F.col("idx") % 1000) * 60.0, F.floor(F.col("idx") / 1000) * 60.0]  # parcels lie apart, so each has only its own strips beside it
    n = F.when(F.col("idx") % 5 == 2, 3).when(F.col("idx") % 5 == 4, 1).otherwise(0)
    w, h = b[2] - b[0], b[3] - b[1]
    cutoff = parcels.select("idx", w.alias("w"), h.alias("h"), n.alias("n"), F.explode(F.sequence(F.lit(0), n)).alias("strip"))
    left = F.when(F.col("strip") == 0, 0.0).otherwise(F.col("w") - F.col("strip") * 0.02)
    right = F.when(F.col("strip") == 0, F.col("w") - F.col("n") * 0.02).otherwise(F.col("w") - (F.col("strip") - 1) * 0.02)
    x, low, high = (lambda c: apart[0] + c), apart[1], apart[1] + F.col("h")
    outline = ring((x(left), low), (x(right), low), (x(right), high), (x(left), high))
    shapes = cutoff.select((F.col("idx") * 8 + F.col("strip")).alias("idx"), F.array(outline).alias("rings"))
    done = L.planar_layer(shapes, snap=0.0, min_sliver=2.0)
    out = done.faces.filter("owner IS NOT NULL").groupBy(F.floor(F.col("owner") / 8).alias("idx")).agg(F.sum("area").alias("area"), F.max(F.col("owner") % 8).alias("left"))
    gone = done.faces.filter(F.size("cover") > 0).select(F.explode("cover").alias("key")).distinct().groupBy(F.floor(F.col("key") / 8).alias("idx")).agg((F.count(F.lit(1)) - 1).alias("slivers"))
    return out.filter("left = 0").join(gone, "idx").select("idx", "slivers", three(F.col("area")).alias("area"))
