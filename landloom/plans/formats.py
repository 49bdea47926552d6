"""Queries on geometry repair, conflation, splines and file formats; results of the kernel are beyond SQL and are tested by hand-made cases."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions.num import rnd
from landloom.operators import repair as R
from landloom.operators.cut import cut
from landloom.plans.registry import query
from landloom.sources import formats


def outlined(df: DataFrame) -> DataFrame:
    """Boxes as outlines of one ring."""
    return df.withColumn("rings", F.array(G.ring_of_box(G.box())))


@query(None, "v_parcel")
def planarise(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    out = R.planarise(outlined(parcels).select("idx", "rings", "x0", "y0", "x1", "y1"))
    return out.select("idx", F.size("rings").alias("parts"), "repaired", rnd(F.col("lost"), 4).alias("lost"), "resolved", "settled")


#: A layer with defects: some outlines crossed like a bow tie, some there twice.
LAYER = "SELECT idx, x0, y0, x1, y1 FROM v_parcel WHERE idx % 30 <> 7 UNION ALL SELECT idx + 20000000, x0, y0, x1, y1 FROM v_parcel WHERE idx % 40 = 9"
DISPUTES = f"WITH l AS ({LAYER}) SELECT 'overlap' AS kind, count(*) AS before FROM l a JOIN l b ON a.idx < b.idx AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1 AND (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) > 0.05 UNION ALL SELECT 'invalid', count(*) FROM v_parcel WHERE idx % 30 = 7"


@query(f"SELECT kind, before, CAST(0 AS BIGINT) AS after, TRUE AS settled FROM ({DISPUTES})", "v_parcel")
def planar_report(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Overlaps and crossed outlines of a layer before it is planarised and after: none may be left. Crossed ones lie apart."""
    b = G.box()
    away = lambda q: G.point(q["x"] + 100000.0, q["y"])
    crossed = F.transform(F.array(G.point(b[0], b[1]), G.point(b[2], b[3]), G.point(b[2], b[1]), G.point(b[0], b[3])), away)
    once = parcels.select("idx", F.array(F.when(F.col("idx") % 30 == 7, crossed).otherwise(G.ring_of_box(b))).alias("rings"))
    layer = once.unionByName(outlined(parcels.filter("idx % 40 = 9").withColumn("idx", F.col("idx") + 20000000)).select("idx", "rings"))
    fixed = cut(R.planarise(R.with_box(layer)))
    calm = fixed.agg(F.bool_and("settled").alias("settled"))
    both = R.issue_counts(layer).join(R.issue_counts(fixed.select("idx", "rings")).withColumnRenamed("n", "after"), "kind")
    return both.filter("kind IN ('overlap', 'invalid')").join(calm, F.lit(True)).select("kind", F.col("n").alias("before"), "after", "settled")  # one row


BOW = "SELECT idx, idx % 30 = 7 AS repaired, CASE WHEN idx % 30 = 7 THEN 2 ELSE 1 END AS parts, (x1 - x0) * (y1 - y0) * CASE WHEN idx % 30 = 7 THEN 0.5 ELSE 1.0 END AS a FROM v_parcel"


@query(f"SELECT idx, repaired, parts, floor(floor(a * 10000000.0 + 0.5) / 10000000.0 * 10000.0 + 0.5) / 10000.0 AS area FROM ({BOW})", "v_parcel")
def make_valid_bowtie(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Every parcel, some with crossed outlines, repaired: the lobes of a crossed box have half its area."""
    b = G.box()
    crossed = F.array(G.point(b[0], b[1]), G.point(b[2], b[3]), G.point(b[2], b[1]), G.point(b[0], b[3]))
    shaped = parcels.select("idx", F.array(F.when(F.col("idx") % 30 == 7, crossed).otherwise(G.ring_of_box(b))).alias("rings"))
    fixed = R.valid_rings(shaped)
    whole = F.aggregate("rings", F.lit(0.0), lambda s, r: s + G.ring_area(r))
    return fixed.select("idx", "repaired", F.size("rings").alias("parts"), rnd(rnd(whole, 7), 4).alias("area"))


@query(None, "v_parcel", "v_structure")
def structure_conflation(spark: SparkSession, parcels: DataFrame, structures: DataFrame) -> DataFrame:
    own = outlined(structures).select(F.col("hint").alias("idx"), F.col("b_idx").alias("ord"), "rings")
    return R.conflate(outlined(parcels).select("idx", "rings"), own).select("idx", F.size("rings").alias("parts"), "included", rnd(F.col("added"), 4).alias("added"))


REMOVED = """WITH r AS (SELECT p.idx, p.x0 AS px0, p.y0 AS py0, p.x1 AS px1, p.y1 AS py1, greatest(k.x0, p.x0) AS x0, greatest(k.y0, p.y0) AS y0, least(k.x1, p.x1) AS x1, least(k.y1, p.y1) AS y1 FROM v_parcel p JOIN v_corridor k ON k.x0 < p.x1 AND k.x1 > p.x0 AND k.y0 < p.y1 AND k.y1 > p.y0),
xi AS (SELECT idx, x, lead(x) OVER (PARTITION BY idx ORDER BY x) AS nx FROM (SELECT DISTINCT idx, x FROM (SELECT idx, x0 AS x FROM r UNION ALL SELECT idx, x1 FROM r))), yi AS (SELECT idx, y, lead(y) OVER (PARTITION BY idx ORDER BY y) AS ny FROM (SELECT DISTINCT idx, y FROM (SELECT idx, y0 AS y FROM r UNION ALL SELECT idx, y1 FROM r))),
g AS (SELECT xi.idx, sum(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.idx = xi.idx AND r.x0 <= x AND r.x1 >= nx AND r.y0 <= y AND r.y1 >= ny) THEN (nx - x) * (ny - y) ELSE 0.0 END) AS a FROM xi JOIN yi ON xi.idx = yi.idx WHERE nx IS NOT NULL AND ny IS NOT NULL GROUP BY xi.idx)
SELECT p.idx, floor(floor(coalesce(g.a, 0.0) * 1000000.0 + 0.5) / 1000000.0 * 1000.0 + 0.5) / 1000.0 AS removed FROM v_parcel p LEFT JOIN g ON g.idx = p.idx"""


@query(REMOVED, "v_parcel", "v_corridor")
def corridor_subtraction(spark: SparkSession, parcels: DataFrame, corridors: DataFrame) -> DataFrame:
    own = outlined(corridors).withColumnRenamed("c_idx", "ord")
    return R.subtract(outlined(parcels), own).select("idx", rnd(rnd(F.col("removed"), 6), 3).alias("removed"))


@query(None, "v_survey")
def tps_fit(spark: SparkSession, survey: DataFrame) -> DataFrame:
    """A spline for each of some sheets, whose legacy frame is turned and bent a little against the surveyed one."""
    x, y = F.col("x"), F.col("y")
    ties = survey.filter("corner = 'C1'").groupBy("parcel").agg(F.min_by(F.struct("x", "y"), "obs_idx").alias("p")).select((F.col("parcel") % 5).cast("string").alias("sheet"), "p.x", "p.y")
    ties = ties.select("sheet", (x * 0.999 - y * 0.01 + F.sin(y / 50) * 0.3).alias("sx"), (y * 1.001 + x * 0.01).alias("sy"), x.alias("tx"), y.alias("ty"))
    out = R.georeference(ties)
    return out.select("sheet", "status", "points", *[rnd(F.col(c), 4).alias(c) for c in ("mean_error", "largest_error", "baseline")])


FILE_ROWS = 2000  # features of one file


def filed(parcels: DataFrame, write, ending: str) -> DataFrame:
    """All parcels as files of at most FILE_ROWS features, by ranges of ids, written where the rows are: path, content."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows = [({"parcel_id": r.parcel_id, "land_use": r.land_use}, [np.array([(r.x0, r.y0), (r.x1, r.y0), (r.x1, r.y1), (r.x0, r.y1)])]) for r in part.sort_values("idx").itertuples()]
        return pd.DataFrame([(f"{int(part['file'].iloc[0])}{ending}", write(rows))], columns=["path", "content"])

    own = parcels.select("idx", "parcel_id", "land_use", "x0", "y0", "x1", "y1", F.floor(F.col("idx") / FILE_ROWS).alias("file"))
    return own.groupBy("file").applyInPandas(run, "path string, content binary")


def as_content(spark: SparkSession, name: str, raw: bytes) -> DataFrame:
    return spark.createDataFrame([(name, bytearray(raw))], "path string, content binary")


def told(features: DataFrame) -> DataFrame:
    """parcel_id, land_use, points and area of features read back from a file."""
    ring = F.transform(F.get("rings", F.lit(0)), lambda p: G.point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    p = F.from_json("properties", "parcel_id string, land_use string")
    return features.select(p["parcel_id"].alias("parcel_id"), p["land_use"].alias("land_use"), F.size(ring).cast("long").alias("points"), rnd(G.ring_area(ring), 6).alias("area"))


BACK = "SELECT p.parcel_id, p.land_use, 5::BIGINT AS points, floor(((p.x1 - p.x0) * (p.y1 - p.y0)) * 1000000.0 + 0.5) / 1000000.0 AS area FROM v_parcel p"


@query(BACK, "v_parcel")
def gpkg_roundtrip(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    return told(formats.read_gpkg(filed(parcels, lambda rows: formats.write_gpkg(rows, "parcels", 32643), ".gpkg")))


@query(BACK, "v_parcel")
def shp_roundtrip(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    return told(formats.read_shapefile(filed(parcels, formats.write_shapefile, ".zip")))


@query("SELECT concat('tile_', k, '.tif') AS path, 1 AS band, 40 AS width, 25 AS height, 0.5::DOUBLE AS pixel, 32643 AS epsg, min(v) AS least, max(v) AS largest, floor(avg(v) * 10000.0 + 0.5) / 10000.0 AS mean FROM (SELECT CAST(floor(c_custkey / 1000) AS BIGINT) AS k, CAST(floor(c_acctbal) AS DOUBLE) AS v FROM customer) GROUP BY k", "customer")
def geotiff_stats(spark: SparkSession, customer: DataFrame) -> DataFrame:
    """Balances written as rasters of 40 x 25 cells, a cell a customer and a file a thousand of them, and read back: size, place and statistics without the masked cells."""

    def write(part: pd.DataFrame) -> pd.DataFrame:
        band = np.full(1000, -99999, np.float32)
        band[part["c_custkey"].to_numpy() % 1000] = part["v"]
        raw = formats.write_tiff(band.reshape(25, 40), (370000.0, 2050000.0), 0.5, nodata=-99999)
        return pd.DataFrame([(f"tile_{part['k'].iloc[0]}.tif", raw)], columns=["path", "content"])

    tiles = customer.select("c_custkey", F.floor(F.col("c_custkey") / 1000).cast("long").alias("k"), F.floor("c_acctbal").cast("double").alias("v"))
    return formats.raster_stats(tiles.groupBy("k").applyInPandas(write, "path string, content binary"))


@query("SELECT p.idx, p.land_use, 5::BIGINT AS points, p.x0 AS min_x, p.y0 AS min_y, p.x1 AS max_x, p.y1 AS max_y, floor((p.x1 - p.x0) * (p.y1 - p.y0) * 1000000.0 + 0.5) / 1000000.0 AS area FROM v_parcel p", "v_parcel")
def geojson_export(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Features written as lines of GeoJSON, and what the lines say, coordinates included."""
    lines = formats.geojson_lines(outlined(parcels), "rings", "idx", "land_use")
    got = lines.select(F.from_json("value", "properties struct<idx:bigint,land_use:string>, geometry struct<type:string,coordinates:array<array<array<double>>>>").alias("f"))
    ring = F.transform(F.get("f.geometry.coordinates", F.lit(0)), lambda p: G.point(p[0], p[1]))
    out = got.select("f.properties.idx", "f.properties.land_use", ring.alias("ring")).select("idx", "land_use", F.size("ring").cast("long").alias("points"), G.ring_bounds(F.col("ring")).alias("b"), rnd(G.ring_area(F.col("ring")), 6).alias("area"))
    return out.select("idx", "land_use", "points", F.col("b.x0").alias("min_x"), F.col("b.y0").alias("min_y"), F.col("b.x1").alias("max_x"), F.col("b.y1").alias("max_y"), "area")


def layers(parcels: DataFrame, register: DataFrame, candidates: DataFrame, survey: DataFrame, structures: DataFrame, corridors: DataFrame, customer: DataFrame, owners: DataFrame | None = None):
    """The sources of a run; with owners (idx, local_a, english_a, local_b, english_b) the names of both sides are theirs, in two scripts."""
    from landloom.plans.harmonize import Layers

    if owners is not None:
        parcels = parcels.drop("owner_name").join(owners.select("idx", F.col("local_a").alias("owner_local"), F.col("english_a").alias("owner_name")), "idx", "left")
        owned = register.join(owners.select(F.col("idx").alias("parcel_ref"), F.col("english_b").alias("owner"), F.col("local_b").alias("owner_local")), "parcel_ref", "left")
        return Layers(parcels, owned, candidates, survey, structures, corridors)
    owned = register.join(customer.select(F.col("c_custkey").alias("parcel_ref"), F.col("c_name").alias("owner")), "parcel_ref", "left")
    return Layers(parcels, owned, candidates, survey, structures, corridors)


@query(None, "v_surveyed", "v_register", "v_candidate", "v_survey", "v_structure", "v_corridor", "customer", "v_owner")
def harmonization_run(spark: SparkSession, *sources: DataFrame) -> DataFrame:
    """The whole run: parcels with match, attribute status, confidence and route."""
    from landloom.plans.harmonize import run

    return run(layers(*sources), "run-1")["parcels"].withColumn("concerns", F.array_join("concerns", ", "))


@query(None, "v_surveyed", "v_register", "v_candidate", "v_survey", "v_structure", "v_corridor", "customer", "v_owner")
def harmonization_conflicts(spark: SparkSession, *sources: DataFrame) -> DataFrame:
    from landloom.plans.harmonize import run

    return run(layers(*sources), "run-1")["conflicts"].groupBy("conflict_type", "severity", "status").agg(F.count(F.lit(1)).alias("n"))


TILED = """WITH e AS (SELECT min(x0) AS ex0, min(y0) AS ey0, max(x1) AS ex1, max(y1) AS ey1 FROM v_parcel), n AS (SELECT *, CAST(ceil((ex1 - ex0) / 128.0) AS BIGINT) AS nx, CAST(ceil((ey1 - ey0) / 128.0) AS BIGINT) AS ny FROM e),
t AS (SELECT tx, ty, ex0 + tx * 128.0 AS a, ey0 + ty * 128.0 AS b, least(ex0 + tx * 128.0 + 128.0, ex1) AS c, least(ey0 + ty * 128.0 + 128.0, ey1) AS d FROM n, LATERAL (SELECT unnest(range(0, nx)) AS tx), LATERAL (SELECT unnest(range(0, ny)) AS ty)),
p AS (SELECT tx, ty, greatest(x0, a) AS x0, greatest(y0, b) AS y0, least(x1, c) AS x1, least(y1, d) AS y1 FROM t JOIN (SELECT x0, y0, x1, y1 FROM v_parcel UNION ALL SELECT x0, y0, x1, y1 FROM v_corridor) q ON q.x0 < c AND q.x1 > a AND q.y0 < d AND q.y1 > b),
xi AS (SELECT tx, ty, x, lead(x) OVER (PARTITION BY tx, ty ORDER BY x) AS nx FROM (SELECT DISTINCT tx, ty, x FROM (SELECT tx, ty, x0 AS x FROM p UNION ALL SELECT tx, ty, x1 FROM p UNION ALL SELECT tx, ty, a FROM t UNION ALL SELECT tx, ty, c FROM t))), yi AS (SELECT tx, ty, y, lead(y) OVER (PARTITION BY tx, ty ORDER BY y) AS ny FROM (SELECT DISTINCT tx, ty, y FROM (SELECT tx, ty, y0 AS y FROM p UNION ALL SELECT tx, ty, y1 FROM p UNION ALL SELECT tx, ty, b FROM t UNION ALL SELECT tx, ty, d FROM t))),
g AS (SELECT xi.tx, xi.ty, sum(CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.tx = xi.tx AND p.ty = xi.ty AND p.x0 <= x AND p.x1 >= nx AND p.y0 <= y AND p.y1 >= ny) THEN 0.0 ELSE (nx - x) * (ny - y) END) AS area FROM xi JOIN yi ON xi.tx = yi.tx AND xi.ty = yi.ty WHERE nx IS NOT NULL AND ny IS NOT NULL GROUP BY xi.tx, xi.ty)
SELECT tx, ty, floor(floor(area * 1000000.0 + 0.5) / 1000000.0 * 1000.0 + 0.5) / 1000.0 AS gap_area, CASE WHEN area <= 0.05 THEN 'covered' WHEN area <= 25.0 THEN 'residual' ELSE 'gap' END AS kind FROM g"""


@query(TILED, "v_parcel", "v_corridor")
def gap_detection(spark: SparkSession, parcels: DataFrame, corridors: DataFrame) -> DataFrame:
    """What neither parcels nor corridors cover, over the extent of the whole layer, by tile."""
    e = parcels.agg(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).first()
    own = outlined(parcels).select("idx", "rings", "x0", "y0", "x1", "y1")
    taken = outlined(corridors).select(F.lit(None).cast("long").alias("idx"), "rings", "x0", "y0", "x1", "y1")
    out = R.gaps(own, tuple(e), exclusions=taken)
    return out.select("tx", "ty", rnd(rnd(F.col("gap_area"), 6), 3).alias("gap_area"), "kind")


@query("SELECT b.b_idx AS idx, b.b_idx % 4 >= 2 AS corrected, CASE WHEN b.b_idx % 4 >= 2 THEN floor(((b.x1 - b.x0) * (b.y1 - b.y0) - (b.x1 - b.x0 - 0.8) * (b.y1 - b.y0 - 0.8)) * 1000.0 + 0.5) / 1000.0 ELSE 0.0::DOUBLE END AS removed FROM v_structure b", "v_structure")
def eave_correction(spark: SparkSession, structures: DataFrame) -> DataFrame:
    """Every footprint of two storeys or more moves inwards by its eaves."""
    f = outlined(structures).select(F.col("b_idx").alias("idx"), (1.0 + (F.col("b_idx") % 4) * 1.0).alias("height"), "rings")
    return R.eave_correction(f).select("idx", "corrected", rnd(F.col("removed"), 3).alias("removed"))


S_AREA = "((a.x1 - a.x0) * (a.y1 - a.y0))"
SHARED = "greatest(greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), least(a.y1, b.y1) - greatest(a.y0, b.y0)), 0.0)"
THIN = "({p}.x1 - {p}.x0) * ({p}.y1 - {p}.y0) < 500.0 OR (power(2 * (({p}.x1 - {p}.x0) + ({p}.y1 - {p}.y0)), 2) / (({p}.x1 - {p}.x0) * ({p}.y1 - {p}.y0)) > 25 AND ({p}.x1 - {p}.x0) * ({p}.y1 - {p}.y0) < 10000.0)"


@query(
    f"""SELECT t.idx, h.host, floor(h.shared * 10000.0 + 0.5) / 10000.0 AS shared FROM (SELECT idx FROM v_parcel p WHERE {THIN.format(p='p')}) t LEFT JOIN (SELECT * FROM (SELECT a.idx, b.idx AS host, {SHARED} AS shared, row_number() OVER (PARTITION BY a.idx ORDER BY {SHARED} DESC, (b.x1 - b.x0) * (b.y1 - b.y0) DESC, b.idx) AS rn
FROM v_parcel a JOIN v_parcel b ON a.x0 - 0.001 <= b.x1 AND b.x0 <= a.x1 + 0.001 AND a.y0 - 0.001 <= b.y1 AND b.y0 <= a.y1 + 0.001 AND ({THIN.format(p='a')}) AND NOT ({THIN.format(p='b')})) WHERE rn = 1) h ON h.idx = t.idx""",
    "v_parcel",
)
def sliver_dissolve(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    return R.sliver_hosts(parcels, 500.0).select("idx", "host", rnd(F.col("shared"), 4).alias("shared"))


@query("SELECT 'csv' AS format, TRUE AS implemented UNION ALL SELECT 'dxf', FALSE UNION ALL SELECT 'geojson', TRUE UNION ALL SELECT 'gpkg', TRUE UNION ALL SELECT 'kml', FALSE UNION ALL SELECT 'pdf', TRUE UNION ALL SELECT 'shp', TRUE", "region")
def export_formats(spark: SparkSession, region: DataFrame) -> DataFrame:
    from landloom.sources.sinks import available

    return available(spark).select("format", "implemented")
