"""Queries on files and layers that arrive: dispatch, ingest records, reference systems, corridors, observations, small lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions import proj as P
from landloom.functions.num import rnd
from landloom.operators import ingest as I
from landloom.operators import shapes as H
from landloom.plans.attributes import PARCEL, reconciled, s_rnd
from landloom.plans.geometry import SCORES, matches
from landloom.plans.registry import query

EXT = "lower(regexp_extract(filename, '(\\.[^./]*)$', 1))"
CAPABILITY = f"CASE WHEN {EXT} IN ('.geojson', '.json', '.gpkg', '.shp', '.csv', '.tsv', '.tif', '.tiff') THEN 'native' WHEN {EXT} = '.las' THEN 'native-header' ELSE 'adapter-ready' END"
KIND = f"CASE WHEN {EXT} IN ('.geojson', '.json', '.gpkg', '.shp', '.gml', '.dxf', '.kml') THEN 'vector' WHEN {EXT} IN ('.csv', '.tsv', '.xlsx') THEN 'table' WHEN {EXT} IN ('.tif', '.tiff') THEN 'raster' WHEN {EXT} IN ('.las', '.laz') THEN 'point' WHEN {EXT} = '.zip' THEN 'package' ELSE 'unknown' END"
READS = f"{EXT} IN ('.geojson', '.json', '.gpkg', '.shp', '.csv', '.tsv', '.tif', '.tiff', '.las')"
ACCEPTED = ("cadastral_map", "revenue_records", "building_footprint", "gnss_cors", "dsm_dtm")


@query(f"SELECT {EXT} AS extension, {CAPABILITY} AS capability, {KIND} AS kind, {READS} AS reader, count(*) AS files FROM v_file GROUP BY 1, 2, 3, 4", "v_file")
def reader_dispatch(spark: SparkSession, files: DataFrame) -> DataFrame:
    return I.dispatch(files).groupBy("extension", "capability", "kind", "reader").agg(F.count(F.lit(1)).alias("files"))


OK = f"category_id IN ({', '.join(map(repr, ACCEPTED))})"
UPLOAD = f"CASE WHEN NOT {OK} THEN 'refused' WHEN NOT {READS} THEN 'stored_adapter_pending' WHEN parse_ok THEN 'parsed' ELSE 'parse_failed' END"
#: A layer's header, else a declaration of a known code; coordinates only of tables that have them and declare nothing.
KNOWN = "(32643, 32644, 32743, 32642, 3857, 7755, 24378, 4326)"
CRS = f"""CASE WHEN NOT {OK} THEN NULL WHEN {READS} AND parse_ok AND {KIND} = 'vector' AND header_crs IS NOT NULL THEN header_crs
WHEN {READS} AND parse_ok AND {KIND} = 'table' AND reach IS NULL THEN NULL
WHEN declared_crs IS NOT NULL THEN CASE WHEN declared_crs IN {KNOWN} THEN declared_crs END
WHEN {READS} AND parse_ok AND {KIND} = 'table' AND reach > 180 THEN 32643 WHEN {READS} AND parse_ok AND {KIND} = 'table' AND reach <= 90 THEN 4326 END"""
CRS_STATUS = f"""CASE WHEN NOT {OK} THEN NULL WHEN {READS} AND parse_ok AND {KIND} = 'table' AND reach IS NULL THEN 'not_applicable' WHEN {READS} AND parse_ok AND {KIND} = 'vector' AND header_crs IS NOT NULL THEN 'detected'
WHEN declared_crs IN {KNOWN} THEN 'declared' WHEN declared_crs IS NULL AND {READS} AND parse_ok AND {KIND} = 'table' AND (reach > 180 OR reach <= 90) THEN 'inferred' ELSE 'missing' END"""
SIZE = "CASE WHEN size_bytes < 1024 THEN concat(size_bytes, ' B') WHEN size_bytes < 1048576 THEN printf('%.1f KB', size_bytes / 1024.0) ELSE printf('%.1f MB', size_bytes / 1048576.0) END"


@query(f"SELECT seq, upload_status, record_count, source_crs, crs_status, CASE WHEN upload_status = 'refused' THEN 'refused' WHEN source_crs IS NULL THEN 'crs_blocked' ELSE 'crs_pending' END AS processing_status, size_human FROM (SELECT seq, {UPLOAD} AS upload_status, CASE WHEN {OK} AND {READS} AND parse_ok THEN features END AS record_count, CAST({CRS} AS INT) AS source_crs, {CRS_STATUS} AS crs_status, {SIZE} AS size_human FROM v_file)", "v_file")
def ingest_record(spark: SparkSession, files: DataFrame) -> DataFrame:
    return I.ingest(files, ACCEPTED).select("seq", "upload_status", "record_count", "source_crs", "crs_status", "processing_status", "size_human")


@query("SELECT seq, coalesce(nullif(CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN 0 ELSE features END, 0), nullif(features, 0), 0) AS feature_count, coalesce(CAST(header_crs AS STRING), nullif(CASE WHEN seq % 2 = 0 THEN '' END, ''), CAST(declared_crs AS STRING)) AS effective_crs FROM v_file", "v_file")
def dataset_adapter(spark: SparkSession, files: DataFrame) -> DataFrame:
    """The public part of records whose counts and reference systems stand in several places."""
    count = F.when(F.col("seq") % 3 == 1, 0).when(F.col("seq") % 3 == 2, F.col("features"))
    raw = files.select("seq", count.cast("long").alias("record_count"), F.col("features").alias("parse_features"), F.col("header_crs").cast("string").alias("source_crs"), F.when(F.col("seq") % 2 == 0, "").alias("effective"), F.col("declared_crs").cast("string").alias("detected"), F.lit("handle").alias("_gdf"))
    return I.summary(I.adapted(raw)).select("seq", "feature_count", "effective_crs")


LAYER = "CASE seq % 7 WHEN 0 THEN 'road_row' WHEN 1 THEN ' Main Road ' WHEN 2 THEN 'Storm Drain' WHEN 3 THEN 'utility line' WHEN 4 THEN 'Water pipe' WHEN 5 THEN 'ward boundary' END"


@query(f"SELECT seq, conflict_type, CASE conflict_type WHEN 'parcel_vs_road_row' THEN 0.0 WHEN 'parcel_vs_drainage' THEN coalesce(nullif(b, 0.0), 3.0) ELSE coalesce(nullif(b, 0.0), 2.0) END AS width_m FROM (SELECT seq, CAST(seq % 4 AS DOUBLE) AS b, CASE WHEN l LIKE '%road%' OR l LIKE '%row%' THEN 'parcel_vs_road_row' WHEN l LIKE '%drain%' THEN 'parcel_vs_drainage' WHEN l LIKE '%util%' OR l LIKE '%water%' OR l LIKE '%power%' THEN 'parcel_vs_utility' END AS conflict_type FROM (SELECT seq, lower({LAYER}) AS l FROM v_file)) WHERE conflict_type IS NOT NULL", "v_file")
def corridor_routing(spark: SparkSession, files: DataFrame) -> DataFrame:
    layer = files.select("seq", F.expr(LAYER).alias("layer"), (F.col("seq") % 4).cast("double").alias("buffer_m"))
    return I.corridors(layer).select("seq", "conflict_type", "width_m")


@query(f"SELECT obs_idx AS seq, CASE WHEN obs_idx % 4 = 0 THEN concat('gnss-', obs_idx) WHEN obs_idx % 4 = 1 THEN concat('g', obs_idx) ELSE concat('o', obs_idx) END AS point_id, {s_rnd('x', 3)} AS x, {s_rnd('y', 3)} AS y, CASE WHEN obs_idx % 6 = 0 THEN accuracy ELSE 0.5 END AS accuracy_m FROM v_survey WHERE obs_idx % 5 <> 3", "v_survey")
def survey_normalise(spark: SparkSession, survey: DataFrame) -> DataFrame:
    """Observations with eastings, with longitudes only (every fifth; they return to their place within a millimetre), or with neither."""
    n = F.col("obs_idx")
    lon, lat = P.utm_inverse(F.col("x"), F.col("y"), 43)
    rows = survey.select(
        n.alias("seq"), F.when(n % 4 >= 2, F.concat(F.lit("o"), n.cast("string"))).alias("obs_id"), F.when(n % 4 == 1, F.concat(F.lit("g"), n.cast("string"))).otherwise("").alias("gt_id"), F.when(n % 5 < 3, F.col("x")).alias("easting"), F.when(n % 5 < 3, F.col("y")).alias("northing"),
        F.when(n % 5 == 4, lon).alias("lon"), F.when(n % 5 == 4, lat).alias("lat"), F.when(n % 6 != 0, 0.5).alias("rms"), F.col("accuracy"), F.lit("gnss").alias("method"),
    )
    return I.observations(rows).select("seq", "point_id", rnd(F.col("x"), 3).alias("x"), rnd(F.col("y"), 3).alias("y"), "accuracy_m")


S_SYSTEMS = """(VALUES (32643, 'WGS 84 / UTM zone 43N', FALSE, 'metre'), (32644, 'WGS 84 / UTM zone 44N', FALSE, 'metre'), (32743, 'WGS 84 / UTM zone 43S', FALSE, 'metre'), (32642, 'WGS 84 / UTM zone 42N', FALSE, 'metre'),
(3857, 'WGS 84 / Pseudo-Mercator', FALSE, 'metre'), (7755, 'WGS 84 / India NSF LCC', FALSE, 'metre'), (24378, 'Indian 1954 / UTM zone 43N', FALSE, 'metre'), (4326, 'WGS 84', TRUE, 'degree')) s(code, label, geographic, unit)"""


@query(f"SELECT f.seq, CAST(c AS INT) AS code, coalesce(s.label, CASE WHEN c IS NULL THEN 'Undefined' ELSE concat('EPSG:', c, ' (unrecognised)') END) AS label, s.geographic, s.unit, s.code IS NOT NULL AS valid FROM (SELECT seq, CASE WHEN seq % 8 = 3 THEN 99999 ELSE coalesce(header_crs, declared_crs) END AS c FROM v_file) f LEFT JOIN {S_SYSTEMS} ON s.code = f.c", "v_file")
def crs_describe(spark: SparkSession, files: DataFrame) -> DataFrame:
    code = F.when(F.col("seq") % 8 == 3, 99999).otherwise(F.coalesce("header_crs", "declared_crs")).cast("int")
    out = files.select("seq", code.alias("c")).join(F.broadcast(I.systems(spark)), F.col("c") == F.col("code"), "left")  # a fixed table
    label = F.coalesce("label", F.when(F.col("c").isNull(), "Undefined").otherwise(F.concat(F.lit("EPSG:"), F.col("c").cast("string"), F.lit(" (unrecognised)"))))
    return out.select("seq", F.col("c").alias("code"), label.alias("label"), "geographic", "unit", F.col("code").isNotNull().alias("valid"))


@query(f"SELECT verdict, count(*) AS pairs FROM (SELECT CASE WHEN a.c IS NULL OR b.c IS NULL THEN 'warning' WHEN a.c = b.c THEN 'ok' WHEN x.geographic <> y.geographic THEN 'error' ELSE 'warning' END AS verdict FROM (SELECT seq, category_id, coalesce(header_crs, declared_crs) AS c FROM v_file) a JOIN (SELECT seq, category_id, coalesce(header_crs, declared_crs) AS c FROM v_file) b ON a.category_id = b.category_id AND a.seq < b.seq LEFT JOIN {S_SYSTEMS.replace(' s(', ' x(')} ON x.code = a.c LEFT JOIN {S_SYSTEMS.replace(' s(', ' y(')} ON y.code = b.c) GROUP BY verdict", "v_file")
def crs_compatibility(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Pairs of layers of one category, counted by reference system: all layers of one system behave alike, so few rows meet."""
    by = files.select("category_id", F.coalesce("header_crs", "declared_crs").cast("int").alias("c")).groupBy("category_id", "c").agg(F.count(F.lit(1)).alias("n"))
    by = by.join(F.broadcast(I.systems(spark)), F.col("c") == F.col("code"), "left").select("category_id", "c", "n", "geographic")
    a, b = by.select("category_id", *[F.col(x).alias(f"a_{x}") for x in ("c", "n", "geographic")]), by.select("category_id", *[F.col(x).alias(f"b_{x}") for x in ("c", "n", "geographic")])
    rank = lambda c: F.coalesce(c, F.lit(-1))
    met = a.join(b, "category_id").filter(rank(F.col("a_c")) <= rank(F.col("b_c")))
    pairs = F.when(F.col("a_c").eqNullSafe(F.col("b_c")), F.col("a_n") * (F.col("a_n") - 1) / 2).otherwise(F.col("a_n") * F.col("b_n")).cast("long")
    verdict = I.compatibility(F.col("a_c"), F.col("b_c"), F.col("a_geographic"), F.col("b_geographic"))
    return met.select(verdict.alias("verdict"), pairs.alias("p")).groupBy("verdict").agg(F.sum("p").alias("pairs")).filter("pairs > 0")


#: What coordinates suggest, and the hints in their order.
SUGGESTED = """WITH h AS (SELECT * FROM (VALUES (1, 4326, 'WGS 84 geographic', 'carried explicitly in the file'), (2, 32643, 'WGS 84 / UTM 43N', 'nearest UTM zone to the project extent'), (3, 32644, 'WGS 84 / UTM 44N', 'adjacent UTM zone to the project extent'),
(4, 24378, 'Indian 1954 / UTM zone 43N', 'legacy Indian SOI topographic series'), (5, 7755, 'WGS 84 / India NSF LCC', 'national projected grid'), (6, 3857, 'WGS 84 / Pseudo-Mercator', 'web-mapping tiles')) t(k, code, label, why)),
f AS (SELECT seq, CASE WHEN reach > 180 THEN 32643 ELSE 4326 END AS code, CASE WHEN reach > 180 THEN 'WGS 84 / UTM zone 43N' ELSE 'WGS 84' END AS label,
CASE WHEN reach > 180 THEN printf('Coordinates exceed geographic bounds (max |value| = %.1f); best-match projected CRS suggested: WGS 84 / UTM zone 43N. Operator confirmation required.', reach) WHEN reach <= 90 THEN 'All coordinates fall inside WGS 84 geographic bounds (|lat| <= 90).' ELSE 'No coordinate reference system could be established.' END AS why FROM v_file)
SELECT seq AS id, CAST(row_number() OVER (PARTITION BY seq ORDER BY k) - 1 AS INT) AS rank, code, label, why FROM (SELECT seq, 0 AS k, code, label, why FROM f UNION ALL SELECT f.seq, h.k, h.code, h.label, h.why FROM f JOIN h ON h.code <> f.code)"""


@query(SUGGESTED, "v_file")
def crs_suggestions(spark: SparkSession, files: DataFrame) -> DataFrame:
    return I.suggestions(spark, files.select(F.col("seq").alias("id"), "reach"))


@query("SELECT seq AS id, CASE WHEN c IS NULL OR c = 99999 THEN 'FAILED' WHEN c = 32643 THEN 'ALIGNED' ELSE 'REPROJECTED' END AS action, 32643 AS target_crs FROM (SELECT seq, CASE WHEN seq % 8 = 3 THEN 99999 ELSE coalesce(header_crs, declared_crs) END AS c FROM v_file)", "v_file")
def layer_alignment(spark: SparkSession, files: DataFrame) -> DataFrame:
    code = F.when(F.col("seq") % 8 == 3, 99999).otherwise(F.coalesce("header_crs", "declared_crs"))
    return I.alignment(files.select(F.col("seq").alias("id"), code.alias("source_crs")))


@query(f"SELECT idx, {s_rnd('x0 + 370000.0', 3)} AS x, {s_rnd('y0 + 2050000.0', 3)} AS y, TRUE AS inside FROM v_parcel", "v_parcel")
def wgs84_storage(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Corners go to longitude and latitude, as they are stored, and back to their place; inside tells whether they lie in the zone's area of use, however far the layer reaches."""
    lon, lat = P.transform(F.col("x0") + 370000.0, F.col("y0") + 2050000.0, 32643, 4326)
    there = parcels.select("idx", lon.alias("lon"), lat.alias("lat"))
    x, y = P.transform(F.col("lon"), F.col("lat"), 4326, 32643)
    return there.select("idx", rnd(x, 3).alias("x"), rnd(y, 3).alias("y"), P.in_area_of_use(F.col("lon"), F.col("lat"), 32643).alias("inside"))


@query(f"SELECT idx, {s_rnd('(x1 - x0) / 111000.0 * (y1 - y0) / 111000.0 * 111000.0 * 111000.0', 4)} AS area_sqm, {s_rnd('(idx % 5) * 0.000009', 9)} AS buffer_deg FROM v_parcel", "v_parcel")
def degree_area(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Areas in square degrees as square metres, and metres as degrees, by the older generation's constants."""
    degrees = (F.col("x1") - F.col("x0")) / 111000.0 * (F.col("y1") - F.col("y0")) / 111000.0
    return parcels.select("idx", rnd(H.square_degrees_to_metres(degrees), 4).alias("area_sqm"), rnd(H.metres_to_degrees((F.col("idx") % 5).cast("double")), 9).alias("buffer_deg"))


GAP = "sqrt(power(greatest(a.x0 - b.x1, b.x0 - a.x1, 0.0), 2) + power(greatest(a.y0 - b.y1, b.y0 - a.y1, 0.0), 2))"


@query(f"SELECT a.b_idx, {s_rnd(GAP, 4)} AS distance, {GAP} = 0 AS meets FROM v_structure a JOIN v_candidate b ON b.cand_idx = a.hint", "v_structure", "v_candidate")
def geometry_distance(spark: SparkSession, structures: DataFrame, candidates: DataFrame) -> DataFrame:
    """Distance of each footprint's ring to the ring of its customer's modern outline."""
    both = structures.select("b_idx", "hint", G.ring_of_box(G.box()).alias("p")).join(candidates.select("cand_idx", G.ring_of_box(G.box()).alias("q")), F.col("hint") == F.col("cand_idx"))
    d = both.select("b_idx", H.ring_distance(F.col("p"), F.col("q")).alias("d"))
    return d.select("b_idx", rnd(F.col("d"), 4).alias("distance"), (F.col("d") == 0).alias("meets"))


OVER_AB = "greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0.0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0.0)"


@query(f"SELECT a.idx, {s_rnd(s_rnd(OVER_AB, 7), 3)} AS overlap_sqm, {s_rnd(s_rnd(f'(a.x1 - a.x0) * (a.y1 - a.y0) - {OVER_AB}', 7), 3)} AS only_a_sqm, {s_rnd(s_rnd(f'(b.x1 - b.x0) * (b.y1 - b.y0) - {OVER_AB}', 7), 3)} AS only_b_sqm, {s_rnd(s_rnd('sqrt(power((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2, 2) + power((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2, 2))', 7), 3)} AS shift_m FROM v_parcel a JOIN v_candidate b ON b.cand_idx = a.idx", "v_parcel", "v_candidate")
def difference_stats(spark: SparkSession, parcels: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rounded to 7 places before 3: areas here are multiples of half a thousandth, where the last bit would decide."""
    both = parcels.select("idx", G.ring_of_box(G.box()).alias("p")).join(candidates.select("cand_idx", G.ring_of_box(G.box()).alias("q")), F.col("idx") == F.col("cand_idx"))
    return both.select("idx", H.difference_stats(F.col("p"), F.col("q")).alias("d")).select("idx", *[rnd(rnd(F.col(f"d.{c}"), 7), 3).alias(c) for c in ("overlap_sqm", "only_a_sqm", "only_b_sqm", "shift_m")])


@query(
    f"""SELECT b_idx, CASE WHEN k IN (0, 1, 4) THEN 1 WHEN k IN (2, 5) THEN 2 ELSE 0 END AS rings, CASE WHEN k IN (0, 1) THEN {s_rnd(s_rnd('a', 7), 4)} WHEN k = 2 THEN {s_rnd(s_rnd('2 * a', 7), 4)} WHEN k = 4 THEN {s_rnd(s_rnd('1.5 * a', 7), 4)} WHEN k = 5 THEN {s_rnd(s_rnd('0.96 * a', 7), 4)} END AS area
FROM (SELECT b_idx, b_idx % 7 AS k, (x1 - x0) * (y1 - y0) AS a FROM v_structure)""",
    "v_structure",
)
def polygonal_part(spark: SparkSession, structures: DataFrame) -> DataFrame:
    """Polygons, multipolygons, a collection with a line and a polygon, one with overlapping polygons, one with a hole, lines and nulls: what is polygonal stays, united."""
    x0, y0, x1, y1 = G.box()
    k, w, h = F.col("b_idx") % 7, x1 - x0, y1 - y0
    ring = G.ring_of_box((x0, y0, x1, y1))
    far, half = G.ring_of_box((x0 + 1000.0, y0, x1 + 1000.0, y1)), G.ring_of_box((x0 + w / 2, y0, x1 + w / 2, y1))
    hole = G.ring_of_box((x0 + w * 0.4, y0 + h * 0.4, x0 + w * 0.6, y0 + h * 0.6))
    part = lambda kind, *r: F.struct(F.lit(kind).alias("kind"), F.array(*r).alias("rings"))
    line, box = part("LineString", F.slice(ring, 1, 2)), part("Polygon", ring)
    parts = F.when(k == 0, F.array(box)).when(k == 1, F.array(line, box)).when(k == 2, F.array(box, part("Polygon", far))).when(k == 3, F.array(line)).when(k == 4, F.array(box, line, part("Polygon", half))).when(k == 5, F.array(line, part("Polygon", ring, hole)))
    kind = F.when(k == 0, "Polygon").when(k == 2, "MultiPolygon").when(k == 3, "LineString").otherwise("GeometryCollection")
    out = H.polygonal(structures.select("b_idx", kind.alias("kind"), parts.alias("parts")), "b_idx")
    return out.select("b_idx", F.coalesce(F.size("rings"), F.lit(0)).alias("rings"), rnd(rnd(F.col("area"), 7), 4).alias("area"))


UNITED = """WITH c AS (SELECT hint, x0, y0, x1, y1 FROM v_structure), xs AS (SELECT DISTINCT hint, x FROM (SELECT hint, x0 AS x FROM c UNION ALL SELECT hint, x1 FROM c)), ys AS (SELECT DISTINCT hint, y FROM (SELECT hint, y0 AS y FROM c UNION ALL SELECT hint, y1 FROM c)),
xi AS (SELECT hint, x, lead(x) OVER (PARTITION BY hint ORDER BY x) AS nx FROM xs), yi AS (SELECT hint, y, lead(y) OVER (PARTITION BY hint ORDER BY y) AS ny FROM ys)
SELECT xi.hint, floor(sum((nx - x) * (ny - y)) * 1000.0 + 0.5) / 1000.0 AS area FROM xi JOIN yi ON xi.hint = yi.hint WHERE nx IS NOT NULL AND ny IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.hint = xi.hint AND c.x0 <= x AND c.x1 >= nx AND c.y0 <= y AND c.y1 >= ny) GROUP BY xi.hint"""


@query(UNITED, "v_structure")
def union_area(spark: SparkSession, structures: DataFrame) -> DataFrame:
    """The footprints of each customer dissolved into one outline."""
    shapes = structures.select("hint", F.col("b_idx").alias("ord"), F.array(G.ring_of_box(G.box())).alias("rings"))
    return H.dissolve(shapes, "hint").select("hint", rnd(H.rings_area(F.col("rings")), 3).alias("area"))


@query(f"SELECT overall, count(*) AS parcels, count(*) FILTER (WHERE 'CONFLICT' IN (owner_status, area_status, id_status)) AS conflicts FROM ({PARCEL}) GROUP BY overall", "v_owner", "v_surveyed", "v_register")
def attribute_status_counts(spark: SparkSession, owner: DataFrame, parcels: DataFrame, register: DataFrame) -> DataFrame:
    bad = (F.col("owner_status") == "CONFLICT") | (F.col("area_status") == "CONFLICT") | (F.col("id_status") == "CONFLICT")
    return reconciled(owner, parcels, register).groupBy("overall").agg(F.count(F.lit(1)).alias("parcels"), F.count_if(bad).alias("conflicts"))


@query(f"SELECT count(*) AS parcels, count(*) FILTER (WHERE verdict IN ('MATCHED', 'PROBABLE')) AS matched, count(*) FILTER (WHERE verdict = 'UNMATCHED') AS unmatched FROM ({SCORES})", "v_parcel", "v_candidate", "v_survey")
def matching_counts(spark: SparkSession, parcels: DataFrame, candidates: DataFrame, survey: DataFrame) -> DataFrame:
    v = F.col("verdict")
    return matches(parcels, candidates, survey).agg(F.count(F.lit(1)).alias("parcels"), F.count_if(v.isin("MATCHED", "PROBABLE")).alias("matched"), F.count_if(v == "UNMATCHED").alias("unmatched"))


@query("SELECT parcel_id AS id, land_use, CAST(NULL AS BIGINT) AS size, ward FROM v_parcel UNION ALL SELECT parcel_id, land_use, size, NULL FROM v_epoch1", "v_parcel", "v_epoch1")
def column_union(spark: SparkSession, parcels: DataFrame, epoch: DataFrame) -> DataFrame:
    one = parcels.select(F.col("parcel_id").alias("id"), "land_use", F.col("ward"))
    return I.union_by_first(one, epoch.select(F.col("parcel_id").alias("id"), "land_use", F.col("size").cast("long").alias("size")))


@query(f"SELECT c.idx, {s_rnd('(p.x0 + p.x1) / 2', 4)} AS x, {s_rnd('(p.y0 + p.y1) / 2', 4)} AS y FROM v_conflict c JOIN v_parcel p ON p.idx = c.parcel_ref", "v_conflict", "v_parcel")
def conflict_points(spark: SparkSession, conflicts: DataFrame, parcels: DataFrame) -> DataFrame:
    at = parcels.select(F.col("idx").alias("parcel_ref"), rnd((F.col("x0") + F.col("x1")) / 2, 4).alias("x"), rnd((F.col("y0") + F.col("y1")) / 2, 4).alias("y"))
    return conflicts.select("idx", "parcel_ref").join(at, "parcel_ref").select("idx", "x", "y")


@query("SELECT idx, severity FROM v_conflict WHERE status = 'OPEN' AND (contains(lower(id), '7') OR contains(lower(conflict_type), '7')) AND contains(conflict_type, 'road')", "v_conflict")
def conflict_search(spark: SparkSession, conflicts: DataFrame) -> DataFrame:
    """Open conflicts of roads that have what was typed in one of their fields."""
    typed = F.greatest(*[F.instr(F.lower(F.col(c)), "7") for c in ("id", "conflict_type")]) > 0
    return conflicts.filter((F.col("status") == "OPEN") & typed & (F.instr("conflict_type", "road") > 0)).select("idx", "severity")


@query("SELECT idx, CASE WHEN ward IS NULL OR ward = 0 THEN 14 ELSE ward END AS ward, CASE WHEN coalesce(land_use, '') = '' THEN 'Unclassified' ELSE land_use END AS land_use, CASE WHEN balance IS NULL OR balance = 0 THEN 50.0 ELSE balance END AS score FROM v_parcel", "v_parcel")
def feature_defaults(spark: SparkSession, parcels: DataFrame) -> DataFrame:
    """Features for a map: what is null, empty or 0 takes the default."""
    from landloom.functions.num import first_truthy

    return parcels.select("idx", F.coalesce(first_truthy(F.col("ward")), F.lit(14)).alias("ward"), F.coalesce(first_truthy(F.col("land_use")), F.lit("Unclassified")).alias("land_use"), F.coalesce(first_truthy(F.col("balance")), F.lit(50.0)).alias("score"))


@query("SELECT pick, CAST(min(idx) AS BIGINT) AS idx FROM (SELECT s.obs_idx AS pick, p.idx FROM v_survey s JOIN v_parcel p ON abs((p.x0 + p.x1) / 2 - s.x) <= 18.0 AND abs((p.y0 + p.y1) / 2 - s.y) <= 18.0 AND sqrt(power((p.x0 + p.x1) / 2 - s.x, 2) + power((p.y0 + p.y1) / 2 - s.y, 2)) < 18.0) GROUP BY pick", "v_survey", "v_parcel")
def hover_pick(spark: SparkSession, survey: DataFrame, parcels: DataFrame) -> DataFrame:
    """The first parcel whose centre lies within 18 units of a point."""
    spots = survey.select(F.col("obs_idx").alias("pick"), "x", "y")
    centres = parcels.select("idx", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    return H.first_within(spots, centres, 18.0)


@query("SELECT seq, col, row, CAST(col * 26.0 AS DOUBLE) AS x0, CAST(row * 22.0 AS DOUBLE) AS y0 FROM (SELECT i AS seq, i % 40 AS col, i // 40 AS row FROM range(0, (SELECT count(*) FROM customer)) t(i)) WHERE col % 8 <> 7 AND row % 5 <> 4", "customer")
def grid_enumeration(spark: SparkSession, customers: DataFrame) -> DataFrame:
    """The cells of a ward of 40 columns and a row for each 40 customers, without roads."""
    rows = -(-customers.count() // 40)
    return I.grid(spark, 40, rows, 26.0, 22.0, 8, 5).filter(F.col("seq") < customers.count()).select("seq", "col", "row", "x0", "y0")


@query("SELECT corner, min(x) AS min_x, min(y) AS min_y, max(x) AS max_x, max(y) AS max_y FROM v_survey GROUP BY corner", "v_survey")
def layer_bounds(spark: SparkSession, survey: DataFrame) -> DataFrame:
    return survey.groupBy("corner").agg(F.min("x").alias("min_x"), F.min("y").alias("min_y"), F.max("x").alias("max_x"), F.max("y").alias("max_y"))


@query(
    f"""SELECT b_idx, idx, {s_rnd('d', 4)} AS distance FROM (SELECT a.b_idx, b.cand_idx AS idx, {GAP} AS d, row_number() OVER (PARTITION BY a.b_idx ORDER BY {GAP}, b.cand_idx) AS rn FROM (SELECT *, FALSE AS f FROM v_structure WHERE b_idx % 10 = 1) a CROSS JOIN v_candidate b) WHERE rn = 1""",
    "v_structure", "v_candidate",
)
def gap_nearest(spark: SparkSession, structures: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each part of a gap (here the footprints of one kind) the nearest outline, ties to the first."""
    parts = structures.filter("b_idx % 10 = 1").select(F.col("b_idx").alias("a_id"), *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    outlines = candidates.select(F.col("cand_idx").alias("b_id"), *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    return H.nearest_box(parts, outlines).select(F.col("a_id").alias("b_idx"), F.col("b_id").alias("idx"), rnd(F.col("distance"), 4).alias("distance"))


FUSED = """WITH m AS (SELECT p.idx, p.x0, p.y0, p.x1, p.y1, CASE WHEN o / (pa + ca - o) >= 0.30 THEN TRUE ELSE FALSE END AS fuse, c.x0 AS u0, c.y0 AS v0, c.x1 AS u1, c.y1 AS v1 FROM v_parcel p LEFT JOIN v_candidate c ON c.cand_idx = p.idx, LATERAL (SELECT (p.x1 - p.x0) * (p.y1 - p.y0) AS pa, (c.x1 - c.x0) * (c.y1 - c.y0) AS ca, greatest(least(p.x1, c.x1) - greatest(p.x0, c.x0), 0.0) * greatest(least(p.y1, c.y1) - greatest(p.y0, c.y0), 0.0) AS o)),
r AS (SELECT idx, x0, y0, x1, y1, TRUE AS plus FROM m UNION ALL SELECT idx, u0, v0, u1, v1, TRUE FROM m WHERE fuse UNION ALL SELECT m.idx, k.x0, k.y0, k.x1, k.y1, FALSE FROM m JOIN v_corridor k ON k.x0 <= greatest(m.x1, coalesce(m.u1, m.x1)) AND k.x1 >= least(m.x0, coalesce(m.u0, m.x0)) AND k.y0 <= greatest(m.y1, coalesce(m.v1, m.y1)) AND k.y1 >= least(m.y0, coalesce(m.v0, m.y0))),
xi AS (SELECT idx, x, lead(x) OVER (PARTITION BY idx ORDER BY x) AS nx FROM (SELECT DISTINCT idx, x FROM (SELECT idx, x0 AS x FROM r UNION ALL SELECT idx, x1 FROM r))), yi AS (SELECT idx, y, lead(y) OVER (PARTITION BY idx ORDER BY y) AS ny FROM (SELECT DISTINCT idx, y FROM (SELECT idx, y0 AS y FROM r UNION ALL SELECT idx, y1 FROM r))),
g AS (SELECT xi.idx, sum(CASE WHEN EXISTS (SELECT 1 FROM r WHERE r.idx = xi.idx AND plus AND r.x0 <= x AND r.x1 >= nx AND r.y0 <= y AND r.y1 >= ny) AND NOT EXISTS (SELECT 1 FROM r WHERE r.idx = xi.idx AND NOT plus AND r.x0 <= x AND r.x1 >= nx AND r.y0 <= y AND r.y1 >= ny) THEN (nx - x) * (ny - y) ELSE 0 END) AS a FROM xi JOIN yi ON xi.idx = yi.idx WHERE nx IS NOT NULL AND ny IS NOT NULL GROUP BY xi.idx)
SELECT m.idx, coalesce(m.fuse, FALSE) AS fused, floor(floor((x1 - x0) * (y1 - y0) * 1000000.0 + 0.5) / 1000000.0 * 100.0 + 0.5) / 100.0 AS before_sqm, floor(floor(g.a * 1000000.0 + 0.5) / 1000000.0 * 100.0 + 0.5) / 100.0 AS after_sqm FROM m JOIN g ON g.idx = m.idx"""


@query(FUSED, "v_parcel", "v_candidate", "v_corridor")
def harmonize_parcel(spark: SparkSession, parcels: DataFrame, candidates: DataFrame, corridors: DataFrame) -> DataFrame:
    """Legacy outlines united with modern ones that agree well enough, less corridors: areas before and after."""
    shape = lambda df, idx: df.select(F.col(idx).alias("idx"), F.array(G.ring_of_box(G.box())).alias("rings"))
    zones = corridors.select(F.col("c_idx").alias("ord"), F.array(G.ring_of_box(G.box())).alias("rings"), "x0", "y0", "x1", "y1")
    out = H.harmonise(shape(parcels, "idx"), shape(candidates, "cand_idx"), None, zones)
    return out.select("idx", "fused", "before_sqm", "after_sqm")
