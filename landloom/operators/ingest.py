"""Taking in files and layers: dispatch by extension, ingest records, reference systems, corridors, survey observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from landloom.functions import proj as P
from landloom.functions.num import first_truthy

#: Extension, capability, kind of geometry, media type, and whether a reader is bundled.
FORMATS = (
    (".geojson", "native", "vector", "application/geo+json", True), (".json", "native", "vector", "application/json", True), (".gpkg", "native", "vector", "application/geopackage+sqlite3", True),
    (".shp", "native", "vector", "application/octet-stream", True), (".csv", "native", "table", "text/csv", True), (".tsv", "native", "table", "text/tab-separated-values", True),
    (".tif", "native", "raster", "image/tiff", True), (".tiff", "native", "raster", "image/tiff", True), (".las", "native-header", "point", "application/octet-stream", True),
    (".laz", "adapter-ready", "point", "application/octet-stream", False), (".gml", "adapter-ready", "vector", "application/octet-stream", False), (".dxf", "adapter-ready", "vector", "application/octet-stream", False),
    (".kml", "adapter-ready", "vector", "application/octet-stream", False), (".xlsx", "adapter-ready", "table", "application/octet-stream", False), (".zip", "adapter-ready", "package", "application/octet-stream", False),
)
#: Reference systems that projects use: code, label, geographic or not, unit.
SYSTEMS = (
    (32643, "WGS 84 / UTM zone 43N", False, "metre"), (32644, "WGS 84 / UTM zone 44N", False, "metre"), (32743, "WGS 84 / UTM zone 43S", False, "metre"), (32642, "WGS 84 / UTM zone 42N", False, "metre"),
    (3857, "WGS 84 / Pseudo-Mercator", False, "metre"), (7755, "WGS 84 / India NSF LCC", False, "metre"), (24378, "Indian 1954 / UTM zone 43N", False, "metre"), (4326, "WGS 84", True, "degree"),
)
#: Systems put forward to an operator, in this order, with the reason.
HINTS = (
    (4326, "WGS 84 geographic", "carried explicitly in the file"), (32643, "WGS 84 / UTM 43N", "nearest UTM zone to the project extent"), (32644, "WGS 84 / UTM 44N", "adjacent UTM zone to the project extent"),
    (24378, "Indian 1954 / UTM zone 43N", "legacy Indian SOI topographic series"), (7755, "WGS 84 / India NSF LCC", "national projected grid"), (3857, "WGS 84 / Pseudo-Mercator", "web-mapping tiles"),
)
#: Widths of corridors around linear assets, in metres.
DRAIN_M, UTILITY_M = 3.0, 2.0


def formats(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FORMATS, "ext string, capability string, kind string, mime string, reader boolean")


def systems(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SYSTEMS, "code int, label string, geographic boolean, unit string")


def dispatch(files: DataFrame) -> DataFrame:
    """files (filename) with extension, capability, kind, mime and reader; unknown extensions wait for an adapter."""
    ext = F.lower(F.regexp_extract("filename", r"(\.[^./]*)$", 1))
    known = formats(files.sparkSession)
    out = files.withColumn("extension", ext).join(F.broadcast(known), F.col("extension") == known.ext, "left")  # a fixed table
    return out.select(
        *files.columns, "extension", F.coalesce("capability", F.lit("adapter-ready")).alias("capability"), F.coalesce("kind", F.lit("unknown")).alias("kind"),
        F.coalesce("mime", F.lit("application/octet-stream")).alias("mime"), F.coalesce("reader", F.lit(False)).alias("reader"),
    )


def human_size(n: Column) -> Column:
    """Bytes in B, KB, MB or GB, one decimal from KB on."""
    at = lambda p: F.concat(F.format_string("%.1f", n / float(1024**p)), F.lit((" B", " KB", " MB", " GB")[p]))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, at(1)).when(n < 1024**3, at(2)).otherwise(at(3))


def system_of(kind: Column, parsed: Column, located: Column) -> tuple[Column, Column]:
    """Reference system and how it was found, of files with header_crs, declared_crs and reach.

    A layer's header counts first, then a declaration of a known code. Coordinates are looked at only in tables with columns for them, and only
    where nothing was declared; a declared code that is unknown leaves the file without a system. A table without such columns needs none.
    """
    known = F.col("declared_crs").isin(*[c for c, *_ in SYSTEMS])
    declared = F.when(known, F.col("declared_crs"))
    guess = F.when(F.col("reach") > 180, 32643).when(F.col("reach") <= 90, 4326)
    layer, rows = (kind == "vector") & parsed, (kind == "table") & parsed
    head = layer & F.col("header_crs").isNotNull()
    code = F.when(head, F.col("header_crs")).when(rows & ~located, F.lit(None)).when(F.col("declared_crs").isNotNull(), declared).when(rows, guess)
    how = F.when(head, "detected").when(rows & ~located, "not_applicable").when(known, "declared").when(rows & F.col("declared_crs").isNull() & guess.isNotNull(), "inferred").otherwise("missing")
    return code.cast("int"), how


def ingest(files: DataFrame, categories: Sequence[str]) -> DataFrame:
    """One record a file: dispatch columns, accepted, upload_status, record_count, source_crs, crs_status, processing_status, size_human.

    files: filename, category_id, size_bytes, parse_ok, features, header_crs, declared_crs, reach (largest absolute coordinate of a table's
    coordinate columns, null without). A file of an unknown category is refused; one without a reader is stored and waits; one
    without a reference system (system_of) is blocked, tables without coordinates included.
    """
    out = dispatch(files)
    accepted = F.coalesce(F.col("category_id").isin(*categories), F.lit(False))
    parsed = F.col("reader") & F.coalesce("parse_ok", F.lit(False))
    upload = F.when(~accepted, "refused").when(~F.col("reader"), "stored_adapter_pending").when(parsed, "parsed").otherwise("parse_failed")
    code, how = system_of(F.col("kind"), parsed, F.col("reach").isNotNull())
    crs = F.when(accepted, code)
    return out.select(
        "*", accepted.alias("accepted"), upload.alias("upload_status"), F.when(upload == "parsed", F.col("features")).alias("record_count"), crs.alias("source_crs"), F.when(accepted, how).alias("crs_status"),
        F.when(~accepted, "refused").when(crs.isNotNull(), "crs_pending").otherwise("crs_blocked").alias("processing_status"), human_size(F.col("size_bytes")).alias("size_human"),
    )


def summary(df: DataFrame) -> DataFrame:
    """df without private columns (a leading underscore)."""
    return df.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")])


def adapted(records: DataFrame) -> DataFrame:
    """records with feature_count and effective_crs: the first of their fallbacks that says something (0 and '' don't)."""
    count = F.coalesce(first_truthy(F.col("record_count"), F.col("parse_features")), F.lit(0))
    return records.withColumn("feature_count", count.cast("long")).withColumn("effective_crs", first_truthy(F.col("source_crs"), F.col("effective"), F.col("detected")))


def compatibility(a: Column, b: Column, geographic_a: Column, geographic_b: Column) -> Column:
    """Whether two layers may be laid over each other: ok, warning, or error where degrees meet metres."""
    return F.when(a.isNull() | b.isNull(), "warning").when(a == b, "ok").when(geographic_a != geographic_b, "error").otherwise("warning")


def suggestions(spark: SparkSession, layers: DataFrame) -> DataFrame:
    """layers (id, reach) -> id, rank, code, label, why: the system that the coordinates suggest (4326 where they say nothing), then the other hints in their order."""
    reach = F.col("reach")
    metric, degrees = reach > 180, reach <= 90
    primary = F.when(metric, 32643).otherwise(4326)
    label = {c: x for c, x, *_ in SYSTEMS}
    far = F.format_string(f"Coordinates exceed geographic bounds (max |value| = %.1f); best-match projected CRS suggested: {label[32643]}. Operator confirmation required.", reach)
    why = F.when(metric, far).when(degrees, "All coordinates fall inside WGS 84 geographic bounds (|lat| <= 90).").otherwise("No coordinate reference system could be established.")
    item = lambda code, text, reason: F.struct(code.cast("int").alias("code"), text.alias("label"), reason.alias("why"))
    first = F.array(item(primary, F.when(metric, label[32643]).otherwise(label[4326]), why))
    rest = F.filter(F.array(*[item(F.lit(c), F.lit(x), F.lit(w)) for c, x, w in HINTS]), lambda h: h["code"] != primary)
    return layers.select("id", F.posexplode(F.concat(first, rest)).alias("rank", "x")).select("id", "rank", "x.code", "x.label", "x.why")


def alignment(layers: DataFrame, target: int = 32643) -> DataFrame:
    """layers (id, source_crs) -> id, action, target_crs: REPROJECTED, ALIGNED, or FAILED where the source is unknown."""
    known = F.col("source_crs").isin(*[c for c, *_ in SYSTEMS])
    action = F.when(~F.coalesce(known, F.lit(False)), "FAILED").when(F.col("source_crs") == target, "ALIGNED").otherwise("REPROJECTED")
    return layers.select("id", action.alias("action"), F.lit(target).alias("target_crs"))


def corridors(layer: DataFrame) -> DataFrame:
    """layer with conflict_type and width by its name: roads are areas already, drains and utilities are lines; others go.

    A width of the row itself (buffer_m, neither null nor 0) counts before the default.
    """
    name = F.lower(F.trim(F.coalesce("layer", F.lit(""))))
    has = lambda *words: F.greatest(*[F.instr(name, w) for w in words], F.lit(0)) > 0
    kind = F.when(has("road", "row"), "parcel_vs_road_row").when(has("drain"), "parcel_vs_drainage").when(has("util", "water", "power"), "parcel_vs_utility")
    own = F.when(F.col("buffer_m") != 0, F.col("buffer_m"))
    width = F.when(kind == "parcel_vs_road_row", 0.0).when(kind == "parcel_vs_drainage", F.coalesce(own, F.lit(DRAIN_M))).otherwise(F.coalesce(own, F.lit(UTILITY_M)))
    return layer.withColumn("conflict_type", kind).withColumn("width_m", width).filter(F.col("conflict_type").isNotNull())


def observations(rows: DataFrame, srid: int = 32643) -> DataFrame:
    """Survey rows (seq, obs_id, gt_id, easting, northing, lon, lat, rms, accuracy, method) in project coordinates: point_id, x, y, accuracy_m.

    Eastings are taken as they are, else longitudes are projected, else the row goes. Rows without an id are named by method and seq. Where rms is
    null or 0 the accuracy counts as it is, 0 too: the last of `a or b` is not judged.
    """
    east, north = P.transform(F.col("lon"), F.col("lat"), 4326, srid)
    grid, earth = F.col("easting").isNotNull() & F.col("northing").isNotNull(), F.col("lon").isNotNull() & F.col("lat").isNotNull()
    point = first_truthy(F.col("obs_id"), F.col("gt_id"), F.concat("method", F.lit("-"), F.col("seq").cast("string")))
    usable = rows.filter(grid | (earth & (F.abs("lat") < 90) & (F.abs("lon") <= 180)))
    out = usable.select("seq", point.alias("point_id"), F.when(grid, F.col("easting")).when(earth, east).alias("x"), F.when(grid, F.col("northing")).when(earth, north).alias("y"), F.coalesce(first_truthy(F.col("rms")), F.col("accuracy")).alias("accuracy_m"))
    return out


def union_by_first(*layers: DataFrame) -> DataFrame:
    """All rows; columns in the order in which they are first seen, null where a layer has none."""
    out = layers[0]
    for df in layers[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def grid(spark: SparkSession, columns: int, rows: int, width: float, height: float, road_columns: int, road_rows: int) -> DataFrame:
    """Cells of a ward without those that roads take (every road_columns-th column and road_rows-th row): seq, col, row, x0, y0, x1, y1."""
    cells = spark.range(columns * rows).select((F.col("id") % columns).alias("col"), F.floor(F.col("id") / columns).alias("row"), F.col("id").alias("seq"))
    free = cells.filter((F.col("col") % road_columns != road_columns - 1) & (F.col("row") % road_rows != road_rows - 1))
    return free.select("seq", "col", "row", (F.col("col") * width).alias("x0"), (F.col("row") * height).alias("y0"), (F.col("col") * width + width).alias("x1"), (F.col("row") * height + height).alias("y1"))
