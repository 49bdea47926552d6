"""Hand-computed values of column functions."""

import math

from pyspark.sql import functions as F

from landloom.functions import geom as G
from landloom.functions import proj as P
from landloom.functions import text as T
from landloom.functions.num import coerce_number, first_truthy, rnd
from landloom.operators import attributes as A
from landloom.operators import matching as M


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_names(spark):
    v, e = F.lit("रमेश कुलकर्णी"), F.lit("Ramesh Kulkarni")
    assert one(spark, T.transliterate(v), T.phonetic_code(v), T.phonetic_code(e), T.name_score(v, e)) == ("RMESH KULKRNI", "R524", "R524", 0.9333)
    assert one(spark, T.name_score(F.lit("सुरेश पाटील"), F.lit("Suresh Patil")), T.phonetic_code(F.lit(" - "))) == (1.0, "Z000")


def test_identifiers(spark):
    r = one(spark, A.identifier_check(F.lit("204/3"), F.lit("204/3A")).alias("a"), A.identifier_check(F.lit("20-4"), F.lit("204")).alias("b"), A.identifier_check(F.lit(""), F.lit("1")).alias("c"))
    assert (r.a.status, r.a.confidence, r.b.status, r.c.status, r.c.confidence) == ("CONFLICT", 0.8, "MATCH", "MISSING", None)


def test_areas(spark):
    r = one(spark, A.area_check(F.lit(100.0), F.lit(103.5)).alias("a"), A.area_check(F.lit(100.0), F.lit(103.6)).alias("b"), A.area_check(F.lit(None).cast("double"), F.lit(1.0)).alias("c"))
    assert (r.a.status, r.b.status, r.c.status) == ("MATCH", "CONFLICT", "MISSING")


def test_numbers(spark):
    raw = ["1,23,456.7 sq.m", "-", "", "n/a", "१२.५", "-4 sqm"]
    df = spark.createDataFrame([(x,) for x in raw], "x string")
    assert [r[0] for r in df.select(coerce_number(F.col("x"))).collect()] == [123456.7, None, None, None, 12.5, -4.0]
    assert one(spark, first_truthy(F.lit(""), F.lit("0"), F.lit("x")), rnd(F.lit(1.23456), 3)) == ("x", 1.235)


def test_boxes(spark):
    box = lambda *v: tuple(map(F.lit, v))
    a, b = box(0.0, 0.0, 4.0, 3.0), box(2.0, 1.0, 6.0, 4.0)
    ra, rb = G.ring_of_box(a), G.ring_of_box(b)
    r = one(spark, G.box_overlap(a, b), G.box_iou(a, b), G.box_shift(a, b), G.ring_area(G.clip_convex(ra, rb)), G.convex_iou(ra, rb), G.compactness(F.lit(16.0), F.lit(16.0)), G.ring_centroid(ra))
    assert r[:3] == (4.0, 0.2, 2.2361) and math.isclose(r[3], 4.0) and math.isclose(r[4], 0.2) and r[5] == 16 and tuple(r[6]) == (2.0, 1.5)


def test_samples(spark):
    df = spark.range(1).select(G.ring_of_box(tuple(map(F.lit, (0.0, 0.0, 6.0, 6.0)))).alias("ring"))
    s = G.with_samples(df, "ring", "s", 24).first()["s"]
    assert [tuple(p) for p in s[:8]] == [(float(i), 0.0) for i in range(6)] + [(6.0, 0.0), (6.0, 1.0)]


def test_projection_round_trip(spark):
    df = spark.range(200).select((F.lit(72.2) + F.col("id") * 0.028).alias("lon"), (F.lit(-60.0) + F.col("id") * 0.6).alias("lat"))
    e, n = P.utm_forward(F.col("lon"), F.col("lat"), 43)
    back = df.select("lon", "lat", e.alias("e"), n.alias("n"))
    lon, lat = P.utm_inverse(F.col("e"), F.col("n"), 43)
    worst = back.select(F.max(F.abs(lon - F.col("lon"))), F.max(F.abs(lat - F.col("lat")))).first()
    assert max(worst) < 1e-8
    x, y = P.mercator_forward(F.lit(73.8), F.lit(18.5))
    assert one(spark, *P.mercator_inverse(x, y)) == (73.8, 18.5) or max(abs(a - b) for a, b in zip(one(spark, *P.mercator_inverse(x, y)), (73.8, 18.5))) < 1e-9


def test_scores(spark):
    c = A.confidence(F.lit(0.9), F.lit(0.9), F.lit(1.0), F.lit(100.0), F.lit(100.0), F.lit(0), F.lit(0.0))
    e = M.encroachment(F.lit(10.0), F.lit(40.0))
    r = one(spark, c.alias("c"), e.alias("e"), M.first_generation_score(F.lit(0.95), F.lit(0.02), F.lit(1.0), F.lit(0.90)))
    assert (r.c.overall, r.c.route, r.e.severity, r.e.confidence, r[2]) == (0.97, "AUTO_ACCEPTED", "HIGH", 0.85, 96.3)
    rows = spark.createDataFrame([(50.0, 0.0), (10.0, 0.0), (9.99, 0.049), (1.0, 0.25)], "a double, s double")
    assert [x[0] for x in rows.select(M.severity(F.col("a"), F.col("s"))).collect()] == ["HIGH", "MEDIUM", "LOW", "HIGH"]


def test_zeros_of_either_sign_are_falsy(spark):
    df = spark.createDataFrame([(0.0,), (-0.0,), (0.01,), (None,)], "v double")
    assert [r[0] for r in df.select(F.coalesce(first_truthy(F.col("v")), F.lit(50.0))).collect()] == [50.0, 50.0, 0.01, 50.0]
    assert [r[0] for r in df.select(F.coalesce(first_truthy(F.col("v").cast("decimal(9,2)")).cast("double"), F.lit(50.0))).collect()] == [50.0, 50.0, 0.01, 50.0]


def test_accuracy_of_zero_stays(spark):
    from landloom.operators.ingest import observations

    cols = "seq long, obs_id string, gt_id string, easting double, northing double, lon double, lat double, rms double, accuracy double, method string"
    rows = [(i, "o", None, 1.0, 2.0, None, None, rms, accuracy, "gnss") for i, (rms, accuracy) in enumerate([(None, 0.0), (0.5, 3.0), (0.0, 3.0), (0.0, 0.0), (None, None)])]
    assert [r[0] for r in observations(spark.createDataFrame(rows, cols)).orderBy("seq").select("accuracy_m").collect()] == [0.0, 0.5, 3.0, 0.0, None]


def test_far_parcels_lie_in_their_zone(spark):
    from landloom.plans import ingest

    far = spark.createDataFrame([(1, 0.0, 0.0), (2, 1000.0, 495_000.0), (3, 0.0, 3_000_000.0), (4, 0.0, 8_000_000.0)], "idx long, x0 double, y0 double")
    got = ingest.wgs84_storage(spark, far).orderBy("idx").collect()
    assert [(r.x, r.y, r.inside) for r in got[:3]] == [(370000.0, 2050000.0, True), (371000.0, 2545000.0, True), (370000.0, 5050000.0, True)] and not got[3].inside
