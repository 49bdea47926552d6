"""Metamorphic and hand-made cases of the polygon kernel, the repair operators and the file formats."""

import json
import math
import random
import struct

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from landloom.functions import batch as B
from landloom.functions import kernel as K
from landloom.operators import repair as R
from landloom.operators import spatial as S
from landloom.sources import formats, generators, tables

SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)


def blob(seed):
    rng = random.Random(seed)
    n = rng.randint(3, 9)
    return np.array([(5 + rng.uniform(1, 5) * math.cos(2 * math.pi * i / n), 5 + rng.uniform(1, 5) * math.sin(2 * math.pi * i / n)) for i in range(n)])


@pytest.mark.parametrize("seed", range(25))
def test_overlay_laws(seed):
    a, b = [blob(seed)], [blob(seed + 100)]
    both, whole = K.overlap_area(a, b), K.area(K.union(a, b))
    assert math.isclose(whole + both, K.area(a) + K.area(b), rel_tol=1e-9)
    assert math.isclose(K.area(K.difference(a, b)), K.area(a) - both, rel_tol=1e-7, abs_tol=1e-9)
    assert math.isclose(K.area(K.symmetric_difference(a, b)), whole - both, rel_tol=1e-7, abs_tol=1e-9)
    assert math.isclose(K.iou(a, b), K.iou(b, a), rel_tol=1e-9)
    moved = [a[0] + 1000.0]
    assert math.isclose(K.area(moved), K.area(a), rel_tol=1e-9)
    assert math.isclose(K.area(K.intersection(a, b)), both, rel_tol=1e-7, abs_tol=1e-9)


def test_validity_and_buffers():
    bow = np.array([(0, 0), (4, 4), (4, 0), (0, 4)], float)
    assert K.is_valid(SQUARE) and not K.is_valid(bow) and not K.is_valid(SQUARE[:2])
    parts = K.make_valid(bow)
    assert math.isclose(sum(K.area([p]) for p in parts), 8.0) and all(K.is_valid(p) for p in parts)
    hole = [SQUARE, np.array([(1, 1), (2, 1), (2, 2), (1, 2)], float)]
    assert K.area(hole) == 15 and K.overlap_area(hole, [SQUARE]) == 15
    assert K.overlap_area([SQUARE], [SQUARE + [4, 0]]) == 0 and K.overlap_area([SQUARE], []) == 0
    line = K.buffer_line(np.array([(0, 0), (10, 0)]), 1.0)
    assert math.isclose(K.area(line), 20 + math.pi, rel_tol=0.01)
    assert math.isclose(K.area(K.shrink_convex(SQUARE, 0.5)), 9.0) and K.shrink_convex(SQUARE, 3.0) == []
    assert math.isclose(K.area([K.snap(SQUARE + 0.04, 0.15)]), 16, rel_tol=0.05)


def test_spline():
    rng = np.random.default_rng(0)
    s = rng.uniform(0, 100, (20, 2))
    t = s @ np.array([[1.01, 0.02], [-0.02, 0.99]]) + [5, -3]
    _, warp = K.thin_plate(s, t)
    assert np.allclose(warp(s), t, atol=1e-6)
    with pytest.raises(ValueError):
        K.thin_plate(s[:3], t[:3])


@pytest.mark.parametrize("held", [0, 1 << 24])
def test_spline_of_many_points(monkeypatch, held):
    """Without its system a spline is the same: of random points with noise, and of a strip of columns."""
    rng = np.random.default_rng(0)
    s = rng.uniform(0, 1000, (900, 2))
    u = np.arange(900) * 5
    t = np.column_stack([(u % 40) * 26.0 + u % 7 * 0.125, u // 40 * 22.0 + u % 3 * 0.125])
    strip = np.column_stack([t[:, 0] * 0.999 - t[:, 1] * 0.01 + np.sin(t[:, 1] / 50) * 0.3, t[:, 1] * 1.001 + t[:, 0] * 0.01])
    line = np.column_stack([np.arange(900.0), np.arange(900.0) * 2])
    for a, b in ((s, s * 1.01 + rng.normal(0, 0.3, (900, 2))), (strip, t)):
        monkeypatch.setattr(K, "DENSE", 3000)
        off = K.thin_plate(a, b)[1](a) - b
        monkeypatch.setattr(K, "DENSE", 100)
        monkeypatch.setattr(K, "HELD", held)
        solve, sizes = np.linalg.solve, []
        monkeypatch.setattr(np.linalg, "solve", lambda m, v: sizes.append(len(m)) or solve(m, v))  # noqa: B023
        assert np.allclose(K.thin_plate(a, b)[1](a) - b, off, atol=1e-7, rtol=0)
        assert max(sizes) <= 2 * K.LEAF
        monkeypatch.setattr(np.linalg, "solve", solve)
    with pytest.raises(np.linalg.LinAlgError):
        K.thin_plate(line, line)


def rings_df(spark, rows):
    pts = [(i, [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]) for i, rings in rows]
    return spark.createDataFrame(pts, f"idx long, rings {R.RINGS}")


def test_planarise(spark):
    rows = [(0, [SQUARE]), (1, [SQUARE + [3, 0]]), (2, [SQUARE + [6, 1]]), (3, [SQUARE * 0.5 + [0.5, 0.5]]), (4, [SQUARE + [50, 50]]), (5, [np.array([(80, 80), (84, 84), (84, 80), (80, 84)], float)])]
    out = {r.idx: r for r in R.planarise(rings_df(spark, rows)).collect()}
    shapes = {i: R.to_rings(r.rings) for i, r in out.items()}
    assert all(K.overlap_area(shapes[a], shapes[b]) <= R.NOISE for a in shapes for b in shapes if a < b)
    assert out[4].lost == 0 and out[5].repaired and math.isclose(K.area(shapes[5]), 8.0)
    whole = []
    for _, r in rows[:4]:
        whole = K.union(whole, r) if whole else r
    assert math.isclose(sum(K.area(shapes[i]) for i in range(4)), K.area(whole), rel_tol=1e-6)
    again = {r.idx: r.lost for r in R.planarise(rings_df(spark, list(shapes.items()))).collect()}
    assert all(abs(v) < 1e-6 for v in again.values())
    assert R.planarise(rings_df(spark, [])).count() == 0


def in_turn(shapes, passes):
    """Disputes of one component settled one after the other, largest first: shapes, disputes won, whether none is left."""
    common = lambda i, j: B.areas(B.packed([shapes[i]]), B.packed([shapes[j]]), B.BOTH)[0][0]
    shapes, size, won = dict(shapes), {i: B.area(B.packed([r]))[0] for i, r in shapes.items()}, dict.fromkeys(shapes, 0)
    for _ in range(passes):
        pairs = sorted((-s, i, j) for i in shapes for j in shapes if i < j and (s := common(i, j)) > R.NOISE)
        if not pairs:
            return shapes, won, True
        for _, i, j in pairs:
            loser, winner = (i, j) if size[i] <= size[j] else (j, i)
            if common(loser, winner) > 0:
                left = B.overlay(B.packed([shapes[loser]]), B.packed([shapes[winner]]), B.FIRST)
                left = B.only(left, B.area(left.single()) > R.HAIR)
                size[loser] = float(B.area(left)[0])
                shapes[loser] = B.unpacked(left)[0] if size[loser] > R.NOISE else []
                won[winner] += 1
    return shapes, won, False


@pytest.mark.parametrize("passes", [1, 12])
def test_components_together_as_alone(passes, monkeypatch):
    """Many components in one batch end as each by itself, bit by bit, with few overlays."""
    rng, rows, alone = np.random.default_rng(4), [], {}
    for label in range(12):
        turn = np.array([[np.cos(label), -np.sin(label)], [np.sin(label), np.cos(label)]])
        shapes = {100 * label + k: [(SQUARE * rng.uniform(0.5, 3, 2) + rng.uniform(0, 12, 2)) @ turn.T] for k in range(9)}
        shapes[100 * label + 9] = shapes[100 * label]  # a copy
        foes = {i: [j for j in shapes if i < j and B.areas(B.packed([shapes[i]]), B.packed([shapes[j]]), B.BOTH)[0][0] > R.NOISE] for i in shapes}
        rows += [(label, i, r, foes[i]) for i, r in shapes.items()]
        alone[label] = in_turn(shapes, passes)
    part = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows]), B.packed([r[2] for r in rows]).arrow(), pa.array([False] * len(rows)), pa.array([r[3] for r in rows], pa.list_(pa.int64()))], names=["label", "idx", "rings", "repaired", "foes"])
    calls, plain = [], B.overlay
    monkeypatch.setattr(B, "overlay", lambda *a, **k: calls.append(1) or plain(*a, **k))
    (idx, rings, _, _, won, calm) = next(R.settle(part, passes))
    assert len(calls) < sum(sum(w.values()) for _, w, _ in alone.values()) / 4
    for i, r, w, c in zip(idx.to_pylist(), B.unpacked(B.Shapes.of(rings)), won.tolist(), calm.tolist(), strict=True):
        shapes, most, settled = alone[i // 100]
        assert len(r) == len(shapes[i]) and all(np.array_equal(p, q) for p, q in zip(r, shapes[i], strict=True)) and (w, c) == (most[i], settled)


def test_conflate_in_order(spark):
    parcels = rings_df(spark, [(0, [SQUARE]), (1, [SQUARE + 100])])
    own = [(0, 1, SQUARE * 0.5 + [2.8, 1]), (0, 2, SQUARE * 0.5 + [1, 1]), (0, 3, SQUARE + [3, 3])]
    df = spark.createDataFrame([(i, o, [[{"x": float(x), "y": float(y)} for x, y in r]]) for i, o, r in own], f"idx long, ord long, rings {R.RINGS}")
    got = {r.idx: (r.included, round(r.added, 6)) for r in R.conflate(parcels, df).collect()}
    assert got == {0: (2, 1.6), 1: (0, 0.0)}


def test_groups(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 51)], "a long, b long")
    assert {r.node: r.label for r in R.groups(edges).collect()} == {i: 0 for i in range(31)} | {50: 50, 51: 50}


def test_georeference_states(spark):
    rows = [("a", float(i % 4), float(i // 4), float(i % 4) + 1, float(i // 4) + 2) for i in range(12)] + [("b", 0.0, 0.0, 1.0, 1.0), ("b", None, 1.0, 1.0, 1.0)]
    got = {r.sheet: (r.status, r.points) for r in R.georeference(spark.createDataFrame(rows, "sheet string, sx double, sy double, tx double, ty double")).collect()}
    assert got == {"a": ("SUCCESS", 12), "b": ("SKIPPED", 1)}


def test_nearest_and_pairs(spark):
    rng = random.Random(3)
    pts = [(i, rng.uniform(0, 500), rng.uniform(0, 500)) for i in range(60)] + [(60, 9000.0, 9000.0)]
    left = [(i, rng.uniform(-200, 700), rng.uniform(-200, 700)) for i in range(40)]
    got = {r.a_id: (r.b.b_order, r.distance) for r in S.nearest(spark.createDataFrame(left, "a_id long, a_x double, a_y double"), spark.createDataFrame(pts, "b_order long, b_x double, b_y double"), 8.0).collect()}
    for i, x, y in left:
        d, k = min((math.hypot(x - p, y - q), j) for j, p, q in pts)
        assert got[i][0] == k and math.isclose(got[i][1], d)


def test_defects_of_the_cadastre(spark):
    n = {r.defect: r.n for r in generators.cadastre(spark).groupBy("defect").agg(F.count("*").alias("n")).collect()}
    assert n["sliver"] >= 1 and n["bow_tie"] >= 1 and n["overlap"] >= 1 and "gap" not in n


def test_formats(spark, tmp_path):
    feature = {"type": "Feature", "properties": {"id": "7"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}
    multi = {"type": "Feature", "properties": {"id": None}, "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [2, 0], [2, 2], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}}
    (tmp_path / "a.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, multi, {"type": "Feature", "properties": {}, "geometry": None}]}))
    got = formats.read_geojson(spark, str(tmp_path / "a.geojson")).orderBy("fid").collect()
    assert [len(r.rings) if r.rings else None for r in got] == [1, 2, None] and got[0].properties["id"] == "7"
    with pytest.raises(ValueError):
        formats.write_gpkg([], "x", 4326)
    (tmp_path / "t.csv").write_bytes("﻿Owner,Area\nA,12\n,x\n".encode())
    t = tables.read_table(spark, str(tmp_path / "t.csv"))
    assert t.columns == ["Owner", "Area"] and tables.numeric_ratio(t).first()["cells"] == 4
    (tmp_path / "t.tsv").write_text("a\tb\n1\t2\n")
    assert tables.read_table(spark, str(tmp_path / "t.tsv")).columns == ["a", "b"]
    las = bytearray(400)
    las[:4], las[24], las[25], las[104] = b"LASF", 1, 2, 3
    struct.pack_into("<I", las, 107, 1234)
    struct.pack_into("<6d", las, 131, 0.01, 0.01, 0.01, 5.0, 6.0, 7.0)
    df = spark.createDataFrame([("a.las", las), ("b.las", bytearray(b"nope"))], "path string, content binary")
    a, b = formats.las_headers(df).orderBy("path").collect()
    assert (a.ok, a.version, a.point_format, a.points, a.scale_offset) == (True, "1.2", 3, 1234, [0.01, 0.01, 0.01, 5.0, 6.0, 7.0]) and not b.ok


def test_sinks(spark, tmp_path):
    from landloom.sources import sinks

    df = rings_df(spark, [(1, [SQUARE]), (2, [SQUARE + 9])])
    sinks.export(df, "csv", str(tmp_path / "c"))
    assert any(p.read_bytes().startswith("﻿idx".encode()) for p in (tmp_path / "c").glob("part-*"))
    sinks.export(df, "geojson", str(tmp_path / "g"))
    assert sum(len(p.read_text().splitlines()) for p in (tmp_path / "g").glob("part-*")) == 2
    sinks.export(df, "gpkg", str(tmp_path / "a.gpkg"))
    back = formats.read_gpkg(formats.files(spark, str(tmp_path / "a.gpkg"))).orderBy("fid").collect()
    assert [len(r.rings[0]) for r in back] == [5, 5] and back[0].srid == 32643
    for kind in ("kml", "xyz", "pdf"):
        with pytest.raises(sinks.Refused):
            sinks.export(df, kind, str(tmp_path / "x"))
    assert sinks.text_pdf(sinks.report_lines({"parcel_id": "P(1)"}, [], [])).startswith(b"%PDF-1.4")


def test_gaps(spark):
    rows = rings_df(spark, [(1, [SQUARE]), (2, [SQUARE + [4, 0]])]).withColumn("x0", (F.col("idx") - 1) * 4.0).withColumn("x1", F.col("idx") * 4.0).withColumn("y0", F.lit(0.0)).withColumn("y1", F.lit(4.0))
    got = {(r.tx, r.ty): (round(r.gap_area, 6), r.kind) for r in R.gaps(rows, (0.0, 0.0, 16.0, 8.0), tile=8.0).collect()}
    assert got == {(0, 0): (32.0, "gap"), (1, 0): (64.0, "gap")}


def test_run_and_store(spark, tmp_path):
    from landloom.plans import harmonize as H
    from landloom.plans.formats import layers
    from landloom.plans.views import relation

    sf = "/root/testdata/sf0.001"
    own = layers(*[relation(spark, sf, v) for v in ("v_surveyed", "v_register", "v_candidate", "v_survey", "v_structure", "v_corridor", "customer")])
    for run_id in ("a", "b"):
        H.persist(H.run(own, run_id), str(tmp_path))
    assert H.latest_run(spark, str(tmp_path)) == "b"
    assert H.table(spark, str(tmp_path), "parcels", "a").count() == own.parcels.count()
    assert set(H.TABLES) == {p.name for p in tmp_path.iterdir()}
    own.datasets = relation(spark, sf, "v_dataset").withColumn("fill", F.col("fill").cast("double")).withColumn("parse_ok", F.lit(False))
    with pytest.raises(H.Blocked):
        H.run(own, "c")


def test_audit_stream(spark, tmp_path):
    from landloom.streaming import audit

    rows = [(str(i), "r", f"user{i % 2}", "review", "p", "ok", "{}", f"2024-01-01 10:{i:02d}:00") for i in range(30)]
    spark.createDataFrame(rows, audit.SCHEMA.replace("timestamp", "string")).withColumn("created_at", F.to_timestamp("created_at")).write.parquet(str(tmp_path / "in"))
    q = audit.activity(audit.trail(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("activity").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sum(r.n for r in spark.table("activity").collect()) == 30
    s = audit.to_store(audit.trail(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"))
    s.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 30
