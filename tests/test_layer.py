"""The shared-edge layer: areas against polygon algebra, shared corners, slivers, parts and gaps, whatever the tile."""

import numpy as np
import pytest

from landloom.functions import arrangement as A
from landloom.functions import batch as B
from landloom.functions import kernel as K
from landloom.operators import layer as L
from landloom.operators import repair as R


def box(a, b, c, d):
    return np.array([(a, b), (c, b), (c, d), (a, d)], float)


def turned(rings, angle=0.3):
    m = np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])
    return [r @ m.T for r in rings]


def frame(spark, shapes):
    return spark.createDataFrame([(i, R.from_rings(r)) for i, r in shapes.items()], f"idx long, rings {R.RINGS}")


def town(seed=1, nx=6, ny=5):
    """Turned boxes that overlap and leave gaps; some notched, some with a hole."""
    rng, out = np.random.default_rng(seed), {}
    for k in range(nx * ny):
        x, y = (k % nx) * 26 + rng.random() * 2, (k // nx) * 22 + rng.random() * 2
        w, h = 26 * rng.uniform(0.9, 1.06), 22 * rng.uniform(0.9, 1.04)
        rings = [box(x, y, x + w, y + h)]
        if k % 3 == 1:
            rings = [np.array([(x, y), (x + w, y), (x + w, y + h * 0.6), (x + w * 0.6, y + h * 0.6), (x + w * 0.6, y + h), (x, y + h)])]
        if k % 3 == 2:
            rings.append(box(x + w * 0.4, y + h * 0.4, x + w * 0.6, y + h * 0.6)[::-1])
        out[k] = turned(rings)
    return out


def grounds(rings):
    """Area of rings counted even-odd, holes the other way round."""
    return abs(sum(np.sum(r[:, 0] * np.roll(r[:, 1], -1) - r[:, 1] * np.roll(r[:, 0], -1)) for r in rings)) / 2


@pytest.mark.parametrize("seed", range(8))
def test_faces_against_polygon_algebra(seed):
    rng = np.random.default_rng(seed)
    shapes = [(k, turned([box(x, y, x + w, y + h)], t)) for k, (x, y, w, h, t) in enumerate(zip(*rng.uniform(0, 30, (2, 7)) + 30, *rng.uniform(2, 30, (2, 7)), rng.uniform(0, 0.5, 7), strict=True))]
    faces, edges, border = A.arrange(shapes, -100, -100, 200, 200)
    assert sum(a for _, a in faces) == pytest.approx(9e4)
    for k, r in shapes:
        assert sum(a for c, a in faces if k in c) == pytest.approx(K.area(r), abs=1e-6)
        for j, q in shapes[:k]:
            assert sum(a for c, a in faces if k in c and j in c) == pytest.approx(K.overlap_area(r, q), abs=1e-6)
    # Each face is the area that its directed edges and pieces of the border enclose.
    total = np.zeros(len(faces))
    for f, g, ax, ay, bx, by in edges:
        total[f] += (ax * by - bx * ay) / 2
        total[g] -= (ax * by - bx * ay) / 2
    for side, a, b, f in border:
        ax, ay, bx, by = {"x0": (-100, b, -100, a), "x1": (200, a, 200, b), "y0": (a, -100, b, -100), "y1": (b, 200, a, 200)}[side]
        total[f] += (ax * by - bx * ay) / 2
    assert total == pytest.approx([a for _, a in faces], abs=1e-5)


def test_corner_beside_the_tile():
    """A corner left of a tile may lie at the middle of a slab; the outline must be crossed there once all the same."""
    arrow = np.array([(-5, 0), (-2, 5), (-5, 10), (20, 10), (20, 0)], float)
    faces, _, _ = A.arrange([(1, [arrow])], 0, -10, 40, 30)
    assert dict(faces) == {(): pytest.approx(1400), (1,): pytest.approx(200)}


@pytest.mark.parametrize("tile", [64.0, 37.0])
def test_planar_town(spark, tile):
    shapes = town()
    out = L.planar_layer(frame(spark, shapes), snap=0.0, min_sliver=0.0, tile=tile)
    areas = {r.idx: r.area for r in out.areas().collect()}
    whole = shapes[0]
    for k in range(1, len(shapes)):
        whole = K.union(whole, shapes[k])
    lost = out.faces.filter("owner IS NULL AND size(cover) > 0").agg({"area": "sum"}).first()[0] or 0.0
    assert out.log["converged"] and sum(areas.values()) + lost == pytest.approx(K.area(whole), abs=1e-4)
    lined = {r.idx: R.to_rings(r.rings) for r in out.outlines().collect()}
    assert {k: pytest.approx(a, abs=1e-3) for k, a in areas.items()} == {k: grounds(r) for k, r in lined.items()}
    # Every corner of an outline that lies on a neighbour's outline is a corner of both or of one side's straight line only where no third meets.
    corners = {k: {tuple(p) for r in rings for p in r} for k, rings in lined.items()}
    for k, rings in lined.items():
        assert all(K.is_valid(r) for r in rings)
        for j in lined:
            if j > k:
                assert K.overlap_area(rings, lined[j]) < 1e-3
    for k, mine in corners.items():
        for j, rings in lined.items():
            if j != k:
                for p in mine - corners[j]:
                    assert not any(on_segment(p, a, b) for r in rings for a, b in zip(r, np.roll(r, -1, axis=0), strict=True))


def on_segment(p, a, b, tol=1e-5):
    d = b - a
    n = np.hypot(*d)
    t = ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / (n * n)
    return 1e-4 / n < t < 1 - 1e-4 / n and abs((p[0] - a[0]) * d[1] - (p[1] - a[1]) * d[0]) / n < tol


def test_largest_keeps_and_copies_go(spark):
    shapes = {1: [box(0, 0, 10, 10)], 2: [box(8, 0, 30, 10)], 3: [box(40, 0, 50, 10)], 4: [box(40, 0, 50, 10)], 5: [box(60, 0, 70, 10)[[0, 2, 1, 3]]], 6: [np.zeros((2, 2))]}
    out = L.planar_layer(frame(spark, shapes), snap=0.0)
    assert {r.idx: round(r.area, 6) for r in out.areas().collect()} == {1: 80.0, 2: 220.0, 4: 100.0, 5: 25.0}
    assert {k: out.log[k] for k in ("overlaps_resolved", "overlap_area_removed_sqm", "parcels_absorbed", "repaired_invalid", "features_dropped", "multi_parts_reduced")} == {"overlaps_resolved": 2, "overlap_area_removed_sqm": 120.0, "parcels_absorbed": 1, "repaired_invalid": 2, "features_dropped": 1, "multi_parts_reduced": 1}
    assert len(out.log) == 19


def test_chain_of_slivers(spark):
    """Slivers beside slivers go to a parcel together, the isolated one goes altogether; the area stays."""
    shapes = {0: [box(0, 0, 20, 20)], 9: [box(24, 0, 60, 20)], 99: [box(100, 100, 100.1, 101)]} | {k: [box(20 + (k - 1) * 0.05, 0, 20 + k * 0.05, 20)] for k in range(1, 9)} | {8: [box(20.35, 0, 24, 0.5)]}
    out = L.planar_layer(frame(spark, shapes), snap=0.0, min_sliver=2.0)
    areas = {r.idx: r.area for r in out.areas().collect()}
    assert set(areas) == {0, 9} and sum(areas.values()) == pytest.approx(400 + 720 + 7 + 1.825)
    assert out.log["slivers_dissolved"] == 9 and out.log["slivers_isolated"] == 1 and out.log["converged"]


@pytest.mark.parametrize("tile", [64.0, 128.0, 25.0])
def test_gaps_by_parts(spark, tile):
    """A gap over a border of tiles is judged whole; one of middle size goes to its neighbour, a large one is a record; what is excluded stays."""
    extent = spark.createDataFrame([(R.from_rings([box(0, 0, 200, 100)]),)], f"rings {R.RINGS}")
    road = spark.createDataFrame([(R.from_rings([box(90, 0, 100, 100)]),)], f"rings {R.RINGS}")
    shapes = {1: [box(0, 0, 61, 100)], 2: [box(67, 0, 90, 100)], 3: [box(61, 0, 67, 60)], 4: [box(61, 66.7, 67, 100)], 5: [box(100, 0, 200, 40)], 6: [box(100, 60, 200, 100)], 7: [box(100, 40, 100.1, 60)]}
    df = frame(spark, shapes)
    faces, edges = L.overlay(L.prepared(L.with_ground(df, extent, road), 0.0), tile)
    owned, _ = L.settled(faces.withColumn("cover", L.F.transform("cover", lambda k: L.F.greatest(k, L.F.lit(L.EXCLUDED)))))
    assert sorted((round(r.area, 6), r.kind) for r in L.gap_parts(owned, edges).collect()) == [(40.2, "gap"), (1998.0, "gap")]
    out = L.planar_layer(df, extent, road, snap=0.0, tile=tile)
    areas = {r.idx: round(r.area, 6) for r in out.areas().collect()}
    assert sum(areas.values()) == pytest.approx(200 * 100 - 1000) and out.gaps().count() == 0
    assert out.log["gaps_closed"] == 2 and out.log["parcels_created_from_gap"] == 1 and out.log["converged"]
    assert areas[2] == 2300.0 and areas[1] == pytest.approx(6100 + 40.2) and max(areas) >= L.CREATED


def test_empty(spark):
    out = L.planar_layer(spark.createDataFrame([], f"idx long, rings {R.RINGS}"))
    assert out.areas().count() == 0 and out.outlines().count() == 0 and out.log["converged"]


def crowd(seed):
    """Boxes, boxes with holes and bow ties, by seed turned or with corners on a grid that many share."""
    rng, out = np.random.default_rng(seed), []
    for k in range(seed * 7 % 25 if seed != 50 else 90):
        (x, y), (w, h) = rng.uniform(-20, 90, 2), rng.uniform(1, 30, 2)
        if seed % 2:
            x, y, w, h = round(x / 2) * 2, round(y / 2) * 2, round(w / 2) * 2 + 2, round(h / 2) * 2 + 2
        rings = [box(x, y, x + w, y + h)]
        if k % 3 == 2:
            rings.append(box(x + w * 0.4, y + h * 0.4, x + w * 0.6, y + h * 0.6)[::-1])
        out.append(turned([rings[0][[0, 2, 1, 3]]] if k % 5 == 4 else rings, 0.3 if seed % 3 else 0.0))
    return out


@pytest.mark.parametrize("most", [2_000_000, 5_000])
def test_tiles_together_as_alone(monkeypatch, most):
    """Many tiles in one pass, some of them in parts or crowded, give each tile's faces, edges and border bit by bit."""
    monkeypatch.setattr(B, "PAIRS", most)
    monkeypatch.setattr(B.parted, "__defaults__", (most,))
    towns = [crowd(k) for k in range(60)]
    tile = np.repeat(np.arange(60), [len(t) for t in towns])
    keys = 1000 * tile + np.arange(len(tile))
    faces, edges, border = ([[] for _ in towns] for _ in range(3))
    for a in A.arranged(B.packed([s for t in towns for s in t]), keys, tile, np.tile([0.0, 0.0, 64.0, 64.0], (60, 1))):
        for i, t in enumerate(a.tile.tolist()):
            faces[t].append((int(a.number[i]), tuple(a.cover[a.starts[i] : a.starts[i + 1]].tolist()), float(a.area[i])))
        for t, f, g, e in zip(*a.edges, strict=True):
            edges[t].append((int(f), int(g), *e.tolist()))
        for t, s, e, f in zip(*a.border, strict=True):
            border[t].append((A.SIDES[s], *e.tolist(), int(f)))
    for t, shapes in enumerate(towns):
        alone = A.arrange(list(zip(keys[tile == t].tolist(), shapes, strict=True)), 0.0, 0.0, 64.0, 64.0)
        assert sorted(faces[t]) == [(k, c, float(a)) for k, (c, a) in enumerate(alone[0])]
        assert sorted(edges[t]) == sorted((f, g, *map(float, e)) for f, g, *e in alone[1])
        assert sorted(border[t]) == sorted((s, float(a), float(b), f) for s, a, b, f in alone[2])


def test_outlines_together_as_alone():
    """Outlines of cells taken at random: holes, touching points and, in some, an edge that is missing."""
    rng, key, edges = np.random.default_rng(1), [], []
    for k in range(120):
        on = np.pad(rng.random((6, 6)) < (0.5 if k % 2 else 0.9), 1)
        mine = []
        for i, j in zip(*np.nonzero(on), strict=True):
            for (u, v), e in {(0, -1): (i, j, i + 1, j), (1, 0): (i + 1, j, i + 1, j + 1), (0, 1): (i + 1, j + 1, i, j + 1), (-1, 0): (i, j + 1, i, j)}.items():
                if not on[i + u, j + v]:
                    mine.append(e)
        mine = sorted(mine)[: -1 if k % 7 == 3 else None]
        key += [3 * k] * len(mine)
        edges += mine
    key, edges, plain = np.array(key), np.array(edges, float), rng.random(len(key)) < 0.7
    keys, rings = A.rings_walked(key, edges, plain)
    assert keys.tolist() == sorted(set(key.tolist()))
    for k, mine in zip(keys, B.unpacked(rings), strict=True):
        alone = A.walked(edges[key == k], plain[key == k])
        assert len(alone) == len(mine) and all(np.array_equal(a, b) for a, b in zip(alone, mine, strict=True))


def test_keys_stay_whole(spark):
    """Rows of a key come together whatever the batches of Arrow."""
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(300).selectExpr("id", "cast(sqrt(id) as long) as k")

        def look(part):
            k, n = np.unique(part["k"].to_numpy(), return_counts=True)
            yield [k, n]

        assert sorted(map(tuple, R.grouped(df, ["k"], look, "k long, n long", "id").collect())) == [(k, min(2 * k + 1, 300 - k * k)) for k in range(18)]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
