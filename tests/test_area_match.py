"""The best candidate by area and support against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from landloom.operators import area_match as A
from landloom.operators import spatial


def brute(areas, candidates):
    out = {}
    for a in areas:
        best = min((-float(A.value(np.array([a]), np.array([x]), s)[0]), o) for x, s, o in candidates)
        out[a] = (best[1], -best[0])
    return out


@pytest.mark.parametrize("supports", [[0.0], [0.0, 0.0, 0.0, 0.3, 0.334, 1.0], [i / 3000 for i in range(200)]])
def test_all_pairs(spark, monkeypatch, supports):
    monkeypatch.setattr(A, "A_RANGE", 40)  # several ranges of area
    rng = random.Random(len(supports))
    candidates = [(rng.choice([0.0, 1e-3, 50.0, rng.uniform(90, 110), rng.uniform(1, 1000), 10 ** rng.uniform(-2, 7)]), rng.choice(supports), o) for o in rng.sample(range(10_000), 700)]
    areas = [0.0, 1e-9, 1e12] + [rng.choice([c[0] for c in candidates]) * rng.choice([1, 1.00003, 0.9]) for _ in range(150)] + [10 ** rng.uniform(-2, 7) for _ in range(150)]
    rows = spark.createDataFrame([(x,) for x in areas + areas[:50]], "a_area double")
    got = A.best_by_area(rows, spark.createDataFrame(candidates, "b_area double, b_support double, b_order long"))
    assert {r.a_area: (r.b_order, r.value) for r in got.collect()} == brute(set(areas), candidates)


def test_no_candidates(spark):
    rows = spark.createDataFrame([(1.0,)], "a_area double")
    assert A.best_by_area(rows, spark.createDataFrame([], "b_area double, b_support double, b_order long")).count() == 0


def test_within_reach(spark):
    """Boxes of very different sizes, one over the whole layer, thin ones and points."""
    rng = random.Random(9)

    def boxes(n):
        out = [(0, -50.0, -50.0, 4000.0, 4000.0), (1, 10.0, 10.0, 10.0, 10.0), (2, 0.0, 500.0, 3000.0, 500.5)]
        for i in range(3, n):
            x, y, w, h = rng.uniform(-20, 900), rng.uniform(-20, 900), 2 ** rng.uniform(-3, 6), 2 ** rng.uniform(-3, 6)
            out.append((i, x, y, x + w, y + h))
        return out

    left, right = boxes(120), boxes(150)
    area = lambda r: (r[3] - r[1]) * (r[4] - r[2])
    want = set()
    for a in left:
        for b in right:
            reach = max(area(a), area(b)) ** 0.5
            if a[1] - reach <= b[3] and b[1] - reach <= a[3] and a[2] - reach <= b[4] and b[2] - reach <= a[4]:
                want.add((a[0], b[0]))
    frame = lambda rows, p: spark.createDataFrame(rows, f"{p}id long, {p}x0 double, {p}y0 double, {p}x1 double, {p}y1 double")
    side = lambda p: F.sqrt((F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0")))
    got = [(r.a_id, r.b_id) for r in spatial.within_reach(frame(left, "a_"), frame(right, "b_"), side("a_"), side("b_")).collect()]
    assert len(got) == len(set(got)) and set(got) == want
