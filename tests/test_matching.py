"""What tasks hold while candidates are matched and splines are fitted."""

import random
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from landloom.functions import kernel as K
from landloom.operators import matching as M
from landloom.operators import spatial as S


def test_boxes_are_expanded_by_tasks_of_bounded_rows(spark, monkeypatch):
    seen = []

    def looked(a, b, *args, **kwargs):
        seen.extend(df.rdd.getNumPartitions() for df in (a, b))
        return S.grid_join(a, b, *args, **kwargs)

    monkeypatch.setattr(M, "grid_join", looked)
    monkeypatch.setattr(M, "TASK_ROWS", 20, raising=False)
    boxes = lambda p: [(F.col("id") % 20 * 26.0).alias(f"{p}x0"), (F.floor(F.col("id") / 20) * 22.0).alias(f"{p}y0"), (F.col("id") % 20 * 26.0 + 24).alias(f"{p}x1"), (F.floor(F.col("id") / 20) * 22.0 + 20).alias(f"{p}y1")]
    ids = spark.range(400).coalesce(1)
    legacy = ids.select(F.col("id").alias("a_idx"), *boxes("a_"))
    out = M.best_matches(legacy, ids.select(F.col("id").alias("b_order"), F.lit(None).cast("double").alias("b_distance"), *boxes("b_"))).collect()
    assert len(out) == 400 and all(r.a_idx == r.b_order and r.iou == 1 for r in out)
    assert min(seen) >= 20


def test_nearest_within_broadcasts_no_expanded_rows(spark, tmp_path):
    rng = random.Random(2)
    at = lambda n: [(i, rng.uniform(-30, 30), rng.uniform(-30, 30)) for i in range(n)]
    left, points = [*at(150), (900, 0.0, 0.0), (901, -12.0, 24.0)], [*at(300), (950, 3.0, 0.0), (951, -12.0, 21.0), (952, -15.0, 24.0)]
    for name, rows, p in (("left", left, "a_id long, a_x double, a_y double"), ("points", points, "b_order long, b_x double, b_y double")):
        spark.createDataFrame(rows, p).write.parquet(f"{tmp_path}/{name}")
    df = S.nearest_within(spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/points"), 3.0)
    want = {}
    for i, x, y in left:
        d, j = min((((x - u) ** 2 + (y - v) ** 2) ** 0.5, j) for j, u, v in points)
        if d <= 3.0:
            want[i] = (j, round(d, 9))
    assert {r.a_id: (r.b.b_order, round(r.distance, 9)) for r in df.collect()} == want and 900 in want and 901 in want
    assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_spline_holds_one_system():
    """Beside its system a spline holds some rows of distances; what the solver copies is not counted here."""
    n = 1500
    s = np.random.default_rng(3).uniform(0, 900, (n, 2))
    t = s + np.sin(s / 50)
    tracemalloc.start()
    try:
        _, warp = K.thin_plate(s, t)
        off = warp(s) - t
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert np.abs(off).max() < 1e-3 and most < 2.5 * 8 * n * n
