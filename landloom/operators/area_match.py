"""The best candidate of a row by area and survey support alone, without a distance limit and without meeting all candidates.

The value of a pair, 0.18 x likeness of areas + 0.10 x support, depends on three numbers of a candidate: area, support, place in the
order. Candidates of equal area and support are one (the first); one whose support is so much lower than that of a candidate of about its
area that it loses for every row is left out, by cells of the logarithm of the area. What remains is cut into ranges of area; a row
visits the ranges that can hold its best by bounds on likeness and support. Within a range and one support the value falls with the
distance in area on both sides, so the best is a neighbour in sorted order, and all that equal it after rounding are one run, whose
first candidate a table of minima gives.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from landloom.operators.cut import cut

LIKE, SUPPORT = 0.18, 0.10
WIDTH = 0.02  # of a cell of ln(area)
REACH = math.ceil(-math.log(1 - SUPPORT / LIKE) / WIDTH) + 1  # cells beyond which full support can't make up for unlike areas
SLACK = 3e-4  # likeness and value are rounded to four places
A_RANGE, RANGES = 20_000, 1024


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smaller area by larger, 4 places; 0 where neither is positive."""
    small, large = np.minimum(a, b), np.maximum(a, b)
    return np.floor(np.divide(small, large, out=np.zeros(np.broadcast(a, b).shape), where=large > 0) * 1e4 + 0.5) / 1e4


def value(a: np.ndarray, b: np.ndarray, support: np.ndarray | float) -> np.ndarray:
    return np.floor((likeness(a, b) * LIKE + support * SUPPORT) * 1e4 + 0.5) / 1e4


def undominated(candidates: DataFrame) -> DataFrame:
    """area, support, first of the candidates (b_area, b_support, b_order) that are best for some row."""
    rows = cut(candidates.groupBy(F.col("b_area").alias("area"), F.col("b_support").alias("support")).agg(F.min("b_order").alias("first")))
    cell = F.when(F.col("area") > 0, F.floor(F.log("area") / WIDTH).cast("int"))
    top = rows.filter("area > 0").groupBy(cell.alias("of")).agg(F.max("support").alias("high"))
    # At most the cells of all doubles; what the best of a cell is sure to give a candidate of another cell.
    near = top.select(F.explode(F.sequence(F.col("of") - REACH, F.col("of") + REACH)).alias("cell"), (F.col("high") * SUPPORT - LIKE * (1 - F.exp(-WIDTH * (F.abs(F.col("cell") - F.col("of")) + 1)))).alias("sure"))
    sure = near.groupBy("cell").agg(F.max("sure").alias("sure"))
    rows = rows.withColumn("cell", cell).join(sure, "cell", "left")
    return rows.filter(F.col("sure").isNull() | (F.col("support") * SUPPORT + SLACK >= F.col("sure"))).select("area", "support", "first")


def first_in_runs(order: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """The minimum of order[lo:hi] for many non-empty runs, by a table of minima of 2^k neighbours."""
    table = [order]
    while 2 << (len(table) - 1) <= len(order):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    k = np.frompyfunc(lambda n: int(n).bit_length() - 1, 1, 1)(hi - lo).astype(int)
    out = np.empty(len(lo), order.dtype)
    for j in np.unique(k):
        m = k == j
        out[m] = np.minimum(table[j][lo[m]], table[j][hi[m] - (1 << j)])
    return out


def best_in_range(a: np.ndarray, area: np.ndarray, support: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each area of a the largest value among the candidates of a range, and the first candidate that has it."""
    turn = np.lexsort((area, support))
    area, support, first = area[turn], support[turn], first[turn]
    starts = np.flatnonzero(np.r_[True, support[1:] != support[:-1]])
    top, who = np.full(len(a), -1.0), np.zeros(len(a), np.int64)
    for s, e in zip(starts, np.r_[starts[1:], len(area)], strict=True):
        x, order, level = area[s:e], first[s:e], support[s]
        at = np.searchsorted(x, a)
        left, right = np.maximum(at - 1, 0), np.minimum(at, len(x) - 1)
        here = np.maximum(value(a, x[left], level), value(a, x[right], level))
        live = np.flatnonzero(here >= top)
        if not len(live):
            continue
        y, best, middle = a[live], here[live], at[live]
        # The run of equal values around a: [lo, hi), found from both sides by halving.
        lo, top_lo = np.zeros(len(y), int), middle.copy()
        while (lo < top_lo).any():
            half = (lo + top_lo) // 2
            reached = value(y, x[np.minimum(half, len(x) - 1)], level) >= best
            lo, top_lo = np.where(reached | (lo >= top_lo), lo, half + 1), np.where(reached, half, top_lo)
        low_hi, hi = middle.copy(), np.full(len(y), len(x))
        while (low_hi < hi).any():
            half = (low_hi + hi) // 2
            reached = value(y, x[np.minimum(half, len(x) - 1)], level) >= best
            low_hi, hi = np.where(reached & (low_hi < hi), half + 1, low_hi), np.where(reached, hi, half)
        found = first_in_runs(order, lo, hi)
        better = (best > top[live]) | (found < who[live])
        top[live[better]], who[live[better]] = best[better], found[better]
    return top, who


def best_by_area(rows: DataFrame, candidates: DataFrame) -> DataFrame:
    """a_area, b_order, value for each distinct a_area of rows: the candidate (b_area, b_support, b_order) of largest value, ties to the first.

    Areas and supports must not be null. Without candidates the result is empty.
    """
    kept = cut(undominated(candidates))
    n = kept.count()
    parts = max(1, min(RANGES, -(-n // A_RANGE)))
    edges = sorted(set(kept.agg(F.percentile_approx("area", [i / parts for i in range(1, parts)], 10_000)).first()[0])) if n and parts > 1 else []
    part = F.lit(0)
    for e in edges:
        part = part + F.when(F.col("area") > e, 1).otherwise(0)
    kept = kept.withColumn("part", part.cast("int"))
    stats = kept.groupBy("part").agg(F.min("area").alias("lo"), F.max("area").alias("hi"), F.max("support").alias("high")).orderBy("part").collect()  # at most RANGES rows
    ids, lo, hi, high = (np.array([r[c] for r in stats], float) for c in ("part", "lo", "hi", "high"))

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 1000):
                a = batch["a_area"].iloc[at : at + 1000].to_numpy(float)[:, None]
                nearest = likeness(a, np.clip(a, lo, hi))
                sure = np.minimum(likeness(a, lo[None]), likeness(a, hi[None]))
                least = (sure * LIKE + high * SUPPORT).max(1, initial=0) - SLACK
                i, j = np.nonzero(nearest * LIKE + high * SUPPORT >= least[:, None])
                yield pd.DataFrame({"a_area": a[i, 0], "part": ids[j].astype(int)})

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"a_area": [], "b_order": [], "value": []})
        top, who = best_in_range(a["a_area"].to_numpy(float), b["area"].to_numpy(float), b["support"].to_numpy(float), b["first"].to_numpy(np.int64))
        return pd.DataFrame({"a_area": a["a_area"].to_numpy(float), "b_order": who, "value": top})

    asked = rows.select("a_area").distinct().mapInPandas(visits, "a_area double, part int")
    found = asked.groupBy("part").cogroup(kept.groupBy("part")).applyInPandas(search, "a_area double, b_order long, value double")
    best = found.groupBy("a_area").agg(F.max_by(F.struct("b_order", "value"), F.struct("value", -F.col("b_order"))).alias("m"))
    return best.select("a_area", "m.b_order", "m.value")


def support(distance: Column, radius: float = 3.0) -> Column:
    return F.coalesce(F.greatest(F.lit(0.0), 1 - distance / radius), F.lit(0.0))
