"""Approximate nearest neighbours by multiprobe p-stable hashing.

Largest inner product becomes smallest distance when vectors are scaled into the unit ball and lifted
to the sphere by one more component. Each of TABLES tables gives a point the bucket of its cells
floor((a x + b) / WIDTH) for some Gaussian directions; their number is the one at which queries of a sample
have the least to do, rows to score and buckets to visit.
For a query the success of a bucket is estimated as the product of the chances that a neighbour at the
expected distance falls into each of its cells. Buckets are visited in descending order of that estimate
until their sum reaches SUCCESS, and only rows of visited buckets are scored. Candidates of all tables
are merged and ranked by the exact inner product of the original vectors in double precision. Products below
that of a query's k-th neighbour within a sample can't be among its k nearest and are left behind.

The visits of all queries meet the buckets that exist in an equi-join. Buckets are gathered in blocks by a hash,
large ones over several blocks by a hash of their rows; a block with very many queries is looked at by
several tasks. What the search costs follows the data: where neighbours are much nearer than other points few
buckets are visited; on vectors without structure about half of the points must be.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TABLES, WIDTH, SUCCESS = 2, 1.2, 0.84
A_VISIT = 256  # a visit of a bucket costs as much as so many rows
TRIED = 32  # queries of the sample on which numbers of hashes are tried
CELLS = 12  # cells of one hash; what lies beyond is counted with the outermost
MOST_HASHES = 15  # four bits of a bucket's key each
SAMPLE = 4096  # vectors looked at to estimate the neighbours' distance
WIDER = 3  # the distance allowed for is that of the k-th neighbour times this in rank, for a sample tells it roughly
DRAWS = 400
BLOCK_BYTES, QUERIES_A_BLOCK = 8 << 20, 1024


def phi(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, by its logistic-polynomial form (error below 1e-3; it only orders buckets)."""
    return 1 / (1 + np.exp(np.clip(-1.5976 * x - 0.070566 * x**3, -60, 60)))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, however small or large."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Tables:
    """The hash functions; equal seeds give equal tables on every node."""

    def __init__(self, dim: int, hashes: int, scale: float, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.scale, self.hashes = scale, hashes
        self.a = rng.standard_normal((TABLES, dim + 1, MOST_HASHES))[:, :, :hashes]
        self.b = rng.uniform(0, WIDTH, (TABLES, MOST_HASHES))[:, :hashes]

    def lifted(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        return np.column_stack([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))])

    def buckets(self, t: int, x: np.ndarray) -> np.ndarray:
        """The key of each point's bucket."""
        c = np.clip(np.floor((self.lifted(x) @ self.a[t] + self.b[t]) / WIDTH).astype(np.int64) + CELLS // 2, 0, CELLS - 1)
        return (c << (4 * np.arange(self.hashes))).sum(1)

    def log_success(self, t: int, q: np.ndarray, near: np.ndarray) -> np.ndarray:
        """(queries, hashes, CELLS): log of the chance that a neighbour of similarity near lies in a cell; q of length 1."""
        q = np.column_stack([q, np.zeros(len(q))])
        mean, sd = near[:, None] * (q @ self.a[t]), np.sqrt(1 - near**2)[:, None]
        edges = (np.arange(CELLS + 1) - CELLS // 2) * WIDTH
        z = (edges[None, None, :] - self.b[t][None, :, None] - mean[:, :, None]) / sd[:, :, None]
        z[:, :, 0], z[:, :, -1] = -40, 40
        return np.log(np.maximum(np.diff(phi(z), axis=2), 1e-9))

    def cut(self, log_p: np.ndarray, seed: int) -> np.ndarray:
        """The estimate at which the buckets visited so far hold SUCCESS of the neighbours; by draws from the cells' chances."""
        rng = np.random.default_rng(seed)
        total = np.cumsum(np.exp(log_p), axis=2)
        out = np.zeros((len(log_p), DRAWS))
        for i in range(self.hashes):
            u = rng.random(DRAWS)[None, :] * total[:, i, -1:]
            cell = (u[:, :, None] > total[:, i, None, :]).sum(2)
            out += np.take_along_axis(log_p[:, i, :], np.minimum(cell, CELLS - 1), 1)
        return np.quantile(out, 1 - SUCCESS, axis=1) - 1e-3

    def visited(self, log_p: np.ndarray, least: float) -> np.ndarray:
        """The keys of all buckets of one query whose estimate is least or more, in descending order of it.

        Cells are chosen hash by hash; a choice is given up once even the best of the other cells can't save it.
        """
        best = np.r_[np.cumsum(log_p.max(1)[::-1])[::-1], 0.0]
        key, sum_ = np.zeros(1, np.int64), np.zeros(1)
        for i in range(self.hashes):
            s = sum_[:, None] + log_p[i][None, :]
            row, cell = np.nonzero(s + best[i + 1] >= least)
            key, sum_ = key[row] | (cell << (4 * i)), s[row, cell]
        return key[np.argsort(-sum_, kind="stable")]


def hashes_for(dim: int, scale: float, sample: np.ndarray, n: int, rank: int) -> int:
    """The number of hashes at which TRIED rows of the sample, as queries among n rows, cost the least."""
    if len(sample) < 2:
        return 1
    q = unit(sample[:TRIED])
    best, out = math.inf, 1
    for hashes in range(1, MOST_HASHES + 1):
        tables = Tables(dim, hashes, scale)
        s = np.column_stack([q, np.zeros(len(q))]) @ tables.lifted(sample).T
        s[np.arange(len(q)), np.arange(len(q))] = -1
        near = nearness(s, rank)
        log_p, keys = tables.log_success(0, q, near), tables.buckets(0, sample)
        cost = 0.0
        for p, cut in zip(log_p, tables.cut(log_p, 0), strict=True):
            seen = tables.visited(p, cut)
            cost += np.isin(keys, seen).mean() * n + A_VISIT * len(seen)
        if cost > 1.5 * best:
            break
        if cost < best:
            best, out = cost, hashes
    return out


def nearness(similarities: np.ndarray, rank: int) -> np.ndarray:
    """The similarity allowed for: that of the neighbour of WIDER times the rank in the sample."""
    at = min(WIDER * rank, similarities.shape[1])
    return np.clip(np.partition(similarities, -at, axis=1)[:, -at], 0.05, 0.995)


@lru_cache(maxsize=8)
def tables_of(dim: int, hashes: int, scale: float) -> Tables:
    return Tables(dim, hashes, scale)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and v, without null ids and without vectors null, empty, zero or holding null or non-finite components."""
    kind = vectors.select(vec_col).schema[0].dataType.simpleString()
    v = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    sound = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))  # a NaN is larger than infinity
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & sound & F.exists("v", lambda x: x != 0))


def length(v: Column) -> Column:
    """The Euclidean norm, however small or large the components are."""
    squares = lambda of: F.sqrt(F.aggregate(of, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    plain, most = squares(v), F.array_max(F.transform(v, F.abs)).cast("double")
    return F.when((plain > 1e-140) & (plain < 1e140), plain).otherwise(most * squares(F.transform(v, lambda x: x / most)))


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_list()).astype(np.float64, copy=False)


def best(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k largest products of each query, of its floor or more, among other ids' rows, ties to smaller ids: place of the query, place of the row, product."""
    s = q @ x.T
    s[q_ids[:, None] == ids[None, :]] = -np.inf
    # The matrix product may differ from the sum below in its last bits; what may still be among the k stays in.
    slack = 4 * q.shape[1] * np.finfo(float).eps * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max(initial=0)
    hit = (s >= (floor - slack)[:, None]) & (s > -np.inf)
    many = np.nonzero(hit.sum(1) > k)[0]
    if len(many):
        hit[many] &= s[many] >= (np.partition(s[many], -k, axis=1)[:, -k] - slack[many])[:, None]
    row, col = np.nonzero(hit)
    exact = (q[row] * x[col]).sum(1)
    order = np.lexsort((ids[col], -exact, row))
    row, col, exact = row[order], col[order], exact[order]
    take = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[take], col[take], exact[take]


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row whose id is divisible by every.

    Candidates are all rows of another id and the same number of components; fewer than k of them give
    fewer rows. Vectors that usable() rejects take no part. Equal scores go to the smaller id. Rows that
    repeat an id are candidates each (a pair of ids is reported once, with its largest score) and one query
    (the smallest vector). An empty table gives no rows.
    """
    rows = usable(vectors, id_col, vec_col)
    norm = F.max(length(F.col("v"))).alias("norm")
    asked = F.count_if(F.col("vec_id") % every == 0).alias("queries")
    kinds = rows.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n"), asked, norm).filter("queries > 0").orderBy("dim").collect()  # one row for each length of vectors
    found = [nearest_of(rows.filter(F.size("v") == r["dim"]), every, k, r["dim"], r["n"], r["queries"], r["norm"]) for r in kinds]
    if not found:
        return rows.limit(0).select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def nearest_of(rows: DataFrame, every: int, k: int, dim: int, n: int, n_queries: int, norm: float) -> DataFrame:
    """nearest() for vectors of one length."""
    rows_a_block = max(256, BLOCK_BYTES // (8 * dim))
    blocks = max(1, -(-n * TABLES // rows_a_block))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded by SAMPLE
    sample = list({r["vec_id"]: r["v"] for r in sample}.items())
    known_ids, raw = np.array([i for i, _ in sample], np.int64), np.array([v for _, v in sample], float).reshape(-1, dim)
    rank = max(1, math.ceil(k * len(sample) / max(n, 1)))
    hashes = hashes_for(dim, norm, raw, n, rank)
    known = tables_of(dim, hashes, norm).lifted(raw)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = tables_of(dim, hashes, norm)
        for part in batches:
            x = stacked(part["v"]) if len(part) else np.zeros((0, dim))
            yield part.assign(buckets=list(np.stack([own.buckets(t, x) for t in range(TABLES)], axis=1)))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each query's visits, and a product that its k-th neighbour reaches at least: that of the k-th in the sample."""
        own = tables_of(dim, hashes, norm)
        for part in batches:
            for at in range(0, len(part), 256):
                ids, v = part["query_id"].iloc[at : at + 256].to_numpy(), stacked(part["q"].iloc[at : at + 256])
                q = unit(v)
                self_ = ids[:, None] == known_ids[None, :]
                s = np.where(self_, -1, np.column_stack([q, np.zeros(len(q))]) @ known.T)
                near = nearness(s, rank)
                if s.shape[1] > k:
                    products = np.where(self_, -np.inf, v @ raw.T)
                    floor = np.partition(products, -k, axis=1)[:, -k]
                    floor = floor - 4 * dim * np.finfo(float).eps * np.linalg.norm(v, axis=1) * norm
                else:
                    floor = np.full(len(ids), -np.inf)
                for t in range(TABLES):
                    log_p = own.log_success(t, q, near)
                    yield pd.DataFrame({"query_id": ids, "floor": floor, "t": t, "buckets": [own.visited(p, c) for p, c in zip(log_p, own.cut(log_p, t), strict=True)]})

    kind = rows.schema["v"].dataType.simpleString()
    placed = materialise(rows.mapInPandas(place, f"vec_id long, v {kind}, buckets array<long>"), "placed")
    asking = rows.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("q"))
    asking = materialise(asking, "queries")
    planned = materialise(asking.mapInPandas(plan, "query_id long, floor double, t int, buckets array<long>"), "visits")
    queries = asking.join(planned.filter("t = 0").select("query_id", "floor"), "query_id")
    sizes = placed.select(F.posexplode("buckets").alias("t", "bucket")).groupBy("t", "bucket").agg(F.ceil(F.count(F.lit(1)) / rows_a_block).cast("int").alias("pieces"))
    sizes = materialise(sizes, "buckets")

    def block(piece: Column) -> Column:
        return F.pmod(F.xxhash64("t", "bucket", piece.cast("int")), F.lit(blocks)).cast("int").alias("block")

    large = sizes.filter("pieces > 1")
    points = placed.select("vec_id", "v", F.posexplode("buckets").alias("t", "bucket")).join(large, ["t", "bucket"], "left")
    points = points.select("t", "bucket", "vec_id", "v", block(F.pmod(F.xxhash64("vec_id", "v"), F.coalesce("pieces", F.lit(1)))))
    visits = planned.select("query_id", "t", F.explode("buckets").alias("bucket")).join(sizes, ["t", "bucket"])
    visits = visits.select("query_id", "t", "bucket", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece")).select("query_id", "t", "bucket", block(F.col("piece")))
    visits = materialise(visits.groupBy("block", "query_id").agg(F.collect_list(F.struct("t", "bucket")).alias("to")), "visits")

    def search(q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        """Bucket by bucket, the queries that visit it and its rows. A query without visits looks at all rows of the first table."""
        got = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if len(q) and len(d):
            key = (d["t"].to_numpy(np.int64) << 60) | d["bucket"].to_numpy(np.int64)
            order = np.argsort(key, kind="stable")
            key, ids, x = key[order], d["vec_id"].to_numpy()[order], stacked(d["v"])[order]
            q_ids, v, floor = q["query_id"].to_numpy(), stacked(q["q"]), q["floor"].to_numpy()
            to = [np.array([(y["t"] << 60) | y["bucket"] for y in z], np.int64) for z in q["to"]]
            who, what = np.repeat(np.arange(len(q)), [len(z) for z in to]), np.concatenate(to)
            turn = np.argsort(what, kind="stable")
            who, what = who[turn], what[turn]
            first = np.nonzero(np.r_[True, what[1:] != what[:-1]])[0] if len(what) else np.zeros(0, np.int64)
            meets = [(who[i:j], np.searchsorted(key, what[i]), np.searchsorted(key, what[i], "right")) for i, j in zip(first, np.r_[first[1:], len(what)][: len(first)], strict=True)]
            everywhere = np.nonzero([not len(z) for z in to])[0]
            meets += [(everywhere[i : i + 256], 0, np.searchsorted(key, 1 << 60)) for i in range(0, len(everywhere), 256)]
            for mine, lo, hi in meets:
                if lo < hi:
                    row, col, score = best(q_ids[mine], v[mine], floor[mine], ids[lo:hi], x[lo:hi], k)
                    got.append((q_ids[mine[row]], ids[lo + col], score))
        row, col, score = (np.concatenate(z) for z in zip(*got, strict=True))
        # A row that several tables found counts once; the best k of the block go on.
        order = np.lexsort((-score, col, row))
        row, col, score = row[order], col[order], score[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (col[1:] != col[:-1])][: len(row)]
        row, col, score = row[new], col[new], score[new]
        order = np.lexsort((col, -score, row))
        row, col, score = row[order], col[order], score[order]
        take = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pd.DataFrame({"query_id": row[take], "vec_id": col[take], "score": score[take]})

    def met(asked: DataFrame) -> DataFrame:
        """asked (block, query_id, to) against the blocks' rows: the k best of each query."""
        tasks = materialise(asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERIES_A_BLOCK).cast("int").alias("tasks")), "tasks")
        left = asked.join(tasks, "block").join(queries, "query_id").withColumn("task", F.pmod(F.xxhash64("query_id"), F.col("tasks")).cast("int"))
        right = points.join(tasks.select("block", F.col("tasks").alias("copies")), "block").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        found = left.groupBy("block", "task").cogroup(right.groupBy("block", "task")).applyInPandas(search, "query_id long, vec_id long, score double")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return materialise(found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "nearest")

    some = met(visits)
    # Queries that found fewer than there may be go on to all rows.
    full = some.groupBy("query_id").count().filter(F.col("count") >= min(k, n - 1)).select("query_id")
    short = materialise(queries.join(full, "query_id", "left_anti").select("query_id"), "short")
    if short.limit(1).count():
        everywhere = short.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "query_id", F.array().cast("array<struct<t:int,bucket:bigint>>").alias("to"))
        some = some.join(full, "query_id", "left_semi").union(met(everywhere))
    return some
