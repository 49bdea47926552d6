"""Quality classifier: regularised quadratic discriminant over transformed document statistics.

Each text is reduced, whole, to a short vector of statistics (lengths, shares of letter case, symbols
and separators, repetition of words and lines). The two classes get a mean and a covariance shrunk
towards the pooled covariance and then towards its diagonal; their Cholesky factors are computed once and
every row is scored by the difference of the two Mahalanobis log densities.
The fit uses sums over all labelled training rows (row count, sums, products), added up in the
cluster: what reaches the driver has the size of the vector squared, whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_back, id_text, materialise

FEATURES = ("log_words", "log_word_len", "upper", "digit", "symbol", "bang", "pipe", "mark", "stop", "unique", "repeat", "top_word", "line_len", "line_repeat", "lower_start", "bracket")
D = len(FEATURES)
BLANK = np.array([32, 9, 10, 11, 12, 13])


def statistics(text: str | None) -> np.ndarray:
    """The vector of a whole text, fixed length; null counts as empty, which has a vector of its own."""
    b = (text or "").encode("utf-8", "replace")
    n = np.bincount(np.frombuffer(b, np.uint8), minlength=256) if b else np.zeros(256, np.int64)
    words = b.split()
    w = max(len(words), 1)
    chars = max(len(b) - int(n[BLANK].sum()), 1)
    seen: dict[bytes, int] = {}
    for x in words:
        seen[x] = seen.get(x, 0) + 1
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = [x for x in b.split(b"\n") if x]
    upper, lower = int(n[65:91].sum()), int(n[97:123].sum())
    share = lambda x, of: np.sqrt(x / of)  # noqa: E731  spreads small shares
    return np.array(
        [
            np.log1p(len(words)), np.log(chars / w), share(upper, max(upper + lower, 1)), share(int(n[48:58].sum()), chars),
            share(int(n[[35, 36, 37, 38, 42, 64, 94, 95, 126]].sum()), chars), share(int(n[33]), w), share(int(n[124]), w), share(int(n[[44, 59, 58, 34, 39]].sum()), w),
            share(int(n[[46, 63]].sum()), w), share(len(seen), w), share(again, w), share(max(seen.values(), default=0), w),
            np.log1p(len(b) / max(len(lines), 1)), share(len(lines) - len(set(lines)), max(len(lines), 1)), share(sum(97 <= x[0] < 123 for x in lines), max(len(lines), 1)), share(int(n[[40, 41, 60, 61, 62, 91, 93, 123, 125]].sum()), chars),
        ]
    )


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and x, the vector of each row's text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            yield pd.DataFrame({"doc_id": part["doc_id"], "x": [statistics(t) for t in part["t"]]})

    src = docs.select(id_text(F.col(id_col)).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return id_back(src.mapInPandas(run, "doc_id string, x array<double>"), "doc_id")


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """From rows (y, x): count, sum and sum of products of each class, added up in the cluster."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for part in batches:
            for y, own in part.groupby("y")["x"]:
                x = np.column_stack([np.ones(len(own)), np.stack(own.to_list())])
                total[int(y)] = total.get(int(y), 0) + x.T @ x
        for y, m in total.items():
            yield pd.DataFrame({"y": y, "k": np.arange(m.size), "v": m.ravel()})

    sums = rows.mapInPandas(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()  # 2 (D + 1)^2 rows at most
    out = {}
    for y in sorted({r.y for r in sums}):
        m = np.zeros((D + 1) ** 2)
        for r in sums:
            if r.y == y:
                m[r.k] = r.v
        m = m.reshape(D + 1, D + 1)
        out[y] = (m[0, 0], m[0, 1:], m[1:, 1:])
    return out


class Discriminant:
    """p(label 1) by log-density differences; constant where a class has no training rows."""

    def __init__(self, sums: dict, pool: float = 0.3, ridge: float = 0.01, temper: float = 0.25):
        """pool: weight of the pooled covariance in each class; ridge: weight of its diagonal; temper: scale of the log odds (statistics are dependent, so raw odds are too sure)."""
        self.fixed, self.temper = None, temper
        n = {y: sums[y][0] for y in (0, 1) if y in sums}
        if len(n) < 2:
            self.fixed = 1.0 if 1 in n else 0.0 if 0 in n else 0.5
            return
        mean = {y: sums[y][1] / n[y] for y in n}
        cov = {y: sums[y][2] / n[y] - np.outer(mean[y], mean[y]) for y in n}
        both = sum(cov[y] * n[y] for y in n) / sum(n.values())
        base = np.diag(np.maximum(np.diag(both), 1e-4))
        self.mean, self.inverse, self.log_det = mean, {}, {}
        for y in n:
            c = (1 - ridge) * ((1 - pool) * cov[y] + pool * both) + ridge * base
            factor = np.linalg.cholesky(c)
            self.inverse[y] = np.linalg.inv(factor)  # of a triangle of D rows
            self.log_det[y] = 2 * np.log(np.diag(factor)).sum()
        self.prior = np.log(n[1] / n[0])

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.fixed is not None:
            return np.full(len(x), self.fixed)
        z = {y: ((x - self.mean[y]) @ self.inverse[y].T) for y in (0, 1)}
        odds = 0.5 * ((z[0] ** 2).sum(1) - (z[1] ** 2).sum(1) + self.log_det[0] - self.log_det[1])
        return 1 / (1 + np.exp(-np.clip(self.temper * odds + self.prior * self.temper, -500, 500)))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4, is 2; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", cut: float = 0.7) -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted (1 if score >= cut, else 0).

    Fitted on all labelled rows that held_out() leaves; labels null or other than 0 and 1, and labels
    without a document, take no part, and a repeated label counts each time. Null text counts as
    empty and is scored. Rows that repeat an id are each scored; with one class only, or without
    labels, the score is constant (1, 0 or 0.5). Only id and text of docs are read.
    """
    x = materialise(features(docs, id_col, text_col), "quality")
    y = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)")
    model = Discriminant(class_sums(x.filter(~held_out(F.col("doc_id"))).join(y, "doc_id").select("y", "x")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            s = model.score(np.stack(part["x"].to_list())) if len(part) else np.zeros(0)
            yield pd.DataFrame({"doc_id": part["doc_id"], "score": s})

    out = id_back(x.withColumn("doc_id", id_text(F.col("doc_id"))).mapInPandas(run, "doc_id string, score double"), "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
